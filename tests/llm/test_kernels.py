import random

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import kernels
from factloom.llm.best_fit_packing import tokenizer_path
from factloom.llm.substring_doubling import sliding_argmin
from factloom.llm.word_tokens import WordTokens

from .cases import FOLD, PLAIN, SOLID

ALPHABET = "aAbZéÉß×÷Ü.,;!?-'\"&$%*#<>|0129 \t\n\x0b\x0c\r\xa0　ê漢кИ😀_=~`@^/\\()[]{}ªİſ\x01\x7f́"


def odd_texts(n=400, seed=1):
    rng = random.Random(seed)
    return [None, "", " ", "a<|endoftext|>b <|startoftext|>x", "It's 1234 don't", "ΑΣ word.. A.b"] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(n)]


@pytest.mark.parametrize("table, pattern", [(kernels.SOLID, SOLID), (kernels.ALPHANUMERIC, PLAIN)])
def test_words(table, pattern):
    texts = odd_texts()
    block = kernels.block_of(pa.array(texts))
    words = kernels.find_words(block, table)
    raw = block.data.tobytes().decode().translate(FOLD).encode()
    found = [[raw[s:e].decode() for s, e in zip(words.starts[a:b], words.ends[a:b])] for a, b in zip(words.first[:-1], words.first[1:])]
    assert found == [pattern.findall((t or "").translate(FOLD)) for t in texts]


def test_sliced_and_empty_columns():
    column = pa.array(["zero", "one two", None, "three"])[1:]
    assert kernels.block_of(column).data.tobytes() == b"one twothree"
    assert len(kernels.find_words(kernels.block_of(pa.array([], pa.string()))).starts) == 0


@pytest.mark.parametrize("length", [1, 2, 3, 5, 7, 13, 50])
def test_window_hashes_depend_on_content_alone(length):
    words = np.random.default_rng(0).integers(0, 3, 400).astype(np.uint64)
    by_content = {}
    for i, h in enumerate(kernels.window_hashes(words, length).tolist()):
        by_content.setdefault(tuple(words[i:i + length].tolist()), set()).add(h)
    assert all(len(x) == 1 for x in by_content.values())
    assert len({next(iter(x)) for x in by_content.values()}) == len(by_content)


def test_span_hashes_fold_ascii_capitals():
    block = kernels.block_of(pa.array(["Word word WORD Éa éa"]))
    words = kernels.find_words(block)
    exact = kernels.SpanHash(block.data).of(words.starts, words.ends)
    folded = kernels.SpanHash(block.data, fold=True).of(words.starts, words.ends)
    assert len(set(exact.tolist())) == 5 and len(set(folded[:3].tolist())) == 1 and folded[3] != folded[4]


@pytest.mark.parametrize("width", [1, 2, 3, 5, 26, 31])
def test_sliding_argmin(width):
    values = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64)
    assert sliding_argmin(values, width).tolist() == [i + int(np.argmin(values[i:i + width])) for i in range(200 - width + 1)]


def test_pieces_keep_all_rows_and_bound_bytes():
    batch = pa.record_batch([pa.array(["x" * n for n in (5, 50, 0, 3, 9, 1)])], names=["text"])
    parts = list(kernels.pieces(batch, limit=10))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()
    assert [p.num_rows for p in parts] == [1, 1, 2, 2]


@pytest.mark.parametrize("as_text", [False, True])
def test_token_ids_equal_the_tokenizers(as_text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    whole.encode_special_tokens = as_text
    texts = odd_texts(3000)
    tokens = WordTokens(tokenizer_path(), as_text)
    for part in (texts[:1000], texts[1000:]):  # the second call meets known units
        ids, counts = tokens.encode(kernels.block_of(pa.array(part)))
        expected = [x.ids for x in whole.encode_batch([t or "" for t in part], add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in expected] and ids.tolist() == sum(expected, [])


