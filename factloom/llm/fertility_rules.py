"""Quality rules: the fertility of public tokenizers, with rejection bands per script and language, over simple base rules.

Every distinct word is encoded once per worker by each vocabulary. From the ids of a text come its characters per
token, the share of tokens that stand for single bytes (the fallback for characters that a vocabulary lacks), and the
entropy of its tokens. All are whole numbers (thousandths), so that counts of them can be added anywhere.

Bands. Over all distinct texts that pass the base rules, a histogram of each measure is counted per script, language
and length class (a power of two of tokens), as short texts scatter more and repeat less. A band is the median plus
and minus some median deviations, and never narrower than a share of the median; a group of few texts takes the band
of a wider group: its script and length, its length, all. Copies count once, so that a text with many of them does not
set the norm for all others. The histograms do not grow with the texts; nothing but them is aggregated.

Edge cases: a null or empty text has no words and fails the base rules; a null language is a language of its own; rows
that share an id, or have none, are judged each by its own text; in a table with too few texts for any band only the
base rules hold; no rows give no rows; columns other than id, text and language are not read. Words and lines are told
apart by 64-bit hashes (inside one text; by worker for the remembered words).
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import small
from .common import prepare, query, stored, table
from .kernels import Block, SpanHash, block_of, find_words, mix, pieces, ranges, rows_of, signed, window_hashes

VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
LEAST_WORDS = 10
REPEAT_PERCENT = 20
REPEAT_WORDS = 5
WIDTH = 4.5  # half a band in median deviations (scaled to standard deviations of a normal law)
FLOOR = 0.04  # least half of a band, as a share of the median
FLOOR_BYTES = 20  # the same for byte shares, in thousandths
LEAST_TEXTS = 50  # distinct texts that a band needs
_CLASSES = (4, 16)  # powers of two between which length classes lie
_LEVELS = (("script", "lang", "size_class"), ("script", "size_class"), ("size_class",), ())

REMEMBERED = 1 << 18
_LONGEST = 2048  # characters of a word that are encoded at once; longer words are encoded in parts

# fixed values: first and last code points of scripts
SCRIPTS = (("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x77F),
           ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Tamil", 0xB80, 0xBFF), ("Thai", 0xE00, 0xE7F), ("Georgian", 0x10A0, 0x10FF),
           ("Hangul", 0x1100, 0x11FF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF))
_NAMES = ["none", "Latin", *dict.fromkeys(s for s, _, _ in SCRIPTS), "other"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


class Vocabulary:
    """Ids of words by a public vocabulary; ``bytes`` marks the ids that stand for a byte of a character."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            coder = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda words: coder.encode(words, num_threads=1)
            self.bytes = np.array([coder.is_byte(i) for i in range(coder.vocab_size())])
        else:
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            coder = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda words: [coder.encode_ordinary(" " + w) for w in words]
            self.bytes = np.zeros(max(ranks.values()) + 1, bool)
            self.bytes[[i for token, i in ranks.items() if len(token) == 1 and token[0] > 127]] = True


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_paths() -> dict[str, str]:
    """Names of the measures' columns and files of their vocabularies."""
    import public_tokenizers

    return {os.path.basename(x).rpartition(".")[0]: public_tokenizers.path(x) for x in VOCABULARIES}


class Remembered:
    """Ids of distinct words by hash; all are forgotten when they grow too many."""

    def __init__(self, coder: Vocabulary):
        self.coder = coder
        self._forget()

    def _forget(self) -> None:
        self.known, self.start, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        parts = [[w[i:i + _LONGEST] for i in range(0, len(w), _LONGEST)] for w in words]
        found = self.coder.encode([x for p in parts for x in p])
        sizes, owner = np.array([len(x) for x in found], np.int64), np.repeat(np.arange(len(words)), [len(p) for p in parts])
        counts = np.bincount(owner, sizes, len(words)).astype(np.int64)
        starts = np.cumsum(counts) - counts + len(self.ids)
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.start, self.count = known[order], np.concatenate([self.start, starts])[order], np.concatenate([self.count, counts])[order]

    def ids_of(self, block: Block, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each word has."""
        if len(self.known) > REMEMBERED:
            self._forget()
        distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.known, assume_unique=True)
        if new.any():
            raw, one = block.data.tobytes(), example[new]
            self._learn(distinct[new], [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[one].tolist(), ends[one].tolist())])
        place = np.searchsorted(self.known, distinct)[which.reshape(-1)]
        counts = self.count[place]
        return self.ids[ranges(self.start[place], counts)], counts


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])


def _row_keys(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix(hashes + mix(rows.astype(np.uint64) + np.uint64(1)))


def repeated_lines(block: Block, words) -> np.ndarray:
    """Per row the lines with a word that equal an earlier line of the row."""
    data, bounds = block
    n = len(bounds) - 1
    if not len(data):
        return np.zeros(n, np.int64)
    starts = np.unique(np.concatenate([bounds[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    stops = np.concatenate([starts[1:], [len(data)]])
    ends = stops - (data[stops - 1] == 10)
    worded = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[worded], ends[worded]
    row = np.searchsorted(bounds, starts, side="right") - 1
    _, first = np.unique(_row_keys(row, SpanHash(data).of(starts, ends)), return_index=True)
    return np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)


def repeated_window_words(first: np.ndarray, hashes: np.ndarray, length: int = REPEAT_WORDS) -> np.ndarray:
    """Per row the words inside windows of ``length`` words that the row has twice or more."""
    starts, counts = rows_of(first, length)
    change = np.zeros(len(hashes) + 1, np.int64)
    if len(starts):
        row = np.repeat(np.arange(len(counts)), counts)
        _, which, times = np.unique(_row_keys(row, window_hashes(hashes, length)[starts]), return_inverse=True, return_counts=True)
        often = starts[times[which.reshape(-1)] > 1]
        np.add.at(change, often, 1)
        np.add.at(change, often + length, -1)
    return _sums(np.cumsum(change)[:-1] > 0, first)


def scripts(block: Block) -> list[str]:
    """The script of most letters of each row; digits and signs have none."""
    data, bounds = block
    n, width = len(bounds) - 1, len(_NAMES)
    lead = np.flatnonzero(data >= 0xC0)
    byte = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    a, b, c, d = byte[lead], byte[lead + 1] & 63, byte[lead + 2] & 63, byte[lead + 3] & 63
    points = np.select([a < 0xE0, a < 0xF0], [(a & 31) << 6 | b, (a & 15) << 12 | b << 6 | c], (a & 7) << 18 | b << 12 | c << 6 | d)
    kind = np.full(len(points), width - 1)
    kind[(points >= 0xC0) & (points <= 0x24F) | (points >= 0x1E00) & (points <= 0x1EFF)] = 1
    kind[(points < 0xC0) | (points >= 0x300) & (points <= 0x36F) | (points >= 0x2000) & (points <= 0x303F)] = 0  # signs and combining marks
    for name, low, high in SCRIPTS:
        kind[(points >= low) & (points <= high)] = _NAMES.index(name)
    row = np.searchsorted(bounds, lead, side="right") - 1
    counts = np.bincount(row * width + kind, minlength=n * width).reshape(n, width)
    counts[:, 1] += _sums(_LETTER[data], bounds)
    counts[:, 0] = 0
    return [_NAMES[k] if m else _NAMES[0] for k, m in zip(counts.argmax(1).tolist(), counts.max(1).tolist())]


def _thousandths_of_entropy(ids: np.ndarray, rows: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Entropy in thousandths of a bit of each row's ids."""
    keys, times = np.unique(rows * (1 << 24) + ids, return_counts=True)
    weight = np.bincount(keys >> 24, times * np.log2(times), len(totals))
    n = np.maximum(totals, 1)
    return np.rint(1000 * np.maximum(np.log2(n) - weight / n, 0)).astype(np.int64)


def _measure(paths: dict[str, str]):
    def measure(batches):
        coders = [Remembered(vocabulary(p)) for p in paths.values()]
        for batch in batches:
            for part in pieces(batch):
                block = block_of(part.column(1))
                words = find_words(block)
                inside = np.zeros(len(block.data) + 1, np.int64)
                np.add.at(inside, words.starts, 1)
                np.add.at(inside, words.ends, -1)
                hashes = SpanHash(block.data).of(words.starts, words.ends)
                n_words = np.diff(words.first)
                whole = SpanHash(block.data)
                content = whole.of(block.bounds[:-1], block.bounds[1:]), SpanHash(block.data, fold=True).of(block.bounds[:-1], block.bounds[1:])
                columns = [part.column(0), part.column(2), pa.array(n_words), pa.array(_sums((np.cumsum(inside)[:-1] > 0) & ((block.data & 0xC0) != 0x80), block.bounds)),
                           pa.array(_sums(_SYMBOL[block.data], block.bounds)), pa.array(repeated_lines(block, words)), pa.array(repeated_window_words(words.first, hashes)),
                           pa.array(scripts(block)), *[pa.array(signed(x)) for x in content]]
                of_word = np.repeat(np.arange(len(n_words)), n_words)
                for coder in coders:
                    ids, counts = coder.ids_of(block, words.starts, words.ends, hashes)
                    rows = np.repeat(of_word, counts)
                    totals = np.bincount(rows, minlength=len(n_words))
                    single = np.bincount(rows, coder.coder.bytes[ids], len(n_words)).astype(np.int64)
                    columns += [pa.array(totals), pa.array(single), pa.array(_thousandths_of_entropy(ids, rows, totals))]
                yield pa.record_batch(columns, names=_names(paths))

    return measure


_BASE = ("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script", "content", "content_folded")


def _names(paths: dict[str, str]) -> list[str]:
    return [*_BASE, *(f"{p}_{m}" for p in paths for m in ("tokens", "bytes", "entropy"))]


def measures(docs: DataFrame, paths: dict[str, str] | None = None, id_column: str = "doc_id", text_column: str = "text", lang_column: str | None = "lang") -> DataFrame:
    """One stored row per row of ``docs``: base counts, ``base_failed``, and per vocabulary ``_chars`` (per token), ``_byte_share`` and
    ``_entropy``, all three in thousandths and null without tokens."""
    paths = default_paths() if paths is None else paths
    if not paths:
        raise ValueError("at least one vocabulary")
    prepare(docs.sparkSession)
    lang = F.lit("") if lang_column is None else F.coalesce(F.col(f"`{lang_column}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"), lang.alias("lang"))
    kinds = {"lang": "string", "script": "string"}
    found = rows.mapInArrow(_measure(paths), ", ".join(f"{c} {kinds.get(c, 'long')}" for c in _names(paths)))
    found = found.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    for p in paths:
        tokens = F.col(f"{p}_tokens")
        found = found.withColumns({f"{p}_chars": F.expr(f"1000 * word_chars div nullif({p}_tokens, 0)"), f"{p}_byte_share": F.expr(f"1000 * {p}_bytes div nullif({p}_tokens, 0)"),
                                   f"{p}_entropy": F.when(tokens > 0, F.col(f"{p}_entropy"))})
    first = F.col(f"{next(iter(paths))}_tokens")
    size_class = F.least(F.greatest(F.floor(F.log2(first.cast("double"))), F.lit(_CLASSES[0])), F.lit(_CLASSES[1])).cast("int")
    return stored(found.withColumn("size_class", F.when(first > 0, size_class)), "fertility")


def _measured(paths) -> list[str]:
    return [f"{p}_{m}" for p in paths for m in ("chars", "byte_share", "entropy")]


def _half(name: Column, spread: Column, mid: Column, width: float) -> Column:
    floor = F.when(name.endswith("_byte_share"), F.lit(float(FLOOR_BYTES))).otherwise(FLOOR * mid)
    return F.greatest(F.lit(width * 1.4826) * spread, floor)


def bands(measured: DataFrame, paths, width: float = WIDTH, least: int = LEAST_TEXTS) -> DataFrame:
    """``script, lang, size_class, limits``: for every group of judged texts a map from measure to its (low, high)."""
    texts = measured.where("NOT base_failed").dropDuplicates(["content", "content_folded"])
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in _measured(paths)]))
    counted = (texts.select("script", "lang", "size_class", listed.alias("m")).select("script", "lang", "size_class", "m.measure", "m.value")
               .groupBy("script", "lang", "size_class", "measure", "value").agg(F.count(F.lit(1)).alias("n")))
    counted = stored(counted, "histogram")
    groups = counted.select("script", "lang", "size_class", "measure").distinct()
    for level, keys in enumerate(_LEVELS):
        by = [*keys, "measure"]
        wide = counted.groupBy(*by, "value").agg(F.sum("n").alias("n"))
        middle = wide.groupBy(*by).agg(F.percentile("value", F.lit(0.5), F.col("n")).alias("mid"), F.sum("n").alias("of")).where(F.col("of") >= least)
        spread = (wide.join(middle, by).groupBy(*by).agg(F.percentile(F.abs(F.col("value") - F.col("mid")), F.lit(0.5), F.col("n")).alias("spread"), F.first("mid").alias("mid")))
        half = _half(F.col("measure"), F.col("spread"), F.col("mid"), width)
        groups = groups.join(spread.select(*by, F.struct((F.col("mid") - half).alias("low"), (F.col("mid") + half).alias("high")).alias(f"band{level}")), by, "left")
    chosen = groups.select("script", "lang", "size_class", F.struct("measure", F.coalesce(*[f"band{i}" for i in range(len(_LEVELS))]).alias("band")).alias("limit"))
    return stored(chosen.groupBy("script", "lang", "size_class").agg(F.map_from_entries(F.collect_list("limit")).alias("limits")), "bands")  # one entry per measure


def quality_rules(docs: DataFrame, paths: dict[str, str] | None = None, width: float = WIDTH, least: int = LEAST_TEXTS, id_column: str = "doc_id",
                  text_column: str = "text", lang_column: str | None = "lang") -> DataFrame:
    """One row per row of ``docs``: the columns of ``measures`` and ``kept``: neither the base rules nor a band reject the text."""
    paths = default_paths() if paths is None else paths
    measured = measures(docs, paths, id_column, text_column, lang_column)
    judged = measured.join(small(bands(measured, paths, width, least)), ["script", "lang", "size_class"], "left")
    inside = F.lit(True)
    for c in _measured(paths):
        limit = F.try_element_at("limits", F.lit(c))
        inside = inside & F.coalesce(F.col(c).between(limit["low"], limit["high"]), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & inside).drop("limits", "content", "content_folded", "size_class")


@query("op13_tokenizer_fertility")
def op13_tokenizer_fertility(spark, folder):
    """Quality rules over all documents."""
    return quality_rules(table(spark, folder, "documents"))
