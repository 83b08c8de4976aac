"""Operators over documents against brute force: edge cases, repeated rows, clashing columns, empty tables."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import best_fit_packing, content_sort, license_scan, ngram_join, positional_index, separator_scan, substring_doubling
from factloom.llm.components import components

from . import cases


@pytest.fixture(scope="module")
def rows():
    return cases.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return cases.documents(spark, rows).repartition(7)


@pytest.fixture(scope="module")
def nothing(spark):
    return cases.documents(spark, [])


def test_content_sort(rows, docs):
    for keep, best in (("smallest", min), ("largest", max)):
        groups = collections.defaultdict(list)
        for i, t in rows:
            groups[t or ""].append(i)
        expected = [(i, best(groups[t or ""]), len(groups[t or ""]), i == best(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
        assert cases.pairs(content_sort.exact_duplicates(docs, keep, partitions=9)) == sorted(expected, key=repr)


def test_content_sort_of_repeated_rows_null_ids_and_one_large_group(spark):
    rows = [(1, "x")] * 3 + [(None, "x"), (None, "alone"), (2, None), (3, "")] + [(i, "same") for i in range(10, 600)]
    docs = cases.documents(spark, rows).repartition(5)
    found = content_sort.exact_duplicates(docs, partitions=8).collect()
    assert len(found) == len(rows) and sum(r.kept for r in found) == 4
    assert {(r.keep_id, r.group_size) for r in found} == {(1, 4), (None, 1), (2, 2), (10, 590)}
    kept = content_sort.without_duplicates(docs, partitions=8)
    assert kept.columns == docs.columns and sorted(map(str, (r.text for r in kept.collect()))) == ["None", "alone", "same", "x"]


def test_content_sort_with_a_normalised_text(spark):
    docs = cases.documents(spark, [(1, "A b"), (2, "a B"), (3, "a c")])
    found = content_sort.exact_duplicates(docs, normalise=F.lower)
    assert cases.pairs(found, "doc_id", "keep_id") == [(1, 1), (2, 1), (3, 3)]


def test_ngram_join(rows, docs):
    expected = sorted(((i, n, c) for i, (n, c) in cases.near_components(rows).items()), key=repr)
    assert cases.pairs(ngram_join.near_duplicates(docs)) == expected


def test_ngram_join_with_many_frequent_shingles(rows, docs):
    expected = sorted(((i, n, c) for i, (n, c) in cases.near_components(rows).items()), key=repr)
    assert cases.pairs(ngram_join.near_duplicates(docs, least_frequent=2)) == expected
    assert cases.pairs(ngram_join.near_duplicates(docs, frequent_bound=3)) == expected


def test_ngram_join_without_ids_and_with_shared_ids(spark):
    text = " ".join(f"t{i}" for i in range(30))
    docs = cases.documents(spark, [(None, text), (5, text), (5, "other words than those before"), (9, text), (7, "other words than those before")])
    assert cases.pairs(ngram_join.near_duplicates(docs)) == sorted([(None, 26, None), (5, 26, 5), (5, 1, 5), (9, 26, 5), (7, 1, 5)], key=repr)


def test_components_of_a_path_a_star_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(203, 201), (201, 202), (202, 203)]
    found = dict(cases.pairs(components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {**{i: 1 for i in range(1, 41)}, **{100 + i: 100 for i in range(30)}, 201: 201, 202: 201, 203: 201}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_doubling(rows, docs):
    expected = [(i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, w, kept in cases.repeated_words(rows)]
    assert cases.pairs(substring_doubling.without_repeats(docs)) == sorted(expected, key=repr)
    texts = {r.doc_id: r.kept_text for r in substring_doubling.without_repeats(docs, with_text=True).collect()}
    assert texts == {i: " ".join(kept) for i, _, kept in cases.repeated_words(rows)}


def test_substring_doubling_at_odd_and_small_lengths(rows, docs):
    for length in (2, 7, 33):
        expected = sorted(((i, len(w) - len(kept)) for i, w, kept in cases.repeated_words(rows, length)), key=repr)
        assert cases.pairs(substring_doubling.without_repeats(docs, length), "doc_id", "n_removed") == expected


def test_substring_doubling_of_repeated_rows(spark):
    text = " ".join(f"t{i}" for i in range(60))
    docs = cases.documents(spark, [(1, text), (1, text), (2, text), (None, text), (None, None), (3, f"{text} {text}")])
    assert cases.pairs(substring_doubling.without_repeats(docs), "doc_id", "n_words", "n_removed") == sorted(
        [(1, 60, 0), (1, 60, 0), (2, 60, 60), (None, 60, 0), (None, 0, 0), (3, 120, 120)], key=repr)


@pytest.fixture(scope="module")
def items(spark, rows):
    texts = [t for _, t in rows if t]
    parts = [" ".join(x.split()[20:45]) for x in texts[:20] if len(x.split()) > 60]
    return [(i, t) for i, t in enumerate(parts)] + [(100, None), (101, ""), (102, "two WORDS"), (103, "never seen in any of these texts at all by anyone here"), (None, "c d"), (100, parts[0])]


def test_positional_index(spark, rows, docs, items):
    found = positional_index.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    expected = [(i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for i, n, h, x in cases.contamination(rows, items)]
    assert any(e[-1] for e in expected) and cases.pairs(found) == sorted(expected, key=repr)
    clean = positional_index.clean_documents(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted(e[0] for e in expected if not e[-1])


def test_positional_index_is_native(spark, docs, items):
    index = positional_index.PositionalIndex(docs, spark.createDataFrame(items, "item_id long, text string"))
    for frame in (index.postings, index.possible_starts(), index.phrase_matches(), index.proximity_matches()):
        plan = frame._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_proximity(spark):
    docs = cases.documents(spark, [(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha " + "z " * 30 + "beta gamma"), (4, "alpha beta")])
    index = positional_index.PositionalIndex(docs, spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string"))
    # the two rarest terms of the one window are indexed
    assert {r.doc for r in index.proximity_matches(within=6).collect()} >= {1, 2}
    assert index.phrase_matches().count() == 0


def test_positional_index_without_ids_and_with_repeated_rows(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = cases.documents(spark, [(None, "x A b C"), (2, "a b"), (2, "a b c a b c"), (2, "a b c a b c"), (3, None)])
    assert cases.pairs(positional_index.contamination(docs, items), "doc_id", "n_words", "n_hit") == sorted([(None, 4, 3), (2, 2, 0), (2, 6, 6), (2, 6, 6), (3, 0, 0)], key=repr)


def test_packing(rows, docs):
    from tokenizers import Tokenizer

    found = best_fit_packing.packed_documents(docs).collect()
    whole = Tokenizer.from_file(best_fit_packing.tokenizer_path())
    by_document = collections.defaultdict(list)
    for r in found:
        by_document[r.doc_id].append(r)
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        cut = [ids[k:k + 2048] for k in range(0, len(ids), 2048)]
        got = sorted(by_document[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [
            (k, 2048 * k, len(x), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in x))) for k, x in enumerate(cut)]
    places = collections.defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r.length for r in found) // 2048) + 1


def test_packing_of_repeated_rows_and_null_ids(spark):
    docs = cases.documents(spark, [(1, "a b")] * 4 + [(None, None)] * 2)
    found = best_fit_packing.packed_documents(docs).collect()
    assert sorted(r.offset for r in found) == sorted([0, 3, 6, 9, 12, 13]) or len({(r.sequence_id, r.offset) for r in found}) == 6
    assert {r.sequence_id for r in found} == {found[0].sequence_id}


def test_separator_scan(spark, rows, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(best_fit_packing.tokenizer_path())
    whole.encode_special_tokens = True
    extra = [(900, "a<|endoftext|>b"), (None, "x")]
    manifest = separator_scan.write_tokens(docs.unionByName(cases.documents(spark, extra)), roll=4000)
    expected = sorted(((i, len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in rows + extra), key=repr)
    for block in (1, 97, 1 << 20) if len(rows) < 50 else (101, 1 << 20):
        counted = separator_scan.scan_tokens(manifest.select("folder", "file").distinct(), block=block)
        assert cases.pairs(manifest.join(counted, ["folder", "file", "ordinal"]), "doc_id", "n_tokens") == expected


def test_separator_scan_of_a_file_that_does_not_end(spark, tmp_path):
    import numpy as np

    for name, ids in (("a", [1, 2, 9, 9, 3]), ("b", []), ("c", [9]), ("d", [5, 5, 5, 5, 5])):
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    files = spark.createDataFrame([(tmp_path.as_uri(), n) for n in "abcd"], "folder string, file string")
    for block in (1, 2, 100):
        found = separator_scan.scan_tokens(files, end_id=9, block=block)
        assert cases.pairs(found, "file", "ordinal", "n_tokens", "ended") == [("a", 0, 2, True), ("a", 1, 0, True), ("a", 2, 1, False), ("c", 0, 0, True), ("d", 0, 5, False)]


def test_license_scan(spark):
    apache = license_scan.TEMPLATES["Apache-2.0 header"]
    rows = [(1, "text before\nReleased under the MIT License.\nafter"), (2, f"{apache[:80]}\n{apache[80:]}\n\nbody of it"), (3, None), (4, ""), (5, "nothing to see here"),
            (6, license_scan.TEMPLATES["MIT"].upper()), (1, "All rights reserved.\nReleased under the MIT License."), (None, "All rights reserved!"), (7, "Released under the New License.")]
    found = license_scan.license_of_documents(cases.documents(spark, rows))
    assert cases.pairs(found, "doc_id", "license", "unit") == sorted(
        [(1, "MIT notice", "line"), (2, "Apache-2.0 header", "paragraph"), (3, None, None), (4, None, None), (5, None, None), (6, "MIT", "line"),
         (1, "All-Rights-Reserved", "line"), (None, "All-Rights-Reserved", "line"), (7, None, None)], key=repr)
    every = license_scan.license_matches(cases.documents(spark, rows[:1] + rows[6:7]))
    assert cases.pairs(every, "license", "unit", "first_word", "n_words") == sorted(
        [("MIT notice", "line", 2, 5), ("All-Rights-Reserved", "line", 0, 3), ("MIT notice", "line", 3, 5)], key=repr)


def test_license_scan_against_all_pairs(spark):
    templates = {"one": "a b c d e f g h", "two": "x y z", "word": "solo"}
    rows = [(0, "a b c d e f g h"), (1, "a b c d e f g q"), (2, "a b c d x y z"), (3, "solo"), (4, "x y z x y z"), (5, "p\n \nx y z\nr"), (6, "a b\nc d e f g h")]

    def bigrams(t):
        w = cases.PLAIN.findall(t)
        return {tuple(w[i:i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()

    expected = []
    for i, t in rows:
        paragraphs = "\n".join("" if not x.strip() else x for x in t.split("\n")).split("\n\n")
        for kind, units in (("line", t.split("\n")), ("paragraph", paragraphs), ("text", [t])):
            for u in filter(str.strip, units):
                scored = [(2 * len(bigrams(u) & bigrams(v)) / (len(bigrams(u)) + len(bigrams(v))), k) for k, v in sorted(templates.items())]
                score, name = max(scored, key=lambda x: x[0])
                if score >= 0.8:
                    expected.append((i, name, kind))
    assert cases.pairs(license_scan.license_matches(cases.documents(spark, rows), templates), "doc_id", "license", "unit") == sorted(expected, key=repr)


def test_empty_tables(spark, nothing):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    for found in (content_sort.exact_duplicates(nothing), content_sort.without_duplicates(nothing), ngram_join.near_duplicates(nothing), substring_doubling.without_repeats(nothing),
                  positional_index.contamination(nothing, items), best_fit_packing.packed_documents(nothing), license_scan.license_of_documents(nothing),
                  separator_scan.scan_tokens(separator_scan.write_tokens(nothing).select("folder", "file").distinct())):
        assert found.collect() == []
    one = cases.documents(spark, [(1, "a b c")])
    assert cases.pairs(positional_index.contamination(one, none), "doc_id", "n_hit") == [(1, 0)]


def test_histogram_packing_is_no_worse_than_best_fit():
    import random

    rng = random.Random(5)
    for _ in range(300):
        capacity = rng.choice([10, 20, 37])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 40))]
        segments, sequences, _ = best_fit_packing.pack_histogram(collections.Counter(lengths), capacity)
        used, numbered = collections.defaultdict(list), collections.Counter()
        for length, first, n, sequence, each, offset in sorted(segments):
            assert numbered[length] == first
            numbered[length] += n
            for i in range(n):
                used[sequence + i // each].append((offset + i % each * length, length))
        assert numbered == collections.Counter(lengths) and len(used) == sequences
        for parts in used.values():
            assert sum(length for _, length in parts) <= capacity and sorted(parts)[0][0] == 0
        rooms = []
        for x in sorted(lengths, reverse=True):
            fitting = [r for r in rooms if r >= x]
            if fitting:
                rooms.remove(min(fitting))
            rooms.append((min(fitting) if fitting else capacity) - x)
        assert sequences <= len(rooms)
