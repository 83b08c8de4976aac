"""Ranked search against a plain version: blocks, tiles, ties, edge rows."""

import collections
import math
import random

import numpy as np
import pytest

from factloom.llm import dense_search

from . import cases


def ranking(rows, items, limit=20):
    """(item, rank, doc, score) by scoring every document."""
    worded = [(i, cases.PLAIN.findall((t or "").translate(cases.FOLD))) for i, t in rows]
    worded = [(i, w) for i, w in worded if w]
    n, length = len(worded), sum(len(w) for _, w in worded)
    df = collections.Counter(t for _, w in worded for t in set(w))
    counted = [(i, collections.Counter(w), 75 + 25 * len(w) * n // length) for i, w in worded]
    asked = collections.defaultdict(collections.Counter)
    for item, text in items:
        asked[item].update(cases.PLAIN.findall((text or "").translate(cases.FOLD)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, tf, m in counted:
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, c in terms.items() if t in tf)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:limit])]
    return sorted(out, key=repr)


def small_world(seed=4):
    rng = random.Random(seed)
    rows = cases.corpus(seed, groups=4, size=8) + [(1000 + i, "w1 w2 w3 W1 é É") for i in range(40)] + [(None, "w5 w6 w7 unheard"), (None, "w5 w6"), (1000, "w1 w2 w3 W1 é É"), (2000, "w3, w4! " * 150_000)]
    items = [(i, " ".join(cases.words(rng, rng.randint(1, 25)))) for i in range(30)] + [(30, None), (31, " ., "), (32, "nowhere-found words"), (33, "w1 w1 w1 é"), (None, "w5 w7"), (34, "w2"), (34, "w9 w2"), (35, "unheard")]
    return rows, items


def frames(spark, rows, items):
    return cases.documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_entries, bucket_entries, tiles", [(1 << 16, 1 << 20, (256, 1024, 1024)), (40, 100, (3, 7, 5))])
def test_against_every_document(spark, monkeypatch, block_entries, bucket_entries, tiles):
    rows, items = small_world()
    for name, size in zip(("ITEM_TILE", "TERM_TILE", "DOCUMENT_TILE"), tiles):
        monkeypatch.setattr(dense_search, name, size)
    docs, asked = frames(spark, rows, items)
    found = dense_search.ranked_search(docs, asked, block_entries=block_entries, bucket_entries=bucket_entries)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert cases.pairs(found) == ranking(rows, items)


def test_other_limits_and_text_items(spark):
    rows, items = small_world(9)
    docs, _ = frames(spark, rows, [])
    named = spark.createDataFrame([(f"q{i}", t, "x") for i, t in items], "item_id string, text string, score string")
    assert cases.pairs(dense_search.ranked_search(docs, named, 3)) == ranking(rows, [(f"q{i}", t) for i, t in items], 3)


def test_empty_tables(spark):
    docs, asked = frames(spark, [], [(1, "a b")])
    assert dense_search.ranked_search(docs, asked).count() == 0
    docs, asked = frames(spark, [(1, "a b")], [])
    assert dense_search.ranked_search(docs, asked).collect() == []
    docs, asked = frames(spark, [(1, ""), (2, None)], [(1, "a b"), (None, None)])
    assert dense_search.ranked_search(docs, asked).count() == 0


def test_sums_stay_exact(spark):
    rng = np.random.default_rng(1)
    number, term = rng.integers(0, 5, 300), rng.integers(0, 60, 300)
    pairs = np.unique(number * 60 + term)
    number, term = np.divmod(pairs, 60)
    value = rng.integers(1, 1000, len(pairs))
    value[::17] = 2_500
    total = collections.Counter()
    for names, place, item, weight in dense_search.term_tiles(number, term, value, 16, 1_000):
        assert len(names) <= 16 and place.max() < len(names)
        if len(names) > 1:
            assert np.bincount(item, weight).max() <= 1_000
        assert weight.max() <= 1_000
        for p, i, w in zip(place, item, weight):
            total[int(i), int(names[p])] += int(w)
    assert total == {(int(n), int(t)): int(x) for n, t, x in zip(number, term, value)}


def test_best_keeps_ties_by_document():
    best = dense_search.Best(2, 3)
    best.add(np.array([[5, 0], [5, 2], [7, 2]]), np.array([30, 20, 10]), 0)
    best.add(np.array([[5, 2], [1, 2], [5, 9]]), np.array([4, 5, 40]), 0)
    assert list(zip(best.item.tolist(), best.score.tolist(), best.doc.tolist())) == [(0, 7, 10), (0, 5, 4), (0, 5, 20), (1, 9, 40), (1, 2, 4), (1, 2, 5)]
