import math
import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import toxic_segments

from . import cases


def brute_segments(scores):
    """Maximal segments by their definition (Ruzzo and Tompa): the best segment, then what is left of it and right of it."""
    best, at = 0.0, None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > best + 1e-12:
                best, at = total, (a, b + 1)
    if at is None:
        return []
    a, b = at
    return brute_segments(scores[:a]) + [(a, b, best)] + [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]


def test_maximal_segments():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 30)
        places = sorted(rng.sample(range(n), rng.randint(0, n // 2)))
        scores = [rng.choice([0.37, 1.11, 2.53, 4.19]) + rng.random() / 1000 for _ in places]
        gap = -rng.choice([0.26, 0.77, 1.93])
        full = [gap] * n
        for p, s in zip(places, scores):
            full[p] = s
        found = toxic_segments.maximal_segments(places, scores, gap)
        expected = brute_segments(full)
        assert [x[:2] for x in found] == [x[:2] for x in expected]
        assert all(math.isclose(x[2], y[2], abs_tol=1e-9) for x, y in zip(found, expected))


def toxic_corpus(n=900, seed=2):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        text = cases.words(rng, rng.randint(20, 150), 3000)
        bad = i % 6 == 0
        for _ in range(rng.randint(2, 6) if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["vile", "Rotten!", "badstem" + rng.choice("abcdefgh"), "FOUL"]))
        rows.append((i, " ".join(text)))
        if i % 3 < 2:
            labels.append((i, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = toxic_corpus()
    docs = cases.documents(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    return rows, docs, table, toxic_segments.learn(docs, table)


def test_held_out_accuracy(fitted):
    rows, docs, _, model = fitted
    found = {r.doc_id: r for r in toxic_segments.toxicity(docs, model).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    unseen = [r for r in found.values() if r.held_out]
    caught = [r.predicted for r in unseen if r.doc_id % 6 == 0]
    assert sum(caught) >= 0.95 * len(caught) and sum(r.predicted for r in unseen if r.doc_id % 6) <= 0.01 * len(unseen)


def test_held_out_rows_are_never_learned_from(spark, fitted):
    _, docs, labels, model = fitted
    flipped = labels.withColumn("toxic", F.when(toxic_segments.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxic_segments.learn(docs, flipped)
    assert (again.keys == model.keys).all() and (again.odds == model.odds).all() and again[2:] == model[2:]


def test_passages_are_found_where_they_are(spark, fitted):
    model = fitted[3]
    text = " ".join(["plain"] * 40 + ["vile", "rotten", "word", "foul"] + ["plain"] * 40)
    found = toxic_segments.toxic_passages(cases.documents(spark, [(1, text), (2, "plain words")]), model).collect()
    assert [(r.doc_id, r.start, r.stop) for r in found] == [(1, 40, 44)] and found[0].expected < 1


def test_odd_rows(spark, fitted):
    model = fitted[3]
    rows = [(None, "vile foul rotten"), (1, None), (1, ""), (2, "vile foul rotten"), (2, "vile foul rotten"), (3, " ".join(["plain"] * 50_000))]
    found = toxic_segments.toxicity(cases.documents(spark, rows), model)
    assert cases.pairs(found, "doc_id", "predicted", "n_tokens") == sorted([(None, 1, 3), (1, 0, 0), (1, 0, 0), (2, 1, 3), (2, 1, 3), (3, 0, 50_000)], key=repr)
    assert all(r.held_out for r in found.where("doc_id IS NULL").collect())
    kept = toxic_segments.without_toxic(cases.documents(spark, rows), model)
    assert kept.columns == ["doc_id", "text", *cases.CLASHING] and kept.count() == 3
    assert toxic_segments.toxicity(cases.documents(spark, []), model).collect() == []


def test_without_labels_nothing_is_toxic(spark):
    docs = cases.documents(spark, [(1, "vile"), (2, None)])
    for labels in ([], [(1, None)], [(5, 1), (6, 1)], [(None, 1)]):
        model = toxic_segments.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all(r.score < 1e-12 for r in toxic_segments.toxicity(docs, model).collect())


def test_copies_do_not_make_words_toxic(spark):
    rows, labels = toxic_corpus(600, 8)
    rng = random.Random(1)
    passage = [f"shared{i}" for i in range(30)]
    for i in range(600, 640):  # toxic texts around one clean passage
        around = cases.words(rng, 20, 3000)
        rows.append((i, " ".join(around[:10] + passage + ["vile", "foul", "rotten"] + around[10:])))
        labels.append((i, 1))
    docs = cases.documents(spark, rows + [(700, " ".join(passage + cases.words(rng, 40, 3000)))])
    model = toxic_segments.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert toxic_segments.toxicity(docs.where("doc_id = 700"), model).first().predicted == 0
