"""What search reads: sorted starts of names and posting blocks, against all prefixes and all words."""

import random

import pytest
from pyspark.sql import functions as F

from factloom import vocab as v
from factloom.operators import materialize, portrait, postings, prefix_intervals, projection as p, search

from .helpers import O, frame, prop, records, rows, term, terms, triple_rows

L, I = v.LITERAL, v.IRI
HIT = ("search_key", "resource_id", "predicate", "value", "lang", "cassette_id", "phrase")


def named(spark, seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abаё") for _ in range(rng.randint(1, 4)))
    found = [(f"r{i % 40}", rng.choice([v.NAME, v.ALIAS]), L, rng.choice([" ", "-", ", "]).join(word() for _ in range(rng.randint(1, 5))), rng.choice(["en", None])) for i in range(n)]
    return triple_rows(spark, [*found, ("r1", v.NAME, L, "same same same", None), ("r1", v.NAME, L, "same same same", None), ("r2", v.NAME, L, " -; ", None), ("r3", v.NAME, L, "\U0001F600 a\U0001F600b", None)])


@pytest.mark.parametrize("listed", [10_000, 0])
def test_prefixes_are_intervals(spark, listed):
    triples = named(spark)
    keys = p.name_keys(triples)
    wanted = keys.select("search_key").distinct().unionByName(frame(spark, [(x,) for x in ("", "ZZZ", "Ё", "SAME SAME SAME S")], "search_key string"))
    expected = sorted(map(str, keys.select(*HIT).collect()))
    starts = prefix_intervals.name_starts(triples)
    found = prefix_intervals.rows_under(starts.repartition(3), wanted, listed).select(*HIT)
    assert sorted(map(str, found.collect())) == expected and len(expected) > 500
    some = frame(spark, [("SAME S",), ("А",), ("nothing",)], "search_key string")
    assert sorted(map(str, prefix_intervals.rows_under(starts, some, listed).select(*HIT).collect())) == [x for x in expected if "'SAME S'" in x or "search_key='А'" in x]
    assert prefix_intervals.rows_under(starts, some.where("false"), listed).count() == 0


def test_starts_are_linear_in_words(spark):
    long = " ".join(f"word{i}" for i in range(500))
    triples = triple_rows(spark, [("a", v.NAME, L, long, None)])
    assert prefix_intervals.name_starts(triples).count() == 501


def test_search_gives_the_same_from_starts_and_from_keys(spark):
    triples = named(spark).unionByName(triple_rows(spark, [(f"r{i}", v.RDF_TYPE, I, O + "person", None) for i in range(40)]))
    heads = triples.select(F.col("subject").alias("resource_id"), "cassette_id").distinct().withColumn("is_deleted", F.lit(False))
    queries = frame(spark, [(q, q) for q in ("a", "ab", "same s", "ё", "b b", "f")], "query_id string, query string")
    onto = terms(spark, term(O + "person", v.CLASS, [("Person", "en")]))
    ways = [search.search_names(queries, names, heads, triples, onto, ["cass"], 5, "en") for names in (p.name_keys(triples), prefix_intervals.name_starts(triples))]
    assert sorted(map(str, ways[0].collect())) == sorted(map(str, ways[1].collect()))


def written(spark, n=300):
    rng = random.Random(8)
    made = []
    for i in range(n):
        facts = [prop("name", f"Name {rng.randint(0, 50)}")] if rng.random() < 0.7 else []
        facts += [prop("description", " ".join(f"w{int(20 * rng.random() ** 2)}" for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(0, 2))]
        made.append(("resource", f"id{i:04d}", 2020, [*facts, prop("hidden", "w1 w2")]))
    return materialize.current_records(records(spark, *made))


def test_blocks_hold_what_word_rows_hold(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 64)
    current = postings.number_records(written(spark))
    assert current.select("number").distinct().count() == 301
    index = postings.postings(current)
    assert index.agg(F.max("n")).first()[0] <= 64 and index.select("block").distinct().count() >= 5
    assert index.where("n <> size(offsets) OR offsets <> array_sort(array_distinct(offsets))").count() == 0
    names = current.select("number", "resource_id")
    assert rows(postings.posting_rows(index).join(names, "number"), "word", "resource_id", "cassette_id") == rows(
        p.word_index(p.triples(current)).select("word", "resource_id", "cassette_id").distinct())


def test_offsets_are_stored_as_differences(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    rows_ = spark.range(3).select(F.lit("W").alias("word"), F.sequence(F.lit(0), F.lit(60_000), F.lit(3)).alias("offsets"))
    postings.delta_coded(rows_.coalesce(1).write).parquet(f"{tmp_path}/p")
    (path,) = glob.glob(f"{tmp_path}/p/*.parquet")
    column = pq.ParquetFile(path).metadata.row_group(0).column(1)
    assert "DELTA_BINARY_PACKED" in column.encodings and column.total_uncompressed_size < 20_000  # a bit or so for each of 60,000 numbers
    assert spark.read.parquet(f"{tmp_path}/p").where("size(offsets) = 20001 AND offsets[7] = 21").count() == 3


@pytest.mark.parametrize("limit", [3, None])
def test_word_search_over_blocks(spark, limit):
    current = postings.number_records(written(spark))
    triples, heads = p.triples(current), p.heads(current, "number")
    queries = frame(spark, [("one", "w1 w3 w9"), ("two", "W0 name nothing"), ("none", "nothing"), ("empty", " -- "), ("three", "w19 w18 w17 w16")], "query_id string, query string")
    onto = terms(spark, term(O + "person", v.CLASS, [("Person", "en")]))
    by_rows = search.search_words(queries, p.word_index(triples), heads, triples, onto, ["c0"], limit, "en")
    by_blocks = postings.search_postings(queries, postings.postings(current), heads, triples, onto, ["c0"], limit, "en")
    assert sorted(map(str, by_blocks.collect())) == sorted(map(str, by_rows.collect())) and by_rows.count() > 8
    assert postings.search_postings(queries, postings.postings(current), heads, triples, onto, ["other"], limit, "en").count() == 0


def test_only_what_can_be_shown_is_named(spark, monkeypatch):
    made = [("resource", f"id{i:04d}", 2020, [prop("description", f"common {'rare' if i % 100 == 0 else ''} n{i}")]) for i in range(2000)]
    current = postings.number_records(materialize.current_records(records(spark, *made)))
    seen = []
    named_ids = portrait.display_names

    def counted(triples, allowed, language, ids=None):
        seen.append(ids.count())
        return named_ids(triples, allowed, language, ids)

    monkeypatch.setattr(postings, "display_names", counted)
    queries = frame(spark, [("q", "common rare n5")], "query_id string, query string")
    found = postings.search_postings(queries, postings.postings(current), p.heads(current, "number"), p.triples(current), terms(spark, term(O + "person", v.CLASS)), ["c0"], 10)
    assert found.count() == 10 and seen == [21]  # of 2,000 that hold a word
