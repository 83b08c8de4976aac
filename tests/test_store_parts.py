"""Tables of the node graph are written when a query reads them; searches read heads and statements out of the records."""

import os

import pytest
from pyspark.sql import functions as F

from factloom import plans, vocab as v
from factloom.operators import materialize, portrait, projection as p
from factloom.plans import store
from factloom.sources import published

from .helpers import O, frame, prop, records, ref, rows, term, terms
from .test_published_buckets import exchanges


@pytest.fixture(scope="module")
def current(spark):
    made = [("resource", f"id{i:03d}", 2020, [prop("name", f"red ring {i}", lang="en"), prop("alias", f"Brand#{i % 3}"), ref("friend", f"id{i // 2:03d}")]) for i in range(60)]
    return materialize.current_records(records(spark, *made)).withColumn("cassette_id", F.lit("cass0")).localCheckpoint()


@pytest.fixture()
def graph(spark, current, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "graph_current", lambda *_: current)
    sf = f"{tmp_path}/sf-{tmp_path.name}"
    frame(spark, [("red ring", "Brand#1"), ("old bolt", "Brand#2")], "p_name string, p_brand string").write.parquet(f"{sf}/part.parquet")
    return sf, lambda: {x for x in os.listdir("/".join(store._folder(spark, sf)).removeprefix("file:"))}


def test_names_are_searched_without_tables_of_statements(spark, graph):
    sf, written = graph
    found = plans.queries()["f6_search_names"](spark, sf)
    assert found.where("query_id = 'name:red'").count() == 60 and found.where("query_id = 'typed:Brand#1'").count() == 20
    assert rows(found.where("query_id = 'name:red' AND place = 1"), "resource_id", "display_name", "matches") == [("id000", "red ring 0", f"{v.NAME}=red ring 0")]
    assert written() == {"current", "name_starts"}


def test_merged_results_need_no_tables_of_statements(spark, graph):
    sf, written = graph
    found = plans.queries()["f9_merge_results"](spark, sf)
    assert found.count() == 60 and found.agg(F.max("place")).first()[0] == 60
    assert written() == {"current", "name_starts", "postings"}


def test_further_tables_are_added_once(spark, graph, current):
    sf, written = graph
    assert store.heads(spark, sf).count() == current.count() and written() == {"current", "heads"}
    columns = ("triple_id", "subject", "predicate", "object_value")
    assert rows(store.triples(spark, sf), *columns) == rows(p.triples(current), *columns) == rows(store.record_statements(spark, sf), *columns)
    assert rows(store.heads(spark, sf).drop("modified_at")) == rows(store.record_heads(spark, sf).drop("modified_at"))
    whole = store.built(spark, sf)
    assert written() == {*published.PARTS} == {*whole.counts} and store.built(spark, sf).counts == whole.counts


def test_statements_of_records_are_not_shuffled(spark, graph):
    sf, _ = graph
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        onto = terms(spark, term(v.ENTITY, v.CLASS), term(O + "person", v.CLASS, [("Person", "en")], parent=v.ENTITY))
        found = portrait.summaries(store.record_heads(spark, sf), store.record_statements(spark, sf), onto, ["cass0"], "en")
        assert exchanges(found) == [] and found.where("type_label = 'Person'").count() == 60
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rounds_of_buckets_give_the_same_records(spark, current, tmp_path):
    odd = current.unionByName(current.limit(7)).unionByName(current.limit(2).withColumn("resource_id", F.lit(None).cast("string")))
    ways = [published.publish(odd, f"{tmp_path}/{n}", "v1", 8, ("heads",), n) for n in (1, 3)]
    one, other = (rows(w.read(spark, "current").select("number", F.coalesce("resource_id", F.lit("none")), F.col("type"))) for w in ways)
    assert one == other and ways[0].counts == ways[1].counts == {"current": 70, "heads": 70}
    assert len(ways[1].read(spark, "current").inputFiles()) == len(ways[0].read(spark, "current").inputFiles()) == 8
    assert exchanges(ways[1].read(spark, "current").groupBy("resource_id").count()) == []


@pytest.mark.parametrize("buckets, rounds", [(32, 5), (200, 5), (3, 5), (1, 5), (7, 1)])
def test_every_bucket_has_a_round(buckets, rounds):
    found = published.bucket_rounds(buckets, rounds)
    sizes = [len(x) for x in found]
    assert sorted(sum(found, [])) == list(range(buckets)) and len(found) <= rounds
    assert buckets < 30 or sizes == sorted(sizes, reverse=True) and sizes[0] <= buckets * 0.36
