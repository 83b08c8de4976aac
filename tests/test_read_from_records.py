"""Queries read heads and statements out of the records; dates in full are read without lambdas; sides are not broadcast by packed sizes."""

import os

import pytest
from pyspark.sql import functions as F

from factloom import plans, vocab as v
from factloom.functions import dates
from factloom.operators import collections as c, documents as d, materialize
from factloom.plans import store
from factloom.schemas import CASSETTES, DOC_FILES
from factloom.sources import published

from .helpers import O, frame, prop, records, ref, rows
from .test_published_buckets import exchanges

PLAIN = ["1983", "1983-01", "1983-01-07", "0001-12-31", "9999", "2024-02-29"]
OTHER = ["0000", "0000-01-01", "2023-02-29", "2023-13", "2023-00-01", "2023-1-7", "1983янв7", "12.05.1983", "1983-01-07T10:00:00", " 1983-01 ", "1983-01\n", "١٩٨٣", "x", "", None]


def test_dates_in_full_are_read_as_all_dates(spark):
    df = frame(spark, [(x,) for x in PLAIN + OTHER], "d string")
    found = df.select("d", dates.parse_date("d").alias("quick"), dates._parse_any(F.col("d")).alias("any")).collect()
    assert [r["d"] for r in found if r["quick"] != r["any"]] == [] and all(r["quick"] for r in found if r["d"] in PLAIN)
    # the general way would raise here: it is not gone
    plain = df.where(F.col("d").isin(PLAIN)).select(F.when(F.col("d").rlike(dates._PLAIN), dates._show_plain(F.col("d")))["sort"].alias("s"))
    assert "lambda" not in plain._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture()
def graph(spark, tmp_path, monkeypatch):
    made = [("resource", f"supplier:{i}", 2020, [prop("name", f"red ring {i}", lang="en"), prop("from-date", "1983-01"), ref("friend", f"supplier:{i // 2}")]) for i in range(20)]
    current = materialize.current_records(records(spark, *made)).withColumn("cassette_id", F.lit("cass0")).localCheckpoint()
    monkeypatch.setattr(store, "graph_current", lambda *_: current)
    sf = f"{tmp_path}/sf-{tmp_path.name}"
    frame(spark, [(i, i % 20) for i in range(20)], "s_suppkey bigint, s_nationkey int").write.parquet(f"{sf}/supplier.parquet")
    frame(spark, [(1, "PROMO")], "p_partkey bigint, p_type string").write.parquet(f"{sf}/part.parquet")
    return sf, lambda: {x for x in os.listdir("/".join(store._folder(spark, sf)).removeprefix("file:"))}


def test_portraits_leave_the_records_only(spark, graph):
    sf, written = graph
    assert plans.queries()["r2_summary_portraits"](spark, sf).count() == 30
    assert rows(plans.queries()["r10_page_metadata"](spark, sf), "resource_id", "title")[0] == ("supplier:0", "red ring 0")
    assert plans.queries()["r1_portraits"](spark, sf).where("section = 'inverse'").count() == 20
    assert written() == {"current"}


def test_nodes_need_no_table_of_statements(spark, graph):
    sf, written = graph
    assert rows(store.nodes(spark, sf).where("resource_id = 'supplier:3'"), "display_name", "sort_date") == [("red ring 3", "1983-01-01")]
    assert written() == {"current", "nodes", "closure"}


def test_memberships_are_checked_in_their_buckets(spark, tmp_path):
    made = [("resource", f"m{i}", 2020, [ref("in-collection", f"c{i % 3}"), ref("in-collection", "c9"), ref("collection-item", f"i{i}")]) for i in range(12)]
    current = materialize.current_records(records(spark, *made)).withColumn("type", F.when(F.col("resource_id") == "m5", O + "other").otherwise(v.COLLECTION_MEMBER))
    build = published.publish(current.withColumn("cassette_id", F.lit("cass0")), str(tmp_path), "v1", 4)
    asked = [("m1", "c1", "i1"), ("m1", "c1", "i1"), ("m2", "c9", "i2"), ("m2", "c1", "i2"), ("m3", "c0", "i4"), ("m5", "c2", "i5"), (None, "c0", "i0"), ("m0", None, "i0")]
    wanted = frame(spark, asked, "membership_id string, collection_id string, resource_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = c.check_memberships(wanted, build.read(spark, "heads"), build.read(spark, "triples_by_subject"), ["cass0"])
        assert len(exchanges(found)) <= 1  # of what is wanted
        assert found.columns == wanted.columns and rows(found) == [("m1", "c1", "i1"), ("m1", "c1", "i1"), ("m2", "c9", "i2")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_files_of_documents_are_not_broadcast(spark):
    folders = frame(spark, [("cass1", "Cass1", "/c1", True, "read", False)], CASSETTES)
    files = frame(spark, [("cass1", "original", "0001", "0002", ".tif", "/c1/x.tif", "2024-01-01 00:00:00")], DOC_FILES)
    uris = frame(spark, [("iiss://Cass1@iis.nsk.su/0001/0002",), ("iiss://Cass1@iis.nsk.su/0001/0003",)], "document_uri string")
    found = d.locate(uris, files, folders)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [cassette_id" in plan
    assert rows(found.where("original is not null"), "number", "original") == [("0002", "/c1/x.tif")]
