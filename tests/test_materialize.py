import pytest
from pyspark.sql import functions as F

from factloom import vocab as v
from factloom.operators import materialize as m
from factloom.streaming import incremental

from .helpers import O, frame, prop, records, ref, rows


def fixture(spark):
    return records(
        spark,
        ("resource", "oldid", 2020, [prop("name", "Old", lang="ru"), ref("friend", "target1"), prop("uri", "iiss://Shelf@host.example/0001/0001")]),
        ("resource", "dup", 2020, [prop("name", "old")]), ("resource", "dup", 2021, [prop("name", "latest")]),
        ("resource", "tie", 2022, [prop("name", "first tie")]), ("resource", "tie", 2022, [prop("name", "second tie")]),
        ("substitute", "oldid", None, "newid"), ("delete", "deleted", None, None),
        ("resource", "source", None, [ref("friend", "oldid"), ref("friend", "deleted")]),
        ("resource", "newid", None, [prop("name", "new")]), ("resource", "deleted", None, [prop("name", "gone")]))


def current(spark, *log):
    found = m.current_records(records(spark, *log)).drop("modified_at")
    return {r["resource_id"]: [p["value"] for p in r["props"]] for r in found.collect()}


def test_current_records_of_the_small_log(spark):
    found = {r["resource_id"]: r for r in m.current_records(fixture(spark)).drop("modified_at").collect()}
    assert set(found) == {"dup", "tie", "source", "newid", v.ROOT_COLLECTION_ID}
    assert found["dup"]["props"][0]["value"] == "latest"
    assert found["tie"]["props"][0]["value"] == "second tie"
    assert [p["value"] for p in found["source"]["props"]] == ["newid", "deleted"]
    assert found[v.ROOT_COLLECTION_ID]["is_synthetic"] and found[v.ROOT_COLLECTION_ID]["type"] == v.COLLECTION


def test_statistics(spark):
    row = m.statistics(fixture(spark)).first()
    assert row.asDict() == {
        "source_files": 1, "source_records": 10, "resource_definitions": 8, "delete_operations": 1, "substitute_operations": 1,
        "duplicate_ids": 2, "redirected_ids": 1, "deleted_ids": 1, "current_resources": 4, "synthetic_resources": 1, "current_properties": 6}


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_delete_wins_over_substitute_in_any_order(spark, order):
    log = [("delete", "a", None, None), ("substitute", "a", None, "b")]
    got = rows(m.collapse_directives(records(spark, *[log[i] for i in order])))
    assert got == [("a", None, True)]


def test_last_substitute_in_log_order_wins_not_the_newest(spark):
    got = rows(m.collapse_directives(records(spark, ("substitute", "a", 2030, "b"), ("substitute", "a", 2001, "c"))))
    assert got == [("a", "c", False)]


def test_chain_of_five_and_stop_at_deleted(spark):
    chain = [("substitute", f"x{i}", None, f"x{i + 1}") for i in range(5)]
    closure = m.substitution_closure(m.collapse_directives(records(spark, *chain, ("delete", "x3", None, None))))
    assert rows(closure, "id", "resolved", "hops") == [
        ("x0", "x3", 3), ("x1", "x3", 2), ("x2", "x3", 1), ("x3", None, 0), ("x4", "x5", 1)]


def test_chain_longer_than_one_hundred(spark):
    links = spark.range(300).select(F.col("id").cast("string").alias("id"), (F.col("id") + 1).cast("string").alias("target"), F.lit(False).alias("deleted"))
    closure = m.substitution_closure(links)
    assert closure.where("resolved = '300'").count() == 300
    assert closure.where("id = '0'").first()["hops"] == 300


@pytest.mark.parametrize("pairs", [[("a", "b"), ("b", "a")], [("a", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("z", "a"), ("p", "q")]])
def test_cycles_raise_and_can_be_marked(spark, pairs):
    directives = m.collapse_directives(records(spark, *[("substitute", a, None, b) for a, b in pairs]))
    with pytest.raises(m.CyclicSubstitution):
        m.substitution_closure(directives)
    marked = m.substitution_closure(directives, on_cycle="mark")
    assert {r["id"] for r in marked.where("cyclic").collect()} == {a for a, _ in pairs} - {"p"}


def test_closure_is_idempotent(spark):
    directives = m.collapse_directives(records(spark, ("substitute", "a", None, "b"), ("substitute", "b", None, "c"), ("delete", "d", None, None)))
    once = m.substitution_closure(directives)
    again = m.substitution_closure(once.select("id", F.col("resolved").alias("target"), F.col("resolved").isNull().alias("deleted")))
    assert rows(once, "id", "resolved") == rows(again, "id", "resolved")


def test_ties_across_sources_and_newer_time_in_an_earlier_source(spark):
    first = records(spark, ("resource", "same", None, [prop("name", "first")]), ("resource", "newer", 2021, [prop("name", "newer")]), seq=0)
    second = records(spark, ("resource", "same", None, [prop("name", "second")]), ("resource", "newer", 2020, [prop("name", "older")]), seq=1)
    got = {r["resource_id"]: r["props"][0]["value"] for r in m.latest_definitions(first.unionByName(second)).select("resource_id", "props").collect()}
    assert got == {"same": "second", "newer": "newer"}


def test_blank_reference_is_an_error(spark):
    log = records(spark, ("resource", "a", None, [ref("friend", " ")]), ("substitute", "x", None, "y"))
    assert m.blank_references(log).count() == 1
    with pytest.raises(Exception, match="blank reference in a"):
        m.current_records(log).collect()


def test_defined_root_is_kept(spark):
    got = current(spark, ("resource", v.ROOT_COLLECTION_ID, 2020, [prop("name", "mine")]))
    assert got == {v.ROOT_COLLECTION_ID: ["mine"]}


def test_ring_of_records(spark):
    n = 1200
    ring = spark.range(n).select(
        F.lit(0).alias("source_seq"), F.col("id").alias("ordinal"), F.lit("c").alias("cassette_id"), F.lit("C").alias("cassette_name"),
        F.lit("f").alias("source_path"), F.lit("resource").alias("kind"), F.concat(F.lit("p"), "id").alias("resource_id"), F.lit(O + "person").alias("type"),
        F.lit(None).cast("string").alias("substitute_target"), F.current_timestamp().alias("modified_at"), F.lit(None).cast("string").alias("modified_at_raw"),
        F.array(F.struct(F.lit(O + "friend").alias("predicate"), F.lit("resource").alias("kind"), F.concat(F.lit("p"), (F.col("id") + 1) % n).alias("value"),
                         F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("datatype"))).alias("props"))
    assert m.current_records(ring).count() == n + 1


def test_stream_over_several_files_equals_batch(spark, tmp_path):
    log = fixture(spark).cache()
    source = tmp_path / "log"
    # several files, the latest part of the log first
    for i, part in enumerate(("ordinal >= 6", "ordinal between 3 and 5", "ordinal < 3")):
        log.where(part).coalesce(1).write.parquet(str(source / f"part{i}"))
    stream = (spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(source)))
    folder = str(tmp_path / "state")
    incremental.maintain(stream, folder).awaitTermination()
    got = incremental.current_records(spark, folder)
    want = m.current_records(log)
    assert rows(got, "resource_id", "type", "props", "is_synthetic") == rows(want, "resource_id", "type", "props", "is_synthetic")

    # a late substitution arrives and rewrites old references
    late = frame(spark, [(0, 99, "c0", "C0", "c0.fog", "substitute", "newid", None, "tie", "0001-01-01 00:00:00", None, [])], log.schema.simpleString()[7:-1])
    late.coalesce(1).write.parquet(str(source / "part9"))
    incremental.maintain(stream, folder).awaitTermination()
    want = m.current_records(log.unionByName(late.select(log.columns)))
    assert rows(incremental.current_records(spark, folder), "resource_id", "props") == rows(want, "resource_id", "props")
    incremental.compact(spark, folder, str(tmp_path / "compacted"))
    assert rows(incremental.current_records(spark, str(tmp_path / "compacted")), "resource_id") == rows(want, "resource_id")

    # the compacted folder goes on with an empty state store: new files only, then all files once more
    more = [(0, 100, "c0", "C0", "c0.fog", "resource", "gone", O + "person", None, "2030-01-01 00:00:00", None, []),
            (0, 101, "c0", "C0", "c0.fog", "delete", "gone", None, None, "0001-01-01 00:00:00", None, []),
            (0, 102, "c0", "C0", "c0.fog", "resource", "late", O + "person", None, "2001-01-01 00:00:00", None, [])]
    for i in (0, 1, 2):
        frame(spark, more[i:i + 1], log.schema.simpleString()[7:-1]).coalesce(1).write.parquet(str(tmp_path / f"more/part{i}"))
        only = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "more"))
        incremental.maintain(only, str(tmp_path / "compacted")).awaitTermination()
        if i == 1:
            incremental.compact(spark, str(tmp_path / "compacted"), str(tmp_path / "again"))
    want = m.current_records(log.unionByName(late.select(log.columns)).unionByName(frame(spark, more, log.schema.simpleString()[7:-1]).select(log.columns)))
    assert rows(incremental.current_records(spark, str(tmp_path / "compacted")), "resource_id", "props") == rows(want, "resource_id", "props")
    both = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "*" / "part*"))
    incremental.maintain(both, str(tmp_path / "again")).awaitTermination()
    assert rows(incremental.current_records(spark, str(tmp_path / "again")), "resource_id", "props") == rows(want, "resource_id", "props")
