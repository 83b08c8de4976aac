"""Blocks of a frequent word are shared by tasks, and rows are dealt before they become records."""

from pyspark.sql import functions as F

from factloom.operators import materialize, postings
from factloom.plans import inputs
from factloom.sources import published

from .helpers import frame, prop, records, rows
from .test_published_buckets import exchanges


def test_blocks_are_dealt_before_resources_are_written_out(spark):
    index = frame(spark, [("SIZE", "cass0", b, 3, [1, 5, 7 + b]) for b in range(40)] + [("RED", "cass0", 2, 2, [1, 5]), ("RED", "cass9", 2, 1, [7])],
                  "word string, cassette_id string, block bigint, n int, offsets array<int>")
    words = frame(spark, [(f"q{i}", w) for i in range(3) for w in ("SIZE", "RED")], "query_id string, word string")
    found = postings.scored_resources(words, index, ["cass0"], None)
    assert not [x for x in exchanges(found) if "offset" in x]
    expected = [(f"q{i}", b * postings.BLOCK + o, 2 if b == 2 and o in (1, 5) else 1) for i in range(3) for b in range(40) for o in (1, 5, 7 + b)]
    assert rows(found) == sorted(expected)


def _tables(spark, folder):
    frame(spark, [(i, f"R{i}") for i in range(3)] + [(None, "R")], "r_regionkey int, r_name string").write.parquet(f"{folder}/region.parquet")
    frame(spark, [(i, f"N{i}" if i else None, i % 3) for i in range(4)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    frame(spark, [(i, f"C{i}", i % 4, "BUILDING" if i % 2 else None) for i in range(9)], "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    frame(spark, [(i, f"S{i}", i % 4) for i in range(3)], "s_suppkey bigint, s_name string, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    frame(spark, [(i, f"red ring {i}", "Brand#1", "PROMO", i) for i in range(6)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    frame(spark, [(i, i % 9 if i else None, "OFP"[i % 3], f"1995-0{i % 9 + 1}-07 00:00:00", "1-URGENT") for i in range(12)] * 2,
          "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    frame(spark, [(i % 12, i % 6, i % 3, i % 8 + 1, 2.0, 10.5, "R", "OF"[i % 2], "1995-03-07 00:00:00" if i % 5 else None) for i in range(40)],
          "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")


def test_dealt_rows_become_the_same_records(spark, tmp_path):
    _tables(spark, str(tmp_path))
    plain, seen = inputs.graph_current(spark, str(tmp_path)), []
    dealt = inputs.graph_current(spark, str(tmp_path), deal=lambda df: seen.append(df.columns) or df.repartition(4, "resource_id"))
    shown = lambda df: sorted(str(r) for r in df.collect())
    assert seen == [["resource_id", "type", "folder", "entity", "vals"]]  # values, and no properties
    assert dealt.columns == plain.columns and shown(dealt) == shown(plain) and plain.count() > 80
    assert [f.dataType for f in dealt.schema] == [f.dataType for f in plain.schema]


def test_a_function_gives_the_records_of_every_round(spark, tmp_path):
    made = [("resource", f"id{i}", 2020, [prop("name", f"Name {i}")]) for i in range(50)]
    current = materialize.current_records(records(spark, *made)).localCheckpoint()
    ways = {"table": current, "dealt": lambda deal: deal(current.drop("props")).withColumn("props", F.array().cast(current.schema["props"].dataType)), "loose": lambda deal: current}
    built = {n: published.publish(x, f"{tmp_path}/{n}", "v1", 8, (), 3).read(spark, "current") for n, x in ways.items()}
    ids = [rows(x, "resource_id") for x in built.values()]
    assert ids[0] == ids[1] == ids[2] and len(ids[0]) == 51
    assert rows(built["table"], "number", "resource_id") == rows(built["dealt"], "number", "resource_id")
    assert len(built["dealt"].inputFiles()) == 8 and all(x.select("number").distinct().count() == 51 for x in built.values())
