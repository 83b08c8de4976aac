"""Records and ids of the node graph are computed by compiled expressions alone."""

import hashlib
import uuid

from pyspark.sql import functions as F

from factloom import vocab as v
from factloom.functions.ids import stable_id
from factloom.operators import projection as p
from factloom.plans.inputs import O, graph_current

from .helpers import frame


def graph(spark, tmp_path):
    frame(spark, [(1, "One", 2, "X"), (2, None, None, "Y"), (3, "Три", 4, None)], "c_custkey long, c_name string, c_nationkey long, c_mktsegment string").write.parquet(
        f"{tmp_path}/customer.parquet")
    return graph_current(spark, str(tmp_path), ("customer:",))


def test_properties_without_value_are_left_out(spark, tmp_path):
    found = {r["resource_id"]: [(q["predicate"][len(O):], q["kind"], q["value"], q["lang"], q["datatype"]) for q in r["props"]] for r in graph(spark, tmp_path).collect()}
    assert found == {
        "customer:1": [("name", "literal", "One", "en", None), ("alias", "literal", "X", None, None), ("citizen", "resource", "nation:2", None, None)],
        "customer:2": [("alias", "literal", "Y", None, None), *found["customer:2"][1:]],
        "customer:3": [("name", "literal", "Три", "ru", None), ("citizen", "resource", "nation:4", None, None)]}


def test_no_interpreted_functions(spark, tmp_path):
    ids = p.triples(graph(spark, tmp_path)).select("subject", "triple_id")
    plan = ids._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "as binary), 256) as binary)" in plan.replace("AS", "as")
    assert ids.select("triple_id").distinct().count() == ids.count()


def test_guid_text(spark):
    found = spark.range(1).select(stable_id(F.lit("a"), F.lit(None).cast("string"), F.lit("Ж")).alias("id")).first()["id"]
    assert found == uuid.UUID(bytes_le=hashlib.sha256("a\x1f\x00\x1fЖ".encode()).digest()[:16]).hex and v.IRI == "iri"
