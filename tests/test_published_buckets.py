"""Published tables meet in their buckets: no shuffle by id."""

import pytest
from pyspark.sql import functions as F

from factloom import vocab as v
from factloom.operators import materialize, ontology, portrait, projection as p, relations
from factloom.sources import published

from .helpers import O, prop, records, rows, term, terms


@pytest.fixture(scope="module")
def build(spark, tmp_path_factory):
    made = [("resource", f"id{i}", 2020, [prop("name", f"Name {i}"), prop("friend", f"id{i // 2}", "resource"), prop("from-date", f"19{i % 90 + 10}")]) for i in range(300)]
    current = materialize.current_records(records(spark, *made))
    return current, published.publish(current, str(tmp_path_factory.mktemp("published")), "v1", 4)


def exchanges(df):
    """Shuffles of the plan and what they deal by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.split("\n") if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]


@pytest.fixture(autouse=True)
def shuffle_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_contents_and_files(spark, build):
    current, done = build
    assert rows(done.read(spark, "heads"), "resource_id", "cassette_id") == rows(p.heads(current), "resource_id", "cassette_id")
    names = ("subject", "predicate", "object_value")
    assert rows(done.read(spark, "triples_by_subject"), *names) == rows(done.read(spark, "triples"), *names) == rows(p.triples(current), *names)
    assert len(done.read(spark, "triples_by_subject").inputFiles()) == 4
    numbers = done.read(spark, "heads").select("number", "resource_id")
    assert numbers.select("number").distinct().count() == 301 and rows(numbers) == rows(done.read(spark, "current").select("number", "resource_id"))


def test_portraits_do_not_shuffle_by_subject(spark, build):
    _, done = build
    heads, triples = done.read(spark, "heads"), done.read(spark, "triples_by_subject")
    summary = portrait.portrait_rows(heads, triples, ["c0"], inverse=False)
    assert exchanges(summary) == [] and summary.count() == 901  # the root collection has a name
    frame = portrait.portrait_heads(heads, triples, ["c0"])
    assert exchanges(frame) == [] and frame.where("type is not null").count() == 301


def test_nodes_do_not_shuffle_by_subject(spark, build):
    _, done = build
    onto = terms(spark, term(v.SYSTEM_OBJECT, v.CLASS), term(O + "person", v.CLASS, [("Person", "en")], parent=v.SYSTEM_OBJECT), term(v.ENTITY, v.CLASS))
    nodes = relations.node_table(done.read(spark, "heads"), done.read(spark, "triples_by_subject"), onto, ontology.ancestors(onto), ["c0"], "en")
    assert exchanges(nodes) == []
    assert nodes.where("display_name like 'Name %' and type_label = 'Person' and sort_date is not null").count() == 300


def test_another_session_knows_the_buckets(spark, build):
    _, done = build
    spark.sql(f"DROP TABLE {published._table_name(done.path + '/heads')}")  # a catalog that has not seen the build
    heads = done.read(spark, "heads")
    found = heads.groupBy("resource_id").agg(F.count("*").alias("n"))
    assert exchanges(found) == [] and found.count() == 301
    assert heads.where("resource_id = 'id7'").count() == 1
