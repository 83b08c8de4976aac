"""Pages of the graph are put together in the buckets of its records: what belongs to a record is not shuffled."""

import pytest
from pyspark.sql import functions as F

from factloom import vocab as v
from factloom.operators import collections, factorised, materialize, ontology, portrait, relations, search
from factloom.session import dealt_anew
from factloom.sources import published

from .helpers import O, prop, records, ref, term, terms

ALLOWED = ["c0"]


@pytest.fixture(scope="module")
def onto(spark):
    return terms(spark, term(v.ENTITY, v.CLASS), term(v.SYSTEM_OBJECT, v.CLASS, parent=v.ENTITY), term(O + "person", v.CLASS, [("Person", "en")], parent=v.SYSTEM_OBJECT),
                 term(O + "marriage", v.CLASS, [("Marriage", "en")], parent=v.ENTITY), term(O + "wife", v.OBJECT_PROPERTY, [("wife", "en")]),
                 term(O + "husband", v.OBJECT_PROPERTY, [("husband", "en")]), term(O + "witness-of", v.OBJECT_PROPERTY, [("witness", "en")]))


@pytest.fixture(scope="module")
def tables(spark, onto, tmp_path_factory):
    made = [("resource", f"p{i}", 2020, [prop("name", f"Name {i}"), *([ref("witness-of", "m1")] if i in (2, 5) else [])], O + "person") for i in range(40)]
    made += [("resource", f"m{i}", 2020, [ref("wife", f"p{i}"), ref("husband", f"p{i + 1}"), prop("note", f" n{i} ")], O + "marriage") for i in range(30)]
    rows = records(spark, *[m[:4] for m in made])
    kinds = F.when(F.col("resource_id").startswith("m"), O + "marriage").otherwise(O + "person")
    current = materialize.current_records(rows.withColumn("type", F.when(F.col("kind") == "resource", kinds)))
    build = published.publish(current, str(tmp_path_factory.mktemp("pages")), "v1", 4)
    by_subject = build.read(spark, "triples_by_subject")
    found = relations.node_table(build.read(spark, "heads"), by_subject, onto, ontology.ancestors(onto), ALLOWED, "en")
    nodes = published.write_bucketed(found, f"{build.path}/nodes", "resource_id", 4)
    return build, by_subject, nodes, relations.edge_table(by_subject, ALLOWED)


@pytest.fixture(autouse=True)
def shuffle_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x or "Exchange rangepartitioning" in x]


def plain(spark, df):
    """The same rows in no buckets."""
    return spark.createDataFrame(df.collect(), df.schema)


def shown(df):
    return sorted(map(str, df.select([F.col(c).cast("string") for c in sorted(df.columns)]).collect()))


def test_records_are_not_shuffled(spark, tables, onto):
    build, by_subject, nodes, _ = tables
    values = relations.public_values(nodes, by_subject, onto, ALLOWED, "en")
    assert not [x for x in exchanges(values) if "subject#" in x or "relation_id#" in x] and values.count() == 30  # the terms have aggregates of their own
    assert exchanges(collections.memberships(by_subject, ALLOWED)) == []
    found = search.class_instances(build.read(spark, "heads"), by_subject, onto, ontology.ancestors(onto), ALLOWED, O + "person", "en")
    assert exchanges(found) == [] and found.count() == 40
    assert exchanges(portrait.summaries(build.read(spark, "heads"), by_subject, onto, ALLOWED, "en")) == []


def test_a_join_may_shuffle_both_sides(spark, tables):
    _, _, nodes, edges = tables
    ids = edges.select(F.col("target_id").alias("resource_id"))
    assert len(exchanges(ids.join(nodes.select("resource_id"), "resource_id"))) == 1
    assert len(exchanges(ids.join(dealt_anew(nodes.select("resource_id"), "resource_id"), "resource_id"))) == 2


@pytest.mark.parametrize("few", [True, False])
def test_relations_of_a_page_either_way(spark, tables, onto, monkeypatch, few):
    _, _, nodes, edges = tables
    if not few:
        monkeypatch.setattr(relations, "row_bound", lambda df, limit=0: False)
    found = [r for part in relations.page_relations(nodes, edges, onto, "en", None, "is_complex") for r in part.select("root_id", "relation_id", "label").collect()]
    expected = {(f"p{i + k}", f"m{i}", ("wife", "husband")[k]) for i in range(30) for k in (0, 1)} - {("p2", "m1", "husband")}
    assert len(found) == len({r[:2] for r in found}) and {tuple(r) for r in found} == expected | {("p2", "m1", "witness"), ("p5", "m1", "witness")}


@pytest.mark.parametrize("technical", [False, True])
def test_rows_in_buckets_and_without(spark, tables, onto, technical):
    _, by_subject, nodes, edges = tables
    bare, links = plain(spark, nodes), plain(spark, edges)
    rows = relations.related(nodes, edges, onto, "en", technical)
    assert rows.count() == 124 and shown(rows) == shown(relations.related(bare, links, onto, "en", technical))
    lists = factorised.related(nodes, edges, onto, "en", technical)
    assert shown(factorised.expand(factorised.merged(nodes, lists)).select(rows.columns)) == shown(rows)
    members = relations.relation_members(nodes, edges, onto, "en")
    values = relations.public_values(nodes, by_subject, onto, ALLOWED, "en")
    entries = relations.relation_entries(nodes, edges, onto, "en", members, values)
    assert shown(entries) == shown(relations.relation_entries(bare, links, onto, "en", plain(spark, members), plain(spark, values)))


def test_a_list_without_label_is_kept(spark, tables, onto):
    nodes = tables[2]
    pair = spark.createDataFrame([("p0", "m0", None), ("p0", "m0", None)], "root_id string, relation_id string, relation_label string")
    two = pair.unionByName(spark.createDataFrame([("p0", "m0", "b"), ("p0", "m0", "a")], pair.schema))
    targets = spark.createDataFrame([("m0", "p1")], "relation_id string, resource_id string")
    links = factorised.merged(nodes, factorised.LinkList(pair, targets), factorised.LinkList(two, targets))
    assert [r["labels"] for r in links.roots.collect()] == [{0: None, 1: "a"}]
