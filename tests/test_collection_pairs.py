"""Collections of a page: ids are matched alone, what is shown is joined to the pairs."""

import re

from factloom import vocab as v
from factloom.operators import relations as g

from .helpers import frame, rows

FLAGS = "is_entity boolean, under_entity boolean, is_org boolean, is_collection boolean, is_document boolean, is_photo boolean, is_complex boolean, is_technical boolean"
NODE = ("resource_id string, type string, type_label string, display_name string, document_uri string, has_document boolean, display_date string, "
        f"sort_date string, role string, cassette_id string, {FLAGS}")


def node(id_, type_="thing", technical=False):
    return (id_, type_, type_, id_, None, False, None, None, None, "c", True, True, False, False, False, False, False, technical)


def test_collections_match_ids_alone(spark):
    # a node, a link and a membership that come twice; two memberships in one collection
    made = [node("a"), node("a"), node("m", v.COLLECTION_MEMBER, True), node("m", v.COLLECTION_MEMBER, True), node("m2", v.COLLECTION_MEMBER, True), node("col")]
    nodes = frame(spark, made, NODE)
    links = [("m", v.COLLECTION_ITEM, "a"), ("m", v.COLLECTION_ITEM, "a"), ("m", v.IN_COLLECTION, "col"), ("m", v.IN_COLLECTION, "col"),
             ("m2", v.COLLECTION_ITEM, "a"), ("m2", v.IN_COLLECTION, "col"), ("x", v.COLLECTION_ITEM, "a"), ("x", v.IN_COLLECTION, "col")]
    edges = frame(spark, [(*x, "c") for x in links], "source_id string, predicate string, target_id string, cassette_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = g.collections_of(nodes, edges)
        assert rows(found, "root_id", "resource_id", "relation_id") == [("a", "col", "m"), ("a", "col", "m2")]
        plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        moved = [x for x in re.findall(r"\) Exchange.*?\nInput[^\n]*", plan, re.S) if "rel_sort_date" in x and "root_id" in x]
        assert len(moved) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
