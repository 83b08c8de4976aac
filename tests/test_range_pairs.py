"""Pairs of the closure meet the ranges of properties before they meet classes."""

from factloom import vocab as v
from factloom.operators import ontology

from .helpers import O, rows, term, terms


def test_closure_is_cut_to_ranges_first(spark):
    onto = terms(spark, term(v.SYSTEM_OBJECT, v.CLASS), term(O + "a", v.CLASS, [("A", "en")], parent=v.SYSTEM_OBJECT), term(O + "b", v.CLASS, [("B", "en")], parent=O + "a"),
                 term(O + "c", v.CLASS, parent=O + "a", abstract=True), term(O + "other", v.CLASS),
                 term(O + "p", v.OBJECT_PROPERTY, ranges=[O + "a", O + "b", O + "b"]), term(O + "q", v.OBJECT_PROPERTY, ranges=[O + "other"]), term(O + "d", v.DATATYPE_PROPERTY, ranges=[O + "a"]))
    closure = ontology.ancestors(onto)
    found = ontology.entity_types_in_range(onto, closure, "en")
    assert rows(found) == [(O + "p", O + "a", "A"), (O + "p", O + "b", "B")]
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in line]
    depth = {column: max(line.index("Join") for line in joins if f"({column}#" in line) for column in ("ancestor_id", "type")}
    assert depth["ancestor_id"] > depth["type"]
