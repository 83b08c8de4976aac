"""Properties of classes are given to the descendants without making the pairs distinct, and only the pairs asked for are tested."""

import pytest

from factloom.operators import ontology as o

from .helpers import frame, rows, term, terms
from .test_published_buckets import exchanges

COLUMNS = ("class_id", "property_id", "priority")


def _classes(parents):
    return [term(c, "Class", [(f"label {c}", "en")], parent=p) for c, p in parents.items()]


PARENTS = {"a": None, "b": "a", "c": "b", "d": "c", "e": "a", "f": "e"}
PROPERTIES = {"p": ["b", "d"], "q": ["a", "c", "e"], "r": ["f", "none"], "s": ["e"], "t": []}


def _brute(parents, properties):
    def line(c):
        seen = []
        while c is not None and c not in seen:
            seen.append(c)
            c = parents.get(c)
        return seen

    return sorted((c, p) for c in parents for p, domains in properties.items() if set(line(c)) & set(domains))


@pytest.fixture(params=["few", "many"])
def sent(request, monkeypatch):
    monkeypatch.setattr(o, "MANY", 100 if request.param == "few" else 1)


def test_pairs_are_made_once_and_not_shuffled_again(spark, sent):
    known = terms(spark, *_classes(PARENTS), *[term(p, "DatatypeProperty", domains=d, priority="01") for p, d in PROPERTIES.items()])
    closure = o.ancestors(known)
    found = o.direct_properties(known, closure)
    assert not [x for x in exchanges(found) if "class_id" in x]
    assert rows(found, "class_id", "property_id") == _brute(PARENTS, PROPERTIES)
    listed = o.schema_properties(known, closure, "en")
    assert not [x for x in exchanges(listed) if "class_id" in x]
    assert rows(listed, "class_id", "property_id") == _brute(PARENTS, PROPERTIES)


def test_a_cycle_keeps_one_of_its_domains(spark, sent):
    parents = {"x": "y", "y": "z", "z": "x", "w": "x", "v": "w"}
    properties = {"p": ["x", "z"], "q": ["w", "y", "v"], "r": ["v"]}
    known = terms(spark, *_classes(parents), *[term(p, "ObjectProperty", domains=d) for p, d in properties.items()])
    assert rows(o.direct_properties(known, o.ancestors(known, strict=False)), "class_id", "property_id") == _brute(parents, properties)


def test_repeated_ids_have_several_lines(spark, sent):
    both = [*_classes(PARENTS), *_classes({"f": "c", "b": "a"})]
    known = terms(spark, *both, *[term(p, "DatatypeProperty", domains=d) for p, d in PROPERTIES.items()], term("s", "DatatypeProperty", domains=["e"], priority="02"))
    found = rows(o.direct_properties(known, o.ancestors(known)), *COLUMNS[:2])
    assert found == sorted([*_brute(PARENTS, PROPERTIES), ("f", "p"), ("e", "s"), ("f", "s")])


def test_allowed_pairs_are_those_of_all_properties(spark):
    known = terms(spark, *_classes(PARENTS), *[term(p, "DatatypeProperty", domains=d) for p, d in PROPERTIES.items()])
    closure = o.ancestors(known)
    asked = [(c, p) for c in (*PARENTS, None, "no") for p in (*PROPERTIES, "no", None)] * 2
    found = o.allowed_properties(frame(spark, asked, "class_id string, property_id string"), known, closure)
    assert rows(found) == _brute(PARENTS, PROPERTIES)


def test_roles_need_the_properties_of_relation_classes_only(spark, monkeypatch):
    known = terms(spark, term("a", "Class", [("A", "en")]), term("rel", "Class", [("Rel", "en")], parent="a"),
                  term("p", "ObjectProperty", [("to", "en")], domains=["a"], ranges=["a"]), term("q", "DatatypeProperty", [("no", "en")], domains=["a"], ranges=["a"]))
    asked, made = [], o.schema_properties
    monkeypatch.setattr(o, "schema_properties", lambda *a: asked.append(a[3:]) or made(*a))
    found = o.relation_roles(known, o.ancestors(known), "en")
    assert rows(found, "type", "relation_class", "property_id", "label") == [(t, c, "p", f"{n}: to") for t in ("a", "rel") for c, n in (("a", "A"), ("rel", "Rel"))]
    assert asked and asked[0][0] == (o.v.OBJECT_PROPERTY,) and rows(asked[0][1], "class_id") == [("a",), ("rel",)]
