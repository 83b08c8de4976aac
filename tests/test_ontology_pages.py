import pytest
from pyspark.sql import functions as F

from factloom import vocab as v
from factloom.functions.dates import parse_date
from factloom.operators import collections, duplicates as d, ontology as o, portrait, projection as p, relations as g, search

from .helpers import O, frame, head_rows, rows, term, terms, triple_rows

L, I = v.LITERAL, v.IRI


def small_ontology(spark):
    return terms(
        spark, term("base", v.CLASS, [("Базовый класс", "ru")]), term("child", v.CLASS, [("Child", "en")], parent="base"),
        term("name", v.DATATYPE_PROPERTY, [("Имя", "ru")], domains=["base"], priority="01"),
        term("mentor", v.OBJECT_PROPERTY, [("Наставник", "ru")], domains=["base"], ranges=["child"], inverse=[("Ученики", "ru")], priority="02"),
        term("status-enum", v.ENUMERATION, states=[("active", "Активен", "ru"), ("active", "Active", "en")]),
        term("status", v.DATATYPE_PROPERTY, [("Статус", "ru")], domains=["child"], ranges=["status-enum"], priority="03"))


def test_hierarchy_properties_and_labels(spark):
    onto = small_ontology(spark)
    closure = o.ancestors(onto)
    assert rows(closure) == [("base", "base", 0), ("child", "base", 1), ("child", "child", 0)]
    ordered = o.property_order(o.direct_properties(onto, closure).where("class_id = 'child'")).collect()
    assert [r["property_id"] for r in ordered] == ["name", "mentor", "status"]
    assert rows(o.inverse_properties(onto, closure), "class_id", "property_id") == [("child", "mentor")]
    assert rows(o.enumeration_labels(onto, "de")) == [("status", "active", "Активен")]
    assert rows(o.enumeration_labels(onto, "en")) == [("status", "active", "Active")]
    assert rows(o.schema_options(onto, "en")) == [("status", "active", "Active")]


@pytest.mark.parametrize("classes", [[("a", "b"), ("b", "a")], [("a", "a")], [("a", "lost")]])
def test_broken_hierarchies_raise(spark, classes):
    with pytest.raises(o.InvalidOntology):
        o.ancestors(terms(spark, *[term(i, v.CLASS, parent=p) for i, p in classes]))


def test_repeated_ids_raise(spark):
    with pytest.raises(o.InvalidOntology, match="base"):
        o.unique_terms(terms(spark, term("base", v.CLASS), term("base", v.ENUMERATION)))


def test_validation_codes(spark):
    en = [("x", "en")]
    onto = terms(
        spark, term("c1", v.CLASS, en, parent="c2"), term("c2", v.CLASS, en, parent="c1"), term("c3", v.CLASS, parent="nowhere"),
        term("c4", v.CLASS, en, parent="e"), term("e", v.ENUMERATION, en), term("d", v.DATATYPE_PROPERTY, en),
        term("r", v.OBJECT_PROPERTY, en, domains=["nowhere", "e"], ranges=["nowhere", "e", "c4"]), term("q", v.OBJECT_PROPERTY, en, domains=["c4"]))
    got = rows(o.validate(onto.withColumn("position", F.monotonically_increasing_id())), "severity", "code", "term_id", "detail")
    assert got == sorted([
        ("error", "missing_entity_root", v.SYSTEM_OBJECT, None), ("error", "cyclic_class_hierarchy", "c2", None),
        ("error", "missing_parent_class", "c3", "nowhere"), ("error", "parent_is_not_class", "c4", "e"),
        ("error", "missing_domain_class", "r", "nowhere"), ("error", "domain_is_not_class", "r", "e"),
        ("error", "missing_range_class", "r", "nowhere"), ("error", "range_is_not_class", "r", "e"), ("error", "missing_range", "q", None),
        ("error", "no_concrete_entity_target", "r", None), ("warning", "missing_label", "c3", None), ("warning", "missing_domain", "d", None),
        ("warning", "missing_range", "d", None), ("warning", "missing_inverse_label", "r", None)])
    assert o.fatal_report(spark, "unreadable", "bad").first()["term_id"] == "$ontology"


def test_class_suggestions(spark):
    onto = terms(spark, term("http://x/people", v.CLASS, [("Ёлка  Зимняя", "ru")]), term("http://x/tree", v.CLASS, [("Елка", "ru"), ("Fir", "en")]), term("http://x/fire", v.CLASS, [("Fire", "en")]))
    ask = lambda q: rows(o.suggest_classes(onto, frame(spark, [("q", q)], "query_id string, query string"), "ru"), "place", "class_id", "exact")
    assert ask("елка") == [(1, "http://x/tree", True), (2, "http://x/people", False)]
    assert ask(" FIR ") == [(1, "http://x/tree", True), (2, "http://x/fire", False)]
    assert ask("ёлка зимняя") == [(1, "http://x/people", True)] and ask("f") == []


@pytest.mark.parametrize("value, display, sort", [
    ("1983", "1983 г.", "1983-01-01"), ("1983-01", "Январь 1983 г.", "1983-01-01"), ("1983-01-07", "7 января 1983 г.", "1983-01-07"),
    ("19830107", "7 января 1983 г.", "1983-01-07"), ("1983.1.7", "7 января 1983 г.", "1983-01-07"), ("1983янв7", "7 января 1983 г.", "1983-01-07"),
    (" 1983 Май ", "Май 1983 г.", "1983-05-01"), ("1983-13", "1983 г.", "1983-01-01"), ("1983-02-30", "1983 г.", "1983-01-01"),
    ("1984-02-29", "29 февраля 1984 г.", "1984-02-29"), ("1983abc", "1983 г.", "1983-01-01"), ("07.01.1983", "7 января 1983 г.", "1983-01-07"),
    ("1983-01-07T10:00:00Z", "7 января 1983 г.", "1983-01-07"), ("7 января 1983", "7 января 1983 г.", "1983-01-07"), ("12/31/1983", "31 декабря 1983 г.", "1983-12-31"),
    ("", None, None), ("  ", None, None), ("abc", None, None), ("83", None, None)])
def test_partial_dates(spark, value, display, sort):
    got = frame(spark, [(value,)], "x string").select(parse_date("x").alias("d")).first()["d"]
    assert (None if got is None else tuple(got)) == (None if display is None else (display, sort))


def relation_ontology(spark):
    ru = lambda x: [(x, "ru")]
    return terms(
        spark, term(v.ENTITY, v.CLASS, abstract=True), term(v.SYSTEM_OBJECT, v.CLASS, parent=v.ENTITY, abstract=True),
        term(O + "person", v.CLASS, ru("Персона"), parent=v.SYSTEM_OBJECT), term(v.ORGANIZATION, v.CLASS, ru("Организация"), parent=v.SYSTEM_OBJECT),
        term(O + "learn", v.CLASS, ru("Учёба"), parent=v.ENTITY, abstract=True), term(O + "aspirant", v.CLASS, ru("Аспирант"), parent=O + "learn"),
        term(v.NAME, v.DATATYPE_PROPERTY, ru("имя"), domains=[v.SYSTEM_OBJECT]),
        term(v.FROM_DATE, v.DATATYPE_PROPERTY, ru("нач.дата"), domains=[v.ENTITY], ranges=[v.DATE]),
        term(v.TO_DATE, v.DATATYPE_PROPERTY, ru("кон.дата"), domains=[v.ENTITY], ranges=[v.DATE]),
        term(O + "learner", v.OBJECT_PROPERTY, ru("ученик"), domains=[O + "learn"], ranges=[O + "person"], inverse=ru("образование в")),
        term(O + "learning-org", v.OBJECT_PROPERTY, ru("в учебном заведении"), domains=[O + "learn"], ranges=[v.ORGANIZATION], inverse=ru("учащийся")))


def test_complex_relation_pages(spark):
    onto = relation_ontology(spark)
    triples = triple_rows(spark, [
        ("person-1", v.RDF_TYPE, I, O + "person", None), ("person-1", v.NAME, L, "Иван Иванов", "ru"), ("org-1", v.RDF_TYPE, I, v.ORGANIZATION, None),
        ("org-1", v.NAME, L, "Институт", "ru"), ("aspirant-1", v.RDF_TYPE, I, O + "aspirant", None), ("aspirant-1", v.FROM_DATE, L, "1987", None),
        ("aspirant-1", v.TO_DATE, L, "1990", None), ("aspirant-1", O + "learner", I, "person-1", None), ("aspirant-1", O + "learning-org", I, "org-1", None)])
    heads = head_rows(spark, "person-1", "org-1", "aspirant-1")
    nodes = g.node_table(heads, triples, onto, o.ancestors(onto), ["cass"], "ru")
    edges = g.edge_table(triples, ["cass"])
    links = g.related(nodes, edges, onto, "ru")
    assert rows(links.where("root_id <> 'aspirant-1'"), "root_id", "resource_id", "relation_label", "relation_id", "display_date", "sort_date") == [
        ("org-1", "person-1", "учащийся · Аспирант", "aspirant-1", "1987 г.–1990 г.", "1987-01-01"),
        ("person-1", "org-1", "образование в · Аспирант", "aspirant-1", "1987 г.–1990 г.", "1987-01-01")]
    members = g.relation_members(nodes, edges, onto, "ru")
    assert rows(members, "resource_id", "role_label") == [("org-1", "в учебном заведении"), ("person-1", "ученик")]
    values = g.public_values(nodes, triples, onto, ["cass"], "ru")
    entries = g.relation_entries(nodes, edges, onto, "ru", members, values, frame(spark, [("person-1",), ("org-1",)], "id string"))
    assert rows(entries, "root_id", "key", "title", "display_date", "n_members") == [
        ("org-1", "aspirant-1", "Аспирант", "1987 г.–1990 г.", 2), ("person-1", "aspirant-1", "Аспирант", "1987 г.–1990 г.", 2)]
    assert rows(g.without_current(entries, members, nodes), "root_id", "n_members") == [("org-1", 1), ("person-1", 1)]
    completed = g.entries_from_links(entries, g.merge_links(links))
    assert completed.count() == entries.count()
    assert rows(g.sections(g.with_sections(entries)), "root_id", "title", "n") == [("org-1", "Аспирант", 1), ("person-1", "Аспирант", 1)]
    # observed relations join a page they are not linked to
    more = g.relation_entries(nodes, edges, onto, "ru", members, values, frame(spark, [("org-1",)], "id string"),
                              frame(spark, [("org-1", "aspirant-1"), ("org-1", "missing")], "root_id string, relation_id string"))
    assert more.count() == 1


URI1, URI2 = "iiss://A@h/0001/0001", "iiss://A@h/0001/0002"


def photo_graph(spark):
    onto = terms(
        spark, term(v.ENTITY, v.CLASS, abstract=True), term(v.SYSTEM_OBJECT, v.CLASS, parent=v.ENTITY, abstract=True), term(O + "person", v.CLASS, parent=v.SYSTEM_OBJECT),
        term(v.ORGANIZATION, v.CLASS, parent=v.SYSTEM_OBJECT), term(v.COLLECTION, v.CLASS, parent=v.SYSTEM_OBJECT), term(v.DOCUMENT, v.CLASS, parent=v.SYSTEM_OBJECT),
        term(v.PHOTO_DOCUMENT, v.CLASS, parent=v.DOCUMENT), *[term(t, v.CLASS, parent=v.ENTITY) for t in v.TECHNICAL_TYPES])
    facts = [("p", O + "person"), ("o", v.ORGANIZATION), ("c", v.COLLECTION), ("d", v.PHOTO_DOCUMENT), ("r1", v.REFLECTION), ("r2", v.REFLECTION),
             ("r3", v.REFLECTION), ("m", v.COLLECTION_MEMBER), ("n", v.COLLECTION_MEMBER), ("t", v.PARTICIPATION)]
    data = [(i, v.RDF_TYPE, I, t, None) for i, t in facts] + [
        ("p", v.NAME, L, "Пётр", "ru"), ("o", v.NAME, L, "Орг", "ru"), ("c", v.NAME, L, "Альбом", "ru"), ("d", v.URI, L, f" {URI1} ", None), ("d", v.DATE, L, "1999", None),
        ("r1", v.REFLECTED, I, "p", None), ("r1", v.IN_DOC, I, "d", None), ("r1", v.DATE, L, "1985", None), ("r2", v.REFLECTED, I, "p", None), ("r2", v.IN_DOC, I, "d", None),
        ("r2", v.DATE, L, "1980-05", None), ("r3", v.REFLECTED, I, "o", None), ("r3", v.IN_DOC, I, "d", None), ("m", v.IN_COLLECTION, I, "c", None),
        ("m", v.COLLECTION_ITEM, I, "d", None), ("n", v.IN_COLLECTION, I, "c", None), ("n", v.COLLECTION_ITEM, I, "p", None),
        ("t", v.PARTICIPANT, I, "p", None), ("t", v.IN_ORG, I, "o", None), ("t", v.ROLE, L, " директор ", "ru")]
    triples, heads = triple_rows(spark, data), head_rows(spark, *[i for i, _ in facts])
    nodes = g.node_table(heads, triples, onto, o.ancestors(onto), ["cass"], "ru").cache()
    return onto, triples, heads, nodes, g.edge_table(triples, ["cass"])


def test_pages_of_bridged_resources(spark):
    onto, triples, heads, nodes, edges = photo_graph(spark)
    assert rows(g.canonical(nodes, edges).where("resource_id <> canonical_id")) == [("m", "d"), ("n", "p"), ("r1", "p"), ("r2", "p"), ("r3", "o"), ("t", "p")]
    cards = g.photo_cards(nodes, edges)
    assert rows(cards, "root_id", "resource_id", "context_id", "sort_date") == [("c", "d", "c", "1999-01-01"), ("o", "d", "o", "1999-01-01"), ("p", "d", "o", "1980-05-01")]
    assert rows(g.participants(nodes, edges), "root_id", "resource_id", "relation_label") == [("c", "p", v.LABEL_COLLECTION_ITEM), ("o", "p", " директор ")]
    assert rows(g.organizations(nodes, edges), "root_id", "resource_id", "relation_label") == [("p", "o", " директор ")]
    assert rows(g.collections_of(nodes, edges), "root_id", "relation_id", "resource_id") == [("d", "m", "c"), ("o", "m", "c"), ("p", "m", "c"), ("p", "n", "c")]
    assert rows(collections.memberships(triples, ["cass"]), "collection_id", "membership_id", "resource_id") == [("c", "m", "d"), ("c", "n", "p")]
    members = g.relation_members(nodes, edges, onto, "ru")
    entries = g.relation_entries(nodes, edges, onto, "ru", members, g.public_values(nodes, triples, onto, ["cass"], "ru"))
    of_p = {r["key"]: r for r in entries.where("root_id = 'p'").collect()}
    assert of_p["r2"]["document_uri"] == URI1 and of_p["r2"]["sort_date"] == "1980-05-01" and of_p["t"]["title"] == "директор"
    # the membership has no date of its own: members with a document lend theirs
    assert {r["key"]: r["sort_date"] for r in entries.where("root_id = 'd'").collect()}["m"] == "1999-01-01"
    media = g.with_sections(entries).where("root_id = 'p' and section_key = 'public:media'")
    assert {r["key"] for r in media.collect()} == {"r1", "r2"}
    # on the document's own page its document is not repeated
    own = {r["key"]: r for r in g.without_current(entries, members, nodes).where("root_id = 'd'").collect()}
    assert own["r1"]["document_uri"] is None and own["r1"]["n_members"] == 1
    assert rows(g.section_page(g.with_sections(entries).where("root_id = 'p'"), 0, "large"), "section_key", "place").count(("public:media", 1)) == 1


def test_several_documents_are_not_one(spark):
    onto = terms(spark, term(v.DOCUMENT, v.CLASS))
    triples = triple_rows(spark, [("a", v.URI, L, URI1, None), ("a", O + "scan", L, URI2, None), ("b", v.URI, L, URI1, None), ("b", O + "scan", L, URI1 + " ", None), ("c", v.URI, L, "http://x/0001/0001", None)])
    nodes = g.node_table(head_rows(spark, "a", "b", "c"), triples, onto, o.ancestors(onto), ["cass"], "ru")
    assert rows(nodes, "resource_id", "document_uri", "has_document") == [("a", None, True), ("b", URI1, True), ("c", None, False)]


def test_presented_portrait_and_page_metadata(spark):
    onto = terms(spark, term("T", v.CLASS, [("Тип", "ru")]), term(v.NAME, v.DATATYPE_PROPERTY, [("имя", "ru")], domains=["T"], priority="01"),
                 term(v.FROM_DATE, v.DATATYPE_PROPERTY, domains=["T"]), term(O + "st", v.DATATYPE_PROPERTY, ranges=["E"]), term("E", v.ENUMERATION, states=[("1", "один", "ru")]))
    long = "слово " * 60
    triples = triple_rows(spark, [("a", v.RDF_TYPE, I, "T", None), ("a", v.NAME, L, "Имя", "ru"), ("a", v.FROM_DATE, L, "1983", None), ("a", O + "st", L, "1", None),
                                  ("a", v.DESCRIPTION, L, long, None), ("b", O + "knows", I, "a", None)])
    heads, closure = head_rows(spark, "a", "b"), o.ancestors(onto)
    frame_ = portrait.portrait_heads(heads, triples, ["cass"])
    shown = portrait.present(portrait.portrait_rows(heads, triples, ["cass"]), frame_, onto, closure, "ru")
    got = {(r["section"], r["predicate"]): (r["label"], r["display_value"], r["unlisted"]) for r in shown.where("resource_id = 'a'").collect()}
    assert got[("literal", v.NAME)] == ("имя", "Имя", False) and got[("literal", v.FROM_DATE)][1] == "1983 г."
    assert got[("literal", O + "st")] == (O + "st", "один", True) and got[("inverse", O + "knows")] == (O + "knows", None, True)
    meta = portrait.page_metadata(shown, frame_, onto, "ru").where("resource_id = 'a'").first()
    assert meta["title"] == "Имя" and meta["description"] == long[:237].rstrip() + "…" and meta["document_uri"] is None


def test_class_instances_include_descendants_and_hide(spark):
    onto = small_ontology(spark)
    triples = triple_rows(spark, [("a", v.RDF_TYPE, I, "child", None), ("b", v.RDF_TYPE, I, "base", None), ("a", v.NAME, L, "b", None), ("b", v.NAME, L, "A", None)])
    hidden = triple_rows(spark, [("h", v.RDF_TYPE, I, "base", None)], "secret")
    heads = head_rows(spark, "a", "b").unionByName(head_rows(spark, "h", cassette="secret"))
    found = search.class_instances(heads, triples.unionByName(hidden), onto, o.ancestors(onto), ["cass"], "base", "ru")
    page = search.class_page(found, 0, 10).collect()
    assert [(r["resource_id"], r["total"]) for r in page] == [("b", 2), ("a", 2)]
    assert [r["resource_id"] for r in search.class_page(found, 1, 1).collect()] == ["a"]
    past = search.class_page(found, 50, 10).collect()
    assert [(r["resource_id"], r["total"]) for r in past] == [(None, page[0]["total"])]
    assert len(search.class_page(found, 0, None).collect()) == page[0]["total"]


def test_duplicates_keep_the_exact_value_and_report_refused_requests(spark):
    onto = terms(spark, term(O + "person", "Class"), term(v.NAME, "DatatypeProperty"), term(v.DATE, "DatatypeProperty", ranges=[v.NON_TEXT_RANGES[0]]))
    names = [("a", "anna smith"), ("a", "ANNA SMITH"), ("b", "Anna Smith"), ("c", "Фттф Ыьшер")] + [(f"n{i}", f"anna smith {i}") for i in range(80)]
    facts = [(i, v.NAME, "literal", n, None) for i, n in names] + [(i, v.RDF_TYPE, "iri", O + "person", None) for i in dict(names)]
    triples, heads = triple_rows(spark, facts), head_rows(spark, *dict(names))
    nodes = g.node_table(heads, triples, onto, o.ancestors(onto), ["cass"], "en")
    asked = frame(spark, [("q", O + "person", v.NAME, " anna smith "), ("again", O + "person", v.NAME, "anna smith"), ("day", O + "person", v.DATE, "1990"),
                          ("long", O + "person", v.NAME, "x" * 600), ("blank", O + "person", v.NAME, "  ")], "request_id string, type string, predicate string, value string")
    found = d.potential_duplicates(asked, nodes, heads, triples, p.name_keys(triples), onto, o.ancestors(onto), ["cass"], language="en")
    expected = [(1, "b", "Anna Smith", False), (2, "a", "anna smith", False), (3, "c", "Фттф Ыьшер", True)]
    for q in ("q", "again"):
        assert rows(found.where(f"request_id = '{q}'"), "place", "resource_id", "matched_value", "alternative") == expected
    assert rows(d.refused_requests(asked, onto)) == [("blank", "no_value"), ("day", "no_text_property"), ("long", "value_too_long")]
