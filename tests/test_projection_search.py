import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from factloom import vocab as v
from factloom.functions import ids, text
from factloom.operators import match, materialize, ontology, portrait, projection as p, relations, search
from factloom.operators.duplicates import potential_duplicates

from .helpers import O, frame, head_rows, prop, records, rows, term, terms, triple_rows

L, I = v.LITERAL, v.IRI


def one(spark, expression, value):
    return frame(spark, [(value,)], "x string").select(expression("x").alias("y")).first()["y"]


def test_stable_id_is_the_guid_text_of_the_hash(spark):
    digest = hashlib.sha256("triple\x1fa\x1f\x00".encode()).digest()[:16]
    got = spark.range(1).select(ids.stable_id(F.lit("triple"), F.lit("a"), F.lit(None).cast("string")).alias("i")).first()["i"]
    assert got == uuid.UUID(bytes_le=digest).hex


def test_projection_of_current_records(spark):
    current = materialize.current_records(records(spark, ("resource", "a", 2020, [prop("name", "Ann", lang="en"), prop("friend", "b", "resource")])))
    triples = p.triples(current)
    assert rows(triples.where("subject = 'a'"), "predicate", "object_kind", "object_value", "lang") == [
        (O + "friend", I, "b", None), (O + "name", L, "Ann", "en"), (v.RDF_TYPE, I, O + "person", None)]
    assert triples.select("triple_id").distinct().count() == triples.count() == 5
    synthetic = p.heads(current).where(F.col("resource_id") == v.ROOT_COLLECTION_ID).drop("modified_at").first()
    assert (synthetic["cassette_id"], synthetic["source_path"]) == (v.SYSTEM_CASSETTE, v.SYNTHETIC_PATH)


def test_search_rows(spark):
    triples = triple_rows(spark, [("a", v.NAME, L, "Anna-Maria Smith", "en"), ("a", v.DESCRIPTION, L, "One, two two", None), ("a", O + "phone", L, "hidden", None)])
    keys = {r["search_key"] for r in p.name_keys(triples).collect()}
    assert {"ANNA MARIA SMITH", "MARIA", "SMI", "ANNA M"} <= keys and "" not in keys
    assert {r["word"] for r in p.word_index(triples).collect()} == {"ANNA", "MARIA", "ONE", "SMITH", "TWO"}


@pytest.mark.parametrize("value, want", [
    ("  Anna-Maria  ", "ANNA MARIA"), ("", ""), (" - ", ""), ("straße", "STRAßE"), ("ﬁn ①", "FIN 1"), ("a b", "A B"), ("Ёж\tёж", "ЁЖ ЁЖ")])
def test_phrase(spark, value, want):
    assert one(spark, text.phrase, value) == want


@pytest.mark.parametrize("value", ["", " ", "-;:", "…", "　", "‥ ‧", "a", "ё", "①", "+", "́"])
def test_has_words_agrees_with_the_tokens(spark, value):
    assert one(spark, text.has_words, value) == (one(spark, text.phrase, value) != "")


@pytest.mark.parametrize("fn, value, want", [
    (text.swap_keyboard, "pbvby", "зимин"), (text.swap_keyboard, "Pbvby", "Зимин"), (text.swap_keyboard, "Зимин", "Pbvby"),
    (text.swap_keyboard, ".", "ю"), (text.swap_keyboard, "1 {", "1 {"), (text.cyrillic_to_latin, "Щука Ёж", "shchuka yozh"),
    (text.cyrillic_to_latin, "Зимин 7", "zimin 7"), (text.latin_to_cyrillic, "Zimin", "зимин"), (text.latin_to_cyrillic, "Yury", "юры"),
    (text.latin_to_cyrillic, "shchyogol", "щёгол"), (text.latin_to_cyrillic, "x-ray", "кс-рай"), (text.latin_to_cyrillic, "dmitriy", "дмитрий")])
def test_spellings(spark, fn, value, want):
    assert one(spark, fn, value) == want


CLASSES = [term(O + "person", v.CLASS, [("Person", "en")])]


def search_names(spark, names, query, allowed=("cass-a",), hidden=()):
    triples = triple_rows(spark, [(i, v.NAME, L, n, "en") for i, n in names] + [(i, v.RDF_TYPE, I, O + "person", None) for i, _ in names], "cass-a")
    heads = head_rows(spark, *[i for i, _ in names], cassette="cass-a")
    for i, n in hidden:
        triples = triples.unionByName(triple_rows(spark, [(i, v.NAME, L, n, "en")], "cass-b"))
        heads = heads.unionByName(head_rows(spark, i, cassette="cass-b"))
    queries = frame(spark, [("q", query)], "query_id string, query string")
    found = search.search_names(queries, p.name_keys(triples), heads, triples, terms(spark, *CLASSES), list(allowed), 50, "en")
    return [(r["resource_id"], r["score"]) for r in found.orderBy("place").collect()]


def test_name_search_scores_and_visibility(spark):
    got = search_names(spark, [("token", "Maria Ann"), ("prefix", "Anna"), ("exact", "Ann")], "ann", hidden=[("hid", "Ann Hidden")])
    assert got == [("exact", 3), ("prefix", 2), ("token", 1)]


@pytest.mark.parametrize("query", ["Zimin", "Pbvby", "зимин"])
def test_alternative_spellings_find_the_name(spark, query):
    assert search_names(spark, [("m", "Зимин")], query) == [("m", 3)]


def test_original_writing_ranks_first(spark):
    got = search_names(spark, [("cyr", "Зимин"), ("lat", "Zimin")], "Zimin")
    assert [i for i, _ in got] == ["lat", "cyr"]


def test_blank_query_and_limits(spark):
    assert search_names(spark, [("a", "Ann")], " -- ") == []
    with pytest.raises(ValueError):
        search.search_names(None, None, None, None, None, [], 0)


def test_word_search_counts_query_words(spark):
    triples = triple_rows(spark, [("a", v.DESCRIPTION, L, "red red car", None), ("b", v.DESCRIPTION, L, "red fast car", None), ("b", v.ALIAS, L, "Bee", None)])
    queries = frame(spark, [("q", "car, RED fast fast")], "query_id string, query string")
    found = search.search_words(queries, p.word_index(triples), head_rows(spark, "a", "b"), triples, terms(spark, *CLASSES), ["cass"], 10, "en")
    got = [(r["resource_id"], r["score"], r["display_name"], [x["value"] for x in r["matches"]]) for r in found.orderBy("place").collect()]
    assert got == [("b", 3, "Bee", ["red fast car"]), ("a", 2, "a", ["red red car"])]


def test_display_names_prefer_name_then_language(spark):
    triples = triple_rows(spark, [("a", v.ALIAS, L, "Alias", "ru"), ("a", v.NAME, L, "En", "en"), ("a", v.NAME, L, "None", None), ("b", v.ALIAS, L, "Only", None), ("c", v.NAME, L, "…", "ru")])
    assert rows(portrait.display_names(triples, ["cass"], "ru")) == [("a", "None"), ("b", "Only")]
    assert rows(portrait.display_names(triples, ["cass"], "EN")) == [("a", "En"), ("b", "Only")]


def test_merge_facets_and_filter(spark):
    schema = "query_id string, place int, resource_id string, display_name string, type string, type_label string, score int, cassette_id string, matches array<struct<predicate:string,value:string,lang:string>>"
    hit = lambda x: [{"predicate": "p", "value": x, "lang": None}]
    names = frame(spark, [("q", 1, "a", "A", "t1", "T1", 3, "c", hit("x"))], schema)
    words = frame(spark, [("q", 1, "b", "B", None, None, 2, "c", hit("y")), ("q", 2, "a", "A", "t1", "T1", 5, "c", hit("z"))], schema)
    merged = search.merge_results(names, words)
    got = [(r["resource_id"], r["score"], [m["value"] for m in r["matches"]]) for r in merged.orderBy("place").collect()]
    assert got == [("a", 5, ["x", "z"]), ("b", 2, ["y"])]
    assert rows(search.type_facets(merged), "type", "label", "n") == [(v.UNKNOWN_TYPE, v.LABEL_NO_TYPE, 1), ("t1", "T1", 1)]
    assert rows(search.filter_by_type(merged, v.UNKNOWN_TYPE), "resource_id") == [("b",)]


def test_patterns_of_every_shape(spark):
    triples = triple_rows(spark, [("s", "p", I, "o", None), ("s", "q", L, "o", None), ("t", "p", L, "x", None)])
    shapes = [(f"{n:04b}", *[value if n >> (3 - i) & 1 else None for i, value in enumerate(("s", "p", I, "o"))]) for n in range(16)]
    patterns = frame(spark, shapes, "pattern_id string, subject string, predicate string, object_kind string, object_value string")
    got = {(r["pattern_id"], r["triple_id"]) for r in match.match_patterns(triples, patterns, ["cass"]).collect()}
    data = [tuple(r[c] for c in ("subject", "predicate", "object_kind", "object_value")) for r in triples.orderBy("triple_id").collect()]
    want = {(s[0], f"{i:032d}") for s in shapes for i, t in enumerate(data) if all(a is None or a == b for a, b in zip(s[1:], t))}
    assert got == want
    assert match.match_patterns(triples, patterns, ["other"]).count() == 0


def test_statements_are_filtered_before_they_are_multiplied(spark):
    triples = triple_rows(spark, [(f"s{i}", O + "p", L, f"v{i}", None) for i in range(2000)])
    patterns = frame(spark, [("one", "s7", None, None, None), ("two", None, O + "p", None, "v9"), ("none", "ghost", None, None, "v1")],
                     "pattern_id string, subject string, predicate string, object_kind string, object_value string")
    found = match.match_patterns(triples, patterns, ["cass"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Filter" in plan[plan.index("Generate"):]
    assert {(r["pattern_id"], r["subject"]) for r in found.collect()} == {("one", "s7"), ("two", "s9")}
    shape = match.F.concat(*[F.when(F.col(c).isNull(), "-").otherwise("+") for c in match._BOUND])
    may = match._may_match(patterns, shape, "+---")
    assert triples.where(may).count() < 10 and triples.where(may & (F.col("subject") == "s7")).count() == 1


def test_duplicates_exact_alternative_and_dates(spark):
    onto = terms(spark, term(O + "person", v.CLASS), term(O + "child", v.CLASS, parent=O + "person"), term(O + "other", v.CLASS),
                 term(v.NAME, v.DATATYPE_PROPERTY), term(O + "born", v.DATATYPE_PROPERTY, ranges=[O + "date"]))
    people = [("exact", "Зимин", "person"), ("latin", "Zimin", "child"), ("wrong", "Зимин", "other")]
    triples = triple_rows(spark, [(i, v.NAME, L, n, "ru") for i, n, _ in people] + [(i, v.RDF_TYPE, I, O + t, None) for i, _, t in people] + [("exact", O + "born", L, "1983", None)])
    heads, closure = head_rows(spark, "exact", "latin", "wrong"), ontology.ancestors(onto)
    nodes = relations.node_table(heads, triples, onto, closure, ["cass"], "ru")
    asked = frame(spark, [("n", O + "person", v.NAME, " Зимин "), ("d", O + "person", O + "born", "1983"), ("e", O + "person", v.NAME, "  ")],
                  "request_id string, type string, predicate string, value string")
    found = potential_duplicates(asked, nodes, heads, triples, p.name_keys(triples), onto, closure, ["cass"], 10, "ru")
    assert rows(found, "request_id", "place", "resource_id", "alternative") == [("n", 1, "exact", False), ("n", 2, "latin", True)]
