"""Search (F) and resource summaries (R3-R5) on the node graph; queries come from the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as v
from ..functions import text
from ..operators import ontology, pages, portrait, postings as lists, projection, search
from .graph_queries import DOC_WORDS, G, NAME_KEYS_SQL, WORDS_SQL
from .inputs import ALLOWED, O, graph_terms, kinds_sql, table
from .registry import query
from .store import derived, heads, name_starts, postings, record_heads, record_statements, triples, triples_by_subject, with_predicates

_TEXTS = (v.RDF_TYPE,) + v.WORD_PREDICATES
_LANG = "en"

# queries: the distinct first words of part names, and the brands typed on the other keyboard layout
_SWAP_FROM, _SWAP_TO = "BrandrandBRAND#0123456789", "ИкфтвкфтвИКФТВ#0123456789"


def name_queries(spark, sf):
    parts = table(spark, sf, "part")
    first = F.split("p_name", " ")[0]
    plain = parts.select(F.concat(F.lit("name:"), first).alias("query_id"), first.alias("query"))
    typed = parts.select(F.concat(F.lit("typed:"), "p_brand").alias("query_id"), text.swap_keyboard("p_brand").alias("query"))
    return plain.union(typed).distinct()


_Q_SQL = """q AS (SELECT DISTINCT 'name:' || split_part(p_name, ' ', 1) AS query_id, split_part(p_name, ' ', 1) AS query FROM part
  UNION SELECT DISTINCT 'typed:' || p_brand, p_brand FROM part)"""


def _translit(x: str) -> str:
    """SQL of the Latin to Cyrillic spelling of the few words in part names and brands."""
    table_ = text.LATIN_TO_CYRILLIC
    longest = sorted((k for k in table_ if len(k) > 1), key=lambda k: list(table_).index(k))
    out = f"lower({x})"
    # none of these words holds two listed sequences that overlap, so replacing in order is exact for them
    for k in longest + [k for k in table_ if len(k) == 1]:
        out = f"replace({out}, '{k}', '{table_[k]}')"
    return out


_SWAPPED = "translate(query, '" + "".join(text._keyboard_table()[0]).replace("'", "''") + "', '" + text._keyboard_table()[1].replace("'", "''") + "')"


def _phrase(x: str) -> str:
    return f"trim(regexp_replace(upper({x}), '[ \\r\\n\\t,.:!?\"''=\\\\|/()\\[\\]{{}};*<>-]+', ' ', 'g'))"


# a brand typed on the other layout is cyrillic, so its swap is the brand and its transliteration is latin
_VARIANTS_SQL = f"""{_Q_SQL.replace("p_brand, p_brand FROM part", "p_brand, " + _SWAPPED.replace("query", "p_brand") + " FROM part")},
raw AS (SELECT query_id, query AS s, 300 AS rank FROM q UNION ALL SELECT query_id, {_SWAPPED}, 220 FROM q WHERE {_SWAPPED} <> query
  UNION ALL SELECT query_id, {_translit('query')}, 160 FROM q WHERE query_id LIKE 'name:%'
  UNION ALL SELECT query_id, replace(replace(replace(replace(replace(lower(query), 'и', 'i'), 'к', 'k'), 'ф', 'f'), 'т', 't'), 'в', 'v'), 160 FROM q WHERE query_id LIKE 'typed:%'),
variants AS (SELECT query_id, {_phrase('s')} AS search_key, max(rank) AS rank FROM raw GROUP BY ALL HAVING {_phrase('s')} <> '')"""

_NAME_SEARCH_SQL = f"""{G}, {kinds_sql()}, {NAME_KEYS_SQL}, {_VARIANTS_SQL},
hits AS (SELECT query_id, resource_id, predicate, value, lang, rank AS base,
  CASE WHEN phrase = search_key THEN 3 WHEN starts_with(phrase, search_key) THEN 2 ELSE 1 END AS score
  FROM seen_keys JOIN variants USING (search_key)),
ranked AS (SELECT query_id, resource_id, max(score) AS score, max(base + score) AS rank,
  arg_min(value, (CASE WHEN predicate = '{v.NAME}' THEN '0' ELSE '1' END) || (CASE lang WHEN 'en' THEN '0' WHEN 'ru' THEN '2' ELSE '1' END) || upper(value)) AS display_name
  FROM hits GROUP BY ALL),
placed AS (SELECT r.*, h.cassette_id, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, upper(display_name), resource_id) AS place
  FROM ranked r JOIN seen_heads h USING (resource_id)),
evidence AS (SELECT query_id, resource_id, string_agg(predicate || '=' || value, ';' ORDER BY predicate, value) AS matches
  FROM (SELECT DISTINCT query_id, resource_id, predicate, value, lang FROM hits) GROUP BY ALL),
types AS (SELECT subject AS resource_id, min(object_value) AS type FROM seen WHERE predicate = '{v.RDF_TYPE}' GROUP BY 1),
found AS (SELECT query_id, place, resource_id, display_name, type, type_label, score, cassette_id, matches
  FROM placed JOIN evidence USING (query_id, resource_id) JOIN types USING (resource_id) JOIN kinds USING (type))"""


def _flat(results):
    return results.withColumn("matches", F.array_join(
        F.transform("matches", lambda m: F.concat_ws("=", m["predicate"], m["value"])), ";"))


def search_names(spark, sf):
    return search.search_names(name_queries(spark, sf), name_starts(spark, sf), record_heads(spark, sf), record_statements(spark, sf),
                               graph_terms(spark), ALLOWED, None, _LANG)


def word_queries(spark, sf):
    """Type and size of every part, as typed text."""
    return table(spark, sf, "part").select(
        F.concat_ws("-", "p_type", F.col("p_size").cast("string")).alias("query_id"),
        F.concat_ws(" ", F.lower("p_type"), F.lit("size"), F.col("p_size").cast("string"), F.lit("nation")).alias("query")).distinct()


def search_words(spark, sf):
    return lists.search_postings(word_queries(spark, sf), postings(spark, sf), record_heads(spark, sf), with_predicates(record_statements(spark, sf), *_TEXTS),
                                 graph_terms(spark), ALLOWED, 20, _LANG)


_WORD_SEARCH_SQL = f"""{WORDS_SQL},
wq AS (SELECT DISTINCT p_type || '-' || p_size AS query_id, p_type || ' size ' || p_size || ' nation' AS query FROM part),
whits AS (SELECT query_id, resource_id, word, predicate, value, lang FROM (SELECT query_id, unnest(list_distinct(string_split(upper(query), ' '))) AS word FROM wq) JOIN seen_words USING (word)),
scored AS (SELECT query_id, resource_id, count(DISTINCT word) AS score FROM whits GROUP BY query_id, resource_id),
wnames AS (SELECT subject AS resource_id, arg_min(object_value, (CASE WHEN predicate = '{v.NAME}' THEN '0' ELSE '1' END) || (CASE lang WHEN 'en' THEN '0' WHEN 'ru' THEN '2' ELSE '1' END) || upper(object_value)) AS display_name
  FROM seen WHERE predicate IN ('{v.NAME}', '{v.ALIAS}') GROUP BY 1),
wplaced AS (SELECT query_id, resource_id, score, coalesce(display_name, resource_id) AS display_name, cassette_id,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, upper(coalesce(display_name, resource_id)), resource_id) AS place
  FROM scored JOIN seen_heads USING (resource_id) LEFT JOIN wnames USING (resource_id) QUALIFY place <= 20),
wevidence AS (SELECT query_id, resource_id, string_agg(predicate || '=' || value, ';' ORDER BY predicate, value) AS matches
  FROM (SELECT DISTINCT query_id, resource_id, predicate, value, lang FROM whits) GROUP BY ALL)"""
_TYPES_SQL = f"types AS (SELECT subject AS resource_id, min(object_value) AS type FROM seen WHERE predicate = '{v.RDF_TYPE}' GROUP BY 1)"


@query("f1_query_variants", f"WITH {_VARIANTS_SQL} SELECT query_id, search_key, CAST(rank AS INTEGER) AS rank FROM variants")
def _(spark, sf):
    return search.query_variants(name_queries(spark, sf))


@query("f2_keyboard_swap", f"SELECT p_partkey, {_SWAPPED.replace('query', 'p_name')} AS swapped FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.swap_keyboard("p_name").alias("swapped"))


_CYRILLIC = "replace(replace(replace(replace(replace(replace(lower(p_name), 'g', 'щ'), 'e', 'ё'), 't', 'ж'), 'r', 'я'), 'o', 'ю'), 'd', 'ъ')"


@query("f3_cyrillic_to_latin", """SELECT p_partkey, replace(replace(replace(replace(replace(replace(lower(p_name), 'd', ''), 'o', chr(1)), 't', 'zh'), 'g', 'shch'), 'r', 'ya'), 'e', 'yo') AS x_,
replace(x_, chr(1), 'yu') AS latin FROM part""".replace("SELECT p_partkey, ", "SELECT p_partkey, latin FROM (SELECT p_partkey, ", 1) + ")")
def _(spark, sf):
    # part names with some letters written in Cyrillic
    mixed = F.translate(F.lower("p_name"), "getrod", "щёжяюъ")
    return table(spark, sf, "part").select("p_partkey", text.cyrillic_to_latin(mixed).alias("latin"))


@query("f4_latin_to_cyrillic", f"SELECT p_partkey, {_translit('p_name')} AS cyrillic FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.latin_to_cyrillic("p_name").alias("cyrillic"))


@query("f5_name_scores", f"""{G}, {NAME_KEYS_SQL}, {_VARIANTS_SQL}
SELECT query_id, resource_id, value, CASE WHEN phrase = search_key THEN 3 WHEN starts_with(phrase, search_key) THEN 2 ELSE 1 END AS score
FROM seen_keys JOIN variants USING (search_key)""")
def _(spark, sf):
    return search.name_hits(name_queries(spark, sf), name_starts(spark, sf), ALLOWED).select("query_id", "resource_id", "value", "score")


@query("f6_search_names", f"{_NAME_SEARCH_SQL} SELECT query_id, CAST(place AS INTEGER) AS place, resource_id, display_name, type, type_label, score, cassette_id, matches FROM found")
def _(spark, sf):
    return _flat(search_names(spark, sf))


@query("f7_search_words", f"""{G}, {kinds_sql()}, {_WORD_SEARCH_SQL}, {_TYPES_SQL}
SELECT query_id, CAST(place AS INTEGER) AS place, resource_id, display_name, type, type_label, score, cassette_id, matches
FROM wplaced JOIN wevidence USING (query_id, resource_id) JOIN types USING (resource_id) JOIN kinds USING (type)""")
def _(spark, sf):
    return _flat(search_words(spark, sf))


def document_records(spark, sf):
    """Documents as records whose content is searched, whole texts."""
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("doc:"), "doc_id").alias("resource_id"), F.lit(O + "document").alias("type"), F.lit("cass0").alias("cassette_id"), F.lit("documents").alias("source_path"),
        F.col("doc_id").alias("ordinal"), F.lit(None).cast("timestamp").alias("modified_at"),
        F.array(F.struct(F.lit(v.DOC_CONTENT).alias("predicate"), F.lit(v.LITERAL).alias("kind"), F.col("text").alias("value"), "lang", F.lit(None).cast("string").alias("datatype"))).alias("props"))
    return derived(spark, sf, "document_records", lambda: lists.number_records(docs))


def document_postings(spark, sf):
    return derived(spark, sf, "document_postings", lambda: lists.postings(document_records(spark, sf)).repartitionByRange("word", "block").sortWithinPartitions("word", "block"), lists.delta_coded)


@query("f7_search_documents", f"""WITH d AS MATERIALIZED (SELECT doc_id, unnest(list_distinct({DOC_WORDS})) AS word FROM documents),
q AS (SELECT DISTINCT item_id, unnest({DOC_WORDS}) AS word FROM benchmark),
scored AS (SELECT item_id, doc_id, count(*) AS score FROM q JOIN d USING (word) GROUP BY item_id, doc_id)
SELECT 'item:' || item_id AS query_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, upper('doc:' || doc_id)) AS INTEGER) AS place, 'doc:' || doc_id AS resource_id, score
FROM scored QUALIFY place <= 20""")
def _(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.concat(F.lit("item:"), "item_id").alias("query_id"), F.col("text").alias("query"))
    records = document_records(spark, sf)
    found = lists.search_postings(asked, document_postings(spark, sf), projection.heads(records, "number"), projection.triples(records), graph_terms(spark), ALLOWED, 20, _LANG)
    return found.select("query_id", "place", "resource_id", "score")


@query("f8_evidence", f"""{_NAME_SEARCH_SQL} SELECT query_id, resource_id, predicate, value, lang FROM
(SELECT DISTINCT query_id, resource_id, predicate, value, lang FROM hits) JOIN placed USING (query_id, resource_id)""")
def _(spark, sf):
    return search_names(spark, sf).select("query_id", "resource_id", F.explode("matches").alias("m")).select(
        "query_id", "resource_id", "m.*")


@query("f9_merge_results", f"""{_NAME_SEARCH_SQL}, {_WORD_SEARCH_SQL},
n AS (SELECT split_part(query_id, ':', 2) AS query_id, resource_id, place, score, matches FROM found WHERE query_id LIKE 'name:%'),
w AS (SELECT w0.query_id, resource_id, place, score FROM (
  SELECT query_id, resource_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, upper(coalesce(display_name, resource_id)), resource_id) AS place
  FROM (SELECT query_id, resource_id, 1 AS score FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS query_id FROM part) JOIN seen_words ON word = upper(query_id) GROUP BY query_id, resource_id)
  JOIN seen_heads USING (resource_id) LEFT JOIN wnames USING (resource_id) QUALIFY place <= 20) w0)
SELECT query_id, resource_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n.place NULLS LAST, w.place) AS INTEGER) AS place,
CAST(greatest(n.score, w.score) AS BIGINT) AS score FROM n FULL JOIN w USING (query_id, resource_id)""")
def _(spark, sf):
    first = F.split("p_name", " ")[0]
    asked = table(spark, sf, "part").select(first.alias("query_id"), first.alias("query")).distinct()
    shown = record_heads(spark, sf), record_statements(spark, sf), graph_terms(spark), ALLOWED
    names = search.search_names(asked, name_starts(spark, sf), *shown, None, _LANG)
    words = lists.search_postings(asked, postings(spark, sf), *shown, 20, _LANG)
    merged = search.merge_results(names, words, None)
    return merged.select("query_id", "resource_id", "place", F.col("score").cast("bigint").alias("score"))


@query("f10_type_facets", f"""{_NAME_SEARCH_SQL} SELECT query_id, coalesce(type, '$unknown') AS type, min(type_label) AS label, count(*) AS n
FROM found GROUP BY 1, 2""")
def _(spark, sf):
    return search.type_facets(search_names(spark, sf))


@query("f11_filter_by_type", f"{_NAME_SEARCH_SQL} SELECT query_id, resource_id FROM found WHERE type = '{O}kind-PROMO'")
def _(spark, sf):
    return search.filter_by_type(search_names(spark, sf), O + "kind-PROMO").select("query_id", "resource_id")


@query("f14_shown_matches", f"""{_NAME_SEARCH_SQL} SELECT query_id, resource_id, string_agg(value, ';' ORDER BY p, value) AS matches FROM (
SELECT query_id, resource_id, value, min(predicate) AS p FROM hits JOIN placed USING (query_id, resource_id) GROUP BY ALL) GROUP BY ALL""")
def _(spark, sf):
    return search.shown_matches(search_names(spark, sf)).select("query_id", "resource_id", F.array_join("matches", ";").alias("matches"))


_SUMMARY_SQL = f"""{G}, {kinds_sql()}, names AS (SELECT subject AS resource_id, arg_min(object_value, (CASE WHEN predicate = '{v.NAME}' THEN '0' ELSE '1' END)
  || (CASE lang WHEN 'en' THEN '0' WHEN 'ru' THEN '2' ELSE '1' END) || upper(object_value)) AS display_name
  FROM seen WHERE predicate IN ('{v.NAME}', '{v.ALIAS}') GROUP BY 1), {_TYPES_SQL}"""


@query("r3_summaries", f"""{_SUMMARY_SQL} SELECT h.resource_id, coalesce(display_name, h.resource_id) AS display_name, type, type_label, h.cassette_id
FROM seen_heads h LEFT JOIN names USING (resource_id) LEFT JOIN types USING (resource_id) LEFT JOIN kinds USING (type)""")
def _(spark, sf):
    return portrait.summaries(heads(spark, sf), triples_by_subject(spark, sf), graph_terms(spark), ALLOWED, _LANG)


@query("r4_best_names", f"{_SUMMARY_SQL} SELECT resource_id, display_name FROM names")
def _(spark, sf):
    return portrait.display_names(triples(spark, sf, v.NAME_PREDICATES), ALLOWED, _LANG)


@query("f13_class_instances", f"""{_SUMMARY_SQL} SELECT h.resource_id, coalesce(display_name, h.resource_id) AS display_name, type, type_label, h.cassette_id
FROM seen_heads h JOIN types USING (resource_id) JOIN kinds USING (type) LEFT JOIN names USING (resource_id) WHERE is_photo""")
def _(spark, sf):
    terms = graph_terms(spark)
    return search.class_instances(heads(spark, sf), triples_by_subject(spark, sf), terms, ontology.ancestors(terms),
                                  ALLOWED, v.PHOTO_DOCUMENT, _LANG)


@query("f13_class_page", f"""{_SUMMARY_SQL} SELECT h.resource_id, coalesce(display_name, h.resource_id) AS display_name,
count(*) OVER () AS total FROM seen_heads h JOIN types USING (resource_id) JOIN kinds USING (type) LEFT JOIN names USING (resource_id) WHERE is_person
ORDER BY lower(coalesce(display_name, h.resource_id)), 2, 1 LIMIT 50 OFFSET 100""")
def _(spark, sf):
    return search.class_page(_persons(spark, sf), 100, 50).select("resource_id", "display_name", "total")


def _persons(spark, sf):
    terms = graph_terms(spark)
    return search.class_instances(heads(spark, sf), triples_by_subject(spark, sf), terms, ontology.ancestors(terms), ALLOWED, O + "person", _LANG)


@query("f13_deep_page", f"""{_SUMMARY_SQL} SELECT type, h.resource_id, coalesce(display_name, h.resource_id) AS display_name,
row_number() OVER (PARTITION BY type ORDER BY lower(coalesce(display_name, h.resource_id)), coalesce(display_name, h.resource_id), h.resource_id) AS place,
count(*) OVER (PARTITION BY type) AS total FROM seen_heads h JOIN types USING (resource_id) JOIN kinds USING (type) LEFT JOIN names USING (resource_id) WHERE type = '{v.COLLECTION_MEMBER}'
QUALIFY place BETWEEN 5001 AND 5050""")
def _(spark, sf):
    # a page of one class among all classes, from ranks that are stored once
    def ranks():
        shown = portrait.summaries(heads(spark, sf), triples_by_subject(spark, sf), graph_terms(spark), ALLOWED, _LANG).where("type is not null")
        return pages.ranked(shown.select("type", "resource_id", "display_name"), ["type"], F.lower("display_name"), "display_name", "resource_id")

    stored = derived(spark, sf, "class_ranks", ranks, pages.in_blocks)
    starts = derived(spark, sf, "class_starts", lambda: pages.groups(stored, ["type"]))
    return pages.page(stored, starts, 5000, 50, type=v.COLLECTION_MEMBER).select("type", "resource_id", "display_name", "place", "total")
