"""Projection (P), lookups (Q), access filter on the node graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as v
from ..functions import text
from ..operators import match, postings, prefix_intervals, projection as p
from ..operators.access import visible
from .inputs import ALLOWED, O, graph_current, graph_sql, literal_rows, table
from .registry import query

G = "WITH " + graph_sql()
GUID = ("substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2) || substr({h}, 11, 2) || substr({h}, 9, 2) || "
        "substr({h}, 15, 2) || substr({h}, 13, 2) || substr({h}, 17, 16)")
_RECORD = f"WITH r AS (SELECT *, sha256(concat_ws(chr(31), 'source-record', cassette_id, source_path, '0', resource_id)) AS h FROM heads)"
NAMED = ("customer:", "supplier:", "part:", "nation:", "region:")


def words_sql(value: str) -> str:
    """Words of ASCII text."""
    return ("list_filter(list_transform(regexp_split_to_array(upper(" + value + "), '[ \\r\\n\\t,.:!?\"''=\\\\|/()\\[\\]{};*<>-]'), "
            "lambda x: trim(x)), lambda x: x <> '')")


NAME_KEYS_SQL = f"""
name_rows AS (SELECT subject AS resource_id, predicate, object_value AS value, lang, cassette_id, {words_sql('object_value')} AS words
  FROM triples WHERE object_kind = 'literal' AND predicate IN ('{v.NAME}', '{v.ALIAS}')),
name_keys AS (SELECT resource_id, predicate, value, lang, cassette_id, array_to_string(words, ' ') AS phrase,
  unnest(list_distinct(list_concat(list_transform(range(1, length(array_to_string(words, ' ')) + 1), lambda n: left(array_to_string(words, ' '), n)),
    flatten(list_transform(words, lambda w: list_transform(range(1, length(w) + 1), lambda n: left(w, n))))))) AS search_key FROM name_rows),
seen_keys AS (SELECT * FROM name_keys WHERE cassette_id IN ('cass0','cass1','cass2','cass3','$system'))"""
WORDS_SQL = f"""
word_index AS (SELECT subject AS resource_id, predicate, object_value AS value, lang, cassette_id,
  unnest(list_distinct({words_sql('object_value')})) AS word FROM triples
  WHERE object_kind = 'literal' AND predicate IN ('{v.NAME}', '{v.ALIAS}', '{v.DESCRIPTION}', '{v.DOC_CONTENT}')),
seen_words AS (SELECT * FROM word_index WHERE cassette_id IN ('cass0','cass1','cass2','cass3','$system'))"""


def triples(spark, sf, nodes=None, predicates=None):
    return p.triples(graph_current(spark, sf, nodes, predicates))


def heads(spark, sf, nodes=None):
    return p.heads(graph_current(spark, sf, nodes, ()))


@query("p1_stable_ids", "WITH " + graph_sql().split(",\nseen_heads")[0] + f""", r AS (
  SELECT *, sha256(concat_ws(chr(31), 'source-record', cassette_id, source_path, '0', resource_id)) AS h FROM heads)
SELECT resource_id, {GUID.format(h='h')} AS source_record_id FROM r""")
def _(spark, sf):
    return heads(spark, sf).select("resource_id", "source_record_id")


@query("p2_heads", f"{G} SELECT resource_id, cassette_id, source_path, false AS is_deleted FROM heads")
def _(spark, sf):
    return heads(spark, sf).select("resource_id", "cassette_id", "source_path", "is_deleted")


@query("p3_triples", f"{G} SELECT subject, predicate, object_kind, object_value, lang, cassette_id FROM triples")
def _(spark, sf):
    return triples(spark, sf).select("subject", "predicate", "object_kind", "object_value", "lang", "cassette_id")


@query("p3_triple_ids", G + f""", numbered AS (
  SELECT *, sha256(concat_ws(chr(31), 'source-record', cassette_id, source_path, '0', subject)) AS h FROM triples),
hashed AS (SELECT *, sha256(concat_ws(chr(31), 'triple', {GUID.format(h='h')}, CAST(ord AS VARCHAR), subject, predicate,
  CASE object_kind WHEN 'iri' THEN '1' ELSE '2' END, object_value, coalesce(lang, chr(0)), chr(0))) AS t FROM numbered)
SELECT subject, predicate, {GUID.format(h='t')} AS triple_id FROM hashed""")
def _(spark, sf):
    return triples(spark, sf).select("subject", "predicate", "triple_id")


DOC_WORDS = ("list_filter(list_transform(regexp_split_to_array(replace(upper(replace(text, 'ß', chr(1))), chr(1), 'ß'), "
              "'[ \\r\\n\\t,.:!?\"''=\\\\|/()\\[\\]{};*<>-]'), lambda x: trim(x)), lambda x: x <> '')")


@query("p4_document_tokens", f"SELECT doc_id, CAST(len({DOC_WORDS}) AS BIGINT) AS n_words, array_to_string({DOC_WORDS}, ' ') AS phrase FROM documents")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    words = docs.select("doc_id", text.tokens("text").alias("words"))
    return words.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.array_join("words", " ").alias("phrase"))


@query("p5_name_keys", f"{G}, {NAME_KEYS_SQL} SELECT search_key, resource_id, predicate, value, lang, cassette_id FROM name_keys")
def _(spark, sf):
    return p.name_keys(triples(spark, sf, NAMED + ("order:",), v.NAME_PREDICATES)).select(
        "search_key", "resource_id", "predicate", "value", "lang", "cassette_id")


@query("p6_word_index", f"{G}, {WORDS_SQL} SELECT word, resource_id, predicate, value, lang, cassette_id FROM word_index")
def _(spark, sf):
    return p.word_index(triples(spark, sf, NAMED + ("order:",), v.WORD_PREDICATES)).select(
        "word", "resource_id", "predicate", "value", "lang", "cassette_id")


@query("p6_document_words", f"""SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct({DOC_WORDS})) AS word FROM documents)
GROUP BY ALL""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.select(
        F.sha2(F.concat_ws("/", F.lit("doc"), "doc_id"), 256).alias("triple_id"), F.col("doc_id").alias("subject"),
        F.lit(v.DOC_CONTENT).alias("predicate"), F.lit(v.LITERAL).alias("object_kind"), F.col("text").alias("object_value"),
        "lang", F.lit("cass0").alias("cassette_id"))
    return p.word_index(rows).groupBy(F.col("resource_id").alias("doc_id"), "word").agg(F.count("*").alias("n"))


@query("p6_postings", f"{G}, {WORDS_SQL} SELECT DISTINCT word, resource_id, cassette_id FROM word_index")
def _(spark, sf):
    records = postings.number_records(graph_current(spark, sf, NAMED + ("order:",), v.WORD_PREDICATES))
    rows = postings.posting_rows(postings.postings(records))
    return rows.join(records.select("number", "resource_id"), "number").select("word", "resource_id", "cassette_id")


@query("p5_name_starts", f"""{G}, {NAME_KEYS_SQL} SELECT k.search_key, resource_id, predicate, value, lang, cassette_id FROM name_keys k
SEMI JOIN (SELECT DISTINCT left(p_name, length(p_name) % 4 + 1) AS search_key FROM (SELECT upper(split_part(p_name, ' ', 2)) AS p_name FROM part)) s ON s.search_key = k.search_key""")
def _(spark, sf):
    # prefixes of one to four letters, met in the sorted starts
    word = F.upper(F.split("p_name", " ")[1])
    keys = table(spark, sf, "part").select(F.left(word, F.length(word) % 4 + 1).alias("search_key"))
    starts = prefix_intervals.name_starts(triples(spark, sf, NAMED + ("order:",), v.NAME_PREDICATES))
    return prefix_intervals.rows_under(starts, keys).select("search_key", "resource_id", "predicate", "value", "lang", "cassette_id")


@query("p7_build_counts", f"""{G}, {NAME_KEYS_SQL}, {WORDS_SQL}
SELECT 'resources' AS part, count(*) AS n_rows FROM heads UNION ALL SELECT 'triples', count(*) FROM triples
UNION ALL SELECT 'name_keys', count(*) FROM name_keys UNION ALL SELECT 'word_index', count(*) FROM word_index""")
def _(spark, sf):
    t = triples(spark, sf)
    named = triples(spark, sf, NAMED + ("order:",), v.WORD_PREDICATES)
    return p.build_counts(heads(spark, sf), t, p.name_keys(named), p.word_index(named))


_PATTERNS = [("p", None, f"{O}citizen", None, None), ("sp", "part:7", f"{O}alias", None, None), ("s", "order:5", None, None, None),
             ("po", None, f"{O}in-org", "iri", "supplier:3"), ("o", None, None, None, "nation:3"), ("pk", None, f"{O}date", "literal", None)]
_PATTERN_SQL = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in _PATTERNS)


@query("q1_match_patterns", f"""{G}, patterns AS (SELECT * FROM (VALUES {_PATTERN_SQL}) AS t(pattern_id, s, p, k, o))
SELECT pattern_id, subject, predicate, object_value FROM triples JOIN patterns
ON (s IS NULL OR s = subject) AND (p IS NULL OR p = predicate) AND (k IS NULL OR k = object_kind) AND (o IS NULL OR o = object_value)
WHERE cassette_id IN ('cass0','cass1','cass2','cass3')""")
def _(spark, sf):
    patterns = literal_rows(spark, _PATTERNS, "pattern_id string, subject string, predicate string, object_kind string, object_value string")
    return match.match_patterns(triples(spark, sf), patterns, ALLOWED).select("pattern_id", "subject", "predicate", "object_value")


@query("q1_find_triples", f"""{G} SELECT subject, object_value FROM triples
WHERE predicate = '{O}located-in' AND object_kind = 'iri' AND cassette_id IN ('cass0','cass1','cass2','cass3')""")
def _(spark, sf):
    return match.find_triples(triples(spark, sf, ("supplier:", "nation:"), (O + "located-in",)), ALLOWED,
                              predicate=O + "located-in", object_kind=v.IRI).select("subject", "object_value")


@query("q2_find_heads", f"""{G} SELECT resource_id, cassette_id FROM heads
WHERE resource_id IN (SELECT 'customer:' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def _(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("id"))
    return match.find_heads(heads(spark, sf, ("customer:",)), urgent).select("resource_id", "cassette_id")


@query("q3_visible_heads", f"{G} SELECT resource_id, cassette_id FROM seen_heads")
def _(spark, sf):
    return match.visible_heads(heads(spark, sf), ALLOWED).select("resource_id", "cassette_id")


@query("q4_names_by_key", f"""{G}, {NAME_KEYS_SQL} SELECT search_key, resource_id, predicate, value, lang FROM name_keys
WHERE cassette_id IN ('cass0','cass1','cass2','cass3') AND search_key IN (SELECT upper(split_part(p_name, ' ', 1)) FROM part)""")
def _(spark, sf):
    keys = table(spark, sf, "part").select(text.phrase(F.split("p_name", " ")[0]).alias("key")).distinct()
    names = p.name_keys(triples(spark, sf, NAMED + ("order:",), v.NAME_PREDICATES))
    return match.names_by_key(names, keys, ALLOWED).select("search_key", "resource_id", "predicate", "value", "lang")


@query("q4_names_by_resource", f"""{G} SELECT DISTINCT subject AS resource_id, predicate, object_value AS value, lang FROM triples
WHERE predicate IN ('{v.NAME}', '{v.ALIAS}') AND cassette_id IN ('cass0','cass1','cass2','cass3')
AND subject IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_acctbal < 0)""")
def _(spark, sf):
    ids = table(spark, sf, "customer").where("c_acctbal < 0").select(
        F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    names = p.name_keys(triples(spark, sf, ("customer:",), v.NAME_PREDICATES))
    return match.names_by_resource(names, ids, ALLOWED).select("resource_id", "predicate", "value", "lang")


@query("q5_find_words", f"""{G}, {WORDS_SQL} SELECT word, resource_id, predicate FROM word_index
WHERE cassette_id IN ('cass0','cass1','cass2','cass3') AND word IN (SELECT upper(p_type) FROM part UNION SELECT upper(r_name) FROM region)""")
def _(spark, sf):
    words = table(spark, sf, "part").select(F.upper("p_type").alias("w")).union(
        table(spark, sf, "region").select(F.upper("r_name"))).distinct()
    index = p.word_index(triples(spark, sf, NAMED + ("order:",), v.WORD_PREDICATES))
    return match.find_words(index, words, ALLOWED).select("word", "resource_id", "predicate")


@query("q6_resource_types", f"""{G} SELECT subject AS resource_id, min(object_value) AS type, count(DISTINCT object_value) AS n_types
FROM seen WHERE predicate = '{v.RDF_TYPE}' GROUP BY 1""")
def _(spark, sf):
    rows = triples(spark, sf, None, ())
    counted = match.resource_types(rows, ALLOWED).groupBy("resource_id").agg(F.count("*").alias("n_types"))
    return match.first_type(rows, ALLOWED).join(counted, "resource_id").select("resource_id", "type", "n_types")


@query("q7_direct_targets", f"""{G} SELECT DISTINCT subject AS resource_id, object_value AS target_id FROM seen
WHERE predicate = '{v.COLLECTION_ITEM}' AND object_kind = 'iri'""")
def _(spark, sf):
    return match.direct_targets(triples(spark, sf, ("member:",), (v.COLLECTION_ITEM,)), ALLOWED, v.COLLECTION_ITEM)


@query("q7_inverse_sources", f"""{G} SELECT DISTINCT object_value AS resource_id, subject AS source_id FROM seen
WHERE predicate = '{v.IN_DOC}' AND object_kind = 'iri'""")
def _(spark, sf):
    return match.inverse_sources(triples(spark, sf, ("reflection:",), (v.IN_DOC,)), ALLOWED, v.IN_DOC)


@query("q8_existing_links", f"""{G}, wanted AS (SELECT 'customer:' || c_custkey AS subject, '{O}citizen' AS predicate, 'nation:' || (c_custkey % 25) AS target_id FROM customer)
SELECT w.* FROM wanted w WHERE EXISTS (SELECT 1 FROM triples t WHERE t.subject = w.subject AND t.predicate = w.predicate
AND t.object_value = w.target_id AND t.cassette_id IN ('cass0','cass1','cass2','cass3'))""")
def _(spark, sf):
    wanted = table(spark, sf, "customer").select(
        F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("subject"), F.lit(O + "citizen").alias("predicate"),
        F.concat(F.lit("nation:"), (F.col("c_custkey") % 25).cast("string")).alias("target_id"))
    return match.existing_links(triples(spark, sf, ("customer:",), (O + "citizen",)), wanted, ALLOWED)


@query("q9_first_literal", f"""{G} SELECT subject AS resource_id, arg_min(object_value, coalesce(lang, '') || chr(1) || object_value) AS value FROM seen
WHERE predicate = '{v.DESCRIPTION}' AND object_kind = 'literal' AND trim(object_value) <> '' GROUP BY 1""")
def _(spark, sf):
    return match.first_literal(triples(spark, sf, ("supplier:", "part:"), (v.DESCRIPTION,)), ALLOWED, v.DESCRIPTION)


@query("a5_row_filter", f"""{G} SELECT cassette_id, count(*) AS n FROM triples
WHERE cassette_id IN (SELECT DISTINCT 'cass' || (n_regionkey % 3) FROM nation) OR cassette_id = '$system' GROUP BY 1""")
def _(spark, sf):
    allowed = table(spark, sf, "nation").select(F.concat(F.lit("cass"), (F.col("n_regionkey") % 3).cast("string")).alias("id")).distinct()
    return visible(triples(spark, sf), allowed).groupBy("cassette_id").agg(F.count("*").alias("n"))
