"""Canonicalization (C), documents (D), checks (V), appends (W), sources (S) and the incremental log (X)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import vocab as v
from ..functions import ids, times, uris
from ..operators import append as w, documents as d, ontology, projection as p, quality as q
from ..session import scratch_folder
from ..sources import published
from ..sources.files import canonical_records
from ..streaming import incremental
from . import store
from .graph_queries import G
from .inputs import LOG_WITH, O, event_log, event_stream, graph_current, literal_rows, table
from .ontology_queries import T, taxonomy
from .registry import ORACLES, QUERIES, query
from ..schemas import CASSETTES


def _day(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- canonicalization --------------------------------------------------------------------------------------

@query("c1_clean_ids", "SELECT page_id, replace(replace(url, '/', '|'), '|', '') AS id FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", ids.clean_id(F.translate("url", "/", "|")).alias("id"))


@query("c2_revision_times", """WITH x AS (SELECT o_orderkey, o_orderdate AS t FROM orders)
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 6 THEN '0001-01-01 00:00:00' WHEN 3 THEN strftime(t - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') ELSE strftime(t, '%Y-%m-%d %H:%M:%S') END AS dated FROM x""")
def _(spark, sf):
    t, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 7
    text = (F.when(k == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(t, "yyyy-MM-dd")).when(k == 2, F.date_format(t, "M/d/yyyy"))
            .when(k == 3, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+03:00'")).when(k == 4, F.date_format(t, "dd.MM.yyyy HH:mm:ss"))
            .when(k == 5, F.date_format(t, "EEE, d MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.lit(" ")))
    return table(spark, sf, "orders").select("o_orderkey", _day(times.revision_time(text)).alias("dated"))


@query("c3_term_iris", f"SELECT event_id, '{O}' || event_type AS iri FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", ids.iri("event_type").alias("iri"))


def element_log(spark, sf):
    """Events as parsed elements: signups substitute, some errors delete without target, clicks have no id."""
    e = table(spark, sf, "events")
    none = F.from_json(F.lit("{}"), "map<string,string>")
    user = F.concat(F.lit("u|"), F.col("user_id").cast("string"))
    kind = F.col("event_type")
    attrs = (F.when(kind == "error", F.when(F.col("value") > 50, F.create_map(F.lit("id"), user)).otherwise(none))
             .when(kind == "signup", F.when(F.col("value") > 50, F.create_map(F.lit("old-id"), user, F.lit("new-id"), F.lit("v|1"))).otherwise(F.create_map(F.lit("rdf:about"), user)))
             .when(kind == "click", none).otherwise(F.create_map(F.lit("rdf:about"), user)))

    def child(name, attributes, value):
        return F.struct(F.lit(name).alias("name"), attributes.alias("attrs"), value.alias("value"))

    empty = F.lit("")
    children = F.array(
        child("name", F.create_map(F.lit("xml:lang"), F.lit("en")), kind),
        child("friend", F.create_map(F.lit("rdf:resource"), F.concat(F.lit("x|"), user)), empty),
        child("iisstore", F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("uri"), F.lit("iiss://A@h/0001/0002"))).otherwise(none), empty),
        child("newid", F.create_map(F.lit("rdf:resource"), F.lit("w|2")), empty))
    name = F.when(kind == "error", "delete").when(kind == "signup", "substitute").otherwise(kind)
    return e.select(
        F.lit("0").alias("source_seq"), F.col("event_id").alias("ordinal"), F.lit("cass").alias("cassette_id"), F.lit("Cass").alias("cassette_name"),
        F.lit(" db ").alias("db_id"), F.lit("/data/Cass/originals/0001/log.fog").alias("source_path"), name.alias("name"),
        F.map_concat(attrs, F.create_map(F.lit("mT"), F.date_format("ts", "yyyy-MM-dd"))).alias("attrs"), children.alias("children"))


_ANON = ("'urn:factloom:anonymous:' || sha256('CASS' || chr(10) || 'db' || chr(10) || 'ORIGINALS/0001/LOG.FOG' || chr(10) || event_id || chr(10) || event_type)")
_ELEMENT_SQL = f"""WITH rec AS (SELECT event_id AS ordinal, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'substitute' ELSE 'resource' END AS kind,
CASE event_type WHEN 'click' THEN {_ANON} ELSE 'u' || user_id END AS resource_id, CASE WHEN event_type NOT IN ('error', 'signup') THEN '{O}' || event_type END AS type,
CASE WHEN event_type = 'signup' THEN CASE WHEN value > 50 THEN 'v1' ELSE 'w2' END END AS substitute_target, strftime(ts, '%Y-%m-%d') || ' 00:00:00' AS dated, event_type, user_id
FROM events WHERE event_type <> 'error' OR value > 50)"""


@query("c5_anonymous_ids", f"SELECT event_id, {_ANON} AS id FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", ids.anonymous_id(
        F.lit("cass"), F.lit(" db "), F.lit("C:\\data\\Cass\\originals\\0001\\log.fog/"), "event_id", "event_type", "urn:factloom:anonymous:").alias("id"))


@query("c6_c7_directives", f"{_ELEMENT_SQL} SELECT ordinal, kind, resource_id, substitute_target, dated FROM rec WHERE kind <> 'resource'")
def _(spark, sf):
    return canonical_records(element_log(spark, sf)).where("kind <> 'resource'").select(
        "ordinal", "kind", "resource_id", "substitute_target", _day("modified_at").alias("dated"))


@query("c4_properties", f"""{_ELEMENT_SQL} SELECT ordinal, resource_id, type, unnest(['{O}name', '{O}friend', '{O}newid'] || CASE WHEN ordinal % 2 = 0 THEN ['{O}uri'] ELSE [] END) AS predicate,
unnest([event_type, 'xu' || user_id, 'w2'] || CASE WHEN ordinal % 2 = 0 THEN ['iiss://A@h/0001/0002'] ELSE [] END) AS value FROM rec WHERE kind = 'resource'""")
def _(spark, sf):
    return (canonical_records(element_log(spark, sf)).where("kind = 'resource'")
            .select("ordinal", "resource_id", "type", F.explode("props").alias("p")).select("ordinal", "resource_id", "type", "p.predicate", "p.value"))


# --- documents ------------------------------------------------------------------------------------------------

@query("d1_document_uris", """SELECT 'part' AS kind, p_partkey AS key, 'Cass' || (p_partkey % 5) AS cassette, lpad(CAST(p_partkey // 1000 % 10000 AS VARCHAR), 4, '0') AS folder,
lpad(CAST(p_partkey % 1000 AS VARCHAR), 4, '0') AS number, true AS is_document FROM part UNION ALL SELECT 'page', page_id, NULL, NULL, NULL, false FROM pages""")
def _(spark, sf):
    parts = graph_current(spark, sf, ("part:",), (v.URI,)).select(
        F.lit("part").alias("kind"), F.substring("resource_id", 6, 20).cast("bigint").alias("key"), F.col("props")[0]["value"].alias("uri"))
    pages = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("key"), F.col("url").alias("uri"))
    known = uris.is_document_uri("uri")
    return parts.unionByName(pages).select("kind", "key", F.when(known, uris.document_cassette("uri")).alias("cassette"),
                                           F.when(known, uris.document_folder("uri")).alias("folder"), F.when(known, uris.document_number("uri")).alias("number"), known.alias("is_document"))


@query("d1_built_uris", "SELECT c_custkey, 'iiss://My%20' || c_mktsegment || '@iis.nsk.su/0001/' || lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS uri FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", uris.document_uri(
        F.concat(F.lit("My "), "c_mktsegment"), F.lit("0001"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0")).alias("uri"))


def _doc_cassettes(spark):
    return literal_rows(spark, [(f"cass{i}", f"Cass{i}", f"/c{i}", i != 4, "read", False) for i in range(5)], CASSETTES)


def doc_files(spark, sf):
    """Files of parts: an original unless the size is a multiple of 7, previews by size; ties of 11 twice."""
    parts = table(spark, sf, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    folder, number = F.lpad((F.floor(k / 1000) % 10000).cast("string"), 4, "0"), F.lpad((k % 1000).cast("string"), 4, "0")
    day = F.lit("2024-01-01").cast("timestamp")

    def one(tree, ext, test, at):
        return F.when(test, F.struct(F.lit(tree).alias("tree"), F.lit(ext).alias("ext"), at.alias("mtime")))

    later = F.timestamp_add("DAY", s % 3 - 1, day)
    files = F.filter(F.array(
        one("original", ".tif", s % 7 != 0, day), one("original", ".JPG", s % 11 == 0, day), one("icon", ".jpg", s % 2 == 0, later),
        one("small", ".jpg", s % 3 == 0, later), one("medium", ".pdf", s % 5 == 0, later), one("normal", ".png", s % 4 == 0, later)), lambda f: f.isNotNull())
    cass = F.concat(F.lit("cass"), (k % 5).cast("string"))
    return parts.select(cass.alias("cassette_id"), folder.alias("folder"), number.alias("stem"), F.explode(files).alias("f")).select(
        "cassette_id", "f.tree", "folder", "stem", "f.ext", F.concat_ws("/", "cassette_id", "f.tree", "folder", F.concat("stem", "f.ext")).alias("path"), "f.mtime")


_LOC_SQL = """WITH x AS (SELECT p_partkey AS k, p_size AS s, 'cass' || (p_partkey % 5) AS c, lpad(CAST(p_partkey // 1000 % 10000 AS VARCHAR), 4, '0') AS f, lpad(CAST(p_partkey % 1000 AS VARCHAR), 4, '0') AS n FROM part),
y AS (SELECT *, 'iiss://Cass' || (k % 5) || '@iis.nsk.su/' || f || '/' || n AS document_uri,
  CASE WHEN k % 5 = 4 THEN 'unknown_cassette' WHEN s % 11 = 0 AND s % 7 <> 0 THEN 'ambiguous' END AS problem, (s % 3 >= 1 OR (s % 7 = 0 AND s % 11 <> 0)) AS fresh FROM x),
loc AS (SELECT document_uri, CASE WHEN k % 5 <> 4 THEN c END AS cassette_id, problem,
  CASE WHEN problem IS NULL THEN CASE WHEN s % 7 <> 0 THEN c || '/original/' || f || '/' || n || '.tif' WHEN s % 11 = 0 THEN c || '/original/' || f || '/' || n || '.JPG' END END AS original,
  CASE WHEN problem IS NULL AND fresh AND s % 2 = 0 THEN c || '/icon/' || f || '/' || n || '.jpg' END AS icon,
  CASE WHEN problem IS NULL AND fresh AND s % 3 = 0 THEN c || '/small/' || f || '/' || n || '.jpg' END AS small,
  CASE WHEN problem IS NULL AND fresh AND s % 5 = 0 THEN c || '/medium/' || f || '/' || n || '.pdf' END AS medium,
  CASE WHEN problem IS NULL AND fresh AND s % 4 = 0 THEN c || '/normal/' || f || '/' || n || '.png' END AS normal FROM y)"""


def locations(spark, sf):
    asked = graph_current(spark, sf, ("part:",), (v.URI,)).select(F.col("props")[0]["value"].alias("document_uri"))
    return d.locate(asked, doc_files(spark, sf), _doc_cassettes(spark))


@query("d2_document_locations", f"{_LOC_SQL} SELECT document_uri, cassette_id, problem, original, icon, small, medium, normal FROM loc")
def _(spark, sf):
    return locations(spark, sf).select("document_uri", "cassette_id", "problem", *d.TREES)


@query("d3_fresh_lines", """SELECT o_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS line, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate GROUP BY 1""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return (lines.where(d.fresh_preview("l_shipdate", "o_orderdate")).groupBy(F.concat_ws("/", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line"))
            .agg(F.count("*").alias("n")))


@query("d4_variants", f"""{_LOC_SQL} SELECT document_uri, coalesce(medium, normal, small, icon, original) AS small_path, coalesce(icon, small, medium, normal, original) AS icon_path,
coalesce(normal, medium, small, icon, original) AS normal_path FROM loc""")
def _(spark, sf):
    found = locations(spark, sf)
    for size in ("small", "icon", "normal"):
        found = d.variant(found, size).withColumnRenamed("path", f"{size}_path")
    return found.select("document_uri", "small_path", "icon_path", "normal_path")


@query("d5_best_images", f"""{_LOC_SQL} SELECT document_uri, coalesce(normal, small, icon, original) AS image,
CASE WHEN normal IS NOT NULL THEN 'normal' WHEN small IS NOT NULL THEN 'small' WHEN icon IS NOT NULL THEN 'icon' WHEN original IS NOT NULL THEN 'original' END AS image_variant FROM loc""")
def _(spark, sf):
    return d.best_image(locations(spark, sf)).select("document_uri", "image", "image_variant")


@query("d6_node_documents", f"{G} SELECT h.resource_id, min(object_value) AS document_uri, count(object_value) > 0 AS has_document FROM seen_heads h LEFT JOIN seen t ON t.subject = h.resource_id AND t.predicate = '{v.URI}' GROUP BY 1")
def _(spark, sf):
    return store.nodes(spark, sf).select("resource_id", "document_uri", "has_document")


def _requests(spark, sf):
    state = F.when(F.col("event_type").isin("signup", "view"), "queued").when(F.col("event_type") == "click", "processing").otherwise("failed")
    return table(spark, sf, "events").select(
        F.concat(F.lit("cass"), (F.col("user_id") % 7).cast("string")).alias("cassette_id"), state.alias("state"), F.col("ts").cast("timestamp").alias("requested_at"))


@query("d7_preview_backlog", """WITH r AS (SELECT 'cass' || (user_id % 7) AS cassette_id, CASE WHEN event_type IN ('signup', 'view') THEN 'queued' WHEN event_type = 'click' THEN 'processing' ELSE 'failed' END AS state, ts
FROM events WHERE user_id % 7 < 4)
SELECT cassette_id, CAST(count(*) FILTER (WHERE state = 'queued') AS BIGINT) AS queued, CAST(count(*) FILTER (WHERE state = 'processing') AS BIGINT) AS processing, CAST(count(*) FILTER (WHERE state = 'failed') AS BIGINT) AS failed,
strftime(min(ts) FILTER (WHERE state = 'queued'), '%Y-%m-%d %H:%M:%S') AS oldest_queued FROM r GROUP BY ROLLUP (cassette_id)""")
def _(spark, sf):
    return d.backlog(_requests(spark, sf), _doc_cassettes(spark)).withColumn("oldest_queued", _day("oldest_queued"))


@query("d8_request_faults", """WITH r AS (SELECT *, md5(CAST(event_id AS VARCHAR)) AS id FROM events WHERE user_id % 7 < 5)
SELECT id AS request_id, 'cass' || (user_id % 7) AS folder_cassette_id, 'other_cassette' AS code FROM r WHERE user_id % 3 = 0
UNION ALL SELECT id, 'cass' || (user_id % 7), 'bad_number' FROM r WHERE user_id >= 100
UNION ALL SELECT id, 'cass' || (user_id % 7), 'bad_file_name' FROM r WHERE event_type = 'view'
UNION ALL SELECT id, 'cass' || (user_id % 7), 'bad_metadata' FROM r WHERE value < 1
UNION ALL SELECT left(id, 31) || '-', 'cass' || (user_id % 7), 'bad_id' FROM r WHERE false""")
def _(spark, sf):
    user = F.col("user_id")
    rows = table(spark, sf, "events").select(
        F.md5(F.col("event_id").cast("string")).alias("request_id"), F.concat(F.lit("cass"), (user % 7).cast("string")).alias("folder_cassette_id"),
        F.when(user % 3 == 0, "other").otherwise(F.concat(F.lit("cass"), (user % 7).cast("string"))).alias("cassette_id"), F.lit("iiss://A@h/0001/0002").alias("document_uri"),
        F.lit("0001").alias("folder_name"), F.when(user >= 100, "00001").otherwise("0002").alias("document_number"),
        F.when(F.col("event_type") == "view", "a/b.jpg").otherwise("b.jpg").alias("original_file_name"), F.floor("value").alias("original_length"),
        F.sha2("event_type", 256).alias("original_sha256"), F.lit(0).alias("attempt"))
    return d.request_faults(rows, _doc_cassettes(spark))


# --- checks ------------------------------------------------------------------------------------------------------

# a build that lost every resource whose id ends in 3 and holds one that does not exist
_LOST = "resource_id LIKE '%3'"


@query("v1_verification", f"""{G}, r AS (SELECT count(*) AS n, count(*) FILTER (WHERE {_LOST}) AS lost FROM heads),
t AS (SELECT count(*) AS n, count(*) FILTER (WHERE subject LIKE '%3') AS lost FROM triples)
SELECT 'resources' AS part, n AS expected, n - lost + 1 AS stored, lost AS missing, CAST(1 AS BIGINT) AS extra, false AS is_match, lost > 100 AS samples_truncated FROM r
UNION ALL SELECT 'triples', n, n - lost, lost, 0, false, lost > 100 FROM t""")
def _(spark, sf):
    whole = graph_current(spark, sf)
    part = whole.where(f"NOT {_LOST}")
    stored = p.heads(part)
    return q.verification(p.heads(whole), p.triples(whole), stored.unionByName(stored.limit(1).withColumn("resource_id", F.lit("ghost"))), p.triples(part))


@query("v1_fresh_build", """SELECT unnest(['resources', 'triples']) AS part, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, true AS is_match""")
def _(spark, sf):
    current = graph_current(spark, sf)
    built = store.built(spark, sf)
    return q.verification(p.heads(current), p.triples(current), built.read(spark, "heads"), built.read(spark, "triples")).select("part", "missing", "extra", "is_match")


@query("v1_difference_samples", f"""{G} (SELECT 'missing' AS side, resource_id AS id FROM heads WHERE {_LOST} ORDER BY 2 LIMIT 100)""")
def _(spark, sf):
    whole = p.heads(graph_current(spark, sf))
    return q.difference_samples(whole, whole.where(f"NOT {_LOST}"), "resource_id")


def staged(spark, sf):
    """Writes drawn from orders: the class is the part with the order's customer key, without namespace for some."""
    o = table(spark, sf, "orders")
    k = F.col("o_custkey")

    def prop(predicate, kind, value, lang=None, datatype=None):
        text = lambda x: F.lit(x).cast("string")
        return F.struct(predicate.alias("predicate"), F.lit(kind).alias("kind"), value.alias("value"), text(lang).alias("lang"), text(datatype).alias("datatype"))

    iri = lambda kind, key: F.concat(F.lit(O + kind), key.cast("string"))
    props = F.array(
        prop(iri("cust", k), "literal", F.lit("1")), prop(iri("cust", k), "Literal", F.lit("99"), None, O + "string"),
        prop(iri("supp", k % 7), "resource", F.concat(F.lit("customer:"), k.cast("string")), "en"),
        prop(F.lit("nothing"), "literal", F.lit("x")), prop(F.lit(v.NAME), "literal", F.lit("y")))
    return o.select(
        F.col("o_orderkey").alias("request_id"), F.concat(F.lit("customer:"), k.cast("string")).alias("resource_id"),
        F.when(k % 5 == 0, F.concat(F.lit("part"), k.cast("string"))).when(k % 5 == 1, F.lit("ghost")).when(k % 5 == 2, iri("cust", k))
        .otherwise(iri("part", k)).alias("type_id"), props.alias("props"))


_STAGED_SQL = f"""st AS (SELECT o_orderkey AS request_id, o_custkey AS k, CASE o_custkey % 5 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE '{O}part' || o_custkey END AS class_id FROM orders),
sp AS (SELECT st.*, pos, CASE pos WHEN 0 THEN '{O}cust' || k WHEN 1 THEN '{O}cust' || k WHEN 2 THEN '{O}supp' || (k % 7) WHEN 3 THEN 'nothing' ELSE '{v.NAME}' END AS predicate FROM st, (SELECT unnest([0, 1, 2, 3, 4]) AS pos)),
allow AS (SELECT sp.*, d.property_id IS NOT NULL AS allowed, t.id AS term_id, t.ranges FROM sp LEFT JOIN (SELECT id, ranges FROM dprops UNION ALL SELECT id, ranges FROM oprops) t ON t.id = sp.predicate
  LEFT JOIN direct d ON d.class_id = sp.class_id AND d.property_id = sp.predicate WHERE sp.class_id IS NOT NULL)"""


@query("v2_write_violations", f"""{T}, {_STAGED_SQL}
SELECT request_id, CAST(NULL AS INTEGER) AS pos, 'unknown_class' AS code FROM st WHERE k % 5 = 1 UNION ALL SELECT request_id, NULL, 'not_a_class' FROM st WHERE k % 5 = 2
UNION ALL SELECT request_id, pos, 'unknown_property' FROM allow WHERE term_id IS NULL AND NOT (predicate = '{v.NAME}' AND k % 5 <> 4)
UNION ALL SELECT request_id, pos, 'property_not_allowed' FROM allow WHERE term_id IS NOT NULL AND NOT allowed
UNION ALL SELECT request_id, pos, 'resource_with_metadata' FROM allow WHERE pos = 2 AND allowed
UNION ALL SELECT request_id, pos, 'datatype_not_allowed' FROM allow WHERE pos = 1 AND allowed AND NOT list_contains(ranges, '{O}string')
UNION ALL SELECT DISTINCT request_id, pos, 'not_an_enumeration_value' FROM (SELECT *, unnest(ranges) AS r FROM allow WHERE allowed)
WHERE r LIKE '{O}enum%' AND (r, CASE pos WHEN 0 THEN '1' WHEN 1 THEN '99' ELSE 'customer:' || k END) NOT IN (SELECT range_id, value FROM states)""")
def _(spark, sf):
    terms = taxonomy(spark, sf)
    rows = store.with_predicates(store.record_statements(spark, sf), v.NAME)
    return q.write_violations(staged(spark, sf), terms, ontology.ancestors(terms), rows, ["cass0", "cass1", "cass2", "cass3"])


def _retyped(spark, sf):
    """The graph's customers typed by the taxonomy, every ninth left without type."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    folder = F.concat(F.lit("cass"), (k % 5).cast("string"))
    rows = c.select(F.concat(F.lit("customer:"), k.cast("string")).alias("subject"), F.lit(v.RDF_TYPE).alias("predicate"), F.lit(v.IRI).alias("object_kind"),
                    F.concat(F.lit(O + "part"), (k * 2).cast("string")).alias("object_value"), folder.alias("cassette_id")).where(k % 9 != 0)
    return rows


@query("v3_target_violations", f"""{T}, links AS (SELECT o_orderkey AS request_id, o_custkey % 1500 AS k, 'customer:' || (o_custkey // 2) AS target_id, o_custkey // 2 AS t, '{O}supp' || (o_custkey % 7) AS predicate, o_custkey FROM orders),
ranged AS (SELECT l.*, p.ranges FROM links l JOIN oprops p ON p.id = l.predicate),
shown AS (SELECT * FROM ranged WHERE t % 5 <> 4)
SELECT request_id, target_id, 'target_missing' AS code FROM ranged WHERE t % 5 = 4 UNION ALL SELECT request_id, target_id, 'target_untyped' FROM shown WHERE t % 9 = 0
UNION ALL SELECT request_id, target_id, 'property_without_class_range' FROM shown WHERE t % 9 <> 0 AND len(ranges) > 0 AND ranges[1] LIKE '{O}enum%'
UNION ALL SELECT request_id, target_id, 'target_out_of_range' FROM shown WHERE t % 9 <> 0 AND len(ranges) > 0 AND ranges[1] IN (SELECT id FROM classes)
  AND ('{O}part' || (t * 2), ranges[1]) NOT IN (SELECT class_id, ancestor_id FROM up)""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    none = F.lit(None).cast("string")
    link = F.struct(F.concat(F.lit("supp"), (F.col("o_custkey") % 7).cast("string")).alias("predicate"), F.lit("resource").alias("kind"),
                    F.concat(F.lit("cust|omer:"), F.floor(F.col("o_custkey") / 2).cast("string")).alias("value"), none.alias("lang"), none.alias("datatype"))
    rows = o.select(F.col("o_orderkey").alias("request_id"), none.alias("resource_id"), F.lit(O + "part1").alias("type_id"), F.array(link).alias("props"))
    terms = taxonomy(spark, sf)
    return q.target_violations(rows, terms, ontology.ancestors(terms), store.heads(spark, sf), _retyped(spark, sf), ["cass0", "cass1", "cass2", "cass3"]).select("request_id", "target_id", "code")


@query("v4_resolved_terms", f"""{T} SELECT 'part' || l_partkey AS name, count(*) AS n, min('{O}part' || l_partkey) FILTER (WHERE '{O}part' || l_partkey IN (SELECT id FROM classes)) AS term_id FROM lineitem GROUP BY 1""")
def _(spark, sf):
    names = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("name")).agg(F.count("*").alias("n"))
    return q.resolve_terms(names, taxonomy(spark, sf), "name").select("name", "n", "term_id")


@query("v5_directive_violations", """SELECT event_id AS request_id, 'unknown_kind' AS code FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, 'self_substitute' FROM events WHERE event_type = 'signup' AND user_id % 10 = 0 UNION ALL SELECT event_id, 'blank_target' FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, 'delete_with_target' FROM events WHERE event_type = 'error' AND user_id % 2 = 0""")
def _(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type").isin("signup", "view"), v.SUBSTITUTE).when(F.col("event_type").isin("error", "purchase"), v.DELETE).otherwise("other")
    user = F.concat(F.lit("u|"), F.col("user_id").cast("string"))
    target = (F.when(F.col("event_type") == "view", " ").when(F.col("event_type") == "signup", F.concat(F.lit("u"), F.expr("cast(user_id - user_id % 10 as string)")))
              .when((F.col("event_type") == "error") & (F.col("user_id") % 2 == 0), "t"))
    return q.directive_violations(e.select(F.col("event_id").alias("request_id"), kind.alias("kind"), user.alias("resource_id"), target.alias("substitute_target")))


# --- appends ---------------------------------------------------------------------------------------------------------

_NOW = "2024-01-15 12:00:00"


@query("w1_append_revisions", f"""{LOG_WITH}, tgt AS (SELECT * FROM log WHERE source_seq = 0),
batch AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'u' || (o_custkey % 200) END AS given FROM orders),
named AS (SELECT seq, coalesce(given, 'new' || (500 + row_number() OVER (PARTITION BY given IS NULL ORDER BY seq) - 1)) AS resource_id FROM batch),
last_at AS (SELECT resource_id, max(modified_on) AS m FROM tgt WHERE kind = 'resource' GROUP BY 1)
SELECT (SELECT max(ordinal) FROM tgt) + row_number() OVER (ORDER BY seq) AS ordinal, n.resource_id,
strftime(CASE WHEN m IS NULL OR m < TIMESTAMP '{_NOW}' THEN TIMESTAMP '{_NOW}' ELSE m + INTERVAL 1 SECOND END + to_seconds(row_number() OVER (PARTITION BY n.resource_id ORDER BY seq) - 1), '%Y-%m-%d %H:%M:%S') AS at, 1 AS n_props
FROM named n LEFT JOIN last_at USING (resource_id)""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    none = F.lit(None).cast("string")
    props = F.array(*[F.struct(F.lit(v.NAME).alias("predicate"), F.lit("literal").alias("kind"), x.alias("value"), none.alias("lang"), none.alias("datatype"))
                      for x in (F.col("o_orderpriority"), F.lit(""))])
    given = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("u|"), (F.col("o_custkey") % 200).cast("string")))
    batch = o.select(F.col("o_orderkey").alias("seq"), given.alias("resource_id"), F.lit("person").alias("type_id"), props.alias("props"))
    rows = w.append_revisions(batch, event_log(spark, sf).where("source_seq = 0"), "ne|w", 500, _NOW)
    return rows.select("ordinal", "resource_id", _day("modified_at").alias("at"), F.size("props").alias("n_props"))


@query("w2_append_directives", f"""{LOG_WITH} SELECT (SELECT max(ordinal) FROM log WHERE source_seq = 1) + row_number() OVER (ORDER BY c_custkey) AS ordinal, 'customer:' || c_custkey AS resource_id,
CASE WHEN c_custkey % 2 = 0 THEN 'delete' ELSE 'substitute' END AS kind, CASE WHEN c_custkey % 2 = 1 THEN 'customer:0' END AS substitute_target, '{_NOW}' AS at FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey")
    batch = table(spark, sf, "customer").select(
        k.alias("seq"), F.when(k % 2 == 0, v.DELETE).otherwise(v.SUBSTITUTE).alias("kind"), F.concat(F.lit("cust|omer:"), k.cast("string")).alias("resource_id"),
        F.when(k % 2 == 1, F.lit("customer:0")).alias("substitute_target"))
    return w.append_directives(batch, event_log(spark, sf).where("source_seq = 1"), _NOW).select(
        "ordinal", "resource_id", "kind", "substitute_target", _day("modified_at").alias("at"))


@query("w3_add_to_collections", f"""{LOG_WITH} SELECT (SELECT max(ordinal) FROM log WHERE source_seq = 2) + row_number() OVER (ORDER BY o_orderkey) AS ordinal, 'm' || (row_number() OVER (ORDER BY o_orderkey) + 6) AS resource_id,
'{v.COLLECTION_MEMBER}' AS type, 'order:' || o_orderkey AS collection_id, 'customer:' || o_custkey AS item_id FROM orders""")
def _(spark, sf):
    batch = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("collection_id"),
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("resource_id"))
    rows = w.add_to_collections(batch, event_log(spark, sf).where("source_seq = 2"), "m", 7, _NOW)
    return rows.select("ordinal", "resource_id", "type", F.col("props")[0]["value"].alias("collection_id"), F.col("props")[1]["value"].alias("item_id"))


@query("w3_remove_from_collections", f"""{LOG_WITH}, {G[5:]}, wanted AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS seq,
'member:' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR), CAST(round(l_extendedprice * 100) AS BIGINT)) AS m FROM lineitem WHERE l_linenumber <= 2)
SELECT m AS resource_id, 'delete' AS kind FROM wanted WHERE m IN (SELECT subject FROM seen WHERE predicate = '{v.IN_COLLECTION}')""")
def _(spark, sf):
    from .relation_queries import _wanted

    batch = _wanted(spark, sf).withColumn("seq", F.col("membership_id"))
    rows = store.triples(spark, sf, (v.RDF_TYPE, v.IN_COLLECTION, v.COLLECTION_ITEM))
    return w.remove_from_collections(batch, store.heads(spark, sf), rows, ["cass0", "cass1", "cass2", "cass3"],
                                     event_log(spark, sf).where("source_seq = 2"), _NOW).select("resource_id", "kind")


# --- published tables, stream -------------------------------------------------------------------------------------------

@query("s7_published_counts", f"""{G} SELECT 'heads' AS part, count(*) AS n_rows FROM heads UNION ALL SELECT 'triples', count(*) FROM triples UNION ALL SELECT 'triples_by_subject', count(*) FROM triples""")
def _(spark, sf):
    current = graph_current(spark, sf)
    done = published.publish(current, f"{scratch_folder(spark)}/publish", uuid.uuid4().hex)
    rows = [done.read(spark, part).agg(F.count("*").alias("n_rows")).select(F.lit(part).alias("part"), "n_rows") for part in ("heads", "triples", "triples_by_subject")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("s8_stored_triples", f"{G} SELECT predicate, object_kind, count(*) AS n FROM triples GROUP BY ALL")
def _(spark, sf):
    return store.triples(spark, sf).groupBy("predicate", "object_kind").agg(F.count("*").alias("n"))


@query("s6_event_props", """SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1""")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(F.from_json("props", "k bigint")["k"].alias("k")).agg(F.count("*").alias("n"))


@query("x1_incremental_current", ORACLES["m8_current_records"])
def _(spark, sf):
    folder = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    incremental.maintain(event_stream(spark, sf), folder).awaitTermination()
    facts = F.array_join(F.transform("props", lambda x: F.concat(F.replace(x["predicate"], F.lit(O), F.lit("")), F.lit("="), x["value"])), ";")
    return incremental.current_records(spark, folder).select(
        "resource_id", "type", F.date_format("modified_at", "yyyy-MM-dd").alias("modified_on"), "cassette_id", "ordinal", "is_synthetic", facts.alias("facts"))
