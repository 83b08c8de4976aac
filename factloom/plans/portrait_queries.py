"""Portraits (R) and access (A) on the node graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as v
from ..operators import access as a, ontology, portrait as r
from ..schemas import CASSETTES, MEMBERS, ROLES
from .graph_queries import G
from .inputs import ALLOWED, O, graph_terms, kinds_sql, literal_rows, table
from .registry import query
from .store import record_heads, record_statements, with_predicates

_LANG = "en"


def _ids(spark, sf):
    """Suppliers of the first nations and the parts they deliver."""
    suppliers = table(spark, sf, "supplier").where("s_nationkey < 10").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"))
    parts = table(spark, sf, "part").where("p_type = 'PROMO'").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"))
    return suppliers.union(parts)


_IDS_SQL = """ids AS (SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_nationkey < 10 UNION ALL SELECT 'part:' || p_partkey FROM part WHERE p_type = 'PROMO')"""
_ROWS_SQL = f"""{_IDS_SQL},
roots AS (SELECT resource_id FROM seen_heads WHERE resource_id IN (SELECT id FROM ids)),
out_rows AS (SELECT subject AS resource_id, CASE object_kind WHEN 'literal' THEN 'literal' ELSE 'direct' END AS section, predicate,
  object_value AS value, lang FROM seen WHERE subject IN (SELECT resource_id FROM roots) AND (object_kind = 'literal' OR predicate <> '{v.RDF_TYPE}')),
in_rows AS (SELECT object_value AS resource_id, 'inverse' AS section, predicate, subject AS value, lang FROM seen
  WHERE object_kind = 'iri' AND object_value IN (SELECT resource_id FROM roots))"""


def rows(spark, sf, inverse=True):
    return r.portrait_rows(record_heads(spark, sf), record_statements(spark, sf), ALLOWED, _ids(spark, sf), inverse)


@query("r1_portraits", f"{G}, {_ROWS_SQL} SELECT * FROM out_rows UNION ALL SELECT * FROM in_rows")
def _(spark, sf):
    return rows(spark, sf).select("resource_id", "section", "predicate", "value", "lang")


@query("r1_portrait_heads", f"""{G}, types AS (SELECT subject AS resource_id, min(object_value) AS type FROM seen WHERE predicate = '{v.RDF_TYPE}' GROUP BY 1)
SELECT resource_id, type, cassette_id, source_path FROM seen_heads LEFT JOIN types USING (resource_id)""")
def _(spark, sf):
    return r.portrait_heads(record_heads(spark, sf), with_predicates(record_statements(spark, sf), v.RDF_TYPE), ALLOWED).select("resource_id", "type", "cassette_id", "source_path")


@query("r2_summary_portraits", f"{G}, {_ROWS_SQL} SELECT * FROM out_rows")
def _(spark, sf):
    return rows(spark, sf, inverse=False).select("resource_id", "section", "predicate", "value", "lang")


_DISPLAY = """CASE WHEN p.is_date THEN CASE length(value)
  WHEN 4 THEN value || ' г.'
  WHEN 7 THEN ['Январь','Февраль','Март','Апрель','Май','Июнь','Июль','Август','Сентябрь','Октябрь','Ноябрь','Декабрь'][CAST(substr(value, 6, 2) AS INTEGER)] || ' ' || left(value, 4) || ' г.'
  ELSE CAST(CAST(substr(value, 9, 2) AS INTEGER) AS VARCHAR) || ' ' || ['января','февраля','марта','апреля','мая','июня','июля','августа','сентября','октября','ноября','декабря'][CAST(substr(value, 6, 2) AS INTEGER)] || ' ' || left(value, 4) || ' г.' END
  ELSE value END"""


@query("r8_presented", f"""{G}, {_ROWS_SQL}, {kinds_sql()}
SELECT resource_id, section, predicate, CASE section WHEN 'inverse' THEN p.inverse_label ELSE p.label END AS label, value,
CASE WHEN section = 'literal' THEN {_DISPLAY} END AS display_value, lang, false AS unlisted,
CASE replace(predicate, '{O}', '') WHEN 'name' THEN '01' WHEN 'alias' THEN '02' WHEN 'description' THEN '03' WHEN 'date' THEN '04'
 WHEN 'from-date' THEN '05' WHEN 'to-date' THEN '06' WHEN 'located-in' THEN '10' WHEN 'supplied-by' THEN '20' WHEN 'supplies' THEN '21' END AS priority
FROM (SELECT * FROM out_rows UNION ALL SELECT * FROM in_rows) JOIN props p USING (predicate)""")
def _(spark, sf):
    terms = graph_terms(spark)
    frame = r.portrait_heads(record_heads(spark, sf), with_predicates(record_statements(spark, sf), v.RDF_TYPE), ALLOWED)
    return r.present(rows(spark, sf), frame, terms, ontology.ancestors(terms), _LANG).drop("datatype")


@query("r10_page_metadata", f"""{G}, {_ROWS_SQL}, {kinds_sql()},
types AS (SELECT subject AS resource_id, min(object_value) AS type FROM seen WHERE predicate = '{v.RDF_TYPE}' GROUP BY 1)
SELECT r.resource_id, CASE WHEN is_photo THEN type_label ELSE n.value END AS title, coalesce(d.value, type_label) AS description, u.value AS document_uri
FROM roots r JOIN types USING (resource_id) JOIN kinds USING (type)
LEFT JOIN out_rows n ON n.resource_id = r.resource_id AND n.predicate = '{v.NAME}'
LEFT JOIN out_rows d ON d.resource_id = r.resource_id AND d.predicate = '{v.DESCRIPTION}'
LEFT JOIN out_rows u ON u.resource_id = r.resource_id AND u.predicate = '{v.URI}'""")
def _(spark, sf):
    terms = graph_terms(spark)
    ids = _ids(spark, sf)
    frame = r.portrait_heads(record_heads(spark, sf), with_predicates(record_statements(spark, sf), v.RDF_TYPE), ALLOWED)
    frame = frame.join(ids.withColumnRenamed("id", "resource_id"), "resource_id", "left_semi")
    shown = r.present(rows(spark, sf, inverse=False), frame, terms, ontology.ancestors(terms), _LANG)
    return r.page_metadata(shown, frame, terms, _LANG)


# --- access: regions are cassettes, customers members, nations roles ------------------------------------

def cassettes(spark, sf):
    """Nations as cassettes."""
    n = table(spark, sf, "nation")
    key = F.col("n_nationkey")
    return n.select(F.concat(F.lit("n"), key.cast("string")).alias("id"), F.col("n_name").alias("name"), F.lit("/").alias("path"),
                    (key % 6 != 5).alias("enabled"), F.when(key % 3 == 0, "none").otherwise(v.READ).alias("default_access"),
                    (key == 7).alias("allow_write"))


_ROLE_ROWS = [
    ("viewer", ["read", "search"], {}),
    ("editor", ["read", "search"], {"n7": ["read", "writeMetadata", "addDocuments", "replaceDocuments"], "n3": ["read", "delete"]}),
    ("administrator", ["read", "search", "export", "rebuildIndex"], {"*": ["read", "writeMetadata", "delete", "manage"]}),
    ("guest", ["search"], {"n4": ["read"]}),
]


def roles(spark):
    return literal_rows(spark, _ROLE_ROWS, ROLES)


def members(spark, sf):
    """Customers as members; the segment gives the roles, some have overrides."""
    key = F.col("c_custkey")
    role = (F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("viewer"), F.lit("editor")))
            .when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("administrator")))
            .when(F.col("c_mktsegment") == "FURNITURE", F.array(F.lit("guest"))).otherwise(F.array(F.lit("viewer"))))
    none = F.from_json(F.lit("{}"), "map<string,array<string>>")
    exact = F.create_map(F.concat(F.lit("n"), (key % 25).cast("string")), F.array(F.lit("read"), F.lit("delete"), F.lit("substitute")))
    wild = F.create_map(F.lit("*"), F.array(F.lit("read"), F.lit(" ")))
    return table(spark, sf, "customer").select(
        F.concat(F.lit("m"), key.cast("string")).alias("user_id"), role.alias("roles"),
        F.when(key % 10 == 1, exact).when(key % 10 == 2, wild).when(key % 10 == 3, F.map_concat(exact, wild)).otherwise(none).alias("cassette_overrides"))


_ROLE_PR = [(r_, x) for r_, rights, _ in _ROLE_ROWS for x in rights]
_ROLE_CR = [(r_, c, x) for r_, _, m_ in _ROLE_ROWS for c, xs in m_.items() for x in xs]


def _tuples(rows_):
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows_)


ACCESS_SQL = f"""WITH cass AS (SELECT 'n' || n_nationkey AS cassette_id, n_name AS name, n_nationkey % 6 <> 5 AS enabled, n_nationkey % 3 <> 0 AS default_read, n_nationkey = 7 AS allow_write FROM nation),
role_pr AS (SELECT * FROM (VALUES {_tuples(_ROLE_PR)}) AS t(role, "right")),
role_cr AS (SELECT * FROM (VALUES {_tuples(_ROLE_CR)}) AS t(role, cassette_id, "right")),
mem AS (SELECT 'm' || c_custkey AS user_id, c_custkey % 10 AS k, 'n' || (c_custkey % 25) AS own,
  unnest(CASE c_mktsegment WHEN 'BUILDING' THEN ['viewer', 'editor'] WHEN 'MACHINERY' THEN ['administrator'] WHEN 'FURNITURE' THEN ['guest'] ELSE ['viewer'] END) AS role FROM customer),
pr AS (SELECT DISTINCT user_id, "right" FROM mem JOIN role_pr USING (role)),
over AS (SELECT DISTINCT user_id, cassette_id, unnest(CASE WHEN k IN (1, 3) AND own = cassette_id THEN ['read', 'delete', 'substitute'] ELSE ['read'] END) AS "right"
  FROM mem CROSS JOIN cass WHERE k IN (2, 3) OR (k = 1 AND own = cassette_id)),
plain AS (SELECT user_id, cassette_id, 'read' AS "right" FROM pr CROSS JOIN cass WHERE "right" = 'read' AND default_read AND enabled
  UNION SELECT user_id, c.cassette_id, "right" FROM mem JOIN role_cr r USING (role) JOIN cass c ON r.cassette_id IN ('*', c.cassette_id)),
cr AS (SELECT user_id, cassette_id, "right" FROM (
  SELECT * FROM plain WHERE (user_id, cassette_id) NOT IN (SELECT user_id, cassette_id FROM over) UNION SELECT * FROM over)
  JOIN cass USING (cassette_id) WHERE enabled AND (allow_write OR "right" = 'read'))"""


def _rights(spark, sf):
    m = members(spark, sf)
    return a.cassette_rights(m, roles(spark), cassettes(spark, sf)), a.project_rights(m, roles(spark))


@query("a1_cassette_rights", f'{ACCESS_SQL} SELECT user_id, cassette_id, "right" FROM cr')
def _(spark, sf):
    return _rights(spark, sf)[0]


@query("a2_project_rights", f'{ACCESS_SQL} SELECT user_id, "right" FROM pr')
def _(spark, sf):
    return a.project_rights(members(spark, sf), roles(spark))


@query("a3_readable_cassettes", f"""{ACCESS_SQL} SELECT user_id, cassette_id FROM cr WHERE "right" = 'read' AND user_id IN (SELECT user_id FROM pr WHERE "right" = 'read')""")
def _(spark, sf):
    return a.readable_cassettes(*_rights(spark, sf))


@query("a3_searchable_cassettes", f"""{ACCESS_SQL} SELECT user_id, cassette_id FROM cr WHERE "right" = 'read'
AND user_id IN (SELECT user_id FROM pr WHERE "right" = 'read') AND user_id IN (SELECT user_id FROM pr WHERE "right" = 'search')""")
def _(spark, sf):
    return a.readable_cassettes(*_rights(spark, sf), search=True)


@query("a4_writable_cassettes", f"""{ACCESS_SQL} SELECT DISTINCT user_id, cassette_id FROM cr x WHERE "right" = 'delete' AND user_id IN (SELECT user_id FROM pr WHERE "right" = 'read')
AND (user_id, cassette_id) IN (SELECT user_id, cassette_id FROM cr WHERE "right" = 'read')""")
def _(spark, sf):
    return a.writable_cassettes(*_rights(spark, sf), cassettes(spark, sf), "delete")


@query("a4_default_write_cassette", f"""{ACCESS_SQL} SELECT user_id, max(CASE WHEN cassette_id = 'n7' AND "right" <> 'read' THEN 'n7' END) AS cassette_id
FROM (SELECT DISTINCT user_id FROM mem) LEFT JOIN cr USING (user_id) GROUP BY 1""")
def _(spark, sf):
    return a.default_write_cassette(_rights(spark, sf)[0], members(spark, sf), cassettes(spark, sf))


@query("a6_cassette_overview", f"""{ACCESS_SQL}, per AS (SELECT user_id, cassette_id, bool_or("right" = 'read') AS reads, bool_or("right" <> 'read') AS writes,
  string_agg("right", ',' ORDER BY "right") AS all_rights, string_agg("right", ',' ORDER BY "right") FILTER (WHERE "right" <> 'read') AS write_rights FROM cr GROUP BY ALL)
SELECT user_id, cassette_id, name, allow_write, user_id IN (SELECT user_id FROM pr WHERE "right" = 'rebuildIndex') AS admin,
CASE WHEN user_id IN (SELECT user_id FROM pr WHERE "right" = 'rebuildIndex') THEN all_rights ELSE write_rights END AS rights
FROM per JOIN cass USING (cassette_id) WHERE reads AND (user_id IN (SELECT user_id FROM pr WHERE "right" = 'rebuildIndex') OR (allow_write AND writes))""")
def _(spark, sf):
    rights, granted = _rights(spark, sf)
    return a.cassette_overview(members(spark, sf), rights, granted, cassettes(spark, sf)).withColumn("rights", F.array_join("rights", ","))


@query("a7_configuration_faults", """SELECT 'unknown_role' AS code, 'm' || c_custkey || '/seg-' || c_mktsegment AS subject FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT 'repeated_role', 'm' || c_custkey || '/BUILDING' FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'unknown_cassette', 'm' || c_custkey || '/x' || c_nationkey FROM customer WHERE c_nationkey >= 20
UNION ALL SELECT 'unknown_right', 'm' || c_custkey || CASE WHEN c_nationkey >= 20 THEN '/x' ELSE '/n' END || c_nationkey || '/fly' FROM customer WHERE c_nationkey % 5 = 0
UNION ALL SELECT 'unknown_right', 'BUILDING/dance' UNION ALL SELECT 'repeated_right', 'MACHINERY/read'
UNION ALL SELECT 'unknown_default_access', 'n' || n_nationkey || '/maybe' FROM nation WHERE n_nationkey % 7 = 1
UNION ALL SELECT 'writable_cassettes', CAST(count(*) AS VARCHAR) FROM nation WHERE n_nationkey % 6 <> 5 AND n_nationkey % 4 = 0
UNION ALL SELECT 'repeated_member', 'm' || c_custkey FROM customer WHERE c_acctbal < 0""")
def _(spark, sf):
    folders = cassettes(spark, sf).drop("default_access", "allow_write")
    n = F.substring("id", 2, 9).cast("int")
    folders = folders.withColumn("default_access", F.when(n % 7 == 1, "maybe").otherwise("read")).withColumn("allow_write", n % 4 == 0)
    kinds = literal_rows(spark, [("BUILDING", ["read", "dance"], {}), ("MACHINERY", ["read", "read"], {})], ROLES)
    c = table(spark, sf, "customer")
    role = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("BUILDING"), F.lit("BUILDING"))).when(
        F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("MACHINERY"))).otherwise(F.array(F.concat(F.lit("seg-"), "c_mktsegment")))
    rights = F.when(F.col("c_nationkey") % 5 == 0, F.array(F.lit("read"), F.lit("fly"))).otherwise(F.array(F.lit("read")))
    people = c.select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("user_id"), role.alias("roles"),
                      F.create_map(F.concat(F.when(F.col("c_nationkey") < 20, "n").otherwise("x"), F.col("c_nationkey").cast("string")), rights).alias("cassette_overrides"))
    # members with a debt are listed twice, the second time without roles
    again = c.where("c_acctbal < 0").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("user_id"),
                                            F.array().cast("array<string>").alias("roles"), F.from_json(F.lit("{}"), "map<string,array<string>>").alias("cassette_overrides"))
    return a.check_configuration(folders, kinds, people.unionByName(again))


@query("r9_redacted_provenance", f"""{G}, lv AS (SELECT resource_id, cassette_id, source_path, CASE cassette_id WHEN 'cass1' THEN 'cassette' ELSE 'none' END AS level FROM seen_heads)
SELECT resource_id, level, CASE level WHEN 'cassette' THEN cassette_id END AS cassette_id, CAST(NULL AS VARCHAR) AS source_path FROM lv""")
def _(spark, sf):
    frame = r.portrait_heads(record_heads(spark, sf), with_predicates(record_statements(spark, sf), v.RDF_TYPE), ALLOWED)
    folders = literal_rows(spark, [("cass0", "Cass0", "/", True, "read", False), ("cass1", "Cass1", "/", True, "read", True)], CASSETTES)
    kinds = literal_rows(spark, [("editor", ["read"], {"*": ["writeMetadata"]})], ROLES)
    people = literal_rows(spark, [("ann", ["editor"], {})], MEMBERS)
    level = r.provenance_level(frame, "ann", a.project_rights(people, kinds), a.cassette_rights(people, kinds, folders))
    return r.redact_provenance(level).select("resource_id", "level", "cassette_id", "source_path")
