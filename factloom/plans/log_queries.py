"""Materialization (M), projection (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as v
from ..operators import materialize as m, projection as p
from .inputs import LOG_WITH, O, event_log, table
from .registry import query


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def part_directives(spark, sf):
    """Deep chains: parts of even size point to half their key; the largest size is deleted."""
    parts = table(spark, sf, "part").where("p_size % 2 = 0 and p_partkey > 0")
    deleted = F.col("p_size") == 50
    return parts.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.when(~deleted, F.floor(F.col("p_partkey") / 2).cast("string")).alias("target"), deleted.alias("deleted"))


_PART_CLOSURE = """WITH RECURSIVE d AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_size = 50 AS deleted,
         CASE WHEN p_size <> 50 THEN CAST(p_partkey // 2 AS VARCHAR) END AS target
  FROM part WHERE p_size % 2 = 0 AND p_partkey > 0),
chain AS (
  SELECT id, target AS cur, 1 AS hops FROM d WHERE NOT deleted
  UNION ALL SELECT c.id, d.target, c.hops + 1 FROM chain c JOIN d ON d.id = c.cur AND NOT d.deleted)
SELECT id, arg_max(cur, hops) AS resolved, CAST(max(hops) AS BIGINT) AS hops FROM chain GROUP BY id
UNION ALL SELECT id, NULL, 0 FROM d WHERE deleted"""


@query("m1_collapse_directives", f"{LOG_WITH} SELECT id, target, deleted FROM directives")
def _(spark, sf):
    return m.collapse_directives(event_log(spark, sf))


@query("m2_substitution_closure", _PART_CLOSURE)
def _(spark, sf):
    return m.substitution_closure(part_directives(spark, sf)).drop("cyclic")


@query("m3_duplicate_ids", f"""{LOG_WITH} SELECT resource_id, count(*) AS definitions FROM log
WHERE kind = 'resource' GROUP BY 1 HAVING count(*) > 1""")
def _(spark, sf):
    return m.duplicate_ids(event_log(spark, sf))


@query("m3_duplicate_line_keys", """SELECT l_orderkey || '/' || l_linenumber AS resource_id, count(*) AS definitions
FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.lit(v.RESOURCE).alias("kind"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("resource_id"))
    return m.duplicate_ids(lines)


@query("m4_latest_definitions", f"""{LOG_WITH} SELECT resource_id, source_path, ordinal, event_type,
CAST(modified_on AS VARCHAR) AS modified_on FROM latest""")
def _(spark, sf):
    return m.latest_definitions(event_log(spark, sf)).select(
        "resource_id", "source_path", "ordinal", F.col("props")[0]["value"].alias("event_type"),
        _day("modified_at").alias("modified_on"))


@query("m4_latest_lines", """SELECT l_orderkey || '/' || l_linenumber AS resource_id, l_partkey AS partkey,
l_suppkey AS suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS shipped FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.lit(v.RESOURCE).alias("kind"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("resource_id"),
        F.col("l_shipdate").alias("modified_at"), F.col("l_partkey").alias("source_seq"), F.col("l_suppkey").alias("ordinal"))
    return m.latest_definitions(lines).select(
        "resource_id", F.col("source_seq").alias("partkey"), F.col("ordinal").alias("suppkey"),
        _day("modified_at").alias("shipped"))


@query("m5_drop_redirected", f"""{LOG_WITH} SELECT resource_id, ordinal FROM latest
WHERE resource_id NOT IN (SELECT id FROM directives)""")
def _(spark, sf):
    log = event_log(spark, sf)
    return m.drop_redirected(m.latest_definitions(log), m.collapse_directives(log)).select("resource_id", "ordinal")


@query("m6_rewrite_references", f"""{LOG_WITH} SELECT resource_id, '{O}friend' AS predicate, friend AS value FROM current_log
UNION ALL SELECT resource_id, '{O}peer', peer FROM current_log""")
def _(spark, sf):
    log = event_log(spark, sf)
    directives = m.collapse_directives(log)
    kept = m.drop_redirected(m.latest_definitions(log), directives)
    rows = m.rewrite_references(kept, m.substitution_closure(directives))
    return (rows.select("resource_id", F.explode("props").alias("p")).where(F.col("p.kind") == v.RESOURCE)
            .select("resource_id", "p.predicate", "p.value"))


@query("m7_root_collection", f"""{LOG_WITH} SELECT resource_id, '{O}person' AS type, false AS is_synthetic FROM latest
UNION ALL SELECT '{v.ROOT_COLLECTION_ID}', '{O}collection', true
WHERE NOT EXISTS (SELECT 1 FROM latest WHERE resource_id = '{v.ROOT_COLLECTION_ID}')""")
def _(spark, sf):
    rows = m.latest_definitions(event_log(spark, sf)).withColumn("is_synthetic", F.lit(False))
    return m.add_root(rows).select("resource_id", "type", "is_synthetic")


@query("m8_current_records", f"""{LOG_WITH} SELECT resource_id, '{O}person' AS type, modified_on, cassette_id, ordinal,
false AS is_synthetic, 'name=' || event_type || ';value=' || cents || ';friend=' || friend || ';peer=' || peer AS facts FROM current_log
UNION ALL SELECT '{v.ROOT_COLLECTION_ID}', '{O}collection', '0001-01-01', NULL, NULL, true, 'name={v.ROOT_COLLECTION_NAME}'""")
def _(spark, sf):
    facts = F.array_join(F.transform("props", lambda p: F.concat(F.replace(p["predicate"], F.lit(O), F.lit("")), F.lit("="), p["value"])), ";")
    return m.current_records(event_log(spark, sf)).select(
        "resource_id", "type", _day("modified_at").alias("modified_on"), "cassette_id", "ordinal", "is_synthetic",
        facts.alias("facts"))


@query("m9_statistics", f"""{LOG_WITH} SELECT count(DISTINCT source_path) AS source_files, count(*) AS source_records,
count(*) FILTER (WHERE kind = 'resource') AS resource_definitions, count(*) FILTER (WHERE kind = 'delete') AS delete_operations,
count(*) FILTER (WHERE kind = 'substitute') AS substitute_operations,
(SELECT count(*) FROM (SELECT resource_id FROM log WHERE kind = 'resource' GROUP BY 1 HAVING count(*) > 1)) AS duplicate_ids,
(SELECT count(*) FROM directives WHERE NOT deleted) AS redirected_ids, (SELECT count(*) FROM directives WHERE deleted) AS deleted_ids,
(SELECT count(*) FROM current_log) AS current_resources, CAST(1 AS BIGINT) AS synthetic_resources,
(SELECT 4 * count(*) + 1 FROM current_log) AS current_properties FROM log""")
def _(spark, sf):
    return m.statistics(event_log(spark, sf))


@query("m10_resolve_ids", f"""{LOG_WITH} SELECT DISTINCT l.third AS id, coalesce(c.resolved, l.third) AS resolved
FROM log l LEFT JOIN closure c ON c.id = l.third""")
def _(spark, sf):
    log = event_log(spark, sf)
    ids = table(spark, sf, "events").select(F.concat(F.lit("u"), F.floor(F.col("user_id") / 3).cast("string")).alias("id"))
    return m.resolve_ids(ids.distinct(), m.substitution_closure(m.collapse_directives(log))).select("id", "resolved")
