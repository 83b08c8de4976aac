"""Ontology operators (H), labels (R6, R7), class suggestions (F12) on a taxonomy drawn from the tables.

Every part is a class below the part with half its key; customers are datatype properties, suppliers object
properties, regions enumerations with their nations as states.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import vocab as v
from ..operators import ontology as o
from .inputs import O, literal_rows, table
from .registry import query
from ..schemas import LABEL, STATE, TERMS


def taxonomy(spark, sf, broken: bool = False) -> DataFrame:
    """Terms; ``broken`` plants missing and wrong parents, blank labels and cycles."""
    def iri(prefix: str, expr: str):
        return F.concat(F.lit(O + prefix), F.expr(f"cast({expr} as string)"))

    def text(value, lang):
        return F.struct(value.alias("value"), (F.lit(lang).cast("string") if not hasattr(lang, "alias") else lang).alias("lang"))

    none_l, none_s = F.array().cast(f"array<{LABEL}>"), F.array().cast("array<string>")
    none_e = F.array().cast(f"array<{STATE}>")
    null = F.lit(None).cast("string")

    def terms(df, id_, kind, labels, inverse=none_l, priority=null, parent=null, domains=none_s, ranges=none_s, states=none_e,
              abstract=F.lit(False), essential=F.lit(False)):
        return df.select(id_.alias("id"), F.lit(kind).alias("kind"), labels.cast(f"array<{LABEL}>").alias("labels"),
                         inverse.cast(f"array<{LABEL}>").alias("inverse_labels"), priority.alias("priority"), parent.alias("parent"),
                         domains.alias("domains"), ranges.alias("ranges"), states.cast(f"array<{STATE}>").alias("states"),
                         abstract.alias("is_abstract"), essential.alias("is_essential"))

    parent = F.when(F.col("p_partkey") == 0, F.lit(v.SYSTEM_OBJECT)).when(F.col("p_partkey") == 3, F.lit(v.ENTITY)).otherwise(iri("part", "floor(p_partkey / 2)"))
    labels = F.array(text(F.col("p_name"), "en"), text(F.col("p_brand"), None), text(F.col("p_type"), "ru"))
    if broken:
        parent = (F.when(F.col("p_size") == 50, iri("lost", "p_partkey")).when(F.col("p_size") == 49, F.lit(O + "enum1"))
                  .when((F.col("p_size") == 47) & (F.col("p_partkey") > 0), iri("part", "p_partkey * 2")).otherwise(parent))
        labels = F.when(F.col("p_size") == 48, F.array(text(F.lit(" "), "en"))).otherwise(labels)
    parts = terms(table(spark, sf, "part"), iri("part", "p_partkey"), v.CLASS, labels, parent=parent,
                  abstract=F.col("p_size") % 3 == 0)
    customers = terms(
        table(spark, sf, "customer"), iri("cust", "c_custkey"), v.DATATYPE_PROPERTY, F.array(text(F.col("c_name"), "en")),
        priority=F.when(F.col("c_nationkey") % 4 != 0, F.lpad(F.col("c_nationkey").cast("string"), 2, "0")),
        domains=F.when(F.col("c_nationkey") % 7 == 0, none_s).otherwise(F.array(iri("part", "c_custkey"), iri("part", "floor(c_custkey / 3)"))),
        ranges=F.when(F.col("c_nationkey") % 3 == 0, none_s).when(F.col("c_nationkey") % 3 == 1, F.array(F.lit(v.DATE)))
        .otherwise(F.array(F.lit(O + "string"), iri("enum", "c_nationkey % 5"), iri("enum", "(c_nationkey + 1) % 5"))),
        essential=F.col("c_nationkey") % 5 == 0)
    suppliers = terms(
        table(spark, sf, "supplier"), iri("supp", "s_suppkey"), v.OBJECT_PROPERTY,
        F.array(text(F.col("s_name"), "en"), text(F.concat(F.lit("ru "), "s_name"), "ru")),
        inverse=F.when(F.col("s_nationkey") % 2 == 0, F.array(text(F.concat(F.lit("of "), "s_name"), "en"))).otherwise(none_l),
        priority=F.when(F.col("s_nationkey") % 4 != 0, F.lpad(F.col("s_nationkey").cast("string"), 2, "0")),
        domains=F.array(iri("part", "s_suppkey"), F.when(F.col("s_nationkey") == 3, F.lit(O + "enum2"))
                        .when(F.col("s_nationkey") == 4, F.lit(O + "part1")).otherwise(iri("part", "floor(s_suppkey / 2)"))),
        ranges=F.when(F.col("s_nationkey") == 5, none_s).when(F.col("s_nationkey") == 6, F.array(F.lit(O + "enum0")))
        .otherwise(F.array(iri("part", "s_suppkey * 23 + 1"))))
    states = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list(F.struct(
        F.col("n_nationkey").cast("string").alias("value"), F.col("n_name").alias("label"),
        F.when(F.col("n_nationkey") % 3 == 0, "ru").when(F.col("n_nationkey") % 3 == 1, "en").alias("lang")))).alias("states"))
    regions = terms(table(spark, sf, "region").join(states, "r_regionkey", "left"), iri("enum", "r_regionkey"), v.ENUMERATION,
                    F.array(text(F.col("r_name"), "en")), states=F.coalesce("states", none_e))
    roots = literal_rows(spark, [
        (v.SYSTEM_OBJECT, v.CLASS, [{"value": "object", "lang": "en"}], [], None, v.ENTITY, [], [], [], True, False),
        (v.ENTITY, v.CLASS, [{"value": "entity", "lang": "en"}], [], None, None, [], [], [], True, False)], TERMS)
    return reduce(DataFrame.unionByName, [parts, customers, suppliers, regions, roots])


def terms_sql(broken: bool = False) -> str:
    """Subqueries classes, dprops, oprops, states, domains, ranges of the same taxonomy."""
    parent = f"CASE WHEN p_partkey = 0 THEN '{v.SYSTEM_OBJECT}' WHEN p_partkey = 3 THEN '{v.ENTITY}' ELSE '{O}part' || (p_partkey // 2) END"
    if broken:
        parent = (f"CASE WHEN p_size = 50 THEN '{O}lost' || p_partkey WHEN p_size = 49 THEN '{O}enum1' "
                  f"WHEN p_size = 47 AND p_partkey > 0 THEN '{O}part' || (p_partkey * 2) ELSE {parent} END")
    return f"""
classes AS (SELECT '{O}part' || p_partkey AS id, {parent} AS parent, p_size % 3 = 0 AS is_abstract, p_name AS en, p_brand AS plain,
    p_type AS ru, p_size = 48 AS odd FROM part
  UNION ALL SELECT '{v.SYSTEM_OBJECT}', '{v.ENTITY}', true, 'object', NULL, NULL, false UNION ALL SELECT '{v.ENTITY}', NULL, true, 'entity', NULL, NULL, false),
dprops AS (SELECT '{O}cust' || c_custkey AS id, c_name AS label, CASE WHEN c_nationkey % 4 <> 0 THEN lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS priority,
  CASE WHEN c_nationkey % 7 = 0 THEN [] ELSE ['{O}part' || c_custkey, '{O}part' || (c_custkey // 3)] END AS domains,
  CASE c_nationkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['{v.DATE}'] ELSE ['{O}string', '{O}enum' || (c_nationkey % 5), '{O}enum' || ((c_nationkey + 1) % 5)] END AS ranges,
  c_nationkey % 5 = 0 AS is_essential FROM customer),
oprops AS (SELECT '{O}supp' || s_suppkey AS id, s_name AS label, CASE WHEN s_nationkey % 2 = 0 THEN 'of ' || s_name END AS inverse_label,
  CASE WHEN s_nationkey % 4 <> 0 THEN lpad(CAST(s_nationkey AS VARCHAR), 2, '0') END AS priority,
  ['{O}part' || s_suppkey, CASE s_nationkey WHEN 3 THEN '{O}enum2' WHEN 4 THEN '{O}part1' ELSE '{O}part' || (s_suppkey // 2) END] AS domains,
  CASE s_nationkey WHEN 5 THEN [] WHEN 6 THEN ['{O}enum0'] ELSE ['{O}part' || (s_suppkey * 23 + 1)] END AS ranges FROM supplier),
states AS (SELECT '{O}enum' || n_regionkey AS range_id, CAST(n_nationkey AS VARCHAR) AS value, n_name AS label, n_nationkey FROM nation),
up AS (SELECT id AS class_id, id AS ancestor_id, 0 AS depth FROM classes
  UNION ALL SELECT u.class_id, c.parent, u.depth + 1 FROM up u JOIN classes c ON c.id = u.ancestor_id WHERE c.parent IS NOT NULL{' AND u.depth < 60' if broken else ''}),
entities AS (SELECT class_id FROM up JOIN classes ON id = class_id WHERE ancestor_id = '{v.SYSTEM_OBJECT}' AND NOT is_abstract),
direct AS (SELECT DISTINCT u.class_id, p.id AS property_id, p.priority FROM
  (SELECT id, priority, unnest(domains) AS d FROM dprops UNION ALL SELECT id, priority, unnest(domains) FROM oprops) p JOIN up u ON u.ancestor_id = p.d),
enum_first AS (SELECT id AS property_id, arg_min(r, pos) AS range_id FROM
  (SELECT id, unnest(ranges) AS r, generate_subscripts(ranges, 1) AS pos FROM dprops UNION ALL SELECT id, unnest(ranges), generate_subscripts(ranges, 1) FROM oprops)
  WHERE r LIKE '{O}enum%' GROUP BY id)"""


T = "WITH RECURSIVE " + terms_sql().strip()
TB = "WITH RECURSIVE " + terms_sql(True).strip()


@query("h1_ancestors", f"{T} SELECT class_id, ancestor_id, depth FROM up")
def _(spark, sf):
    return o.ancestors(taxonomy(spark, sf))


@query("h2_is_a", f"""{T} SELECT '{O}part' || l_partkey AS type, count(*) AS n FROM lineitem
WHERE '{O}part' || l_partkey IN (SELECT class_id FROM up WHERE ancestor_id = '{O}part3') GROUP BY 1""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit(O + "part"), F.col("l_partkey").cast("string")).alias("type"))
    return o.is_a(rows, o.ancestors(taxonomy(spark, sf)), O + "part3").groupBy("type").agg(F.count("*").alias("n"))


@query("h2_descendants", f"{T} SELECT class_id, depth FROM up WHERE ancestor_id = '{O}part2'")
def _(spark, sf):
    return o.descendants(o.ancestors(taxonomy(spark, sf)), O + "part2")


@query("h3_direct_properties", f"{T} SELECT class_id, property_id, priority FROM direct")
def _(spark, sf):
    terms = taxonomy(spark, sf)
    return o.direct_properties(terms, o.ancestors(terms))


@query("h4_inverse_properties", f"""{T} SELECT DISTINCT u.class_id, p.id AS property_id, p.priority
FROM (SELECT id, priority, unnest(ranges) AS r FROM oprops) p JOIN up u ON u.ancestor_id = p.r""")
def _(spark, sf):
    terms = taxonomy(spark, sf)
    return o.inverse_properties(terms, o.ancestors(terms))


@query("h5_schema_classes", f"""{T} SELECT id AS class_id, en AS label, parent, is_abstract, id IN (SELECT class_id FROM entities) AS is_entity FROM classes""")
def _(spark, sf):
    terms = taxonomy(spark, sf)
    return o.schema_classes(terms, o.ancestors(terms), "en")


@query("h5_schema_properties", f"""{T} SELECT class_id, property_id, d.priority, label, inverse_label, kind, is_essential, array_to_string(ranges, ' ') AS ranges FROM direct d JOIN (
SELECT id, label, NULL AS inverse_label, 'literal' AS kind, is_essential, ranges FROM dprops
UNION ALL SELECT id, label, inverse_label, 'resource', false, ranges FROM oprops) p ON p.id = d.property_id""")
def _(spark, sf):
    terms = taxonomy(spark, sf)
    return o.schema_properties(terms, o.ancestors(terms), "en").withColumn("ranges", F.array_join("ranges", " "))


@query("h5_schema_options", f"""{T} SELECT id AS property_id, value, min(label) AS label FROM (
SELECT id, unnest(ranges) AS range_id FROM dprops UNION ALL SELECT id, unnest(ranges) FROM oprops) JOIN states USING (range_id) GROUP BY 1, 2""")
def _(spark, sf):
    return o.schema_options(taxonomy(spark, sf), "en")


@query("h6_relation_roles", f"""{T} SELECT DISTINCT u.class_id AS type, c.id AS relation_class, p.id AS property_id,
c.en || ': ' || coalesce(p.inverse_label, p.label) AS label
FROM classes c JOIN direct d ON d.class_id = c.id JOIN (SELECT id, label, inverse_label, unnest(ranges) AS r FROM oprops) p ON p.id = d.property_id
JOIN up u ON u.ancestor_id = p.r
WHERE NOT c.is_abstract AND c.id NOT IN (SELECT class_id FROM up WHERE ancestor_id = '{v.SYSTEM_OBJECT}')
AND u.class_id IN (SELECT '{O}part' || p_partkey FROM part WHERE p_type = 'PROMO')""")
def _(spark, sf):
    terms = taxonomy(spark, sf)
    promo = table(spark, sf, "part").where("p_type = 'PROMO'").select(F.concat(F.lit(O + "part"), F.col("p_partkey").cast("string")).alias("type"))
    return o.relation_roles(terms, o.ancestors(terms), "en", promo)


@query("h7_entity_types_in_range", f"""{T} SELECT DISTINCT p.id AS property_id, c.id AS type, c.en AS label
FROM (SELECT id, unnest(ranges) AS r FROM oprops) p JOIN up u ON u.ancestor_id = p.r JOIN classes c ON c.id = u.class_id
WHERE c.id IN (SELECT class_id FROM entities)""")
def _(spark, sf):
    terms = taxonomy(spark, sf)
    return o.entity_types_in_range(terms, o.ancestors(terms), "en")


_ISSUES_SQL = f"""{TB}, kinds AS (SELECT id, 'Class' AS kind FROM classes UNION ALL SELECT '{O}enum' || r_regionkey, 'EnumerationType' FROM region),
props AS (SELECT id, domains, ranges, false AS is_object, true AS has_inverse FROM dprops UNION ALL SELECT id, domains, ranges, true, inverse_label IS NOT NULL FROM oprops),
doms AS (SELECT DISTINCT p.id, d AS other, k.kind FROM (SELECT id, unnest(domains) AS d FROM props) p LEFT JOIN kinds k ON k.id = d),
rngs AS (SELECT DISTINCT p.id, r AS other, k.kind FROM (SELECT id, unnest(ranges) AS r FROM props WHERE is_object) p LEFT JOIN kinds k ON k.id = r),
ups AS (SELECT DISTINCT class_id, ancestor_id FROM up),
rings AS (SELECT c.id, c.parent FROM classes c WHERE (c.parent, c.id) IN (SELECT class_id, ancestor_id FROM ups) ),
ring_name AS (SELECT r.id, min(u.ancestor_id) AS ring FROM rings r JOIN ups u ON u.class_id = r.id WHERE u.ancestor_id IN (SELECT id FROM rings) GROUP BY 1),
entry AS (SELECT u.class_id, arg_min(u.ancestor_id, u.depth) AS id FROM up u WHERE u.ancestor_id IN (SELECT id FROM rings) GROUP BY 1),
firsts AS (SELECT ring, arg_min(e.id, e.class_id) AS entry FROM entry e JOIN ring_name USING (id) GROUP BY 1),
issues AS (
SELECT 'warning' AS severity, 'missing_label' AS code, id AS term_id, NULL AS detail FROM classes WHERE odd
UNION ALL SELECT 'error', CASE WHEN k.kind IS NULL THEN 'missing_parent_class' ELSE 'parent_is_not_class' END, c.id, c.parent FROM classes c LEFT JOIN kinds k ON k.id = c.parent WHERE c.parent IS NOT NULL AND (k.kind IS NULL OR k.kind <> 'Class')
UNION ALL SELECT 'error', 'cyclic_class_hierarchy', r.id, NULL FROM rings r JOIN firsts f ON f.entry = r.parent
UNION ALL SELECT 'warning', 'missing_domain', id, NULL FROM props WHERE len(domains) = 0
UNION ALL SELECT 'error', CASE WHEN kind IS NULL THEN 'missing_domain_class' ELSE 'domain_is_not_class' END, id, other FROM doms WHERE kind IS NULL OR kind <> 'Class'
UNION ALL SELECT CASE WHEN is_object THEN 'error' ELSE 'warning' END, 'missing_range', id, NULL FROM props WHERE len(ranges) = 0
UNION ALL SELECT 'error', CASE WHEN kind IS NULL THEN 'missing_range_class' ELSE 'range_is_not_class' END, id, other FROM rngs WHERE kind IS NULL OR kind <> 'Class'
UNION ALL SELECT 'error', 'no_concrete_entity_target', r.id, NULL FROM rngs r WHERE r.kind = 'Class' AND NOT EXISTS (
  SELECT 1 FROM ups u JOIN entities e ON e.class_id = u.class_id WHERE u.ancestor_id = r.other)
UNION ALL SELECT 'warning', 'missing_inverse_label', id, NULL FROM props WHERE is_object AND len(ranges) > 0 AND NOT has_inverse)"""


@query("h8_validation_issues", f"{_ISSUES_SQL} SELECT * FROM issues")
def _(spark, sf):
    return o.validate(taxonomy(spark, sf, broken=True))


@query("h8_validation_summary", f"""{_ISSUES_SQL} SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM region) + 2 AS term_count,
count(*) FILTER (WHERE severity = 'error') AS error_count, count(*) FILTER (WHERE severity = 'warning') AS warning_count, count(*) FILTER (WHERE severity = 'error') = 0 AS is_valid FROM issues""")
def _(spark, sf):
    terms = taxonomy(spark, sf, broken=True)
    return o.validation_summary(o.validate(terms), terms)


@query("r6_label_choice", f"""{T} SELECT id, en AS label, NULL AS inverse_label FROM classes UNION ALL SELECT id, label, NULL FROM dprops
UNION ALL SELECT id, label, inverse_label FROM oprops UNION ALL SELECT '{O}enum' || r_regionkey, r_name, NULL FROM region""")
def _(spark, sf):
    return o.labelled(taxonomy(spark, sf), "EN").select("id", "label", "inverse_label")


@query("r6_label_fallback", f"""{T} SELECT id, coalesce(plain, en) AS label FROM classes UNION ALL SELECT id, label FROM dprops
UNION ALL SELECT id, 'ru ' || label FROM oprops UNION ALL SELECT '{O}enum' || r_regionkey, r_name FROM region""")
def _(spark, sf):
    return o.labelled(taxonomy(spark, sf), "de").select("id", "label")


@query("r7_enumeration_labels", f"{T} SELECT property_id, value, label FROM enum_first JOIN states USING (range_id)")
def _(spark, sf):
    return o.enumeration_labels(taxonomy(spark, sf), "en")


@query("f12_suggest_classes", f"""{T}, forms AS (SELECT DISTINCT id, en AS label, is_abstract, unnest([lower(en), lower(plain), lower(ru), substr(id, {len(O) + 1})]) AS form FROM classes),
asked AS (SELECT DISTINCT lower(left(p_name, 3)) AS q FROM part UNION SELECT DISTINCT lower(p_brand) FROM part)
SELECT q AS query_id, id AS class_id, label, rest = 0 AS exact, is_abstract, CAST(place AS INTEGER) AS place FROM (
SELECT q, id, label, is_abstract, rest, row_number() OVER (PARTITION BY q ORDER BY rest, lower(label), label, id) AS place FROM (
SELECT q, id, label, is_abstract, min(length(form) - length(q)) AS rest FROM forms JOIN asked ON starts_with(form, q) WHERE form IS NOT NULL GROUP BY ALL))""")
def _(spark, sf):
    parts = table(spark, sf, "part")
    asked = parts.select(F.left("p_name", F.lit(3)).alias("q")).union(parts.select("p_brand")).distinct()
    return o.suggest_classes(taxonomy(spark, sf), asked.select(F.lower("q").alias("query_id"), F.col("q").alias("query")), "en")
