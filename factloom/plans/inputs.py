"""The star-schema tables read as the fact model, in Spark and as SQL subqueries.

Mapping only: every entity says, in expressions both dialects read, which node a table row is and which
properties it has. Operators and the SQL they are compared with start from here and share nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

from .. import vocab as v
from ..schemas import PROPERTY, TERMS
from ..session import configure

O = v.NS
ALLOWED = ["cass0", "cass1", "cass2", "cass3"]  # cass4 is hidden


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table; its schema is read from the files once per process."""
    configure(spark)
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Configuration rows as a table of constants, without a Python worker."""
    fields = StructType.fromDDL(schema)
    text = json.dumps([dict(zip(fields.names, r)) for r in rows], ensure_ascii=False)
    return configure(spark).range(1).select(F.inline(F.from_json(F.lit(text), ArrayType(fields))))




# --- revision log from events -------------------------------------------------------------------

def event_log(spark: SparkSession, sf: str) -> DataFrame:
    return event_records(table(spark, sf, "events"))


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same log as a stream of its files."""
    schema = table(spark, sf, "events").schema
    return event_records(spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf))


def event_records(e: DataFrame) -> DataFrame:
    """Records of ``schemas.RECORDS``: users are ids; large errors delete, large signups substitute."""
    big = F.col("value") > 200
    kind = (F.when(big & (F.col("event_type") == "error"), v.DELETE)
            .when(big & (F.col("event_type") == "signup") & (F.col("user_id") > 0), v.SUBSTITUTE).otherwise(v.RESOURCE))

    def user(expr: str):
        return F.concat(F.lit("u"), F.expr(expr).cast("string"))

    def prop(predicate: str, kind_: str, value, lang=None):
        return F.struct(F.lit(O + predicate).alias("predicate"), F.lit(kind_).alias("kind"), value.alias("value"),
                        F.lit(lang).cast("string").alias("lang"), F.lit(None).cast("string").alias("datatype"))

    props = F.array(
        prop("name", v.LITERAL, F.col("event_type"), "en"),
        prop("value", v.LITERAL, F.round(F.col("value") * 100).cast("bigint").cast("string")),
        prop("friend", v.RESOURCE, user("floor(user_id / 3)")),
        prop("peer", v.RESOURCE, user("floor(user_id / 2)")))
    seq = (F.col("event_id") % 5).cast("int")
    e = e.withColumn("kind", kind).withColumn("source_seq", seq)
    is_resource = F.col("kind") == v.RESOURCE
    return e.select(
        "source_seq", F.col("event_id").alias("ordinal"),
        F.concat(F.lit("cass"), F.col("source_seq").cast("string")).alias("cassette_id"),
        F.concat(F.lit("Cass"), F.col("source_seq").cast("string")).alias("cassette_name"),
        F.concat(F.lit("cass"), F.col("source_seq").cast("string"), F.lit("/originals/0001/log.fog")).alias("source_path"),
        "kind", user("user_id").alias("resource_id"), F.when(is_resource, F.lit(O + "person")).alias("type"),
        F.when(F.col("kind") == v.SUBSTITUTE, user("floor(user_id / 2)")).alias("substitute_target"),
        F.col("ts").cast("date").cast("timestamp").alias("modified_at"),
        F.col("ts").cast("date").cast("string").alias("modified_at_raw"),
        F.when(is_resource, props).otherwise(F.slice(props, 1, 0)).alias("props"))


LOG_SQL = f"""
log AS (
  SELECT event_id % 5 AS source_seq, event_id AS ordinal, 'cass' || (event_id % 5) AS cassette_id,
         'cass' || (event_id % 5) || '/originals/0001/log.fog' AS source_path,
         CASE WHEN value > 200 AND event_type = 'error' THEN 'delete'
              WHEN value > 200 AND event_type = 'signup' AND user_id > 0 THEN 'substitute'
              ELSE 'resource' END AS kind,
         'u' || user_id AS resource_id, 'u' || (user_id // 2) AS half, 'u' || (user_id // 3) AS third,
         CAST(ts AS DATE) AS modified_on, event_type, CAST(round(value * 100) AS BIGINT) AS cents
  FROM events),
directives AS (
  SELECT resource_id AS id, bool_or(kind = 'delete') AS deleted,
         CASE WHEN NOT bool_or(kind = 'delete')
              THEN arg_max(half, source_seq * 1000000000000 + ordinal) FILTER (WHERE kind = 'substitute') END AS target
  FROM log WHERE kind <> 'resource' GROUP BY 1),
chain AS (
  SELECT id, target AS cur, 1 AS hops FROM directives WHERE NOT deleted
  UNION ALL
  SELECT c.id, d.target, c.hops + 1 FROM chain c JOIN directives d ON d.id = c.cur AND NOT d.deleted),
closure AS (
  SELECT id, arg_max(cur, hops) AS resolved, max(hops) AS hops FROM chain GROUP BY id
  UNION ALL SELECT id, NULL, 0 FROM directives WHERE deleted),
latest AS (
  SELECT * FROM log WHERE kind = 'resource'
  QUALIFY row_number() OVER (PARTITION BY resource_id ORDER BY modified_on DESC, source_seq DESC, ordinal DESC) = 1),
current_log AS (
  SELECT l.resource_id, CAST(l.modified_on AS VARCHAR) AS modified_on, l.cassette_id, l.source_path, l.ordinal,
         l.event_type, l.cents, coalesce(f.resolved, l.third) AS friend, coalesce(p.resolved, l.half) AS peer
  FROM latest l LEFT JOIN closure f ON f.id = l.third LEFT JOIN closure p ON p.id = l.half
  WHERE l.resource_id NOT IN (SELECT id FROM directives))"""

LOG_WITH = "WITH RECURSIVE " + LOG_SQL.strip()


# --- graph of nodes from the star schema -----------------------------------------------------------

@dataclass(frozen=True)
class Entity:
    """One node per row of ``table``: id, type, folder and properties as SQL both dialects read."""

    table: str
    prefix: str
    id: str
    type: str
    folder: str
    props: tuple[tuple[str, str, str, str | None], ...]  # predicate, kind, value, language
    where: str = "true"


def _num(expr: str) -> str:
    return f"cast({expr} as string)"


_DAY = "cast(cast({} as date) as string)"
_ORDER_DAY, _SHIP_DAY = _DAY.format("o_orderdate"), _DAY.format("l_shipdate")
_LINE_ID = ("concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), "
            "cast(l_suppkey as string), " + _SHIP_DAY + ", cast(cast(round(l_extendedprice * 100) as bigint) as string))")

ENTITIES = (
    Entity("region", "region:", _num("r_regionkey"), f"'{O}place'", "r_regionkey % 5", (
        ("name", "literal", "r_name", "en"),)),
    Entity("nation", "nation:", _num("n_nationkey"), f"'{O}place'", "n_nationkey % 5", (
        ("name", "literal", "n_name", "en"),
        ("located-in", "iri", f"concat('region:', {_num('n_regionkey')})", None))),
    Entity("customer", "customer:", _num("c_custkey"), f"concat('{O}seg-', c_mktsegment)", "c_custkey % 5", (
        ("name", "literal", "case when c_custkey % 3 <> 0 then c_name end", "en"),
        ("name", "literal", "case when c_custkey % 3 = 0 then c_name end", "ru"),
        ("alias", "literal", "c_mktsegment", None),
        ("citizen", "iri", f"concat('nation:', {_num('c_nationkey')})", None))),
    Entity("supplier", "supplier:", _num("s_suppkey"), f"'{O}org-sys'", "s_suppkey % 5", (
        ("name", "literal", "s_name", "en"),
        ("description", "literal", f"concat('works in NATION_', {_num('s_nationkey')})", "en"),
        ("located-in", "iri", f"concat('nation:', {_num('s_nationkey')})", None))),
    Entity("part", "part:", _num("p_partkey"), f"concat('{O}kind-', p_type)", "p_partkey % 5", (
        ("name", "literal", "p_name", "en"),
        ("alias", "literal", "p_brand", None),
        ("uri", "literal", "concat('iiss://Cass', cast(p_partkey % 5 as string), '@iis.nsk.su/', "
         "lpad(cast(cast(floor(p_partkey / 1000) as bigint) % 10000 as string), 4, '0'), '/', "
         "lpad(cast(p_partkey % 1000 as string), 4, '0'))", None),
        ("description", "literal", f"concat(p_type, ' / size ', {_num('p_size')})", "en"),
        ("date", "literal", f"case when p_size % 2 = 0 then {_num('1950 + p_size')} end", None))),
    Entity("orders", "order:", _num("o_orderkey"), f"'{O}collection'", "o_orderkey % 5", (
        ("name", "literal", f"concat('Order ', {_num('o_orderkey')})", "en"),
        ("from-date", "literal", f"case o_orderkey % 3 when 0 then substring({_ORDER_DAY}, 1, 4) "
         f"when 1 then substring({_ORDER_DAY}, 1, 7) else {_ORDER_DAY} end", None),
        ("to-date", "literal", "case when o_orderkey % 4 = 0 then '2005' end", None))),
    Entity("orders", "deal:", _num("o_orderkey"), f"'{O}participation'", "o_orderkey % 5", (
        ("participant", "iri", f"concat('customer:', {_num('o_custkey')})", None),
        ("in-org", "iri", f"concat('supplier:', {_num('cast(floor(o_custkey / 15) as bigint)')})", None),
        ("role", "literal", "case when o_orderstatus <> 'P' then o_orderpriority end", "en"),
        ("from-date", "literal", _ORDER_DAY, None))),
    Entity("lineitem", "member:", _LINE_ID, f"'{O}collection-member'", "l_suppkey % 5", (
        ("in-collection", "iri", f"concat('order:', {_num('l_orderkey')})", None),
        ("collection-item", "iri", f"case when l_linenumber = 3 then concat('supplier:', {_num('l_suppkey')}) "
         f"else concat('part:', {_num('l_partkey')}) end", None)), "l_linenumber <= 3"),
    Entity("lineitem", "reflection:", _LINE_ID, f"'{O}reflection'", "l_suppkey % 5", (
        ("reflected", "iri", f"case when l_linenumber = 4 then concat('supplier:', {_num('l_suppkey')}) "
         f"else concat('order:', {_num('l_orderkey')}) end", None),
        ("in-doc", "iri", f"concat('part:', {_num('l_partkey')})", None),
        ("from-date", "literal", f"case when l_linenumber = 4 then {_SHIP_DAY} end", None)),
        "l_linenumber between 4 and 5"),
    Entity("lineitem", "delivery:", _LINE_ID, f"'{O}delivery'", "l_suppkey % 5", (
        ("supplied-by", "iri", f"concat('supplier:', {_num('l_suppkey')})", None),
        ("supplies", "iri", f"concat('part:', {_num('l_partkey')})", None),
        ("for-order", "iri", f"concat('order:', {_num('l_orderkey')})", None),
        ("role", "literal", "case when l_linestatus = 'O' then l_returnflag end", None),
        ("quantity", "literal", _num("cast(l_quantity as bigint)"), None),
        ("from-date", "literal", f"case when l_linenumber = 6 then {_SHIP_DAY} end", None)),
        "l_linenumber >= 6"),
)
PREFIXES = tuple(e.prefix for e in ENTITIES)


def _dealt_records(spark: SparkSession, sf: str, deal: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``graph_current`` whose rows are dealt before their properties are written out: values alone are moved."""
    width = max(len(e.props) for e in ENTITIES)
    branches = []
    for n, e in enumerate(ENTITIES):
        values = [f"cast({x} as string)" for _, _, x, _ in e.props] + ["cast(null as string)"] * (width - len(e.props))
        branches.append(table(spark, sf, e.table).where(e.where).selectExpr(
            f"concat('{e.prefix}', {e.id}) as resource_id", f"{e.type} as type", f"cast({e.folder} as string) as folder", f"{n} as entity",
            f"array({', '.join(values)}) as vals"))

    def listed(column) -> str:
        texts = [column(e.props[i]) if i < len(e.props) else None for e in ENTITIES for i in range(width)]
        return "array(" + ", ".join("cast(null as string)" if t is None else f"'{t}'" for t in texts) + ")"

    names, kinds, langs = listed(lambda x: O + x[0]), listed(lambda x: v.RESOURCE if x[1] == "iri" else x[1]), listed(lambda x: x[3])
    props = [f"if(vals[{i}] is null, cast(array() as array<{PROPERTY}>), array(named_struct('predicate', get({names}, entity * {width} + {i}), "
             f"'kind', get({kinds}, entity * {width} + {i}), 'value', vals[{i}], 'lang', get({langs}, entity * {width} + {i}), "
             f"'datatype', cast(null as string))))" for i in range(width)]
    tables = "array(" + ", ".join(f"'{e.table}'" for e in ENTITIES) + ")"
    return deal(reduce(DataFrame.unionByName, branches)).selectExpr(
        "resource_id", "type", "timestamp'2024-01-01 00:00:00' as modified_at", f"concat({', '.join(props)}) as props",
        "concat('cass', folder) as cassette_id", "concat('Cass', folder) as cassette_name", f"get({tables}, entity) as source_path",
        "0L as ordinal", "false as is_synthetic")


def graph_current(spark: SparkSession, sf: str, nodes: tuple[str, ...] | None = None,
                  predicates: tuple[str, ...] | None = None, deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Current records of the chosen node kinds, with only the chosen properties, so scans read no other column.

    ``deal`` shuffles rows by their ``resource_id`` (all records are then given), before they have their properties.
    """
    if deal is not None and nodes is None and predicates is None:
        return _dealt_records(spark, sf, deal)
    branches = []
    for e in ENTITIES:
        if nodes is not None and e.prefix not in nodes:
            continue
        # lists of none or one put together: unlike a filter's lambda, compiled by Spark
        none = f"cast(array() as array<{PROPERTY}>)"
        props = [
            f"if(({x}) is null, {none}, array(named_struct('predicate', '{O}{p}', 'kind', '{v.RESOURCE if k == 'iri' else k}', 'value', {x}, "
            f"'lang', cast({'null' if lang is None else repr(lang)} as string), 'datatype', cast(null as string))))"
            for p, k, x, lang in e.props if predicates is None or O + p in predicates]
        listed = f"concat({', '.join(props)})" if props else none
        branches.append(table(spark, sf, e.table).where(e.where).selectExpr(
            f"concat('{e.prefix}', {e.id}) as resource_id", f"{e.type} as type", "timestamp'2024-01-01 00:00:00' as modified_at",
            f"{listed} as props", f"concat('cass', cast({e.folder} as string)) as cassette_id",
            f"concat('Cass', cast({e.folder} as string)) as cassette_name", f"'{e.table}' as source_path",
            "0L as ordinal", "false as is_synthetic"))
    return reduce(DataFrame.unionByName, branches)


def graph_sql(nodes: tuple[str, ...] | None = None) -> str:
    """Subqueries ``heads`` and ``triples`` of the same graph."""
    heads, triples = [], []
    for e in ENTITIES:
        if nodes is not None and e.prefix not in nodes:
            continue
        head = f"concat('{e.prefix}', {e.id})"
        folder = f"concat('cass', cast({e.folder} as string))"
        heads.append(f"SELECT {head} AS resource_id, {folder} AS cassette_id, '{e.table}' AS source_path FROM {e.table} WHERE {e.where}")
        rows = [(v.RDF_TYPE, "iri", e.type, None)] + [(O + p, k, x, lang) for p, k, x, lang in e.props]
        for i, (pred, kind, x, lang) in enumerate(rows):
            place = " + ".join(["-1" if i == 0 else "0", *(f"CAST(({y}) IS NOT NULL AS INTEGER)" for _, _, y, _ in rows[1:i])])
            triples.append(
                f"SELECT {head} AS subject, '{pred}' AS predicate, {place} AS ord, '{kind}' AS object_kind, {x} AS object_value, "
                f"{'NULL' if lang is None else repr(lang)} AS lang, {folder} AS cassette_id, '{e.table}' AS source_path "
                f"FROM {e.table} WHERE {e.where} AND ({x}) IS NOT NULL")
    return ("heads AS MATERIALIZED (" + " UNION ALL ".join(heads) + "),\ntriples AS MATERIALIZED (" + " UNION ALL ".join(triples) + "),\n"
            "seen_heads AS MATERIALIZED (SELECT * FROM heads WHERE cassette_id IN ('cass0','cass1','cass2','cass3','$system')),\n"
            "seen AS MATERIALIZED (SELECT * FROM triples WHERE cassette_id IN ('cass0','cass1','cass2','cass3','$system'))")


# --- the graph's ontology ---------------------------------------------------------------------------

# class: parent, English label, Russian label, abstract
_CLASSES = {
    "entity": (None, "Entity", "Сущность", True),
    "sys-obj": ("entity", "System object", "Системный объект", True),
    "place": ("sys-obj", "Place", "Место", False),
    "person": ("sys-obj", "Person", "Персона", False),
    "org-sys": ("sys-obj", "Organization", "Организация", False),
    "collection": ("sys-obj", "Collection", "Коллекция", False),
    "document": ("sys-obj", "Document", "Документ", True),
    "photo-doc": ("document", "Photo", "Фотодокумент", False),
    "reflection": ("entity", "Reflection", "Отражение", False),
    "participation": ("entity", "Participation", "Участие", False),
    "collection-member": ("entity", "Membership", "Членство", False),
    "delivery": ("entity", "Delivery", "Поставка", False),
    **{f"seg-{s}": ("person", s.title(), None, False)
       for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")},
    **{f"kind-{k}": ("photo-doc", k.title(), None, False)
       for k in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")},
}
# property: kind, domain, range, label, inverse label, priority
_PROPERTIES = {
    "name": ("DatatypeProperty", "entity", None, "name", None, "01"),
    "alias": ("DatatypeProperty", "sys-obj", None, "alias", None, "02"),
    "description": ("DatatypeProperty", "sys-obj", None, "description", None, "03"),
    "uri": ("DatatypeProperty", "document", None, "address", None, None),
    "date": ("DatatypeProperty", "document", "date", "date", None, "04"),
    "from-date": ("DatatypeProperty", "entity", "date", "from", None, "05"),
    "to-date": ("DatatypeProperty", "entity", "date", "to", None, "06"),
    "role": ("DatatypeProperty", "entity", None, "role", None, "07"),
    "quantity": ("DatatypeProperty", "delivery", "integer", "quantity", None, "08"),
    "located-in": ("ObjectProperty", "sys-obj", "place", "located in", "place of", "10"),
    "citizen": ("ObjectProperty", "person", "place", "citizen of", None, "11"),
    "participant": ("ObjectProperty", "participation", "person", "participant", "takes part", None),
    "in-org": ("ObjectProperty", "participation", "org-sys", "organization", "members", None),
    "in-collection": ("ObjectProperty", "collection-member", "collection", "collection", "holds", None),
    "collection-item": ("ObjectProperty", "collection-member", "sys-obj", "item", "kept in", None),
    "reflected": ("ObjectProperty", "reflection", "sys-obj", "shows", "shown in", None),
    "in-doc": ("ObjectProperty", "reflection", "document", "document", "reflects", None),
    "supplied-by": ("ObjectProperty", "delivery", "org-sys", "supplier", "supplied", "20"),
    "supplies": ("ObjectProperty", "delivery", "sys-obj", "goods", None, "21"),
    "for-order": ("ObjectProperty", "delivery", "collection", "order", "deliveries", "22"),
}


def graph_terms(spark: SparkSession) -> DataFrame:
    def texts(**labels):
        return [{"value": text, "lang": lang} for lang, text in labels.items() if text is not None]

    rows = [(O + c, v.CLASS, texts(en=en, ru=ru), [], None, None if p is None else O + p, [], [], [], a, False)
            for c, (p, en, ru, a) in _CLASSES.items()]
    rows += [(O + p, kind, texts(en=label), texts(en=inverse), priority, None, [O + d], [] if r is None else [O + r],
              [], False, False) for p, (kind, d, r, label, inverse, priority) in _PROPERTIES.items()]
    return literal_rows(spark, rows, TERMS)


def _values(rows: list[tuple]) -> str:
    def cell(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows) + ")"


def _ancestors(name: str) -> list[str]:
    out = [name]
    while (name := _CLASSES[name][0]) is not None:
        out.append(name)
    return out


def kinds_sql() -> str:
    """Subqueries ``kinds`` (class, English label, group flags) and ``props`` (property, label, inverse label)."""
    flags = ("sys-obj", "entity", "org-sys", "collection", "document", "photo-doc", "person")
    rows = [(O + c, en, *[f in _ancestors(c) for f in flags], O + c in v.TECHNICAL_TYPES)
            for c, (_, en, _, _) in _CLASSES.items()]
    props = [(O + p, label, inverse or label, kind == "DatatypeProperty" and r == "date")
             for p, (kind, _, r, label, inverse, _) in _PROPERTIES.items()]
    return (f"kinds AS (SELECT * FROM {_values(rows)} AS t(type, type_label, is_entity, under_entity, is_org, is_collection, "
            f"is_document, is_photo, is_person, is_technical)),\nprops AS (SELECT * FROM {_values(props)} AS t(predicate, label, inverse_label, is_date))")
