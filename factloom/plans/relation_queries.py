"""Collections, duplicates and resource pages (G) on the node graph, for every resource."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as v
from ..functions.dates import parse_date
from ..operators import access, collections as c, duplicates as d, factorised as f, relations as g
from ..schemas import CASSETTES, MEMBERS, ROLES
from . import store
from .graph_queries import G
from .inputs import ALLOWED, O, graph_terms, kinds_sql, literal_rows, table
from .registry import query

_LANG = "en"


def show_sql(x: str) -> str:
    """Display text of Y, Y-M or Y-M-D."""
    return (f"CASE length({x}) WHEN 4 THEN {x} || ' г.' WHEN 7 THEN ['Январь','Февраль','Март','Апрель','Май','Июнь','Июль','Август','Сентябрь','Октябрь','Ноябрь','Декабрь'][CAST(substr({x}, 6, 2) AS INTEGER)] || ' ' || left({x}, 4) || ' г.' "
            f"ELSE CAST(CAST(substr({x}, 9, 2) AS INTEGER) AS VARCHAR) || ' ' || ['января','февраля','марта','апреля','мая','июня','июля','августа','сентября','октября','ноября','декабря'][CAST(substr({x}, 6, 2) AS INTEGER)] || ' ' || left({x}, 4) || ' г.' END")


def sort_sql(x: str) -> str:
    return f"CASE length({x}) WHEN 4 THEN {x} || '-01-01' WHEN 7 THEN {x} || '-01' ELSE {x} END"


NODES_SQL = f"""{kinds_sql()},
facts AS MATERIALIZED (SELECT subject AS resource_id, min(object_value) FILTER (WHERE predicate = '{v.RDF_TYPE}') AS type,
  coalesce(min(object_value) FILTER (WHERE predicate = '{v.NAME}' AND lang = 'en'), min(object_value) FILTER (WHERE predicate = '{v.NAME}')) AS name,
  min(object_value) FILTER (WHERE predicate = '{v.FROM_DATE}') AS d_from, min(object_value) FILTER (WHERE predicate = '{v.TO_DATE}') AS d_to,
  min(object_value) FILTER (WHERE predicate = '{v.DATE}') AS d_own, min(object_value) FILTER (WHERE predicate = '{v.ROLE}') AS role,
  min(object_value) FILTER (WHERE predicate = '{v.URI}') AS uri FROM seen GROUP BY 1),
nodes AS MATERIALIZED (SELECT h.resource_id, type, type_label, coalesce(name, h.resource_id) AS display_name, uri AS document_uri, uri IS NOT NULL AS has_document,
  CASE WHEN d_from IS NOT NULL THEN {show_sql('d_from')} || CASE WHEN d_to IS NULL THEN '' ELSE '–' || {show_sql('d_to')} END
       ELSE {show_sql('d_own')} END AS display_date, {sort_sql('coalesce(d_from, d_own)')} AS sort_date, role,
  is_entity, under_entity, is_org, is_collection, is_document, is_photo, under_entity AND NOT is_entity AS is_complex, is_technical
  FROM seen_heads h JOIN facts USING (resource_id) JOIN kinds USING (type)),
edges AS MATERIALIZED (SELECT subject AS source_id, predicate, object_value AS target_id FROM seen WHERE object_kind = 'iri' AND predicate <> '{v.RDF_TYPE}')"""

_LINK = """l.root_id, n.resource_id, n.display_name, n.type, n.type_label, l.relation_label, l.relation_id, n.document_uri,
CASE WHEN r.sort_date IS NOT NULL THEN r.display_date WHEN n.document_uri IS NOT NULL THEN n.display_date END AS display_date,
CASE WHEN r.sort_date IS NOT NULL THEN r.sort_date WHEN n.document_uri IS NOT NULL THEN n.sort_date END AS sort_date,
coalesce(r.type, l.relation_label) AS group_key, coalesce(r.type_label, l.relation_label) AS group_label, n.has_document"""


def _links(name: str, pairs: str) -> str:
    return f"{name} AS (SELECT {_LINK} FROM ({pairs}) l JOIN nodes n ON n.resource_id = l.resource_id AND NOT n.is_technical LEFT JOIN nodes r ON r.resource_id = l.relation_id)"


_PEOPLE = f"""SELECT DISTINCT a.target_id AS root_id, b.target_id AS resource_id, a.source_id AS relation_id, coalesce(m.role, 'участник') AS relation_label
FROM edges a JOIN nodes m ON m.resource_id = a.source_id AND m.type = '{v.PARTICIPATION}' JOIN edges b ON b.source_id = a.source_id AND b.predicate = '{v.PARTICIPANT}'
JOIN nodes root ON root.resource_id = a.target_id AND root.is_org WHERE a.predicate = '{v.IN_ORG}'
UNION ALL SELECT DISTINCT a.target_id, b.target_id, a.source_id, 'элемент коллекции' FROM edges a JOIN nodes m ON m.resource_id = a.source_id AND m.type = '{v.COLLECTION_MEMBER}'
JOIN edges b ON b.source_id = a.source_id AND b.predicate = '{v.COLLECTION_ITEM}' JOIN nodes i ON i.resource_id = b.target_id AND NOT i.is_document
JOIN nodes root ON root.resource_id = a.target_id AND root.is_collection WHERE a.predicate = '{v.IN_COLLECTION}'"""
_ORGS = f"""SELECT DISTINCT a.target_id AS root_id, b.target_id AS resource_id, a.source_id AS relation_id, coalesce(m.role, 'участие') AS relation_label
FROM edges a JOIN nodes m ON m.resource_id = a.source_id AND m.type = '{v.PARTICIPATION}' JOIN edges b ON b.source_id = a.source_id AND b.predicate = '{v.IN_ORG}'
JOIN nodes root ON root.resource_id = a.target_id AND NOT root.is_technical WHERE a.predicate = '{v.PARTICIPANT}'"""
_HOLD = f"""SELECT DISTINCT root_id, h.target_id AS resource_id, k.source_id AS relation_id, 'в коллекции' AS relation_label FROM (
SELECT resource_id AS root_id, resource_id AS item_id FROM nodes WHERE NOT is_technical
UNION SELECT a.target_id, b.target_id FROM edges a JOIN nodes m ON m.resource_id = a.source_id AND m.type = '{v.REFLECTION}'
JOIN edges b ON b.source_id = a.source_id AND b.predicate = '{v.IN_DOC}' JOIN nodes doc ON doc.resource_id = b.target_id
JOIN nodes root ON root.resource_id = a.target_id AND NOT root.is_technical WHERE a.predicate = '{v.REFLECTED}')
JOIN edges k ON k.target_id = item_id AND k.predicate = '{v.COLLECTION_ITEM}' JOIN nodes m ON m.resource_id = k.source_id AND m.type = '{v.COLLECTION_MEMBER}'
JOIN edges h ON h.source_id = k.source_id AND h.predicate = '{v.IN_COLLECTION}'"""
INCIDENT_SQL = """incident AS MATERIALIZED (SELECT DISTINCT e.source_id AS root_id, 0 AS direction, predicate, e.target_id AS other_id, label FROM edges e JOIN props USING (predicate)
  JOIN nodes r ON r.resource_id = e.source_id AND NOT r.is_technical
  UNION ALL SELECT DISTINCT e.target_id, 1, predicate, e.source_id, inverse_label FROM edges e JOIN props USING (predicate) JOIN nodes r ON r.resource_id = e.target_id AND NOT r.is_technical)"""


def _related(technical: bool) -> str:
    return f"""SELECT f.root_id, t.resource_id, f.relation_id, f.label || ' · ' || m.type_label AS relation_label FROM
(SELECT root_id, other_id AS relation_id, arg_min(label, direction || predicate) AS label FROM incident GROUP BY ALL) f
JOIN nodes m ON m.resource_id = f.relation_id AND m.is_complex {'' if technical else 'AND NOT m.is_technical'}
JOIN (SELECT DISTINCT source_id, target_id FROM edges) o ON o.source_id = f.relation_id AND o.target_id <> f.root_id JOIN nodes t ON t.resource_id = o.target_id AND t.is_entity
UNION ALL SELECT DISTINCT i.root_id, i.other_id, CAST(NULL AS VARCHAR), i.label FROM incident i JOIN nodes n ON n.resource_id = i.other_id AND NOT n.is_complex"""


PAGES_SQL = ",\n".join([NODES_SQL, INCIDENT_SQL])
_MERGED_SQL = ",\n".join([PAGES_SQL, _links("people", _PEOPLE), _links("orgs", _ORGS), _links("holders", _HOLD), _links("rel", _related(True)), """
merged AS (SELECT * FROM (SELECT *, 0 AS no FROM people UNION ALL SELECT *, 1 FROM orgs UNION ALL SELECT *, 2 FROM holders UNION ALL SELECT *, 3 FROM rel)
  QUALIFY row_number() OVER (PARTITION BY root_id, resource_id, coalesce(relation_id, ''), group_key ORDER BY no, sort_date NULLS LAST, lower(display_name), relation_label) = 1)"""])
_LINK_COLUMNS = "root_id, resource_id, display_name, type, type_label, relation_label, relation_id, document_uri, display_date, sort_date, group_key, group_label, has_document"

_ENTRIES_SQL = PAGES_SQL + f""",
members AS MATERIALIZED (SELECT DISTINCT m.resource_id AS relation_id, CASE side WHEN 0 THEN 'direct:' ELSE 'inverse:' END || e.predicate AS role_key, n.resource_id,
    CASE side WHEN 0 THEN p.label ELSE p.inverse_label END AS role_label, n.display_name, n.document_uri, n.has_document, n.display_date, n.sort_date
  FROM (SELECT 0 AS side, source_id AS rel, target_id AS other, predicate FROM edges UNION ALL SELECT 1, target_id, source_id, predicate FROM edges) e
  JOIN nodes m ON m.resource_id = e.rel AND m.is_complex JOIN nodes n ON n.resource_id = e.other AND n.is_entity JOIN props p USING (predicate)),
vals AS MATERIALIZED (SELECT DISTINCT subject AS relation_id, p.label, trim(object_value) AS value FROM seen t JOIN nodes n ON n.resource_id = t.subject AND n.is_complex
  JOIN props p USING (predicate) WHERE object_kind = 'literal' AND NOT is_date AND predicate NOT IN ('{v.NAME}', '{v.URI}')),
cx AS MATERIALIZED (SELECT DISTINCT i.root_id, n.* FROM incident i JOIN nodes n ON n.resource_id = i.other_id AND n.is_complex),
docs AS (SELECT cx.root_id, cx.resource_id, arg_min(m.document_uri, (CASE WHEN m.resource_id = cx.root_id THEN '1' ELSE '0' END) || lower(m.role_label) || chr(1) || lower(m.display_name) || chr(1) || m.resource_id) AS doc,
    min(m.sort_date) AS member_sort, arg_min(m.display_date, m.sort_date || m.display_date) AS member_display
  FROM cx JOIN members m ON m.relation_id = cx.resource_id AND m.document_uri IS NOT NULL GROUP BY ALL),
entries AS MATERIALIZED (SELECT cx.root_id, cx.resource_id AS key, coalesce(trim(role), CASE WHEN display_name <> cx.resource_id THEN display_name END, type_label) AS title, cx.resource_id AS relation_id,
    type AS relation_type, type_label AS relation_type_label, type AS group_key, type_label AS group_label,
    coalesce(display_date, member_display) AS display_date, coalesce(sort_date, member_sort) AS sort_date, coalesce(document_uri, doc) AS document_uri, CAST(NULL AS VARCHAR) AS member_id,
    coalesce(nm, 0) AS n_members, coalesce(nd, 0) AS n_documents, coalesce(nv, 0) AS n_values
  FROM cx LEFT JOIN docs USING (root_id, resource_id) LEFT JOIN (SELECT relation_id, count(*) AS nm, count(*) FILTER (WHERE has_document) AS nd FROM members GROUP BY 1) mm ON mm.relation_id = cx.resource_id
  LEFT JOIN (SELECT relation_id, count(*) AS nv FROM vals GROUP BY 1) vv ON vv.relation_id = cx.resource_id
  UNION ALL SELECT i.root_id, CASE direction WHEN 0 THEN 'direct:' ELSE 'inverse:' END || predicate || chr(10) || other_id, label, NULL, NULL, NULL,
    CASE direction WHEN 0 THEN 'direct:' ELSE 'inverse:' END || predicate, label, CASE WHEN document_uri IS NOT NULL THEN display_date END,
    CASE WHEN document_uri IS NOT NULL THEN sort_date END, document_uri, other_id, 1, CAST(has_document AS BIGINT), 0
  FROM incident i JOIN nodes n ON n.resource_id = i.other_id AND NOT n.is_complex)"""
_ENTRY_COLUMNS = "root_id, key, title, relation_id, relation_type, relation_type_label, group_key, group_label, display_date, sort_date, document_uri, member_id, n_members, n_documents, n_values"
_SECTION_SQL = """CASE WHEN document_uri IS NOT NULL OR n_documents > 0 THEN 'public:media' ELSE 'public:links:' || coalesce(relation_type, group_key) END AS section_key,
CASE WHEN document_uri IS NOT NULL OR n_documents > 0 THEN 'Фотографии' WHEN relation_type LIKE '%/reflection' THEN 'Отражены' ELSE coalesce(relation_type_label, group_label) END AS section_title"""


# --- collections ----------------------------------------------------------------------------------------

_MEMBERSHIP_SQL = f"""membership AS MATERIALIZED (SELECT DISTINCT a.object_value AS collection_id, a.subject AS membership_id, b.object_value AS resource_id, a.cassette_id AS membership_cassette_id
FROM seen a JOIN seen b ON b.subject = a.subject AND b.predicate = '{v.COLLECTION_ITEM}' WHERE a.predicate = '{v.IN_COLLECTION}')"""


@query("g1_memberships", f"{G}, {_MEMBERSHIP_SQL} SELECT * FROM membership")
def _(spark, sf):
    return c.memberships(store.triples_by_subject(spark, sf), ALLOWED)


_CONTENTS_SQL = f"""{G}, {kinds_sql()}, {_MEMBERSHIP_SQL}, names AS (SELECT subject AS resource_id, arg_min(object_value, (CASE WHEN predicate = '{v.NAME}' THEN '0' ELSE '1' END)
  || (CASE lang WHEN 'en' THEN '0' WHEN 'ru' THEN '2' ELSE '1' END) || upper(object_value)) AS display_name FROM seen WHERE predicate IN ('{v.NAME}', '{v.ALIAS}') GROUP BY 1),
types AS (SELECT subject AS resource_id, min(object_value) AS type FROM seen WHERE predicate = '{v.RDF_TYPE}' GROUP BY 1),
items AS (SELECT m.collection_id, CAST(row_number() OVER (PARTITION BY m.collection_id ORDER BY upper(display_name), m.resource_id, m.membership_id) AS INTEGER) AS place,
  m.membership_id, m.resource_id, display_name, type, type_label, m.membership_cassette_id, h.cassette_id
  FROM membership m JOIN seen_heads ch ON ch.resource_id = m.collection_id JOIN seen_heads h ON h.resource_id = m.resource_id
  JOIN names n ON n.resource_id = m.resource_id JOIN types t ON t.resource_id = m.resource_id JOIN kinds USING (type))"""


def contents(spark, sf):
    return c.contents(store.heads(spark, sf), store.triples_by_subject(spark, sf),
                      graph_terms(spark), ALLOWED, None, _LANG)


@query("g2_collection_contents", f"{_CONTENTS_SQL} SELECT * FROM items")
def _(spark, sf):
    return contents(spark, sf)


_WANTED_SQL = """wanted AS (SELECT 'member:' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR), CAST(round(l_extendedprice * 100) AS BIGINT)) AS membership_id,
'order:' || l_orderkey AS collection_id, 'part:' || l_partkey AS resource_id FROM lineitem)"""


def _wanted(spark, sf):
    from .inputs import ENTITIES

    line_id = next(e.id for e in ENTITIES if e.prefix == "member:")
    return table(spark, sf, "lineitem").selectExpr(
        f"concat('member:', {line_id}) as membership_id", "concat('order:', cast(l_orderkey as string)) as collection_id",
        "concat('part:', cast(l_partkey as string)) as resource_id")


@query("g3_membership_check", f"""{G}, {_WANTED_SQL} SELECT w.* FROM wanted w SEMI JOIN (SELECT subject FROM seen WHERE predicate = '{v.RDF_TYPE}' AND object_value = '{v.COLLECTION_MEMBER}') t ON t.subject = membership_id
SEMI JOIN (SELECT subject, object_value FROM seen WHERE predicate = '{v.IN_COLLECTION}') i ON i.subject = membership_id AND i.object_value = collection_id
SEMI JOIN (SELECT subject, object_value FROM seen WHERE predicate = '{v.COLLECTION_ITEM}') r ON r.subject = membership_id AND r.object_value = resource_id""")
def _(spark, sf):
    rows = store.with_predicates(store.record_statements(spark, sf), v.RDF_TYPE, v.IN_COLLECTION, v.COLLECTION_ITEM)
    return c.check_memberships(_wanted(spark, sf), store.record_heads(spark, sf), rows, ALLOWED)


@query("g4_redacted_memberships", f"""{_CONTENTS_SQL} SELECT collection_id, place, resource_id,
CASE membership_cassette_id WHEN 'cass2' THEN membership_id END AS membership_id, CASE membership_cassette_id WHEN 'cass2' THEN 'cass2' END AS membership_cassette_id FROM items""")
def _(spark, sf):
    folders = literal_rows(spark, [("cass2", "Cass2", "/", True, "read", True), ("cass3", "Cass3", "/", True, "read", False)], CASSETTES)
    kinds = literal_rows(spark, [("editor", ["read"], {"*": ["read", "delete"]})], ROLES)
    people = literal_rows(spark, [("ann", ["editor"], {})], MEMBERS)
    shown = c.redact_memberships(contents(spark, sf), "ann", access.project_rights(people, kinds), access.cassette_rights(people, kinds, folders))
    return shown.select("collection_id", "place", "resource_id", "membership_id", "membership_cassette_id")


# --- duplicates --------------------------------------------------------------------------------------------

@query("g5_potential_duplicates", f"""{G}, {NODES_SQL}, asked AS (SELECT DISTINCT 'name:' || p_name AS request_id, '{v.NAME}' AS predicate, p_name AS value, 'photo' AS kind FROM part
UNION SELECT DISTINCT 'seg:' || c_mktsegment, '{v.ALIAS}', c_mktsegment, 'person' FROM customer),
hit AS (SELECT request_id, a.predicate, n.resource_id, n.display_name, n.type, n.type_label, a.value FROM asked a JOIN seen t ON t.predicate = a.predicate AND t.object_value = a.value
  JOIN nodes n ON n.resource_id = t.subject JOIN kinds k ON k.type = n.type WHERE CASE a.kind WHEN 'photo' THEN k.is_photo ELSE k.is_person END)
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY resource_id) AS INTEGER) AS place, resource_id, display_name, type, type_label, predicate,
value AS matched_value, false AS alternative FROM hit""")
def _(spark, sf):
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("name:"), "p_name").alias("request_id"), F.lit(v.PHOTO_DOCUMENT).alias("type"), F.lit(v.NAME).alias("predicate"),
        F.concat(F.lit(" "), "p_name").alias("value"))
    people = table(spark, sf, "customer").select(
        F.concat(F.lit("seg:"), "c_mktsegment").alias("request_id"), F.lit(O + "person").alias("type"), F.lit(v.ALIAS).alias("predicate"), F.col("c_mktsegment").alias("value"))
    dates = table(spark, sf, "part").select(
        F.concat(F.lit("date:"), "p_size").alias("request_id"), F.lit(v.PHOTO_DOCUMENT).alias("type"), F.lit(v.DATE).alias("predicate"), F.col("p_size").cast("string").alias("value"))
    asked = parts.union(people).union(dates).distinct()
    rows = store.with_predicates(store.record_statements(spark, sf), v.RDF_TYPE, v.NAME, v.ALIAS)
    return d.potential_duplicates(asked, store.nodes(spark, sf), store.record_heads(spark, sf), rows, store.name_starts(spark, sf), graph_terms(spark), store.closure(spark, sf), ALLOWED, None, _LANG)


# --- pages ---------------------------------------------------------------------------------------------------

_FLAGS = "is_entity, is_org, is_collection, is_document, is_photo, is_complex, is_technical"


@query("r5_graph_names", f"{G}, {NODES_SQL} SELECT resource_id, display_name FROM nodes")
def _(spark, sf):
    return store.nodes(spark, sf).select("resource_id", "display_name")


@query("g6_canonical", f"""{G}, {NODES_SQL} SELECT n.resource_id, coalesce(f.target_id, n.resource_id) AS canonical_id FROM nodes n LEFT JOIN (
SELECT e.source_id, min(e.target_id) AS target_id FROM edges e JOIN nodes b ON b.resource_id = e.source_id
WHERE b.type = '{v.REFLECTION}' AND e.predicate = '{v.REFLECTED}' OR b.type = '{v.PARTICIPATION}' AND e.predicate = '{v.PARTICIPANT}' OR b.type = '{v.COLLECTION_MEMBER}' AND e.predicate = '{v.COLLECTION_ITEM}' GROUP BY 1
HAVING min(e.target_id) IN (SELECT resource_id FROM nodes WHERE NOT is_technical)) f ON f.source_id = n.resource_id""")
def _(spark, sf):
    return g.canonical(store.nodes(spark, sf), store.edges(spark, sf))


@query("g6_page_roots", f"""{G}, {NODES_SQL}, asked AS (SELECT DISTINCT subject AS id FROM seen), c AS (SELECT n.resource_id, coalesce(f.target_id, n.resource_id) AS root_id FROM nodes n
LEFT JOIN (SELECT e.source_id, min(e.target_id) AS target_id FROM edges e JOIN nodes b ON b.resource_id = e.source_id
WHERE b.type = '{v.REFLECTION}' AND e.predicate = '{v.REFLECTED}' OR b.type = '{v.PARTICIPATION}' AND e.predicate = '{v.PARTICIPANT}' OR b.type = '{v.COLLECTION_MEMBER}' AND e.predicate = '{v.COLLECTION_ITEM}' GROUP BY 1
HAVING min(e.target_id) IN (SELECT resource_id FROM nodes WHERE NOT is_technical)) f ON f.source_id = n.resource_id)
SELECT c.resource_id AS asked_id, c.root_id FROM c SEMI JOIN asked ON asked.id = c.resource_id SEMI JOIN (SELECT resource_id FROM nodes WHERE NOT is_technical) t ON t.resource_id = c.root_id""")
def _(spark, sf):
    asked = store.with_predicates(store.triples_by_subject(spark, sf), v.RDF_TYPE).select("subject")
    return g.page_roots(store.nodes(spark, sf), store.edges(spark, sf), asked)


@query("g7_node_classes", f"{G}, {NODES_SQL} SELECT resource_id, {_FLAGS} FROM nodes")
def _(spark, sf):
    return store.nodes(spark, sf).select("resource_id", *_FLAGS.split(", "))


@query("g8_participants", f"{G}, {PAGES_SQL}, {_links('people', _PEOPLE)} SELECT * FROM people")
def _(spark, sf):
    return g.participants(store.nodes(spark, sf), store.edges(spark, sf))


@query("g9_organizations", f"{G}, {PAGES_SQL}, {_links('orgs', _ORGS)} SELECT * FROM orgs")
def _(spark, sf):
    return g.organizations(store.nodes(spark, sf), store.edges(spark, sf))


@query("g10_collections", f"{G}, {PAGES_SQL}, {_links('holders', _HOLD)} SELECT * FROM holders")
def _(spark, sf):
    return g.collections_of(store.nodes(spark, sf), store.edges(spark, sf))


@query("g11_related", f"{G}, {PAGES_SQL}, {_links('rel', _related(False))} SELECT * FROM rel")
def _(spark, sf):
    return g.related(store.nodes(spark, sf), store.edges(spark, sf), graph_terms(spark), _LANG)


def page_links(spark, sf):
    """The four lists of all pages, factorised; its tables are written once."""
    n, e, t = store.nodes(spark, sf), store.edges(spark, sf), graph_terms(spark)
    links = f.merged(n, f.participants(n, e), f.organizations(n, e), f.collections_of(n, e), f.related(n, e, t, _LANG, technical=True))
    kept = {part: store.derived(spark, sf, f"link_{part}", lambda part=part: getattr(links, part)) for part in ("roots", "targets", "direct")}
    return links._replace(**kept)


def merged(spark, sf):
    """Every link of every page: here the pairs are wanted, so the lists are made as pairs."""
    n, e, t = store.nodes(spark, sf), store.edges(spark, sf), graph_terms(spark)
    return g.merge_links(g.participants(n, e), g.organizations(n, e), g.collections_of(n, e), g.related(n, e, t, _LANG, technical=True))


@query("g12_link_rows", f"{G}, {PAGES_SQL}, {_links('rel', _related(True))} SELECT root_id, resource_id, relation_id, display_date, sort_date, document_uri, group_key, group_label FROM rel")
def _(spark, sf):
    return g.related(store.nodes(spark, sf), store.edges(spark, sf), graph_terms(spark), _LANG, technical=True).select(
        "root_id", "resource_id", "relation_id", "display_date", "sort_date", "document_uri", "group_key", "group_label")


@query("g13_merged_links", f"{G}, {_MERGED_SQL} SELECT {_LINK_COLUMNS} FROM merged")
def _(spark, sf):
    return merged(spark, sf)


@query("g13_link_counts", f"{G}, {_MERGED_SQL} SELECT root_id, count(*) AS n_links FROM merged GROUP BY root_id")
def _(spark, sf):
    return f.link_counts(page_links(spark, sf))


@query("g13_first_links", f"""{G}, {_MERGED_SQL} SELECT root_id, resource_id, relation_label, relation_id, display_date, group_key, CAST(row_number() OVER (PARTITION BY root_id
ORDER BY sort_date NULLS LAST, lower(display_name), display_name, coalesce(relation_id, ''), resource_id, relation_label) AS INTEGER) AS place FROM merged QUALIFY place BETWEEN 3 AND 7""")
def _(spark, sf):
    return f.first_links(page_links(spark, sf), 5, 2).select("root_id", "resource_id", "relation_label", "relation_id", "display_date", "group_key", "place")


@query("g14_relation_entries", f"{G}, {_ENTRIES_SQL} SELECT {_ENTRY_COLUMNS} FROM entries")
def _(spark, sf):
    return store.entries(spark, sf)


@query("g15_relation_members", f"{G}, {_ENTRIES_SQL} SELECT relation_id, role_key, resource_id, role_label, display_name, document_uri FROM members")
def _(spark, sf):
    return store.members(spark, sf).select("relation_id", "role_key", "resource_id", "role_label", "display_name", "document_uri")


@query("g16_public_values", f"{G}, {_ENTRIES_SQL} SELECT * FROM vals")
def _(spark, sf):
    return store.values(spark, sf)


_PHOTO_SQL = f"""cand AS (SELECT a.target_id AS root_id, b.target_id AS doc, a.source_id AS rel, 0 AS src FROM edges a JOIN nodes m ON m.resource_id = a.source_id AND m.type = '{v.REFLECTION}'
  JOIN edges b ON b.source_id = a.source_id AND b.predicate = '{v.IN_DOC}' JOIN nodes root ON root.resource_id = a.target_id AND NOT root.is_technical WHERE a.predicate = '{v.REFLECTED}'
  UNION ALL SELECT a.target_id, b.target_id, a.source_id, 1 FROM edges a JOIN nodes m ON m.resource_id = a.source_id AND m.type = '{v.COLLECTION_MEMBER}'
  JOIN edges b ON b.source_id = a.source_id AND b.predicate = '{v.COLLECTION_ITEM}' JOIN nodes root ON root.resource_id = a.target_id AND root.is_collection WHERE a.predicate = '{v.IN_COLLECTION}'),
best AS (SELECT c.root_id, c.doc, r.sort_date, r.display_date FROM cand c JOIN nodes p ON p.resource_id = c.doc AND p.is_photo JOIN nodes r ON r.resource_id = c.rel
  QUALIFY row_number() OVER (PARTITION BY c.root_id, c.doc ORDER BY r.sort_date NULLS LAST, src, rel) = 1),
ctx AS (SELECT b.target_id AS doc, arg_min(o.resource_id, a.source_id || chr(1) || o.resource_id) AS cid FROM edges b JOIN nodes m ON m.resource_id = b.source_id AND m.type = '{v.REFLECTION}'
  JOIN edges a ON a.source_id = b.source_id AND a.predicate = '{v.REFLECTED}' JOIN nodes o ON o.resource_id = a.target_id AND o.is_org WHERE b.predicate = '{v.IN_DOC}' GROUP BY 1),
fold AS (SELECT b.target_id AS doc, arg_min(o.resource_id, a.source_id || chr(1) || o.resource_id) AS cid FROM edges b JOIN nodes m ON m.resource_id = b.source_id AND m.type = '{v.COLLECTION_MEMBER}'
  JOIN edges a ON a.source_id = b.source_id AND a.predicate = '{v.IN_COLLECTION}' JOIN nodes o ON o.resource_id = a.target_id AND o.is_collection WHERE b.predicate = '{v.COLLECTION_ITEM}' GROUP BY 1),
cards AS (SELECT b.root_id, p.resource_id, p.display_name, p.document_uri, CASE WHEN root.is_org OR root.is_collection THEN b.root_id ELSE coalesce(ctx.cid, fold.cid) END AS context_id,
  coalesce(b.display_date, p.display_date) AS display_date, coalesce(b.sort_date, p.sort_date) AS sort_date, p.has_document
  FROM best b JOIN nodes p ON p.resource_id = b.doc JOIN nodes root ON root.resource_id = b.root_id LEFT JOIN ctx USING (doc) LEFT JOIN fold USING (doc))"""


@query("g17_photo_cards", f"{G}, {NODES_SQL}, {_PHOTO_SQL} SELECT c.*, n.display_name AS context_label FROM cards c LEFT JOIN nodes n ON n.resource_id = c.context_id")
def _(spark, sf):
    return g.photo_cards(store.nodes(spark, sf), store.edges(spark, sf))


_TEXT_SQL = "CASE o_orderkey % 5 WHEN 0 THEN left(d, 4) WHEN 1 THEN left(d, 7) WHEN 2 THEN d WHEN 3 THEN replace(d, '-', '') ELSE replace(d, '-', '.') || ' ' END"


@query("g18_partial_dates", f"""WITH x AS (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders),
y AS (SELECT o_orderkey, {_TEXT_SQL} AS text, CASE o_orderkey % 5 WHEN 0 THEN left(d, 4) WHEN 1 THEN left(d, 7) ELSE d END AS iso FROM x)
SELECT o_orderkey, text, {show_sql('iso')} AS display, {sort_sql('iso')} AS sort FROM y""")
def _(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 5
    text = (F.when(k == 0, F.left(day, F.lit(4))).when(k == 1, F.left(day, F.lit(7))).when(k == 2, day).when(k == 3, F.replace(day, F.lit("-"), F.lit("")))
            .otherwise(F.concat(F.replace(day, F.lit("-"), F.lit(".")), F.lit(" "))))
    return table(spark, sf, "orders").select("o_orderkey", text.alias("text")).withColumn("p", parse_date("text")).select("o_orderkey", "text", "p.display", "p.sort")


@query("g19_effective_dates", f"{G}, {NODES_SQL} SELECT resource_id, display_date, sort_date FROM nodes")
def _(spark, sf):
    return store.nodes(spark, sf).select("resource_id", "display_date", "sort_date")


@query("g20_entry_dates", f"{G}, {_ENTRIES_SQL} SELECT root_id, key, display_date, sort_date FROM entries WHERE relation_id IS NOT NULL")
def _(spark, sf):
    return store.entries(spark, sf).where("relation_id is not null").select("root_id", "key", "display_date", "sort_date")


@query("g22_sections", f"""{G}, {_ENTRIES_SQL}, sec AS (SELECT *, {_SECTION_SQL} FROM entries)
SELECT root_id, section_key, arg_min(section_title, (sort_date IS NULL) || coalesce(sort_date, '') || chr(1) || lower(group_label) || chr(1) || lower(title) || chr(1) || key) AS title, count(*) AS n FROM sec GROUP BY ALL""")
def _(spark, sf):
    return g.sections(g.with_sections(store.entries(spark, sf)))


@query("g23_completed_entries", f"""{G}, {_ENTRIES_SQL}, {_MERGED_SQL[len(PAGES_SQL) + 2:]}
SELECT root_id, key, title, relation_id, group_key, member_id FROM entries
UNION ALL SELECT root_id, 'compat:' || coalesce(relation_id, '') || chr(10) || resource_id || chr(10) || group_key || chr(10) || relation_label, relation_label, relation_id, group_key, resource_id
FROM merged m SEMI JOIN (SELECT DISTINCT root_id FROM entries) r USING (root_id)
LEFT JOIN (SELECT DISTINCT root_id AS a_root, relation_id AS a_relation FROM entries WHERE relation_id IS NOT NULL) ON a_root = root_id AND a_relation = relation_id
LEFT JOIN (SELECT DISTINCT root_id AS b_root, member_id AS b_member FROM entries WHERE relation_id IS NULL) ON b_root = root_id AND b_member = resource_id
WHERE CASE WHEN relation_id IS NOT NULL THEN a_root IS NULL ELSE b_root IS NULL END""")
def _(spark, sf):
    return g.entries_from_links(store.entries(spark, sf), merged(spark, sf)).select("root_id", "key", "title", "relation_id", "group_key", "member_id")


@query("g24_without_current", f"""{G}, {_ENTRIES_SQL}, own AS (SELECT relation_id, resource_id AS root_id, count(*) AS k, max(document_uri) AS doc, count(*) FILTER (WHERE has_document) AS kd FROM members GROUP BY ALL)
SELECT e.root_id, e.key, e.n_members - coalesce(k, 0) AS n_members, e.n_documents - coalesce(kd, 0) AS n_documents, CASE WHEN doc IS NULL OR document_uri <> doc THEN document_uri END AS document_uri
FROM entries e LEFT JOIN own ON own.relation_id = e.relation_id AND own.root_id = e.root_id
WHERE k IS NULL OR e.n_members - k > 0 OR n_values > 0 OR (CASE WHEN doc IS NULL OR document_uri <> doc THEN document_uri END) IS NOT NULL""")
def _(spark, sf):
    return g.without_current(store.entries(spark, sf), store.members(spark, sf), store.nodes(spark, sf)).select(
        "root_id", "key", "n_members", "n_documents", "document_uri")


@query("g21_g25_section_pages", f"""{G}, {_ENTRIES_SQL}, sec AS (SELECT *, {_SECTION_SQL} FROM entries)
SELECT root_id, section_key, key, sort_date, title, CAST(row_number() OVER (PARTITION BY root_id, section_key ORDER BY sort_date NULLS LAST, lower(title), title, key) AS INTEGER) AS place
FROM sec QUALIFY place > 10 AND place <= 20""")
def _(spark, sf):
    return g.section_page(g.with_sections(store.entries(spark, sf)), 1, "large").select("root_id", "section_key", "key", "sort_date", "title", "place")
