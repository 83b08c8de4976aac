"""Resource pages for all resources at once: links, relation entries, photos, sections.

Two tables carry everything: ``nodes`` (one row per visible resource with what pages show of it) and ``edges``
(visible links). A page part is a table with ``root_id``; pass ``roots`` to build the pages of some resources only.

A relation's members are kept per relation, not per page, so a relation with a million members is a million rows
and not a million times a million. Anything that depends on the page's own resource is derived by a join on it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab as v
from ..functions.dates import parse_date
from ..functions.ids import is_blank
from ..functions.labels import pick_label
from ..functions.uris import is_document_uri
from ..session import cut_lineage, dealt_anew, row_bound, small
from .access import visible
from .match import links, visible_heads
from .ontology import enumeration_labels
from .portrait import date_properties

_FLAGS = {"is_entity": v.SYSTEM_OBJECT, "under_entity": v.ENTITY, "is_org": v.ORGANIZATION, "is_collection": v.COLLECTION,
          "is_document": v.DOCUMENT, "is_photo": v.PHOTO_DOCUMENT}


# --- nodes and edges -------------------------------------------------------------------------------------

def class_flags(terms: DataFrame, closure: DataFrame, language: str) -> DataFrame:
    """(type, type_label, group flags, is_complex, is_technical) of every term."""
    per_class = closure.groupBy(F.col("class_id").alias("type")).agg(
        *[F.bool_or(F.col("ancestor_id") == c).alias(f) for f, c in _FLAGS.items()])
    known = terms.select(F.col("id").alias("type"), F.coalesce(pick_label("labels", language), "id").alias("type_label"))
    flags = known.join(per_class, "type", "left").fillna(False, list(_FLAGS))
    return (flags.withColumn("is_complex", F.col("under_entity") & ~F.col("is_entity"))
            .withColumn("is_technical", F.col("type").isin(*v.TECHNICAL_TYPES)))


def node_table(heads: DataFrame, triples: DataFrame, terms: DataFrame, closure: DataFrame, allowed, language: str = "ru") -> DataFrame:
    """One row per visible resource: type and flags, graph name, single document, effective date, role.

    One aggregation over the statements. The effective date is the start (with the end, where there is one),
    else the earliest of all date properties.
    """
    dates = small(cut_lineage(date_properties(terms).withColumn("is_date", F.lit(True))))
    rows = visible(triples, allowed).where(
        (F.col("object_kind") == v.LITERAL) | ((F.col("predicate") == v.RDF_TYPE) & (F.col("object_kind") == v.IRI)))
    rows = rows.join(dates, "predicate", "left")
    literal = F.col("object_kind") == v.LITERAL
    text = F.struct(F.coalesce("lang", F.lit("")).alias("lang"), F.col("object_value").alias("value"))
    trimmed = F.trim("object_value")
    uri = F.when(literal & is_document_uri(trimmed), trimmed)
    parsed = F.when(F.col("is_date") & literal, parse_date("object_value"))
    rows = rows.withColumn("uri", uri).withColumn("parsed", F.when(parsed.isNotNull(), F.struct(parsed["sort"].alias("sort"), parsed["display"].alias("display"))))

    def first(predicate: str, test: Column = F.lit(True)) -> Column:
        return F.min(F.when(literal & (F.col("predicate") == predicate) & test, text))["value"]

    filled = ~is_blank("object_value")
    facts = rows.groupBy(F.col("subject").alias("resource_id")).agg(
        F.min(F.when(F.col("predicate") == v.RDF_TYPE, F.col("object_value"))).alias("type"),
        F.coalesce(first(v.NAME, F.lower("lang") == language.lower()), first(v.NAME)).alias("name"),
        first(v.FROM_DATE, filled).alias("from_text"), first(v.TO_DATE, filled).alias("to_text"),
        first(v.ROLE, filled).alias("role"), F.min("parsed").alias("earliest"),
        F.min("uri").alias("low"), F.max("uri").alias("high"))
    dated = facts.withColumn("start", parse_date("from_text")).withColumn("end", parse_date("to_text"))
    spanned = F.when(F.col("end").isNull(), F.col("start.display")).otherwise(F.concat_ws("–", "start.display", "end.display"))
    flags = small(cut_lineage(class_flags(terms, closure, language)))
    shown = visible_heads(heads, allowed).select("resource_id", "cassette_id").join(dated, "resource_id", "left").join(flags, "type", "left")
    return shown.select(
        "resource_id", "type", F.coalesce("type_label", "type").alias("type_label"), F.coalesce("name", "resource_id").alias("display_name"),
        F.when(F.col("low") == F.col("high"), F.col("low")).alias("document_uri"), F.col("low").isNotNull().alias("has_document"),
        F.when(F.col("start").isNotNull(), spanned).otherwise(F.col("earliest.display")).alias("display_date"),
        F.coalesce("start.sort", "earliest.sort").alias("sort_date"), "role", "cassette_id",
        *[F.coalesce(f, F.lit(False)).alias(f) for f in (*_FLAGS, "is_complex", "is_technical")])


def edge_table(triples: DataFrame, allowed) -> DataFrame:
    return links(triples, allowed)


def property_labels(terms: DataFrame, language: str) -> DataFrame:
    """(predicate, label, inverse_label) with the fallbacks of a page."""
    own = F.coalesce(pick_label("labels", language), "id")
    return terms.select(F.col("id").alias("predicate"), own.alias("label"),
                        F.coalesce(pick_label("inverse_labels", language), own).alias("inverse_label"))


def _labelled(rows: DataFrame, terms: DataFrame, language: str) -> DataFrame:
    found = rows.join(small(property_labels(terms, language)), "predicate", "left")
    return found.withColumn("label", F.coalesce("label", "predicate")).withColumn("inverse_label", F.coalesce("inverse_label", "predicate"))


def _roots(nodes: DataFrame, roots: DataFrame | None, in_buckets: bool = False) -> DataFrame:
    """Resources that have a page; ``in_buckets`` for joins with the sources of links, each of which is one record and no hub."""
    own = nodes.where("not is_technical").withColumnRenamed("resource_id", "root_id")
    own = own if in_buckets else dealt_anew(own, "root_id")
    return own if roots is None else own.join(roots.select(F.col(roots.columns[0]).alias("root_id")), "root_id", "left_semi")


# --- canonical address -----------------------------------------------------------------------------------

_CANONICAL = {v.REFLECTION: v.REFLECTED, v.PARTICIPATION: v.PARTICIPANT, v.COLLECTION_MEMBER: v.COLLECTION_ITEM}


def canonical(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(resource_id, canonical_id): bridge resources stand for their first target unless it is missing or a bridge."""
    wanted = reduce(lambda a, b: a | b, [(F.col("type") == t) & (F.col("predicate") == p) for t, p in _CANONICAL.items()])
    bridges = nodes.where(F.col("type").isin(*_CANONICAL)).select(F.col("resource_id").alias("source_id"), "type")
    first = (edges.where(F.col("predicate").isin(*_CANONICAL.values())).join(bridges, "source_id").where(wanted)
             .groupBy(F.col("source_id").alias("resource_id")).agg(F.min("target_id").alias("canonical_id")))
    real = nodes.where("not is_technical").select(F.col("resource_id").alias("canonical_id"))
    found = first.join(real, "canonical_id", "left_semi")
    return nodes.select("resource_id").join(found, "resource_id", "left").withColumn(
        "canonical_id", F.coalesce("canonical_id", "resource_id"))


def page_roots(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked_id, root_id): the resource whose page answers an asked id, bridge ids included; unknown ids have no row.

    The link and entry operators take the ``root_id`` column as their ``roots``.
    """
    ids = asked.select(F.col(asked.columns[0]).alias("resource_id")).distinct()
    found = canonical(nodes, edges).join(ids, "resource_id", "left_semi")
    real = nodes.where("not is_technical").select(F.col("resource_id").alias("canonical_id"))
    return found.join(real, "canonical_id", "left_semi").select(F.col("resource_id").alias("asked_id"), F.col("canonical_id").alias("root_id"))


# --- links of a page ----------------------------------------------------------------------------------------

def _link_rows(pairs: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    """Link rows of (root_id, resource_id, relation_label, relation_id and, as rel_*, what the relation shows) with ``more`` columns of the pairs or the resource."""
    target = dealt_anew(nodes.where("not is_technical"), "resource_id").select(
        "resource_id", "display_name", "type", "type_label", "document_uri", "has_document",
        F.col("display_date").alias("own_display"), F.col("sort_date").alias("own_sort"), *[c for c in more if c not in pairs.columns])
    from_relation = F.col("rel_sort_date").isNotNull()
    own = F.col("document_uri").isNotNull()

    def date(relation: str, of_target: str) -> Column:
        return F.when(from_relation, F.col(relation)).when(own, F.col(of_target))

    return pairs.join(target, "resource_id").select(
        "root_id", "resource_id", "display_name", "type", "type_label", "relation_label", "relation_id", "document_uri",
        date("rel_display_date", "own_display").alias("display_date"), date("rel_sort_date", "own_sort").alias("sort_date"),
        F.coalesce("rel_type", "relation_label").alias("group_key"),
        F.coalesce("rel_type_label", "relation_label").alias("group_label"), "has_document", *more)


_REL = ("type", "type_label", "display_date", "sort_date")


def _as_relation(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("resource_id").alias("relation_id"), *[F.col(c).alias(f"rel_{c}") for c in _REL], "role")


def _bridged(nodes: DataFrame, edges: DataFrame, bridge_type: str, toward_root: str, onward: str, roots: DataFrame, label: Column) -> DataFrame:
    """root <- bridge of the type -> resource."""
    bridge = _as_relation(nodes.where(F.col("type") == bridge_type))
    inward = edges.where(F.col("predicate") == toward_root).select(F.col("source_id").alias("relation_id"), F.col("target_id").alias("root_id"))
    out = edges.where(F.col("predicate") == onward).select(F.col("source_id").alias("relation_id"), F.col("target_id").alias("resource_id"))
    return (inward.join(roots.select("root_id"), "root_id", "left_semi").join(bridge, "relation_id").join(out, "relation_id")
            .withColumn("relation_label", label).drop("role").distinct())


def participants(nodes: DataFrame, edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Participants of organizations and items, other than documents, of collections."""
    own = _roots(nodes, roots)
    people = _bridged(nodes, edges, v.PARTICIPATION, v.IN_ORG, v.PARTICIPANT, own.where("is_org"),
                      F.coalesce("role", F.lit(v.LABEL_PARTICIPANT)))
    items = _bridged(nodes, edges, v.COLLECTION_MEMBER, v.IN_COLLECTION, v.COLLECTION_ITEM, own.where("is_collection"),
                     F.lit(v.LABEL_COLLECTION_ITEM))
    items = items.join(nodes.where("not is_document").select("resource_id"), "resource_id", "left_semi")
    return _link_rows(people.unionByName(items), nodes)


def organizations(nodes: DataFrame, edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Organizations a resource takes part in."""
    return _link_rows(_bridged(nodes, edges, v.PARTICIPATION, v.PARTICIPANT, v.IN_ORG, _roots(nodes, roots),
                               F.coalesce("role", F.lit(v.LABEL_PARTICIPATION))), nodes)


def _reflected_documents(nodes: DataFrame, edges: DataFrame, roots: DataFrame, *shown: str) -> DataFrame:
    """(root_id, document_id, relation_id and what is ``shown`` of the relation) of documents that show the root."""
    bridge = nodes.where(F.col("type") == v.REFLECTION).select(F.col("resource_id").alias("relation_id"), *shown)
    shows = edges.where(F.col("predicate") == v.REFLECTED).select(F.col("source_id").alias("relation_id"), F.col("target_id").alias("root_id"))
    held = edges.where(F.col("predicate") == v.IN_DOC).select(F.col("source_id").alias("relation_id"), F.col("target_id").alias("document_id"))
    # what the relation's record says is put together before it is dealt by the root
    return shows.join(bridge, "relation_id").join(held, "relation_id").join(roots.select("root_id"), "root_id", "left_semi").distinct()


def collections_of(nodes: DataFrame, edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Collections that hold the resource or a document showing it."""
    own = _roots(nodes, roots)
    documents = (_reflected_documents(nodes, edges, own)
                 .join(dealt_anew(nodes.select(F.col("resource_id").alias("document_id")), "document_id"), "document_id", "left_semi")
                 .select("root_id", F.col("document_id").alias("item_id")))
    items = own.select("root_id", F.col("root_id").alias("item_id")).unionByName(documents)
    bridge = _as_relation(nodes.where(F.col("type") == v.COLLECTION_MEMBER)).drop("role")
    held = edges.where(F.col("predicate") == v.COLLECTION_ITEM).select(F.col("source_id").alias("relation_id"), F.col("target_id").alias("item_id"))
    holder = edges.where(F.col("predicate") == v.IN_COLLECTION).select(F.col("source_id").alias("relation_id"), F.col("target_id").alias("resource_id"))
    # ids alone are matched; what the bridge shows is joined to the pairs that are left
    kept = held.join(bridge.select("relation_id"), "relation_id", "left_semi").join(items, "item_id").select("relation_id", "root_id").distinct()
    pairs = kept.join(holder.distinct(), "relation_id").join(bridge.distinct(), "relation_id")
    return _link_rows(pairs.withColumn("relation_label", F.lit(v.LABEL_IN_COLLECTION)), nodes)


def incident(nodes: DataFrame, edges: DataFrame, terms: DataFrame, language: str, roots: DataFrame | None = None, others: str | None = None) -> DataFrame:
    """(root_id, direction, predicate, other_id, label) of a page's own links, both ways; direction 0 is outward. ``others`` is a condition
    on the nodes that the links lead to.

    A link stated twice is here twice; the users of this table drop repeats where they group anyway.
    """
    outward, inward = _sides(nodes, edges, terms, language, roots, others)
    return outward.unionByName(inward)


def _sides(nodes: DataFrame, edges: DataFrame, terms: DataFrame, language: str, roots: DataFrame | None, others: str | None,
           rare: bool = False) -> tuple[DataFrame, DataFrame]:
    """``incident`` outward and inward; ``rare`` others are looked for among the targets of links before links are dealt by them."""
    def side(direction: int) -> DataFrame:
        root, other = ("source_id", "target_id") if direction == 0 else ("target_id", "source_id")
        checks = [("root_id", _roots(nodes, roots, direction == 0).select("root_id"))]
        if others is not None:
            chosen = nodes.where(others).select(F.col("resource_id").alias("other_id"))
            checks.append(("other_id", chosen if direction == 1 else _met(edges, chosen) if rare else dealt_anew(chosen, "other_id")))
        found = edges.select(F.col(root).alias("root_id"), F.col(other).alias("other_id"), "predicate")
        for key, ids in checks if direction == 0 else checks[::-1]:  # the source first, before links are dealt by their targets
            found = found.join(ids, key, "left_semi")
        return _labelled(found, terms, language).select("root_id", F.lit(direction).alias("direction"), "predicate", "other_id",
                                                        F.col("inverse_label" if direction else "label").alias("label"))

    return side(0), side(1)


def _met(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Those of the chosen ids that are targets, to be broadcast, if they are few; all of them, if not."""
    met = edges.select(F.col("target_id").alias("other_id")).distinct().join(chosen, "other_id", "left_semi")
    return F.broadcast(met) if row_bound(met) else dealt_anew(chosen, "other_id")


def page_relations(nodes: DataFrame, edges: DataFrame, terms: DataFrame, language: str, roots: DataFrame | None, relations: str) -> list[DataFrame]:
    """(root_id, relation_id, label) of the relations (a condition on nodes) on each page, once, with the label of the first link.

    Links to a relation come before its own. Where they are few they are a table to be broadcast, and the second one has the rest:
    a relation's own links are grouped where they were checked and joined in the buckets of their record.
    """
    def first(near: DataFrame) -> DataFrame:
        return near.groupBy("root_id", F.col("other_id").alias("relation_id")).agg(F.min(F.struct("direction", "predicate", "label"))["label"].alias("label"))

    outward, inward = _sides(nodes, edges, terms, language, roots, relations, True)
    before = first(outward)
    if not row_bound(before):
        return [dealt_anew(first(outward.unionByName(inward)), "relation_id")]
    return [F.broadcast(before), first(inward).join(F.broadcast(before.select("root_id", "relation_id")), ["root_id", "relation_id"], "left_anti")]


def related(nodes: DataFrame, edges: DataFrame, terms: DataFrame, language: str, technical: bool = False, roots: DataFrame | None = None) -> DataFrame:
    """Neighbours of a page; a complex relation stands for the entities it links, labelled ``role · type``.

    ``technical`` also follows bridge resources, which otherwise show in their own lists.
    """
    bridges, plain = "is_complex" if technical else "is_complex and not is_technical", "not is_complex and not is_technical"
    complex_ = _as_relation(nodes.where(bridges)).drop("role")
    onward = edges.select(F.col("source_id").alias("relation_id"), F.col("target_id").alias("resource_id")).distinct()
    named = F.when(is_blank("rel_type_label"), F.col("label")).otherwise(F.concat_ws(" · ", "label", "rel_type_label"))
    # relations first: joined with a broadcast they stay in their buckets
    linked = [complex_.join(first, "relation_id").join(onward, "relation_id") for first in page_relations(nodes, edges, terms, language, roots, bridges)]
    through = reduce(DataFrame.unionByName, linked).where("resource_id <> root_id").withColumn("relation_label", named).drop("label")
    direct = incident(nodes, edges, terms, language, roots, plain).select(
        "root_id", F.col("other_id").alias("resource_id"), F.col("label").alias("relation_label")).distinct()
    for c in ("relation_id", *[f"rel_{c}" for c in _REL]):
        direct = direct.withColumn(c, F.lit(None).cast("string"))
    # a relation shows entities only; that is asked where its targets are met anyway
    shown = _link_rows(through.withColumn("entity", F.lit(True)).unionByName(direct.withColumn("entity", F.lit(False))),
                       nodes.where(f"is_entity or {plain}"), "entity", "is_entity")
    return shown.where("is_entity or not entity").drop("entity", "is_entity")


def link_order() -> list[Column]:
    """Dated links first by date, then name and ids."""
    return [F.col("sort_date").asc_nulls_last(), F.lower("display_name"), F.col("display_name"), F.coalesce("relation_id", F.lit("")), F.col("resource_id")]


def merge_links(*groups: DataFrame) -> DataFrame:
    """Union of link lists; of rows with the same relation, resource and group the earlier list's wins."""
    rows = reduce(DataFrame.unionByName, [g.withColumn("list_no", F.lit(i)) for i, g in enumerate(groups)])
    order = F.struct("list_no", F.col("sort_date").isNull().alias("undated"), "sort_date", F.lower("display_name").alias("folded"), "relation_label")
    keys = ("root_id", "resource_id", "group_key")
    rest = [c for c in rows.columns if c not in (*keys, "relation_id", "list_no")]
    merged = rows.groupBy(*keys, F.coalesce("relation_id", F.lit("")).alias("relation_key")).agg(
        F.min_by(F.struct(*rest, "relation_id"), order).alias("row"))
    return merged.select(*keys, "row.*").select(*groups[0].columns)


# --- relation entries ------------------------------------------------------------------------------------------

def relation_members(nodes: DataFrame, edges: DataFrame, terms: DataFrame, language: str) -> DataFrame:
    """Entities linked by each complex relation, either way, once per role: (relation_id, role_key, resource_id, role_label, ...)."""
    complex_ = nodes.where("is_complex").select(F.col("resource_id").alias("relation_id"))
    shown = nodes.where("is_entity and not is_technical").select(
        "resource_id", "display_name", "type", "type_label", "document_uri", "has_document", "display_date", "sort_date")
    shown = dealt_anew(shown, "resource_id")

    def side(relation: str, other: str, prefix: str, label: str) -> DataFrame:
        found = edges.select(F.col(relation).alias("relation_id"), F.col(other).alias("resource_id"), "predicate").join(
            complex_ if relation == "source_id" else dealt_anew(complex_, "relation_id"), "relation_id", "left_semi").distinct()
        return _labelled(found, terms, language).select(
            "relation_id", "resource_id", F.concat(F.lit(prefix), "predicate").alias("role_key"), F.col(label).alias("role_label"))

    both = side("source_id", "target_id", "direct:", "label").unionByName(side("target_id", "source_id", "inverse:", "inverse_label"))
    return both.join(shown, "resource_id").select(
        "relation_id", "role_key", "resource_id", "role_label", "display_name", "type", "type_label", "document_uri", "has_document",
        "display_date", "sort_date")


def member_order() -> list[Column]:
    """Order of a relation's members after the page's own resource."""
    role = F.coalesce("role_label", F.lit(""))
    return [F.lower(role), role, F.lower("display_name"), F.col("display_name"), F.col("resource_id")]


def _member_facts(members: DataFrame) -> DataFrame:
    """Per relation: earliest date of members with a document, the first two documents of different members, counts."""
    order = F.struct(*member_order())
    with_doc = members.where("document_uri is not null")
    # first document of each member, then the two first members; the window is limited before its shuffle
    each = with_doc.groupBy("relation_id", "resource_id").agg(F.min(F.struct(order.alias("o"), "document_uri")).alias("d"))
    two = Window.partitionBy("relation_id").orderBy("d")
    top = each.withColumn("n", F.row_number().over(two)).where("n <= 2").groupBy("relation_id").agg(
        F.max(F.when(F.col("n") == 1, F.col("resource_id"))).alias("first_member"),
        F.max(F.when(F.col("n") == 1, F.col("d.document_uri"))).alias("first_document"),
        F.max(F.when(F.col("n") == 2, F.col("d.document_uri"))).alias("second_document"))
    counted = members.groupBy("relation_id").agg(
        F.min(F.when(F.col("document_uri").isNotNull() & F.col("sort_date").isNotNull(), F.struct("sort_date", "display_date"))).alias("member_date"),
        F.count("*").alias("n_members"), F.count(F.when(F.col("has_document") | F.col("document_uri").isNotNull(), 1)).alias("n_documents"))
    return counted.join(top, "relation_id", "left")


def public_values(nodes: DataFrame, triples: DataFrame, terms: DataFrame, allowed, language: str) -> DataFrame:
    """(relation_id, label, value) distinct: literals of complex relations that are no name, address or date."""
    complex_ = nodes.where("is_complex").select(F.col("resource_id").alias("subject"))
    hidden = small(date_properties(terms))
    rows = (visible(triples, allowed).where((F.col("object_kind") == v.LITERAL) & ~F.col("predicate").isin(v.NAME, v.URI) & ~is_blank("object_value")
                                            & ~F.trim("object_value").rlike("(?i)^iiss://"))
            .join(complex_, "subject", "left_semi").join(hidden, "predicate", "left_anti"))
    states = small(enumeration_labels(terms, language).select(
        F.col("property_id").alias("predicate"), F.col("value").alias("object_value"), F.col("label").alias("state")))
    named = _labelled(rows.select(F.col("subject").alias("relation_id"), "predicate", "object_value"), terms, language)
    return (named.join(states, ["predicate", "object_value"], "left")
            .select("relation_id", "label", F.trim(F.coalesce("state", "object_value")).alias("value")).distinct())


def relation_entries(nodes: DataFrame, edges: DataFrame, terms: DataFrame, language: str, members: DataFrame,
                     values: DataFrame, roots: DataFrame | None = None, observed: DataFrame | None = None) -> DataFrame:
    """One entry per complex relation of a page and one per ordinary link.

    ``observed`` adds (root_id, relation_id) seen by other parts of a page. Members of complex entries are
    ``members`` by relation_id, values are ``values``; the one member of an ordinary entry is ``member_id``.
    """
    relation = nodes.where("is_complex").select(
        F.col("resource_id").alias("relation_id"), "type", "type_label", "display_name", "role", "document_uri", "display_date", "sort_date")
    pairs = reduce(DataFrame.unionByName, page_relations(nodes, edges, terms, language, roots, "is_complex")).select("root_id", "relation_id")
    if observed is not None:
        own = _roots(nodes, roots).select("root_id")
        pairs = pairs.unionByName(observed.select("root_id", "relation_id").join(own, "root_id", "left_semi")).distinct()
    counts = values.groupBy("relation_id").agg(F.count("*").alias("n_values"))
    facts = relation.join(_member_facts(members), "relation_id", "left").join(counts, "relation_id", "left")
    title = (F.when(~is_blank("role"), F.trim("role")).when(F.col("display_name") != F.col("relation_id"), F.col("display_name"))
             .otherwise(F.coalesce("type_label", F.lit(v.LABEL_RELATION))))
    other_first = F.when(F.col("first_member") != F.col("root_id"), F.col("first_document")).otherwise(F.coalesce("second_document", "first_document"))
    complex_ = pairs.join(facts, "relation_id").select(
        "root_id", F.col("relation_id").alias("key"), title.alias("title"), "relation_id", F.col("type").alias("relation_type"),
        F.col("type_label").alias("relation_type_label"), F.coalesce("type", "relation_id").alias("group_key"),
        F.coalesce("type_label", title).alias("group_label"), F.coalesce("display_date", "member_date.display_date").alias("display_date"),
        F.coalesce("sort_date", "member_date.sort_date").alias("sort_date"), F.coalesce("document_uri", other_first).alias("document_uri"),
        F.lit(None).cast("string").alias("member_id"), F.coalesce("n_members", F.lit(0)).alias("n_members"),
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_values", F.lit(0)).alias("n_values"))
    simple = "not is_complex and not is_technical"
    near, plain = incident(nodes, edges, terms, language, roots, simple), dealt_anew(nodes.where(simple), "resource_id").select(
        F.col("resource_id").alias("other_id"), "document_uri", "has_document", "display_date", "sort_date")
    side = F.when(F.col("direction") == 0, "direct:").otherwise("inverse:")
    none, dated = F.lit(None).cast("string"), F.col("document_uri").isNotNull()
    ordinary = near.distinct().join(plain, "other_id").select(
        "root_id", F.concat(side, "predicate", F.lit("\n"), "other_id").alias("key"), F.col("label").alias("title"),
        none.alias("relation_id"), none.alias("relation_type"), none.alias("relation_type_label"),
        F.concat(side, "predicate").alias("group_key"), F.col("label").alias("group_label"),
        F.when(dated, F.col("display_date")).alias("display_date"), F.when(dated, F.col("sort_date")).alias("sort_date"),
        "document_uri", F.col("other_id").alias("member_id"), F.lit(1).cast("bigint").alias("n_members"),
        F.col("has_document").cast("bigint").alias("n_documents"), F.lit(0).cast("bigint").alias("n_values"))
    return complex_.unionByName(ordinary)


def entry_order() -> list[Column]:
    return [F.col("sort_date").asc_nulls_last(), F.lower("group_label"), F.lower("title"), F.col("key")]


def timeline_order() -> list[Column]:
    """Dated entries first, then title and key."""
    return [F.col("sort_date").asc_nulls_last(), F.lower("title"), F.col("title"), F.col("key")]


def entries_from_links(entries: DataFrame, merged: DataFrame) -> DataFrame:
    """Entries completed by the page's links that none of them stands for; pages without entries stay empty."""
    pages = entries.select("root_id").distinct()
    by_relation = entries.where("relation_id is not null").select("root_id", "relation_id").distinct()
    by_member = entries.where("relation_id is null").select("root_id", F.col("member_id").alias("resource_id")).distinct()
    linked = merged.join(pages, "root_id", "left_semi")
    missing = (linked.where("relation_id is not null").join(by_relation, ["root_id", "relation_id"], "left_anti")
               .unionByName(linked.where("relation_id is null").join(by_member, ["root_id", "resource_id"], "left_anti")))
    none = F.lit(None).cast("string")

    def filled(c: str) -> Column:
        return F.when(F.trim(c) != "", F.trim(c)).otherwise(F.col("relation_label"))

    identity = F.concat_ws("\n", F.coalesce("relation_id", F.lit("")), "resource_id", F.coalesce("group_key", "relation_label"), "relation_label")
    added = missing.select(
        "root_id", F.concat(F.lit("compat:"), identity).alias("key"), F.col("relation_label").alias("title"), "relation_id",
        none.alias("relation_type"), none.alias("relation_type_label"), filled("group_key").alias("group_key"),
        filled("group_label").alias("group_label"), "display_date", "sort_date", "document_uri", F.col("resource_id").alias("member_id"),
        F.lit(1).cast("bigint").alias("n_members"), F.col("has_document").cast("bigint").alias("n_documents"), F.lit(0).cast("bigint").alias("n_values"))
    return entries.unionByName(added.dropDuplicates(["root_id", "key"]))


def without_current(entries: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries without the page's own resource among the members; emptied entries are dropped.

    A document that belongs to the page's resource is no longer shown as the entry's.
    """
    own = members.select("relation_id", F.col("resource_id").alias("root_id"), "document_uri", "has_document")
    mine = own.groupBy("relation_id", "root_id").agg(
        F.count("*").alias("own_members"), F.max("document_uri").alias("own_document"),
        F.count(F.when(F.col("has_document") | F.col("document_uri").isNotNull(), 1)).alias("own_documents"))
    selfs = nodes.select(F.col("resource_id").alias("root_id"), F.col("resource_id").alias("member_id"), F.col("document_uri").alias("self_document"),
                         F.col("has_document").alias("self_has"))
    complex_ = entries.where("member_id is null").join(mine, ["relation_id", "root_id"], "left")
    single = entries.where("member_id is not null").join(selfs, ["root_id", "member_id"], "left").select(
        *entries.columns, F.when(F.col("self_has").isNotNull(), 1).cast("bigint").alias("own_members"),
        F.col("self_document").alias("own_document"), F.col("self_has").cast("bigint").alias("own_documents"))
    rows = complex_.select(*entries.columns, "own_members", "own_document", "own_documents").unionByName(single)
    zero = F.lit(0)
    kept = (rows.withColumn("document_uri", F.when(F.col("own_document").isNull() | (F.col("document_uri") != F.col("own_document")), F.col("document_uri")))
            .withColumn("n_members", F.col("n_members") - F.coalesce("own_members", zero))
            .withColumn("n_documents", F.col("n_documents") - F.coalesce("own_documents", zero)))
    untouched = F.coalesce("own_members", zero) == 0
    return kept.where(untouched | (F.col("n_members") > 0) | F.col("document_uri").isNotNull() | (F.col("n_values") > 0)).select(*entries.columns)


def with_sections(entries: DataFrame) -> DataFrame:
    """Adds ``section_key`` and ``section_title``: media together, the rest by relation type, then group."""
    def filled(c: str) -> Column:
        return F.when(F.trim(c) != "", F.trim(c))

    group = F.when(F.col("relation_type").rlike("(?i)(^|[/#])reflection$"), v.LABEL_REFLECTED).otherwise(F.coalesce(
        filled("relation_type_label"), filled("group_label"), filled("title"), F.lit(v.LABEL_RELATIONS)))
    media = F.col("document_uri").isNotNull() | (F.col("n_documents") > 0)
    key = F.coalesce(filled("relation_type"), filled("group_key"), group)
    return (entries.withColumn("section_key", F.when(media, "public:media").otherwise(F.concat(F.lit("public:links:"), key)))
            .withColumn("section_title", F.when(media, v.LABEL_PHOTOS).otherwise(group)))


def sections(sectioned: DataFrame) -> DataFrame:
    """(root_id, section_key, title, n): the blocks of each page, titled by their first entry."""
    first = F.struct(F.col("sort_date").isNull().alias("undated"), "sort_date", F.lower("group_label").alias("g"), F.lower("title").alias("t"), "key", "section_title")
    return sectioned.groupBy("root_id", "section_key").agg(F.min(first)["section_title"].alias("title"), F.count("*").alias("n"))


PAGE_SIZES = {"table": 30, "small": 30, "medium": 18, "large": 10}
_DEFAULT_PAGE = 18


def section_page(sectioned: DataFrame, page: int = 0, layout: str = "medium") -> DataFrame:
    """Rows of one page (from 0) of every section, in timeline order, with their ``place``.

    The window keeps at most the rows up to this page of a section, before the shuffle too.
    """
    size = PAGE_SIZES.get(layout, _DEFAULT_PAGE)
    ranked = Window.partitionBy("root_id", "section_key").orderBy(*timeline_order())
    return (sectioned.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= (page + 1) * size)
            .where(F.col("place") > page * size))


# --- photos -------------------------------------------------------------------------------------------------------

def photo_cards(nodes: DataFrame, edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Photos that show a resource and photos of a collection, with the earliest-dated relation and a context.

    The context of an organization's or a collection's photos is itself; else the first organization, else the
    first collection of the photo.
    """
    own = _roots(nodes, roots)
    dates = ("sort_date", "display_date")
    shown = _reflected_documents(nodes, edges, own, *dates).withColumn("source", F.lit(0))
    member = nodes.where(F.col("type") == v.COLLECTION_MEMBER).select(F.col("resource_id").alias("relation_id"), *dates)

    def bridged(predicate: str, name: str) -> DataFrame:
        return edges.where(F.col("predicate") == predicate).select(F.col("source_id").alias("relation_id"), F.col("target_id").alias(name))

    kept = (bridged(v.IN_COLLECTION, "root_id").join(member, "relation_id").join(bridged(v.COLLECTION_ITEM, "document_id"), "relation_id")
            .join(own.where("is_collection").select("root_id"), "root_id", "left_semi").distinct()
            .withColumn("source", F.lit(1)))
    photos = dealt_anew(nodes.where("is_photo"), "resource_id").select(
        F.col("resource_id").alias("document_id"), "display_name", "document_uri", "has_document",
        F.col("display_date").alias("doc_display"), F.col("sort_date").alias("doc_sort"))
    candidates = shown.unionByName(kept).join(photos.select("document_id"), "document_id", "left_semi")
    best = candidates.groupBy("root_id", "document_id").agg(F.min(F.struct(
        F.col("sort_date").isNull().alias("undated"), "sort_date", "source", "relation_id", "display_date")).alias("r"))

    def context(bridge_type: str, to_document: str, to_context: str, flag: str, name: str) -> DataFrame:
        bridge = nodes.where(F.col("type") == bridge_type).select(F.col("resource_id").alias("relation_id"))
        target = dealt_anew(nodes.where(flag), "resource_id").select(F.col("resource_id").alias("context_id"), F.col("display_name").alias("context_label"))
        pairs = bridged(to_document, "document_id").join(bridge, "relation_id", "left_semi").join(bridged(to_context, "context_id"), "relation_id").join(target, "context_id")
        return pairs.groupBy("document_id").agg(F.min(F.struct("relation_id", "context_id", "context_label")).alias(name))

    orgs = context(v.REFLECTION, v.IN_DOC, v.REFLECTED, "is_org", "org")
    folders = context(v.COLLECTION_MEMBER, v.COLLECTION_ITEM, v.IN_COLLECTION, "is_collection", "folder")
    itself = F.col("root_is_context")
    page = own.select("root_id", F.col("display_name").alias("root_name"), (F.col("is_org") | F.col("is_collection")).alias("root_is_context"))
    dated = F.col("r.sort_date").isNotNull()
    return (best.join(photos, "document_id").join(orgs, "document_id", "left").join(folders, "document_id", "left").join(page, "root_id")
            .select("root_id", F.col("document_id").alias("resource_id"), "display_name", "document_uri",
                    F.when(itself, F.col("root_id")).otherwise(F.coalesce("org.context_id", "folder.context_id")).alias("context_id"),
                    F.when(itself, F.col("root_name")).otherwise(F.coalesce("org.context_label", "folder.context_label")).alias("context_label"),
                    F.when(dated, F.col("r.display_date")).otherwise(F.col("doc_display")).alias("display_date"),
                    F.coalesce("r.sort_date", "doc_sort").alias("sort_date"), "has_document"))
