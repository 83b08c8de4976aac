"""Resource summaries and portraits.

A portrait is a set of rows, one per literal or link, with the columns it is sorted by. Nothing is gathered
per resource, so a hub with a third of all links is as easy as any other resource.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab as v
from ..functions import text
from ..functions.dates import parse_date
from ..functions.ids import is_blank
from ..functions.labels import language_rank, pick_label
from ..functions.uris import is_document_uri
from ..session import cut_lineage, small
from .access import visible
from .match import first_type, visible_heads
from .ontology import direct_properties, enumeration_labels, inverse_properties

LITERALS, DIRECT, INVERSE = "literal", "direct", "inverse"


def best_name(predicate: str, value: str, lang: str, language: str) -> Column:
    """Aggregate: a name before an alias, then by language rank, then alphabetically without regard to case."""
    order = F.struct((F.col(predicate) != v.NAME).alias("alias"), language_rank(lang, language).alias("rank"),
                     F.upper(value).alias("folded"), F.col(value).alias("value"))
    return F.min(order)["value"]


def _of(triples: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Statements about the ids (column resource_id) only; the join serves the aggregation by subject that follows."""
    return triples if ids is None else triples.join(ids.select(F.col("resource_id").alias("subject")), "subject", "left_semi")


def display_names(triples: DataFrame, allowed, language: str, ids: DataFrame | None = None) -> DataFrame:
    """(resource_id, display_name) over all searchable names and aliases of a resource."""
    names = visible(_of(triples, ids), allowed).where(
        (F.col("object_kind") == v.LITERAL) & F.col("predicate").isin(*v.NAME_PREDICATES) & text.has_words("object_value"))
    return names.groupBy(F.col("subject").alias("resource_id")).agg(
        best_name("predicate", "object_value", "lang", language).alias("display_name"))


def type_labels(terms: DataFrame, language: str) -> DataFrame:
    return terms.select(F.col("id").alias("type"), pick_label("labels", language).alias("type_label"))


def with_type(rows: DataFrame, triples: DataFrame, terms: DataFrame, allowed, language: str, ids: DataFrame | None = None) -> DataFrame:
    """Adds ``type`` and ``type_label`` (the type itself where it has no label). ``ids`` limits the statements read."""
    typed = rows.join(first_type(_of(triples, ids), allowed), "resource_id", "left")
    return typed.join(small(type_labels(terms, language)), "type", "left").withColumn(
        "type_label", F.coalesce("type_label", "type"))


def summaries(heads: DataFrame, triples: DataFrame, terms: DataFrame, allowed, language: str = "ru",
              ids: DataFrame | None = None) -> DataFrame:
    """(resource_id, display_name, type, type_label, cassette_id) of visible resources."""
    shown = visible_heads(heads, allowed).select("resource_id", "cassette_id")
    if ids is not None:
        ids = ids.select(F.col(ids.columns[0]).alias("resource_id"))
        shown = shown.join(ids, "resource_id", "left_semi")
    named = shown.join(display_names(triples, allowed, language, ids), "resource_id", "left").withColumn(
        "display_name", F.coalesce("display_name", "resource_id"))
    return with_type(named, triples, terms, allowed, language, ids).select(
        "resource_id", "display_name", "type", "type_label", "cassette_id")


def portrait_rows(heads: DataFrame, triples: DataFrame, allowed, ids: DataFrame | None = None, inverse: bool = True,
                  by_object: DataFrame | None = None) -> DataFrame:
    """(resource_id, section, predicate, value, lang, datatype, cassette_id, triple_id) of visible resources.

    Literals are sorted by predicate, language, value, triple_id, links by predicate, value, triple_id; see
    ``portrait_order``. ``inverse=False`` is the summary portrait, which never reads links by target; ``by_object`` are the
    same statements in an order that serves those links, where ``triples`` are in the buckets of their subjects.
    """
    shown = visible_heads(heads, allowed).select("resource_id")
    if ids is not None:
        shown = shown.join(ids.select(F.col(ids.columns[0]).alias("resource_id")), "resource_id", "left_semi")
    rows = visible(triples, allowed)

    def section(found: DataFrame, name, value: str) -> DataFrame:
        return found.join(shown, "resource_id", "left_semi").select(
            "resource_id", name.alias("section"), "predicate", F.col(value).alias("value"), "lang", "datatype",
            "cassette_id", "triple_id")

    outgoing = rows.where((F.col("object_kind") == v.LITERAL) | ((F.col("object_kind") == v.IRI) & (F.col("predicate") != v.RDF_TYPE)))
    kind = F.when(F.col("object_kind") == v.LITERAL, LITERALS).otherwise(DIRECT)
    out = section(outgoing.withColumn("resource_id", F.col("subject")), kind, "object_value")
    if inverse:
        incoming = (rows if by_object is None else visible(by_object, allowed)).where(F.col("object_kind") == v.IRI).withColumn("resource_id", F.col("object_value"))
        out = out.unionByName(section(incoming, F.lit(INVERSE), "subject"))
    return out


def portrait_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("resource_id", F.col("section") != LITERALS, F.col("section") != DIRECT, "predicate",
                        F.when(F.col("section") == LITERALS, F.coalesce("lang", F.lit(""))), "value", "triple_id")


def portrait_heads(heads: DataFrame, triples: DataFrame, allowed) -> DataFrame:
    """(resource_id, type, source_record_id, cassette_id, source_path, modified_at): the portrait's frame."""
    return visible_heads(heads, allowed).drop("is_deleted").join(first_type(triples, allowed), "resource_id", "left")


def date_properties(terms: DataFrame) -> DataFrame:
    """Ids of the properties whose values are dates."""
    fixed = terms.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in v.DATE_PREDICATES])).alias("predicate"))
    own = terms.where((F.col("kind") == v.DATATYPE_PROPERTY) & F.array_contains("ranges", v.DATE)).select(
        F.col("id").alias("predicate"))
    return own.unionByName(fixed).distinct()


def present(rows: DataFrame, frame: DataFrame, terms: DataFrame, closure: DataFrame, language: str = "ru") -> DataFrame:
    """Portrait rows with labels, display values and the ontology's order of properties.

    Order: ``unlisted``, ``priority`` (nulls last), predicate, lang (literals), value. ``frame`` gives each
    resource its type. Values stay as stored; ``display_value`` shows dates and enumeration labels.
    """
    listed = direct_properties(terms, closure).select(
        F.col("class_id").alias("type"), F.col("property_id").alias("predicate"), "priority", F.lit(False).alias("is_inverse"))
    listed = listed.unionByName(inverse_properties(terms, closure).select(
        F.col("class_id").alias("type"), F.col("property_id").alias("predicate"), "priority", F.lit(True).alias("is_inverse")))
    labels = small(terms.select(F.col("id").alias("predicate"), pick_label("labels", language).alias("own"),
                                pick_label("inverse_labels", language).alias("back")))
    dates = small(date_properties(terms).withColumn("is_date", F.lit(True)))
    states = small(enumeration_labels(terms, language).select(
        F.col("property_id").alias("predicate"), "value", F.col("label").alias("state")))
    inverse = F.col("section") == INVERSE
    property_label = F.coalesce("own", "predicate")
    shown = F.when(F.col("section") == LITERALS, F.when(is_blank("value"), F.col("value")).otherwise(F.coalesce(
        F.when(F.col("is_date"), parse_date("value")["display"]), F.col("state"), F.col("value"))))
    return (
        rows.withColumn("is_inverse", inverse).join(frame.select("resource_id", "type"), "resource_id", "left")
        .join(labels, "predicate", "left").join(dates, "predicate", "left").join(states, ["predicate", "value"], "left")
        .join(small(cut_lineage(listed.withColumn("listed", F.lit(True)))), ["type", "predicate", "is_inverse"], "left")
        .select("resource_id", "section", "predicate",
                F.when(inverse, F.coalesce(F.col("back"), property_label)).otherwise(property_label).alias("label"),
                "value", shown.alias("display_value"), "lang", "datatype", F.col("listed").isNull().alias("unlisted"), "priority"))


def provenance_level(frame: DataFrame, user_id: str, project_rights: DataFrame, cassette_rights: DataFrame) -> DataFrame:
    """Adds ``level``: full for those who may rebuild, cassette for those who may write there, else none."""
    def mine(rights: DataFrame) -> DataFrame:
        return rights.where(F.col("user_id") == user_id)

    admin = mine(project_rights).where(F.col("right") == v.REBUILD_INDEX).agg((F.count("*") > 0).alias("admin"))
    writes = mine(cassette_rights).where(F.col("right") == "writeMetadata").select("cassette_id", F.lit(True).alias("writes")).distinct()
    return (frame.crossJoin(admin).join(writes, "cassette_id", "left")
            .withColumn("level", F.when(F.col("admin"), "full").when(F.col("writes"), "cassette").otherwise("none"))
            .drop("admin", "writes"))


def redact_provenance(frame: DataFrame) -> DataFrame:
    """Source columns blanked according to ``level``."""
    full, some = F.col("level") == "full", F.col("level").isin("full", "cassette")
    for name in ("source_record_id", "source_path", "modified_at"):
        frame = frame.withColumn(name, F.when(full, F.col(name)))
    return frame.withColumn("cassette_id", F.when(some, F.col("cassette_id")))


_DESCRIPTION_LIMIT = 240


def page_metadata(presented: DataFrame, frame: DataFrame, terms: DataFrame, language: str = "ru") -> DataFrame:
    """(resource_id, title, description, document_uri) for a page's head.

    A resource with a document is titled by its type; the address is given only if it is the only one.
    """
    order = [F.col("unlisted"), F.coalesce("priority", F.lit("￿")).alias("priority"), F.col("predicate"),
             F.coalesce("lang", F.lit("")).alias("lang"), F.col("value")]
    tail = text.terminal_name("predicate")

    def first(test: Column) -> Column:
        return F.min(F.when(test, F.struct(*order, F.col("display_value").alias("shown"))))["shown"]

    trimmed = F.trim("value")
    uri = F.when(is_document_uri(trimmed), trimmed)
    literals = presented.where(F.col("section") == LITERALS).groupBy("resource_id").agg(
        first(tail.isin("name", "alias")).alias("name"),
        first(tail.isin("description", "comment") & ~is_blank("display_value")).alias("described"),
        F.min(uri).alias("low"), F.max(uri).alias("high"))
    kind = F.coalesce("type_label", "type")
    about = F.coalesce(F.trim("described"), kind, F.lit(v.LABEL_RESOURCE))
    short = F.concat(F.rtrim(F.left(about, F.lit(_DESCRIPTION_LIMIT - 3))), F.lit("…"))
    return (frame.select("resource_id", "type").join(small(type_labels(terms, language)), "type", "left")
            .join(literals, "resource_id", "left")
            .select("resource_id",
                    F.when(F.col("low").isNotNull(), F.coalesce(kind, F.lit(v.LABEL_DOCUMENT)))
                    .when(is_blank("name"), F.col("resource_id")).otherwise(F.col("name")).alias("title"),
                    F.when(F.length(about) <= _DESCRIPTION_LIMIT, about).otherwise(short).alias("description"),
                    F.when(F.col("low") == F.col("high"), F.col("low")).alias("document_uri")))
