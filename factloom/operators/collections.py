"""Collections: memberships, contents, checks and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab as v
from ..session import dealt_anew
from .access import visible
from .match import visible_heads
from .portrait import summaries
from .search import check_limit


def memberships(triples: DataFrame, allowed) -> DataFrame:
    """(collection_id, membership_id, resource_id, membership_cassette_id) distinct.

    Both statements belong to the membership record, so the join key is that record and never a large collection.
    """
    iri = visible(triples, allowed).where(F.col("object_kind") == v.IRI)
    holder = iri.where(F.col("predicate") == v.IN_COLLECTION).select(
        F.col("subject").alias("membership_id"), F.col("object_value").alias("collection_id"), F.col("cassette_id").alias("membership_cassette_id"))
    item = iri.where(F.col("predicate") == v.COLLECTION_ITEM).select(
        F.col("subject").alias("membership_id"), F.col("object_value").alias("resource_id"))
    return holder.join(item, "membership_id").select("collection_id", "membership_id", "resource_id", "membership_cassette_id").distinct()


def contents(heads: DataFrame, triples: DataFrame, terms: DataFrame, allowed, limit: int | None = None, language: str = "ru",
             collections: DataFrame | None = None) -> DataFrame:
    """Visible members of visible collections by name, id and membership; ``limit`` keeps the first of each collection."""
    check_limit(limit)
    held = memberships(triples, allowed).join(
        dealt_anew(visible_heads(heads, allowed).select(F.col("resource_id").alias("collection_id")), "collection_id"), "collection_id", "left_semi")
    if collections is not None:
        held = held.join(collections.select(F.col(collections.columns[0]).alias("collection_id")), "collection_id", "left_semi")
    shown = summaries(heads, triples, terms, allowed, language, held.select("resource_id").distinct())
    items = held.join(dealt_anew(shown, "resource_id"), "resource_id")
    order = Window.partitionBy("collection_id").orderBy(F.upper("display_name"), "resource_id", "membership_id")
    placed = items.withColumn("place", F.row_number().over(order))
    return ((placed if limit is None else placed.where(F.col("place") <= limit))
            .select("collection_id", "place", "membership_id", "resource_id", "display_name", "type", "type_label",
                    "membership_cassette_id", "cassette_id"))


def check_memberships(wanted: DataFrame, heads: DataFrame, triples: DataFrame, allowed) -> DataFrame:
    """Those (membership_id, collection_id, resource_id) that exist: visible record of the type with both links."""
    rows = visible(triples, allowed, system=False).where(
        (F.col("object_kind") == v.IRI) & (F.col("predicate").isin(v.IN_COLLECTION, v.COLLECTION_ITEM)
                                           | ((F.col("predicate") == v.RDF_TYPE) & (F.col("object_value") == v.COLLECTION_MEMBER))))

    def held(predicate: str) -> Column:
        return F.collect_set(F.when(F.col("predicate") == predicate, F.col("object_value")))

    # a record's own statements meet by its id alone, where they lie in its bucket
    facts = rows.groupBy(F.col("subject").alias("membership_id")).agg(
        F.bool_or(F.col("predicate") == v.RDF_TYPE).alias("typed"), held(v.IN_COLLECTION).alias("holders"), held(v.COLLECTION_ITEM).alias("held"))
    facts = facts.where("typed and size(holders) > 0 and size(held) > 0")
    shown = visible(heads.where(~F.col("is_deleted")), allowed, system=False).select(F.col("resource_id").alias("membership_id"))
    known = facts.join(shown, "membership_id", "left_semi")
    found = wanted.select("membership_id", F.struct(*wanted.columns).alias("row")).join(known, "membership_id")
    return found.where(F.array_contains("holders", F.col("row.collection_id")) & F.array_contains("held", F.col("row.resource_id"))).select("row.*")


def redact_memberships(items: DataFrame, user_id: str, project_rights: DataFrame, cassette_rights: DataFrame) -> DataFrame:
    """Membership columns blanked where the user could not delete the membership."""
    admin = project_rights.where((F.col("user_id") == user_id) & (F.col("right") == v.REBUILD_INDEX)).agg((F.count("*") > 0).alias("admin"))
    deletes = cassette_rights.where((F.col("user_id") == user_id) & (F.col("right") == "delete")).select(
        F.col("cassette_id").alias("membership_cassette_id"), F.lit(True).alias("deletes")).distinct()
    rows = items.crossJoin(admin).join(deletes, "membership_cassette_id", "left")
    able = F.col("admin") | F.coalesce("deletes", F.lit(False))
    for name in ("membership_id", "membership_cassette_id"):
        rows = rows.withColumn(name + "_", F.when(able, F.col(name)))
    return rows.drop("admin", "deletes", "membership_id", "membership_cassette_id").withColumnsRenamed(
        {"membership_id_": "membership_id", "membership_cassette_id_": "membership_cassette_id"})
