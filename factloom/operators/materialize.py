"""Revision log to current records.

Rules: a deletion wins over every substitution of the same id, whatever their order; of several
substitutions the last in log order wins; of several definitions the newest wins, the later one on a tie.
Log order is ``(source_seq, ordinal)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab as v
from ..functions.ids import is_blank
from ..functions.times import min_time
from ..session import BROADCAST_ROWS, cut_lineage

_LOG_ORDER = ("source_seq", "ordinal")


class CyclicSubstitution(ValueError):
    """Substitutions that lead back to themselves."""


def _revision_order() -> Column:
    return F.struct("modified_at", *_LOG_ORDER)


def collapse_directives(records: DataFrame) -> DataFrame:
    """(id, target, deleted): one row per id that is deleted or substituted; the target of a deleted id is null."""
    found = (
        records.where(F.col("kind").isin(v.DELETE, v.SUBSTITUTE))
        .groupBy(F.col("resource_id").alias("id"))
        .agg(
            F.max_by("substitute_target", F.when(F.col("kind") == v.SUBSTITUTE, F.struct(*_LOG_ORDER))).alias("target"),
            F.bool_or(F.col("kind") == v.DELETE).alias("deleted")))
    return found.withColumn("target", F.when(~F.col("deleted"), F.col("target")))


def substitution_closure(directives: DataFrame, on_cycle: str = "raise") -> DataFrame:
    """(id, resolved, hops, cyclic): end of every substitution chain.

    A chain ends at an id that is not substituted; a deleted id is such an end. Deleted ids themselves
    resolve to null. Each round joins the jumps with themselves, so chains of length n need about log2(n)
    rounds. ``on_cycle="mark"`` returns cyclic ids with ``cyclic = true`` and no target instead of raising.
    """
    jumps = cut_lineage(directives.where(~F.col("deleted")).select(
        "id", F.col("target").alias("cur"), F.lit(1).cast("bigint").alias("hops")))
    total = jumps.count()
    rounds = math.ceil(math.log2(total)) + 1 if total > 1 else 1
    active = None
    for _ in range(rounds + 1):
        ahead = jumps.select(F.col("id").alias("cur"), F.col("cur").alias("far"), F.col("hops").alias("more"))
        if total <= BROADCAST_ROWS:
            ahead = F.broadcast(ahead)
        jumps = cut_lineage(jumps.join(ahead, "cur", "left").select(
            "id", F.coalesce("far", "cur").alias("cur"),
            (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("far").isNotNull().alias("active")))
        active = jumps.where("active").select("id")
        looped = jumps.where("active and id = cur")
        if active.isEmpty() or (on_cycle == "raise" and not looped.isEmpty()):
            break
    if on_cycle == "raise" and not active.isEmpty():
        sample = [r["id"] for r in active.orderBy("id").limit(5).toLocalIterator()]
        raise CyclicSubstitution(f"cyclic substitute chain, for example through: {', '.join(sample)}")
    resolved = jumps.select(
        "id", F.when(~F.col("active"), F.col("cur")).alias("resolved"),
        F.when(~F.col("active"), F.col("hops")).alias("hops"), F.col("active").alias("cyclic"))
    deleted = directives.where("deleted").select(
        "id", F.lit(None).cast("string").alias("resolved"), F.lit(0).cast("bigint").alias("hops"),
        F.lit(False).alias("cyclic"))
    return resolved.unionByName(deleted)


def duplicate_ids(records: DataFrame) -> DataFrame:
    """Ids defined more than once, deleted and substituted ones included."""
    return (records.where(F.col("kind") == v.RESOURCE)
            .groupBy("resource_id").agg(F.count("*").alias("definitions")).where("definitions > 1"))


def latest_definitions(records: DataFrame) -> DataFrame:
    """Newest definition of every id. Partial aggregation keeps one row per id and map task, so a hot id is no hot task."""
    row = F.struct(*[c for c in records.columns if c not in ("resource_id", "kind", "substitute_target")])
    return (records.where(F.col("kind") == v.RESOURCE)
            .groupBy("resource_id").agg(F.max_by(row, _revision_order()).alias("row"))
            .select("resource_id", "row.*"))


def drop_redirected(definitions: DataFrame, directives: DataFrame) -> DataFrame:
    """Without the subjects that were deleted or substituted."""
    return definitions.join(directives.select(F.col("id").alias("resource_id")), "resource_id", "left_anti")


def _sized(closure: DataFrame) -> DataFrame:
    targets = closure.where("resolved is not null").select("id", "resolved")
    return F.broadcast(targets) if targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else targets


def resolve_ids(ids: DataFrame, closure: DataFrame, column: str = "id") -> DataFrame:
    """Adds ``resolved``: the end of the id's chain, or the id itself."""
    targets = _sized(closure).withColumnRenamed("id", column)
    return ids.join(targets, column, "left").withColumn("resolved", F.coalesce("resolved", column))


def rewrite_references(definitions: DataFrame, closure: DataFrame, key: str = "resource_id") -> DataFrame:
    """Resource values of ``props`` replaced by the ends of their chains.

    Only the references that do change are regrouped, at most one record's properties per group;
    deleted targets keep their dangling reference. A blank reference is an error.
    """
    changed = (
        definitions.select(key, F.posexplode("props").alias("pos", "p"))
        .where(F.col("p.kind") == v.RESOURCE)
        .select(key, "pos", F.col("p.value").alias("id"))
        .join(_sized(closure), "id")
        .groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "resolved"))).alias("moves")))

    def value(p: Column, i: Column) -> Column:
        moved = F.coalesce(F.try_element_at("moves", i), p["value"])
        blank = (p["kind"] == v.RESOURCE) & is_blank(p["value"])
        return F.when(blank, F.raise_error(F.concat(F.lit("blank reference in "), F.col(key))).cast("string")).otherwise(moved)

    return definitions.join(changed, key, "left").withColumn(
        "props", F.transform("props", lambda p, i: p.withField("value", value(p, i)))).drop("moves")


def blank_references(records: DataFrame) -> DataFrame:
    """Records that hold a reference without target; set these aside before materializing a faulty log."""
    return records.where(F.exists("props", lambda p: (p["kind"] == v.RESOURCE) & is_blank(p["value"])))


def _root_collection(like: DataFrame) -> DataFrame:
    prop = F.struct(
        F.lit(v.NAME).alias("predicate"), F.lit(v.LITERAL).alias("kind"), F.lit(v.ROOT_COLLECTION_NAME).alias("value"),
        F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("datatype"))
    known = {"resource_id": F.lit(v.ROOT_COLLECTION_ID), "type": F.lit(v.COLLECTION), "modified_at": min_time(),
             "props": F.array(prop), "is_synthetic": F.lit(True)}
    return like.sparkSession.range(1).select(*[
        known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def add_root(current: DataFrame) -> DataFrame:
    """With the built-in root collection when the log defines none."""
    present = current.where(F.col("resource_id") == v.ROOT_COLLECTION_ID).select("resource_id")
    return current.unionByName(_root_collection(current).join(present, "resource_id", "left_anti"))


def current_records(records: DataFrame, on_cycle: str = "raise") -> DataFrame:
    """The current cloud: newest definitions, without deleted and substituted ids, references at their chain ends."""
    directives = cut_lineage(collapse_directives(records))
    closure = substitution_closure(directives, on_cycle)
    kept = drop_redirected(latest_definitions(records), directives)
    current = rewrite_references(kept, closure).withColumn("is_synthetic", F.lit(False))
    return add_root(current.drop("modified_at_raw"))


def statistics(records: DataFrame, source_files: DataFrame | None = None) -> DataFrame:
    """One row of counters over the log and its current cloud; a single shuffle on the id.

    ``source_files`` counts files that hold no record as well; without it files are counted from the records.
    """
    def ops(kind: str) -> Column:
        return F.count(F.when(F.col("kind") == kind, 1))

    per_id = records.groupBy("resource_id").agg(
        ops(v.RESOURCE).alias("defs"), ops(v.DELETE).alias("dels"), ops(v.SUBSTITUTE).alias("subs"),
        F.max_by(F.size("props"), F.when(F.col("kind") == v.RESOURCE, _revision_order())).alias("n_props"))
    is_current = "defs > 0 and dels = 0 and subs = 0"

    def ids(condition: str) -> Column:
        return F.count(F.when(F.expr(condition), 1))

    root = F.when(F.coalesce(F.bool_or(F.expr(f"{is_current} and resource_id = '{v.ROOT_COLLECTION_ID}'")), F.lit(False)), 0).otherwise(1)
    counted = per_id.agg(
        F.coalesce(F.sum(F.expr("defs + dels + subs")), F.lit(0)).alias("source_records"),
        F.coalesce(F.sum("defs"), F.lit(0)).alias("resource_definitions"),
        F.coalesce(F.sum("dels"), F.lit(0)).alias("delete_operations"),
        F.coalesce(F.sum("subs"), F.lit(0)).alias("substitute_operations"),
        ids("defs > 1").alias("duplicate_ids"), ids("dels = 0 and subs > 0").alias("redirected_ids"),
        ids("dels > 0").alias("deleted_ids"), ids(is_current).alias("current_resources"),
        root.cast("bigint").alias("synthetic_resources"),
        (F.coalesce(F.sum(F.when(F.expr(is_current), F.col("n_props"))), F.lit(0)) + root).alias("current_properties"))
    files = (source_files.agg(F.count("*").alias("source_files")) if source_files is not None
             else records.agg(F.countDistinct("cassette_id", "source_path").alias("source_files")))
    return files.crossJoin(counted)  # one row each
