"""Current records kept up to date from an append-only log.

A stateful stream keeps, per id, the newest definition and the directives seen so far, and appends what changed to a
table of deltas. There is no watermark: a late revision is legal, and its time, not its arrival, decides. One late
substitution can rewrite old references, so chains are resolved over the kept rows when they are read.

Deltas are merged by the same order as rows of the log, so a delta that knows less than an earlier one takes nothing
back: a stream that starts with an empty state store over a compacted folder, or reads files again, ends the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import vocab as v
from ..operators import materialize as m
from ..session import cut_lineage

_ORDER = ("source_seq", "ordinal")
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # on disk, not on the heap


def newest_state(records: DataFrame) -> DataFrame:
    """(resource_id, definition, target, target_order, deleted) per id; the same aggregation in batch and in a stream."""
    definition = F.struct(*[c for c in records.columns if c not in ("resource_id", "kind", "substitute_target")])
    is_definition, is_swap = F.col("kind") == v.RESOURCE, F.col("kind") == v.SUBSTITUTE
    return records.groupBy("resource_id").agg(
        F.max_by(F.when(is_definition, definition), F.when(is_definition, F.struct("modified_at", *_ORDER))).alias("definition"),
        F.max_by("substitute_target", F.when(is_swap, F.struct(*_ORDER))).alias("target"),
        F.max(F.when(is_swap, F.struct(*_ORDER))).alias("target_order"),
        F.bool_or(F.col("kind") == v.DELETE).alias("deleted"))


def maintain(records: DataFrame, folder: str, once: bool = True) -> StreamingQuery:
    """Start keeping the state of a streaming log under ``folder``. ``once`` works off what is there and stops.

    A batch that is run again after a failure writes the same version again, so nothing is counted twice.
    """
    def save(changed: DataFrame, version: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/deltas/version={version}")

    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    stream = newest_state(records).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/stream")
    return (stream.trigger(availableNow=True) if once else stream).start()


def kept_state(spark: SparkSession, folder: str) -> DataFrame:
    """Every id's state over all deltas."""
    deltas = spark.read.option("basePath", f"{folder}/deltas").parquet(f"{folder}/deltas")
    newest = F.when(F.col("definition").isNotNull(), F.struct("definition.modified_at", *[f"definition.{c}" for c in _ORDER]))
    return deltas.groupBy("resource_id").agg(
        F.max_by("definition", newest).alias("definition"), F.max_by("target", "target_order").alias("target"),
        F.max("target_order").alias("target_order"), F.bool_or("deleted").alias("deleted"))


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """Write the state as the first delta of a new folder. ``maintain`` goes on there, over the files that came since or over all."""
    kept_state(spark, folder).write.mode("error").parquet(f"{into}/deltas/version=-1")


def current_records(spark: SparkSession, folder: str, on_cycle: str = "raise") -> DataFrame:
    """The same rows a batch run over the whole log gives."""
    state = cut_lineage(kept_state(spark, folder))
    target = F.when(~F.col("deleted"), F.col("target"))
    directives = state.where("deleted or target is not null").select(F.col("resource_id").alias("id"), target.alias("target"), "deleted")
    definitions = state.where("definition is not null").select("resource_id", "definition.*")
    kept = m.drop_redirected(definitions, directives)
    current = m.rewrite_references(kept, m.substitution_closure(directives, on_cycle)).withColumn("is_synthetic", F.lit(False))
    return m.add_root(current.drop("modified_at_raw"))
