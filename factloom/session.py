"""Session settings, lineage cutting and size-checked broadcast."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is broadcast only when it was counted and holds at most this many rows.
BROADCAST_ROWS = 100_000

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split hot keys even where the split costs one more shuffle before an aggregation on the same key
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # let lists of looked-up keys reach the parquet statistics one by one
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
}

# At most this many looked-up keys are listed in a scan filter.
LISTED_KEYS = 1_000


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators count on: UTC timestamps and adaptive skew handling."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """A table written inside gives back the disk of its shuffles once it is written, not when the driver next collects garbage."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before) if before is not None else spark.conf.unset(_RELEASE)


def scratch_folder(spark: SparkSession) -> str:
    """Shared folder for checkpoints and derived tables: ``spark.checkpoint.dir``.

    Only a session in one process, such as a test's, gets a temporary one when none is set.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir()
    if found is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context._jsc.sc().isLocal():
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="factloom-")
        context.setCheckpointDir(folder)
        found = context.getCheckpointDir()
    return found.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    scratch_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bound(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``limit`` rows; reads no more than ``limit + 1`` of them."""
    return df.limit(limit + 1).count() <= limit


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when its counted size allows, else unchanged (shuffle join, split by AQE)."""
    return F.broadcast(df) if row_bound(df, limit) else df


def dealt_anew(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` to be joined by a text column of theirs without the buckets they may be stored in.

    A join leans on buckets where only one side has them, and a key with very many rows on the other side is then one task.
    Behind an expression both sides are shuffled and adaptive execution splits such a key.
    """
    return rows.withColumn(column, F.concat(column, F.lit("")))


def lookup(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is among the keys (the column of the same name in ``keys``).

    A few keys become a scan filter, so files sorted by the column are skipped; up to the broadcast bound they
    are broadcast; more are joined by shuffle. ``keys`` should be materialized, it is counted first.
    """
    wanted = keys.select(column).distinct()
    listed = [r[0] for r in wanted.limit(LISTED_KEYS + 1).collect()]  # bounded by the limit
    if len(listed) <= LISTED_KEYS:
        return rows.where(F.col(column).isin(listed))
    return rows.join(small(wanted), column, "left_semi")
