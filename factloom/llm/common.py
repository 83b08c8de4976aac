"""What the text operators share: the shared folder, registered queries, and the columns they ask for."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import configure, scratch_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` gives the same rows from the same tables."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# Rows and bytes that go to a Python worker at once: texts are long, and a batch is held by the JVM and by Python.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 24)}


def prepare(spark: SparkSession) -> None:
    """Settings of the text operators; Python workers find this package where the driver found it."""
    configure(spark)
    for key, value in _BATCHES.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    environment = spark.sparkContext.environment
    if _ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, environment.get("PYTHONPATH", "")]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    prepare(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{scratch_folder(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, partition: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives the loss of executors."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, what)
    prepare(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition) if partition else writer).parquet(folder)
    fields = df.select(*[c for c in df.columns if c != partition], *([partition] if partition else [])).schema
    return spark.read.schema(fields).parquet(folder)


def keyed_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids and texts; a null text counts as empty. Other columns are never read."""
    prepare(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
