"""Exact duplicates by sorting content: range-partition, sort externally, compare neighbours in full.

Sampled splitters deal the rows by (first bytes, SHA-256, id) of the normalised text. The splitters are short
whatever the texts' length, and the id lets the copies of one text spread over many partitions, however many there
are. Each partition is sorted by content with Spark's spilling sort, then streamed: neighbours are compared byte by
byte and every run of equal texts starts with the row that stays. Only the first and last run of a partition can go
on in another one; their texts (two per partition) are grouped by equality to join such runs.

Edge cases: a null text counts as empty (all empty texts are copies of each other); a null id stays only if no row
of its group has an id; of repeated rows with the same id and text exactly one stays; no rows give no rows; other
columns are not read unless carried.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from .common import query, stored, table

# Leading bytes of a text that splitters hold; more only moves work from the digest to the bytes.
SPLITTER_BYTES = 32


def _mark_runs(text_column: str, out_columns: list[str]):
    """Streams sorted rows; adds the run number, whether the row opens it, and the text of the partition's outer rows."""
    def mark(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        previous, run, waiting = None, -1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = pc.fill_null(batch.column(batch.schema.get_field_index(text_column)), "")
            same = [previous is not None and texts[0].as_py() == previous]
            opens = pc.invert(pa.concat_arrays([pa.array(same, pa.bool_()), pc.equal(texts[1:], texts[:-1])]))
            numbers = pc.add(pc.cumulative_sum(pc.cast(opens, pa.int32())), pa.scalar(run, pa.int32()))
            edges = pa.nulls(batch.num_rows, pa.string())
            if previous is None:
                edges = pa.concat_arrays([texts[:1], edges[1:]])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in out_columns]
            columns += [pa.repeat(pa.scalar(part, pa.int32()), batch.num_rows), numbers, opens, edges]
            out = pa.record_batch(columns, names=[*out_columns, "part", "run", "opens", "edge"])
            previous, run = texts[-1].as_py(), numbers[-1].as_py()
            if waiting is not None:
                yield waiting
            if out.num_rows > 1:
                yield out.slice(0, out.num_rows - 1)
            waiting = out.slice(out.num_rows - 1)
        if waiting is not None:  # the last row shows its text as well
            yield waiting.set_column(waiting.num_columns - 1, "edge", pa.array([previous], pa.string()))

    return mark


def _numbered_columns(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, str, str]:
    """``docs`` with its columns called c0, c1, ... by place, as any name may clash with a helper's; and what id and text are called."""
    def place(name: str) -> str:
        same = [i for i, c in enumerate(docs.columns) if c == name] or [i for i, c in enumerate(docs.columns) if c.lower() == name.lower()]
        if not same:
            raise ValueError(f"no column {name}")
        return f"c{same[0]}"

    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), place(id_column), place(text_column)


def sorted_runs(docs: DataFrame, keep: str = "smallest", normalise=None, carry: bool = False, id_column: str = "doc_id", text_column: str = "text",
                partitions: int | None = None) -> tuple[DataFrame, str]:
    """All rows in content order, stored in the shared folder, and the name of their id: the id, or with ``carry`` all columns, called c0, c1, ...
    by their place in ``docs``; ``sha256`` of the normalised text, ``part``, ``run``, ``opens`` (first of its run) and ``edge`` (the text of a
    partition's outer rows)."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    docs, id_column, text_column = _numbered_columns(docs, id_column, text_column)
    text: Column = F.coalesce(F.col(text_column), F.lit(""))
    text = text if normalise is None else normalise(text)
    wanted = docs.columns if carry else [id_column]
    rows = docs.select(*wanted, text.alias("normal"))
    rows = rows.withColumns({"head": F.substring(F.encode("normal", "utf-8"), 1, SPLITTER_BYTES), "sha256": F.unhex(F.sha2(F.col("normal"), 256))})
    best = F.col(id_column).asc_nulls_last() if keep == "smallest" else F.col(id_column).desc_nulls_last()
    keys = (F.col("head"), F.col("sha256"), best)
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    dealt = dealt.sortWithinPartitions(F.col("head"), F.col("sha256"), F.col("normal"), best)
    out_columns = [*wanted, "sha256"]
    schema = StructType([*dealt.select(*out_columns).schema.fields, StructField("part", IntegerType()),
                         StructField("run", IntegerType()), StructField("opens", BooleanType()), StructField("edge", StringType())])
    return stored(dealt.mapInArrow(_mark_runs("normal", out_columns), schema), "content-sort"), id_column


def _joined_runs(rows: DataFrame, id_column: str) -> DataFrame:
    """Runs that other partitions go on with: (part, run, keep_id, group_size, first)."""
    outer = rows.where(F.col("edge").isNotNull()).select("part", "run", "edge").distinct()
    sizes = rows.groupBy("part", "run").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("opens"), F.col(id_column))).alias("id"))
    pieces = outer.join(sizes, ["part", "run"])
    groups = pieces.groupBy("edge").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n").alias("group_size"), F.min(F.struct("part", "run", "id")).alias("best"))
    return (pieces.join(groups.where("pieces > 1"), "edge")
            .select("part", "run", F.col("best.id").alias("keep_id"), "group_size", (F.col("part") == F.col("best.part")).alias("first")))


def exact_duplicates(docs: DataFrame, keep: str = "smallest", normalise=None, id_column: str = "doc_id", text_column: str = "text",
                     partitions: int | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id`` (id of the row that stays), ``group_size``, ``kept`` and
    ``text_sha256`` of the normalised text."""
    rows, own = sorted_runs(docs, keep, normalise, False, id_column, text_column, partitions)
    several = (rows.groupBy("part", "run").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("opens"), F.col(own))).alias("head_id"))
               .where("n > 1"))
    across = _joined_runs(rows, own)
    return (rows.join(several, ["part", "run"], "left").join(across, ["part", "run"], "left")
            .select(F.col(own).alias(id_column),
                    F.when(F.col("group_size").isNotNull(), F.col("keep_id")).when(F.col("n").isNotNull(), F.col("head_id")).otherwise(F.col(own)).alias("keep_id"),
                    F.coalesce("group_size", "n", F.lit(1)).cast("long").alias("group_size"),
                    (F.col("opens") & F.coalesce("first", F.lit(True))).alias("kept"),
                    F.lower(F.hex("sha256")).alias("text_sha256")))


def without_duplicates(docs: DataFrame, keep: str = "smallest", normalise=None, id_column: str = "doc_id", text_column: str = "text",
                       partitions: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called."""
    rows, own = sorted_runs(docs, keep, normalise, True, id_column, text_column, partitions)
    across = _joined_runs(rows, own).where("not first").select("part", "run")
    kept = rows.where("opens").join(across, ["part", "run"], "left_anti")
    return kept.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


@query("op6_content_sort", """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents""")
def op6_content_sort(spark, folder):
    """Equal texts of all documents; the row with the largest id stays."""
    return exact_duplicates(table(spark, folder, "documents"), keep="largest")
