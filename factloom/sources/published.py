"""The derived tables of one build, written together or each when it is first read, and read by every later query.

Layout under ``<folder>/<version>/``: ``current`` (numbered records), ``heads`` and ``triples_by_subject``, all three in
the same buckets of ids and sorted by them, ``triples`` (by predicate, sorted by object then subject), ``name_starts``
(sorted by start) and ``postings`` (blocks sorted by word). Tables in the same buckets are joined and aggregated by id
without a shuffle, and looked-up ids open their own buckets only. The last three are ranged on enough columns to split a
hot predicate, start or word over many files, and sorted so that scans skip files by their statistics.

Ids of source records and statements are hashes that no codec makes smaller; they are not stored, but computed from the stored
columns where a query selects them. Files are packed by Zstandard; ids in order are stored by what differs from the id before.

Statements are ranged in rounds of whole predicates, each of which gives back its shuffle before the next begins: besides the
tables, the disk holds the shuffle of about an eighth of the statements (or of the most frequent predicate), not of all.
Records that are cheap to read again may be dealt in rounds of buckets likewise. All other tables are made from ``current``.

Buckets are known to a session's catalog only; ``read`` tells them to any session that opens the tables again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession, functions as F

from ..operators import projection
from ..operators.postings import dealt_by_id, delta_coded, numbered, postings
from ..operators.prefix_intervals import name_starts
from ..session import shuffles_released

# tables in buckets and the id that deals them
BUCKETED = {"current": "resource_id", "heads": "resource_id", "triples_by_subject": "subject"}
CODEC = "zstd"
PARTS = ("current", "triples_by_subject", "triples", "name_starts", "postings", "heads")  # in the order they are written
ROUNDS = 8  # in which statements are ranged
DEALT_ROUNDS = 3  # in which records that are cheap to read again are dealt


def _table_name(path: str) -> str:
    return f"published_{hashlib.md5(path.encode()).hexdigest()}"


def bucketed_table(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A table written by ``write_bucketed``, with its buckets."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        fields = spark.read.parquet(path).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def packed(writer: DataFrameWriter) -> DataFrameWriter:
    """Small files: Zstandard over Parquet's second data pages, which store texts that begin alike as differences."""
    return (writer.option("compression", CODEC).option("parquet.compression.codec.zstd.level", "9")
            .option("parquet.writer.version", "PARQUET_2_0"))


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, mode: str = "error") -> DataFrame:
    """``df`` in buckets of ``key``; rows must be dealt by it, then every bucket is one file."""
    packed(df.write).mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(_table_name(path))
    return df.sparkSession.table(_table_name(path))


def predicate_rounds(statements: DataFrame, rounds: int = ROUNDS) -> list[list[str | None]]:
    """All predicates in groups of at most a share of the statements, or of one predicate that alone has more; the largest groups first."""
    counted = {r["predicate"]: r["n"] for r in statements.groupBy("predicate").agg(F.count(F.lit(1)).alias("n")).collect()}  # a folder each
    share, groups = -(-sum(counted.values()) // rounds), []
    for predicate, n in sorted(counted.items(), key=lambda x: (-x[1], x[0] or "")):
        group = next((g for g in groups if g[0] + n <= share), None)
        if group is None:
            groups.append(group := [0, []])
        group[0] += n
        group[1].append(predicate)
    return [found for _, found in sorted(groups, key=lambda g: -g[0])]


def _of_round(statements: DataFrame, predicates: list[str | None]) -> DataFrame:
    wanted = F.coalesce(F.col("predicate").isin([x for x in predicates if x is not None]), F.lit(False))
    return statements.where(wanted | F.col("predicate").isNull() if None in predicates else wanted)


def bucket_rounds(buckets: int, rounds: int) -> list[list[int]]:
    """All buckets in rounds that fall evenly, the last the smallest: a shuffle comes on top of what the rounds before it have written."""
    rounds = min(rounds, buckets)
    ends = [round(buckets * i * (2 * rounds + 1 - i) / (rounds * (rounds + 1))) for i in range(rounds + 1)]
    return [list(range(a, b)) for a, b in zip(ends, ends[1:]) if a < b]


def _of_buckets(records: DataFrame, some: list[int], buckets: int) -> DataFrame:
    """Records that ``repartition`` deals to some of the buckets."""
    return records.where(F.pmod(F.hash("resource_id"), F.lit(buckets)).isin(some))


@dataclass(frozen=True)
class Published:
    """Path of one version, its build counts (of the tables written so far) and its number of buckets."""

    path: str
    counts: dict[str, int]
    buckets: int

    def read(self, spark: SparkSession, part: str) -> DataFrame:
        path = f"{self.path}/{part}"
        rows = bucketed_table(spark, path, BUCKETED[part], self.buckets) if part in BUCKETED else spark.read.parquet(path)
        if part == "heads":
            return projection.heads_with_ids(rows, "number")
        return projection.triples_with_ids(rows) if part in ("triples", "triples_by_subject") else rows


def _write(spark: SparkSession, build: Published, part: str, df: DataFrame, order: tuple[str, ...] = (), partitions: tuple[str, ...] = (),
           kind=lambda writer: writer, mode: str = "error") -> None:
    """Write a table of the build, or with mode ``append`` more of it, and count its rows meanwhile."""
    seen, path = Observation(f"{part}-{mode}"), f"{build.path}/{part}"
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # observed above the exchange: its sampling pass must not count
    rows = df.observe(seen, F.count(F.lit(1)).alias("n"))
    with shuffles_released(spark):
        if part in BUCKETED:
            write_bucketed(rows, path, BUCKETED[part], build.buckets, mode)
        else:
            kind(packed(rows.write)).mode(mode).partitionBy(*partitions).parquet(path)
    build.counts[part] = build.counts.get(part, 0) + int(seen.get["n"])


def publish(current: DataFrame | Callable[[Callable[[DataFrame], DataFrame]], DataFrame], folder: str, version: str, buckets: int | None = None,
            parts: tuple[str, ...] = PARTS, rounds: int = 1) -> Published:
    """Write the derived tables (all, unless ``parts`` names some) of the current records under one version; rows are counted while written.

    A version is never overwritten: a second build under the same name is an error. ``buckets`` (the session's shuffle
    partitions, if not given) should leave a bucket of statements small enough for one task. ``current`` is run once for each
    of the ``rounds``, in which its buckets are written; more than one need records that are the same each time and cheap.

    A function instead of the records is called for each round with what deals rows by ``resource_id``: it may deal rows that
    are smaller than the records it makes of them, one of each.
    """
    make = current if callable(current) else lambda deal: current
    spark = SparkSession.active() if callable(current) else current.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    build = Published(f"{folder.rstrip('/')}/{version}", {}, buckets)
    # the compact records are moved once, by hash, so nothing is run twice for samples; heads and statements stay in their buckets
    for i, some in enumerate(bucket_rounds(buckets, rounds)):
        done = []

        def deal(rows: DataFrame, some=some, done=done) -> DataFrame:
            done.append(True)
            return dealt_by_id(rows if rounds == 1 else _of_buckets(rows, some, buckets), buckets)

        made = make(deal)
        _write(spark, build, "current", numbered(made if done else deal(made)), mode="append" if i else "error")
    return extend(spark, build, parts)


def extend(spark: SparkSession, build: Published, parts: tuple[str, ...]) -> Published:
    """The build with these tables too, written from its records (and ``triples`` from ``triples_by_subject``); those it has are left alone."""
    wanted = {*parts, "triples_by_subject"} if "triples" in parts else set(parts)
    records = build.read(spark, "current")
    for part in (x for x in PARTS if x in wanted and x not in build.counts):
        if part == "triples_by_subject":
            _write(spark, build, part, projection.plain_triples(records))
        elif part == "triples":
            statements = bucketed_table(spark, f"{build.path}/triples_by_subject", "subject", build.buckets)
            for i, predicates in enumerate(predicate_rounds(statements)):
                _write(spark, build, part, _of_round(statements, predicates), ("predicate", "object_value", "subject"), ("predicate",), mode="append" if i else "error")
        elif part == "name_starts":
            _write(spark, build, part, name_starts(projection.triples(records)), ("start", "resource_id"))
        elif part == "postings":
            _write(spark, build, part, postings(records), ("word", "block", "cassette_id"), kind=delta_coded)
        elif part == "heads":
            _write(spark, build, part, projection.plain_heads(records, "number"))
    return build
