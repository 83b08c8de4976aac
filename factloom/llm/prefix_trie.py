"""The trie of conversation prefixes, its subtree totals found by time-forward processing.

Prefixes. Turns become narrow rows (digest and length) and get exact ranks from one range exchange and the sizes of its
partitions. Every conversation is rebuilt: the first ``h`` turns of its family's first conversation, then its own turns
after its first ``h``. A prefix is named by running sums of 64-bit hashes of (place, turn), two independent ones, taken in
blocks of turns; so neither a conversation nor a family of copies is one task.

Totals. A node whose prefix has more rows below it than a shard may have is heavy; what hangs below the heavy ones are
shards of bounded size. In every shard the nodes are sorted in reverse level order (by Spark's spilling sort) and
streamed: a node takes the messages of its children from a priority queue ordered the same way, and sends its total
forward to its parent. The queue spills sorted runs to the shared folder. Totals of shard roots are added up per heavy
parent, then the heavy nodes are done alike; if they are deeper than a band of levels, the bands are shards in turn, and
their roots form the next tree.

Edge cases: a null role or text is empty, a null turn comes first; turns of one number follow each other by digest, equal
rows are repeated turns; rows without a conversation id are left out; a family's first conversation may be missing; no
conversations give no nodes; other columns are not read. Prefixes are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import small
from .common import new_folder, prepare, query, stored, table

FAMILY = 5
HEADS = 9  # a family shares fewer turns than this
TURNS_IN_BLOCK = 1024
SHARD_ROWS = 1 << 16  # rows below a node from which on it is heavy; fewer for small tables, so that all tasks have work
LEAST_SHARD_ROWS = 64
BAND = 512  # levels of heavy nodes done at once
QUEUED = 1 << 17  # messages that a queue holds in memory
CHUNK_IDS = 1 << 14  # conversation ids that are written into one piece of text

_ROOT = hashlib.md5(b"0:0:0").digest()
_EMPTY = hashlib.sha256().hexdigest()
_MESSAGE = struct.Struct(">i16sqq")


class SpillingQueue:
    """Messages (level, node, leaves, saved) in order of level and node; what memory does not hold lies in sorted runs."""

    def __init__(self, folder: str, limit: int = QUEUED):
        self.folder, self.limit = folder, limit
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []  # (next message, place of its run)
        self.files: list = []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            self._spill()

    def _store(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        return store, root

    def _spill(self) -> None:
        store, root = self._store()
        name = f"{root}/{uuid.uuid4().hex}"
        with store.open_output_stream(name) as out:
            for i in range(0, len(self.heap), 4096):
                out.write(b"".join(_MESSAGE.pack(*m) for m in (heapq.heappop(self.heap) for _ in range(min(4096, len(self.heap))))))
                if not self.heap:
                    break
        self.files.append((store, name, store.open_input_stream(name, buffer_size=1 << 16)))
        self._advance(len(self.files) - 1)

    def _advance(self, run: int) -> None:
        raw = self.files[run][2].read(_MESSAGE.size)
        if raw:
            heapq.heappush(self.runs, (_MESSAGE.unpack(raw), run))

    def take(self, level: int, node: bytes) -> tuple[int, int]:
        """Sum of all messages to a node; they are gone then."""
        leaves = saved = 0
        while self.heap and self.heap[0][:2] == (level, node):
            _, _, a, b = heapq.heappop(self.heap)
            leaves, saved = leaves + a, saved + b
        while self.runs and self.runs[0][0][:2] == (level, node):
            (_, _, a, b), run = heapq.heappop(self.runs)
            leaves, saved = leaves + a, saved + b
            self._advance(run)
        return leaves, saved

    def close(self) -> None:
        """Ends the queue; every message must have met its node."""
        left = len(self.heap) + len(self.runs)
        for store, name, source in self.files:
            source.close()
            store.delete_file(name)
        self.files.clear()
        if left:
            raise ValueError(f"{left} messages to nodes outside their shard")


def forward(nodes: DataFrame, stride: int = 1, queued: int = QUEUED) -> DataFrame:
    """``node, shard, leaves, saved``: totals of the subtrees inside each shard. ``nodes`` are (node, parent, depth, shard, leaves, saved),
    with the shard's root for ``shard``; a parent lies ``stride`` levels above."""
    folder = new_folder(nodes.sparkSession, "queues")

    def run(batches):
        queue = SpillingQueue(folder, queued)
        for batch in batches:
            out = []
            for node, parent, depth, shard, leaves, saved in zip(*(batch.column(i).to_pylist() for i in range(6))):
                a, b = queue.take(-depth, node)
                leaves, saved = leaves + a, saved + b
                out.append((leaves, saved))
                if node != shard:
                    queue.push((stride - depth, parent, leaves, saved))
            yield pa.record_batch([batch.column(0), batch.column(3), *(pa.array(x, pa.int64()) for x in (zip(*out) if out else ((), ())))], names=["node", "shard", "leaves", "saved"])
        queue.close()

    ordered = nodes.select("node", "parent", "depth", "shard", "leaves", "saved").repartition("shard").sortWithinPartitions(F.col("depth").desc(), "node")
    return ordered.mapInArrow(run, "node binary, shard binary, leaves long, saved long")


def _turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, start, n, digest, bytes``: distinct turns in order, ``n`` repeats, ``start`` turns of any conversation before."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"),
                                                             F.octet_length(text).cast("long").alias("bytes"))
    counted = stored(rows.groupBy("conv_id", "turn", "digest", "bytes").agg(F.count(F.lit(1)).alias("n")), "distinct-turns")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]

    def place(batches):
        from pyspark import TaskContext

        import numpy as np

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            upto = before + np.cumsum(n)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(np.full(len(n), part, np.int32)), pa.array(upto - n)],
                                  names=["conv_id", "n", "digest", "bytes", "part", "inside"])
            before = int(upto[-1]) if len(n) else before

    ranged = counted.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "n", "digest", "bytes")
    placed = stored(ranged.mapInArrow(place, "conv_id long, n long, digest binary, bytes long, part int, inside long"), "placed-turns")
    sizes = placed.groupBy("part").agg(F.sum("n").alias("size"))  # one row per partition of the exchange
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("before"))
    return placed.join(F.broadcast(offsets), "part").select("conv_id", (F.col("before") + F.col("inside")).alias("start"), "n", "digest", "bytes")


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from its family's first one."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``conv_id, depth, digest, bytes, size`` of the rebuilt conversations (``size`` turns each), and ``conv_id, size`` of all."""
    turns = stored(_turns(conversations), "turns")
    sizes = turns.groupBy("conv_id").agg(F.min("start").alias("first"), F.sum("n").alias("turns"))
    convs = stored(sizes.withColumns({"h": shared_turns(F.col("conv_id")), "family": F.col("conv_id") - F.col("conv_id") % FAMILY}), "conversations")
    heads_of = convs.select(F.col("conv_id").alias("family"), F.col("turns").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    known = stored(convs.join(heads_of, "family", "left").withColumn("taken", taken)
                   .withColumn("size", F.col("taken") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).drop("there"), "families")
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(TURNS_IN_BLOCK * 64).cast("long")))  # never one long array
    upto, before = F.least(F.col("from") + TURNS_IN_BLOCK * 64, F.col("n")) - 1, F.col("start") - F.col("first") + 1
    ranked = (turns.join(known.select("conv_id", "first", "h", "taken", "size"), "conv_id").withColumn("from", steps)
              .withColumn("rank", F.explode(F.sequence(F.col("from") + before, upto + before))))
    own = ranked.where("rank > h").select("conv_id", (F.col("rank") - F.col("h") + F.col("taken")).alias("depth"), "digest", "bytes", "size")
    heads = ranked.where(F.col("rank") < HEADS).select(F.col("conv_id").alias("family"), F.col("rank").alias("depth"), "digest", "bytes")
    shared = known.where("taken > 0").select("conv_id", "family", "taken", "size").join(heads, "family").where("depth <= taken")
    return own.unionByName(shared.select(own.columns)), known.select("conv_id", "size")


def _prefix(depth: Column, one: Column, two: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), one.cast("string"), two.cast("string")).cast("binary")))


def prefixes(rows: DataFrame) -> DataFrame:
    """Adds ``node`` and ``parent``, the names of the prefix that ends with a row's turn and of the one before."""
    wide = "decimal(38,0)"
    hashed = rows.withColumns({"one": F.xxhash64("depth", "digest").cast(wide), "two": F.xxhash64("digest", "depth").cast(wide), "block": F.expr(f"(depth - 1) div {TURNS_IN_BLOCK}")})
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    upto = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    hashed = stored(hashed, "rebuilt")
    long = hashed.where("block > 0").select("conv_id").distinct()  # what short conversations need not do
    blocks = hashed.join(small(long), "conv_id", "left_semi").groupBy("conv_id", "block").agg(F.sum("one").cast(wide).alias("sum_one"), F.sum("two").cast(wide).alias("sum_two"))
    before = blocks.select("conv_id", "block", F.sum("sum_one").over(upto).cast(wide).alias("before_one"), F.sum("sum_two").over(upto).cast(wide).alias("before_two")).where("block > 0")
    zero = F.lit(0).cast(wide)
    summed = hashed.withColumns({f"upto_{x}": F.sum(x).over(inside).cast(wide) for x in ("one", "two")}).join(small(stored(before, "turn-blocks")), ["conv_id", "block"], "left")
    one, two = (F.col(f"upto_{x}") + F.coalesce(f"before_{x}", zero) for x in ("one", "two"))
    return summed.withColumns({"node": _prefix(F.col("depth"), one, two), "parent": _prefix(F.col("depth") - 1, one - F.col("one"), two - F.col("two"))})


def ends_of(rows: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of (node, conv_id): SHA-256 over the ids in order. Ids are put into pieces of text by range first."""
    def write(batches):
        node, ids, first = None, [], 0
        for batch in batches:
            out = []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != node or len(ids) == CHUNK_IDS:
                    if ids:
                        out.append((node, first, ",".join(ids)))
                    node, ids, first = key, [], conv
                ids.append(str(conv))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.string()))], names=["node", "first", "ids"])
        if ids:
            yield pa.record_batch([pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], names=["node", "first", "ids"])

    def digest(batches):
        node = check = None
        for batch in batches:
            out = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key == node:
                    check.update(b",")
                else:
                    if node is not None:
                        out.append((node, check.hexdigest()))
                    node, check = key, hashlib.sha256()
                check.update(ids.encode())
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.string()))], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.record_batch([pa.array([node], pa.binary()), pa.array([check.hexdigest()])], names=["node", "ends_sha256"])

    pieces = stored(rows.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(write, "node binary, first long, ids string"), "ends")
    ordered = pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
    return stored(ordered.mapInArrow(digest, "node binary, ends_sha256 string"), "ends-digests")


def _summed(heavy: DataFrame, paths: DataFrame, band: int, stride: int, queued: int) -> DataFrame:
    """``node, leaves, saved`` of the heavy nodes (conv_id, node, parent, depth, leaves, saved); ``paths`` are (conv_id, depth, node)."""
    levels, root = band * stride, F.lit(_ROOT)
    if (heavy.agg(F.max("depth")).first()[0] or 0) < levels:
        return stored(forward(heavy.withColumn("shard", root), stride, queued).select("node", "leaves", "saved"), "heavy-totals")
    above = paths.select("conv_id", F.col("depth").alias("top"), F.col("node").alias("found"))

    def at(rows: DataFrame, depth: Column, name: str) -> DataFrame:
        """Adds the node of the row's conversation at a depth."""
        return rows.withColumn("top", depth - depth % levels).join(above, ["conv_id", "top"], "left").withColumn(name, F.coalesce("found", root)).drop("top", "found")

    banded = stored(at(heavy.select("conv_id", "node", "parent", "depth", "leaves", "saved"), F.col("depth"), "shard"), "bands-of-levels")
    tops = banded.where("node = shard").drop("leaves", "saved", "shard").join(forward(banded, stride, queued).where("node = shard").drop("shard"), "node")
    tops = stored(at(tops.withColumnRenamed("parent", "hangs_on"), F.greatest(F.col("depth") - 1, F.lit(0)), "parent"), "band-roots")
    whole = _summed(tops, paths, band, levels, queued)
    sent = (whole.join(tops.where("depth > 0").select("node", "hangs_on"), "node").groupBy(F.col("hangs_on").alias("node"))
            .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
    filled = banded.join(sent, "node", "left").withColumns({x: F.col(x) + F.coalesce(f"more_{x}", F.lit(0)) for x in ("leaves", "saved")})
    return stored(forward(filled, stride, queued).select("node", "leaves", "saved"), "heavy-totals")


def subtree_totals(nodes: DataFrame, paths: DataFrame, shard_rows: int, band: int = BAND, queued: int = QUEUED) -> DataFrame:
    """``node, leaves, saved`` over whole subtrees. ``nodes`` are (conv_id, node, parent, depth, below, leaves, saved); ``paths`` (conv_id, depth, node)
    are the nodes of every conversation; a node with more than ``shard_rows`` rows below is heavy, the root always."""
    heavy = stored(nodes.where((F.col("below") > shard_rows) | (F.col("depth") == 0)), "heavy-nodes")
    deepest = paths.join(small(heavy.select("node")), "node", "left_semi").groupBy("conv_id").agg(F.max("depth").alias("deepest"))
    roots = paths.join(deepest, "conv_id", "left").where(F.col("depth") == F.coalesce("deepest", F.lit(0)) + 1).select("conv_id", F.col("node").alias("shard"))
    light = stored(nodes.where((F.col("below") <= shard_rows) & (F.col("depth") > 0)).join(roots, "conv_id"), "light-nodes")
    done = stored(forward(light, 1, queued), "light-totals")
    sent = (done.where("node = shard").drop("shard").join(light.where("node = shard").select("node", "parent"), "node").groupBy(F.col("parent").alias("node"))
            .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
    filled = heavy.join(sent, "node", "left").withColumns({x: F.col(x) + F.coalesce(f"more_{x}", F.lit(0)) for x in ("leaves", "saved")})
    filled = stored(filled.select("conv_id", "node", "parent", "depth", "leaves", "saved"), "heavy-filled")
    return done.select("node", "leaves", "saved").unionByName(_summed(filled, paths, band, 1, queued))


def prefix_trie(conversations: DataFrame, shard_rows: int | None = None, band: int = BAND, queued: int = QUEUED) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` and ``node``, its name."""
    spark = conversations.sparkSession
    prepare(spark)
    rows, convs = rebuilt(conversations)
    rows = stored(prefixes(rows).select("conv_id", "depth", "node", "parent", "bytes", "size"), "trie-rows")
    root = (convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("size").alias("below")).where("n_convs > 0")
            .select(F.lit(_ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", "below", F.lit(0).cast("long").alias("bytes")))
    grouped = rows.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                       F.sum(F.col("size") - F.col("depth") + 1).alias("below"), F.max("bytes").alias("bytes"))
    nodes = stored(grouped.unionByName(root.select(grouped.columns)), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    full = stored(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                  .withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")}), "trie-counted")
    if shard_rows is None:
        total = full.where("depth = 0").agg(F.max("below")).first()[0] or 0
        shard_rows = max(LEAST_SHARD_ROWS, min(SHARD_ROWS, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    totals = stored(subtree_totals(full.drop("n_children", "n_convs", "bytes"), rows.select("conv_id", "depth", "node"), shard_rows, band, queued), "trie-totals")
    ends = ends_of(rows.where("depth = size").select("node", "conv_id").unionByName(convs.where("size = 0").select(F.lit(_ROOT).alias("node"), "conv_id")))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (full.drop("leaves", "saved").join(totals, "node").join(ends, "node", "left").join(parents, "parent", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"), "node"))


@query("op11_prefix_trie", """
WITH turns AS MATERIALIZED (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (
  SELECT c, c - c % 5 AS family, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''),
      lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384::BIGINT) ELSE crc >> 1 END), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT c FROM turns)),
pieces AS (
  SELECT v.c, 0 AS part, r, role, text FROM convs v JOIN turns t ON t.c = v.family AND t.r <= v.h
  UNION ALL SELECT v.c, 1, r, role, text FROM convs v JOIN turns t ON t.c = v.c AND t.r > v.h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, r) AS d, sha256(strlen(role)::VARCHAR || ':' || role || text) AS digest, strlen(text) AS bytes FROM pieces),
members AS MATERIALIZED (
  SELECT c, d, string_agg(digest, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path, bytes FROM placed
  UNION ALL SELECT c, 0, '', 0 FROM convs),
nodes AS MATERIALIZED (SELECT path, max(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM members GROUP BY path),
lasts AS (SELECT c, max(d) AS d FROM members GROUP BY c),
ends AS (SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256 FROM members JOIN lasts USING (c, d) GROUP BY path),
children AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS MATERIALIZED (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k USING (path)),
subtrees AS (
  SELECT left(path, 64 * up) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM counted) GROUP BY 1)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM counted k JOIN subtrees s USING (path) LEFT JOIN ends e USING (path)
LEFT JOIN nodes p ON k.depth > 0 AND p.path = left(k.path, greatest(length(k.path) - 64, 0))""")
def op11_prefix_trie(spark, folder):
    """Nodes of all rebuilt conversations."""
    return prefix_trie(table(spark, folder, "conversations")).drop("node")
