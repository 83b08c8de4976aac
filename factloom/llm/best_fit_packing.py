"""Best-fit packing of token pieces into sequences, after Martello and Toth's dominance reduction.

Pieces of one length are alike, so an instance is its histogram: at most ``capacity`` counts, whatever the corpus.
The reduction and the best-fit steps work on whole runs of alike pieces and end in a few thousand segments ("pieces
number r.. of length L go, t to a sequence, to sequences s.."), again bounded by the capacity and not by the rows.
Spark makes the pieces, counts them, numbers them within their length, and looks up the segment of each.

Dominance (Martello and Toth 1990): for a piece j let k be how many of the smallest others fit beside it. Nothing
fits: j stays alone. One fits, or j and the largest fitting j* fill the sequence: j and j* stay together. Two fit:
j and j* if j* is no smaller than the best pair, or j and the best pair under their neighbour conditions. Some best
packing has these sets, so fixing them loses nothing. What is left is packed by best fit, longest first.

Numbers within a length are counted in salted parts, so a length that most pieces share is no single task.

Edge cases: null and empty texts are one piece with the end id alone; a null id is kept; repeated rows are packed
as often as they occur; no rows give no rows; a text that encodes to more than ``capacity`` ids is cut into full
pieces and a rest, nothing else is cut.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import keyed_texts, query, stored, table
from .kernels import block_of, pieces as slices
from .word_tokens import WordTokens

CAPACITY = 2048
# Rows of one length that are numbered by one task.
NUMBERED_ROWS = 20_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of every text: ``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids`` (little-endian 32 bit)."""
    path = path or tokenizer_path()

    def cut(batches):
        tokens = WordTokens(path)
        for batch in batches:
            for part in slices(batch):
                ids, counts = tokens.encode(block_of(part.column(1)))
                total = counts + 1
                flat = np.full(int(total.sum()), end_id, "<u4")
                to = np.cumsum(total) - total
                flat[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                n = -(-total // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, total[row] - start)
                raw, at = memoryview(flat).cast("B"), ((to[row] + start) * 4).tolist()
                parts = [raw[s:s + 4 * c] for s, c in zip(at, length.tolist())]
                columns = [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                           pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.tobytes() for x in parts], pa.binary()))
                yield pa.record_batch(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])

    return keyed_texts(docs).mapInArrow(cut, _PIECES + (", ids binary" if with_ids else ""))


class _Plan:
    """Segments of a packing: for each, length, first number, pieces, first sequence, pieces a sequence, offset."""

    def __init__(self):
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.numbered: dict[int, int] = {}
        self.sequences = 0

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def place(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        first = self.numbered.get(length, 0)
        self.rows.append((length, first, n, sequence, each, offset))
        self.numbered[length] = first + n


def _largest(counts: np.ndarray) -> np.ndarray:
    """For every size the largest available length that is no longer, 0 if none."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def dominating_set(counts: np.ndarray, length: int) -> tuple[int, ...] | None:
    """Companions of one piece of ``length`` that some best packing puts beside it; None if dominance does not say."""
    capacity = len(counts) - 1
    rest = counts.copy()
    rest[length] -= 1
    room = capacity - length
    small, k, taken = np.flatnonzero(rest), 0, 0
    for x in small:
        fit = min(int(rest[x]), (room - taken) // int(x), 3 - k)
        k, taken = k + fit, taken + fit * int(x)
        if k >= 3 or fit < rest[x]:
            break
    if k == 0:
        return ()
    below = _largest(rest)
    best = int(below[room])
    if k == 1 or length + best == capacity:
        return (best,)
    if k > 2:
        return None
    larger = small[small <= room]
    other = below[room - larger]
    alike = (other == larger) & (rest[larger] < 2)
    other = np.where(alike, below[np.maximum(larger - 1, 0)], other)
    sums = np.where(other > 0, larger + other, 0)
    at = int(np.argmax(sums))
    a, b = sorted((int(larger[at]), int(other[at])), reverse=True)
    if not b or best >= a + b:
        return (best,)
    if best == a:
        between = int(rest[b + 1:a].sum())
        above = small[small > b]
        if a == b or between <= 1:
            return (a, b)
        two = []
        for x in above[:2]:
            two += [int(x)] * min(2, int(rest[x]))
        if len(two) < 2 or length + two[0] + two[1] > capacity:
            return (a, b)
    return None


def pack_histogram(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int, int]:
    """Segments, number of sequences, and how many of them the reduction fixed."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = _Plan()
    changed = True
    while changed:  # a set that is fixed can make others dominate
        changed = False
        for length in range(capacity, 0, -1):
            while counts[length]:
                beside = dominating_set(counts, length)
                if beside is None:
                    break
                members = [length, *beside]
                times = min(int(counts[x]) // members.count(x) for x in set(members))
                first, offset = plan.open(times), 0
                for x in members:
                    plan.place(x, times, first, 1, offset)
                    counts[x] -= times
                    offset += x
                changed = True
    fixed = plan.sequences
    bins: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, how many)
    rooms = np.zeros(capacity + 1, np.int64)
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            fitting = np.flatnonzero(rooms[length:])
            if len(fitting):
                room = length + int(fitting[0])
                first, many = bins[room].pop()
                rooms[room] -= 1
            else:
                room = capacity
                many = -(-left // (room // length))
                first = plan.open(many)
            each = room // length
            full = min(many, left // each)
            if full:
                plan.place(length, full * each, first, each, capacity - room)
                left -= full * each
                if room - each * length:
                    bins.setdefault(room - each * length, []).append((first, full))
                    rooms[room - each * length] += 1
            if full < many and left:
                plan.place(length, left, first + full, left, capacity - room)
                bins.setdefault(room - left * length, []).append((first + full, 1))
                rooms[room - left * length] += 1
                full, left = full + 1, 0
            if full < many:
                bins.setdefault(room, []).append((first + full, many - full))
                rooms[room] += 1
    return plan.rows, plan.sequences, fixed


def numbered_by_length(rows: DataFrame, total: int) -> DataFrame:
    """Adds ``number``: 0, 1, ... within each length, in salted parts."""
    parts = max(1, -(-total // NUMBERED_ROWS))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    return (salted.withColumn("inside", inside).join(before, ["length", "salt"])
            .select(*rows.columns, (F.col("before") + F.col("inside") - 1).alias("number")))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces (``doc_id, piece, length, ids_crc32``, further columns stay)."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    segments, _, _ = pack_histogram(histogram, capacity)
    order = np.array(sorted(segments), np.int64).reshape(-1, 6)
    keys = order[:, 0] << 44 | order[:, 1]

    def look_up(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, number = at["length"].to_numpy(), at["number"].to_numpy()
            seg = order[np.searchsorted(keys, length << 44 | number, side="right") - 1]
            inside = number - seg[:, 1]
            sequence, offset = seg[:, 3] + inside // seg[:, 4], seg[:, 5] + inside % seg[:, 4] * length
            kept = [n for n in batch.schema.names if n != "number"]
            yield pa.record_batch([*(at[n] for n in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    numbered = numbered_by_length(pieces, sum(histogram.values()))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    return numbered.mapInArrow(look_up, ", ".join([*kinds, "sequence_id long", "offset long"]))


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all texts with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack(stored(token_pieces(docs, path, capacity), "pieces"), capacity)


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark, folder):
    """All documents in sequences of at most 2048 tokens."""
    return packed_documents(table(spark, folder, "documents"))
