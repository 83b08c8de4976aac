"""Near duplicates by Jaccard similarity of word n-grams: rare-first prefix join, then connected components.

1. Every shingle's document count is taken over all texts, as packed 32-bit remainders per hash part, not as a row per
   shingle. Shingles in at least ``LEAST_FREQUENT`` documents are the frequent ones; only where these are more than
   ``FREQUENT``, which bounds what is broadcast, the least count is doubled until they are not.
2. A document orders its shingles by (document count, hash), frequent ones last, and keeps the prefix in which two
   similar documents must meet. Prefix entries are packed per hash part; parts drop shingles that one document has.
3. Lists of documents that share a prefix shingle are first joined as stars around their smallest id. Length,
   positional and suffix filter (counts of shingles per hash range bound the difference) prune, the rest is verified
   on the texts, once per pair.
4. Only lists that still touch several components are looked at pair by pair, across components: pairs inside one
   component are known to be connected, so a group of thousands of copies never makes all its pairs.

Links (``document_links``, ``class_links``) are counted inside components, where all of them lie. Texts of equal shingle
sets are one class. The classes of a component are dealt into bands by set size (similar ones lie in the same or
neighbouring bands) and blocks of bounded size; every pair of blocks is a cell in which all pairs are compared exactly.
A class is sent to as many cells as its bands have blocks, and cells send counts per class, not pairs.

A list under a frequent shingle may be as long as the corpus; its entries skip the packed parts and are grouped and
joined by Spark with partial aggregation and skew splitting (aggregates are stored before a join, so that both sides are
shuffles that can be split). Set sizes and intersections come from 64-bit hashes: a
verified pair counts a false common shingle with a chance of |A||B| / 2**64.

Edge cases: null and empty texts have no shingles and are linked with nothing; a text of fewer than ``n`` words is one
shingle; rows that share an id are one vertex, each of them gives a row; rows without an id are linked with nothing
and have no component; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, small
from .common import ORACLES, keyed_texts, query, stored, table
from .components import components
from .kernels import SpanHash, block_of, find_words, pieces, ranges, rows_of, signed, window_hashes

WORDS = 5
SIMILAR = (3, 4)  # intersection / union as a fraction
FREQUENT = 1 << 22  # frequent shingles at most: 12 bytes each are broadcast
LEAST_FREQUENT = 8
PART_ENTRIES = 1 << 20  # entries that one task of a hash part gets, about
FLUSH_ENTRIES = 1 << 21  # entries that a task holds before it sends them
RANGES = 64  # hash ranges of the suffix filter
BAND = 1.34  # ratio of set sizes in a band: more than 4 / 3, so that similar sets are at most one band apart
BLOCK_CLASSES, BLOCK_SHINGLES = 1 << 10, 1 << 18  # of a block of classes, about
SPREAD, SPREAD_CLASSES = 16, 64  # blocks that a band is dealt into at least, as far as each has so many classes
COLUMNS = 1 << 12  # shingles that a cell compares at once
LISTED_IDS = 1_000_000  # candidate ids (8 bytes each) that may be broadcast to thin out the texts


def shingle_sets(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text end to end, and the size of each set."""
    block = block_of(texts)
    words = find_words(block)
    hashes = SpanHash(block.data, fold=True).of(words.starts, words.ends)
    counts = np.diff(words.first)
    starts, each = rows_of(words.first, n)
    row = np.repeat(np.arange(len(counts)), each)
    found = window_hashes(hashes, n)[starts]
    for k in range(1, n):  # short texts: the whole sequence
        short = np.flatnonzero(counts == k)
        if len(short):
            found = np.concatenate([found, window_hashes(hashes, k)[words.first[short]]])
            row = np.concatenate([row, short])
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return found[new], np.bincount(row[new], minlength=len(counts))


def _keys(hashes: np.ndarray, parts: int) -> np.ndarray:
    """(hash part, 32-bit remainder) as one number."""
    return ((hashes >> np.uint64(32)) % np.uint64(parts)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))


def _packed_gaps(sorted_values: np.ndarray) -> bytes:
    gaps = np.diff(sorted_values, prepend=np.uint64(0))
    if len(gaps) and int(gaps.max()) < 1 << 24:
        return b"3" + gaps.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return b"4" + sorted_values.astype("<u4").tobytes()


def _unpacked_gaps(blob) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    if raw[0] == ord("4"):
        return raw[1:].view("<u4").astype(np.uint64)
    wide = np.zeros((len(raw) // 3, 4), np.uint8)
    wide[:, :3] = raw[1:].reshape(-1, 3)
    return np.cumsum(wide.reshape(-1).view("<u4").astype(np.uint64), dtype=np.uint64)


def frequent_shingles(docs: DataFrame, text_bytes: int, n: int, bound: int = FREQUENT, least: int = LEAST_FREQUENT) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and document counts of the frequent shingles, at most ``bound`` of them, and the number of hash parts."""
    parts = max(1, math.ceil(text_bytes / 6 / (4 * PART_ENTRIES)))

    def send(held):
        keys = np.sort(_keys(np.concatenate(held), parts))
        cuts = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
        used = np.flatnonzero(np.diff(cuts))
        for some in np.array_split(used, max(1, len(used) // 64)):
            blobs = [_packed_gaps(keys[cuts[p]:cuts[p + 1]] & np.uint64(0xFFFFFFFF)) for p in some]
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def gather(batches):
        held, many = [], 0
        for batch in batches:
            for piece in pieces(batch):
                found, _ = shingle_sets(piece.column(1), n)
                held.append(found)
                many += len(found)
                if many > FLUSH_ENTRIES:
                    yield from send(held)
                    held, many = [], 0
        if many:
            yield from send(held)

    def count(batches):
        held = [(np.uint64(p) << np.uint64(32)) | _unpacked_gaps(blob) for batch in batches
                for p, blob in zip(batch.column(0).to_pylist(), (x.as_buffer() for x in batch.column(1)))]
        if held:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= least
            yield pa.record_batch([pa.array(signed(keys[often])), pa.array(counts[often])], names=["key", "n"])

    counted = stored(docs.mapInArrow(gather, "part int, blob binary").repartition(parts, "part").mapInArrow(count, "key long, n long"), "frequent")
    while counted.where(F.col("n") >= least).count() > bound:
        least *= 2
    counted = counted.where(F.col("n") >= least).toArrow()
    keys = counted["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.minimum(counted["n"].to_numpy()[order], (1 << 31) - 1).astype(np.int32), parts


_ENTRIES = "kind int, key long, doc_id long, size int, pos int, center long, near boolean, ranges binary"


def _prefix_entries(docs: DataFrame, frequent, key_parts: int, text_bytes: int, n: int) -> DataFrame:
    """Rows of kind 0: (doc_id, size, ranges) of every row; 1: entries of shared rare prefix shingles with their star; 2: of frequent ones."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT keys
    parts = max(1, math.ceil(text_bytes / 24 / PART_ENTRIES))
    up, down = SIMILAR

    def send(held):
        kind, key, doc, size, pos = (np.concatenate(x) for x in zip(*held))
        part = np.where(kind == 1, (key >> np.uint64(7)) % np.uint64(parts), doc.view(np.uint64) % np.uint64(parts)).astype(np.int64) * 2 + (kind == 2)
        order = np.argsort(part, kind="stable")
        key, doc, size, pos, part = key[order], doc[order], size[order], pos[order], part[order]
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            by = np.lexsort((size[a:b], doc[a:b]))  # texts that share an id keep their own sizes
            documents, sizes = doc[a:b][by], size[a:b][by].astype(np.int32)
            new = np.ones(b - a, bool)
            new[1:] = (documents[1:] != documents[:-1]) | (sizes[1:] != sizes[:-1])
            which = np.empty(b - a, np.int64)
            which[by] = np.cumsum(new) - 1
            documents, sizes = documents[new], sizes[new]
            wide = len(documents) >= 1 << 16
            blob = b"".join([key[a:b].tobytes(), np.minimum(pos[a:b], 65535).astype("<u2").tobytes(), which.astype("<u4" if wide else "<u2").tobytes(),
                             documents.tobytes(), sizes.tobytes()])
            yield pa.record_batch([pa.array([int(part[a]) // 2], pa.int32()), pa.array([1 + int(part[a]) % 2], pa.int32()), pa.array([b - a], pa.int32()),
                                   pa.array([len(documents)], pa.int32()), pa.array([blob], pa.binary())], names=["part", "kind", "n", "documents", "blob"])

    def gather(batches):
        keys, often = shared.value
        held, many = [], 0
        for batch in batches:
            for piece in pieces(batch):
                found, sizes = shingle_sets(piece.column(1), n)
                ids = piece.column(0).to_numpy()
                row = np.repeat(np.arange(len(sizes)), sizes)
                counts = np.bincount(row * RANGES + (found >> np.uint64(58)).astype(np.int64), minlength=len(sizes) * RANGES)
                ranges_ = np.minimum(counts, 255).astype(np.uint8).tobytes()
                blob = b"".join([ids.astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), ranges_])
                yield pa.record_batch([pa.array([int(ids[0]) % parts], pa.int32()), pa.array([0], pa.int32()), pa.array([len(ids)], pa.int32()),
                                       pa.array([len(ids)], pa.int32()), pa.array([blob], pa.binary())], names=["part", "kind", "n", "documents", "blob"])
                key = _keys(found, key_parts)
                rank = np.zeros(len(found), np.int32)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    rank = np.where(keys[at] == key, often[at], 0)
                if rank.any():
                    order = np.lexsort((rank, row))  # stable: by hash within a count
                    found, key, rank = found[order], key[order], rank[order]
                length = np.where(sizes > 0, sizes - (up * sizes + down - 1) // down + 1, 0)
                first = np.cumsum(sizes) - sizes
                at = ranges(first, length)
                who = np.repeat(np.arange(len(sizes)), length)
                held.append((np.where(rank[at] > 0, 2, 1), np.where(rank[at] > 0, key[at], found[at]), ids[who], sizes[who].astype(np.int32), at - first[who]))
                many += len(at)
                if many > FLUSH_ENTRIES:
                    yield from send(held)
                    held, many = [], 0
        if many:
            yield from send(held)

    def rows(kind, key=None, doc=None, size=None, pos=None, center=None, near=None, ranges_=None):
        none = lambda t: pa.nulls(len(doc), t)
        return pa.record_batch([pa.array(np.full(len(doc), kind, np.int32)), none(pa.int64()) if key is None else pa.array(signed(key)), pa.array(doc),
                                pa.array(size), none(pa.int32()) if pos is None else pa.array(pos.astype(np.int32)),
                                none(pa.int64()) if center is None else pa.array(center), none(pa.bool_()) if near is None else pa.array(near),
                                none(pa.binary()) if ranges_ is None else pa.array(ranges_, pa.binary())],
                               names=["kind", "key", "doc_id", "size", "pos", "center", "near", "ranges"])

    def lists(batches):
        held = []
        for batch in batches:
            for kind, many, documents, blob in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), (x.as_buffer() for x in batch.column(4))):
                raw = np.frombuffer(blob, np.uint8)
                if kind == 0:
                    doc, size = raw[:8 * many].view("<i8"), raw[8 * many:12 * many].view("<i4")
                    marks = raw[12 * many:].tobytes()
                    yield rows(0, doc=doc, size=size, ranges_=[marks[i * RANGES:(i + 1) * RANGES] for i in range(many)])
                    continue
                wide = 4 if documents >= 1 << 16 else 2
                cut = np.cumsum([0, 8 * many, 2 * many, wide * many, 8 * documents, 4 * documents])
                key, pos, which, doc, size = (raw[a:b] for a, b in zip(cut[:-1], cut[1:]))
                which = which.copy().view(f"<u{wide}")
                entry = (key.copy().view(np.uint64), doc.copy().view(np.int64)[which], size.copy().view(np.int32)[which], pos.copy().view("<u2").astype(np.int64))
                if kind == 2:
                    yield rows(2, *entry)
                else:
                    held.append(entry)
        if not held:
            return
        key, doc, size, pos = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((doc, key))
        key, doc, size, pos = key[order], doc[order], size[order], pos[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(key)))
        lead = np.repeat(start, length)
        several = np.repeat(doc[start + length - 1] != doc[start], length)
        key, size_, pos_, lead = key[several], size[several], pos[several], lead[several]
        s, q = size[lead].astype(np.int64), pos[lead]
        own = size_.astype(np.int64)
        near = (np.minimum(s, own) * down >= np.maximum(s, own) * up) & (np.minimum(s - q, own - pos_) * (up + down) >= up * (s + own)) & (doc[several] != doc[lead])
        for a in range(0, len(key), 1 << 16):
            b = a + (1 << 16)
            yield rows(1, key[a:b], doc[several][a:b], size_[a:b], pos_[a:b], doc[lead][a:b], near[a:b])

    packed = docs.mapInArrow(gather, "part int, kind int, n int, documents int, blob binary").repartition(parts, "part")
    return stored(packed.mapInArrow(lists, _ENTRIES), "prefix-lists", "kind")


def _may_be_similar(a: str, b: str):
    """Length and positional filter of two entries (column prefixes), for their first common shingle."""
    up, down = SIMILAR
    return (F.expr(f"least({a}.size, {b}.size) * {down}L >= greatest({a}.size, {b}.size) * {up}L")
            & F.expr(f"least({a}.size - {a}.pos, {b}.size - {b}.pos) * {up + down}L >= {up}L * ({a}.size + {b}.size)"))


def _after_suffix_filter(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose shingles per hash range may still overlap enough: the ranges' count differences bound the set difference."""
    up, down = SIMILAR
    left = sets.select(F.col("doc_id").alias("a"), F.col("size").alias("size_a"), F.col("ranges").alias("ranges_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("size").alias("size_b"), F.col("ranges").alias("ranges_b"))

    def keep(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            x, y = (np.frombuffer(b"".join(at[c].to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int32) for c in ("ranges_a", "ranges_b"))
            size = at["size_a"].to_numpy().astype(np.int64) + at["size_b"].to_numpy()
            differ = np.abs(x - y).sum(axis=1)
            good = (size - differ) * (up + down) >= 2 * up * size  # 2 |A n B| <= size - differ
            yield pa.record_batch([at[c] for c in ("a", "b")], names=["a", "b"]).filter(pa.array(good))

    return pairs.join(left, "a").join(right, "b").mapInArrow(keep, "a long, b long").distinct()


def similar_pairs(pairs: DataFrame, docs: DataFrame, n: int = WORDS) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose texts are similar; each pair is verified once."""
    up, down = SIMILAR

    def verify(batches):
        known = known_text = None
        for batch in batches:
            at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            a, b, good = at["a"].to_pylist(), at["b"].to_pylist(), []
            start = 0
            for part in pieces(batch, "text_a"):
                found, sizes = shingle_sets(part.column(batch.schema.get_field_index("text_a")), n)
                ends = np.cumsum(sizes)
                for i in range(part.num_rows):
                    x = found[ends[i] - sizes[i]:ends[i]]
                    text = at["text_b"][start + i].as_py()
                    if text != known_text:
                        known_text = text
                        known, _ = shingle_sets(pa.array([known_text]), n)
                    common = len(np.intersect1d(x, known, assume_unique=True))
                    good.append(common * down >= up * (len(x) + len(known) - common) and common > 0)
                start += part.num_rows
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    wanted = cut_lineage(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    texts = docs.select("doc_id", "text").join(small(wanted, LISTED_IDS), "doc_id", "left_semi")
    first = texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}).join(pairs.hint("shuffle_hash"), "a").select("b", "a", "text_a")
    both = first.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    return both.mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = WORDS, frequent_bound: int = FREQUENT, least_frequent: int = LEAST_FREQUENT) -> DataFrame:
    """One row per row: ``doc_id, n_shingles, component_id`` (smallest id that links reach)."""
    texts = keyed_texts(docs)
    known = texts.where("doc_id IS NOT NULL")
    text_bytes = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys, counts, key_parts = frequent_shingles(known, text_bytes, n, frequent_bound, least_frequent)
    entries = _prefix_entries(known, (keys, counts), key_parts, text_bytes, n)
    sets = entries.where("kind = 0").select("doc_id", "size", "ranges")
    shared = entries.where("kind > 0").select("key", "kind", "doc_id", "size", "pos", "center", "near")

    # stars around the smallest id of every list
    often = shared.where("kind = 2").select("key", "doc_id", "size", "pos")
    leads = stored(often.groupBy("key").agg(F.min(F.struct("doc_id", "size", "pos")).alias("lead")).select("key", "lead.*"), "leads")
    stars = often.alias("x").join(leads.alias("y"), "key").where("x.doc_id <> y.doc_id").where(_may_be_similar("x", "y"))
    pairs = (shared.where("kind = 1 AND near").select(F.col("doc_id").alias("a"), F.col("center").alias("b"))
             .union(stars.select("x.doc_id", "y.doc_id")).distinct())
    tried = stored(_after_suffix_filter(pairs, sets), "star-pairs")
    links = stored(similar_pairs(tried, known, n), "star-links")
    parts = stored(components(links), "star-parts")

    # lists that touch several components: pairs across them
    placed = shared.join(parts.withColumnRenamed("vertex", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_keys = stored(placed.groupBy("kind", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
                       .select("kind", "key"), "open-keys")
    still = stored(placed.join(open_keys, ["kind", "key"]).select("kind", "key", "doc_id", "size", "pos", "component"), "open-lists")
    across = (still.alias("x").join(still.alias("y"), ["kind", "key"]).where("x.component < y.component").where(_may_be_similar("x", "y"))
              .select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct())
    ordered = across.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    further = stored(similar_pairs(stored(_after_suffix_filter(ordered, sets), "open-pairs"), known, n), "open-links")
    final = stored(components(links.union(further)), "parts")
    found = (sets.join(final.withColumnRenamed("vertex", "doc_id"), "doc_id", "left")
             .select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))

    def sizes(batches):
        for batch in batches:
            for piece in pieces(batch):
                yield pa.record_batch([piece.column(0), pa.array(shingle_sets(piece.column(1), n)[1]), pa.nulls(piece.num_rows, pa.int64())],
                                      names=["doc_id", "n_shingles", "component_id"])

    return found.unionByName(texts.where("doc_id IS NULL").mapInArrow(sizes, "doc_id long, n_shingles long, component_id long"))


def _class_of(found: np.ndarray) -> int:
    """A 64-bit id of a shingle set."""
    return int.from_bytes(hashlib.sha256(found.tobytes()).digest()[:8], "little", signed=True)


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``x`` with all of ``y``."""
    out = np.zeros((len(x), len(y)), np.int64)
    a, b = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(a, b)
    if not len(shared):
        return out
    sides = []
    for values, sets in ((a, x), (b, y)):
        row = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        held = shared[at] == values
        order = np.argsort(at[held], kind="stable")
        sides.append((at[held][order], row[held][order], len(sets)))
    for low in range(0, len(shared), COLUMNS):
        marks = []
        for at, row, n in sides:
            i, j = np.searchsorted(at, [low, low + COLUMNS])
            mark = np.zeros((n, min(COLUMNS, len(shared) - low)), np.float32)
            mark[row[i:j], at[i:j] - low] = 1
            marks.append(mark)
        out += np.rint(marks[0] @ marks[1].T).astype(np.int64)
    return out


def _classes(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Every row (``doc_id, n_shingles, class, component``), and the classes (``class, class_id, component, size, weight``)."""
    def mark(batches):
        for batch in batches:
            for piece in pieces(batch):
                found, sizes = shingle_sets(piece.column(1), n)
                ends = np.cumsum(sizes)
                ids = [_class_of(found[e - k:e]) if k else None for e, k in zip(ends.tolist(), sizes.tolist())]
                yield pa.record_batch([piece.column(0), pa.array(sizes.astype(np.int64)), pa.array(ids, pa.int64())], names=["doc_id", "n_shingles", "class"])

    texts = keyed_texts(docs)
    marked = stored(texts.mapInArrow(mark, "doc_id long, n_shingles long, class long"), "marked")
    parts = stored(near_duplicates(docs, n).where("doc_id IS NOT NULL").select("doc_id", F.col("component_id").alias("component")).distinct(), "vertex-parts")
    rows = stored(marked.join(parts, "doc_id", "left"), "marked-parts")
    members = rows.where("doc_id IS NOT NULL AND class IS NOT NULL").distinct()
    classes = members.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.min("component").alias("component"), F.min("n_shingles").alias("size"),
                                           F.count(F.lit(1)).alias("weight"))
    return rows, stored(classes, "classes")


def _compared(docs: DataFrame, classes: DataFrame, n: int, listed: bool) -> DataFrame:
    """Links between classes: pairs ``a, b`` (class ids), or per class and cell the ``n`` documents linked to it."""
    up, down = SIMILAR
    banded = classes.withColumn("band", F.floor(F.log("size") / math.log(BAND)).cast("int"))
    counted = stored(banded.groupBy("component", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")), "bands")
    many = F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("s") / BLOCK_SHINGLES), F.least(F.lit(SPREAD), F.ceil(F.col("n") / SPREAD_CLASSES))).cast("int")
    blocks = counted.select("component", "band", "n", many.alias("many"))
    for name, step in (("above", -1), ("below", 1)):
        blocks = blocks.join(counted.select("component", (F.col("band") + step).alias("band"), many.alias(name)), ["component", "band"], "left")
    blocks = stored(blocks.where("n > 1 OR above IS NOT NULL OR below IS NOT NULL"), "blocks")
    placed = stored(banded.join(small(blocks), ["component", "band"]).withColumn("block", F.expr("int(pmod(xxhash64(class), many))")), "placed")

    def sets(batches):
        for batch in batches:
            for piece in pieces(batch):
                found, sizes = shingle_sets(piece.column(1), n)
                ends = np.cumsum(sizes)
                own = [found[e - k:e] for e, k in zip(ends.tolist(), sizes.tolist())]
                yield pa.record_batch([pa.array([_class_of(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["class", "found"])

    wanted = small(placed.select(F.col("class_id").alias("doc_id")).distinct(), LISTED_IDS)
    found = keyed_texts(docs).join(wanted, "doc_id", "left_semi").mapInArrow(sets, "class long, found binary").dropDuplicates(["class"])
    cells = F.expr("""concat(
      transform(sequence(0, many - 1), j -> struct(band AS low, band AS high, least(block, j) AS i, greatest(block, j) AS j)),
      if(above IS NULL, array(), transform(sequence(0, above - 1), j -> struct(band AS low, band + 1 AS high, block AS i, j AS j))),
      if(below IS NULL, array(), transform(sequence(0, below - 1), j -> struct(band - 1 AS low, band AS high, j AS i, block AS j))))""")
    dealt = placed.join(found, "class").withColumn("cell", F.explode(cells)).select(
        "component", "cell.low", "cell.high", "cell.i", "cell.j", "band", "block", "class", "class_id", "weight", "found")

    def compare(key, group):
        _, low, high, i, j = (k.as_py() for k in key)
        band, block, ids, weight = (group[c].to_numpy() for c in ("band", "block", "class_id", "weight"))
        own = [np.frombuffer(b, np.uint64) for b in group["found"].to_pylist()]
        size = np.array([len(x) for x in own])
        x, y = np.flatnonzero((band == low) & (block == i)), np.flatnonzero((band == high) & (block == j))
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(x) and len(y):
            common = _common([own[k] for k in x], [own[k] for k in y])
            good = (common > 0) & (common * (up + down) >= up * (size[x][:, None] + size[y][None, :]))
            if (low, i) == (high, j):
                good = np.triu(good, 1)
            a, b = (side[k] for side, k in zip((x, y), np.nonzero(good)))
        if listed:
            return pa.table({"a": pa.array(np.minimum(ids[a], ids[b])), "b": pa.array(np.maximum(ids[a], ids[b]))})
        linked = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
        used = np.flatnonzero(linked)
        return pa.table({"class": pa.array(group["class"].to_numpy()[used]), "n": pa.array(np.rint(linked[used]).astype(np.int64))})

    return dealt.groupBy("component", "low", "high", "i", "j").applyInArrow(compare, "a long, b long" if listed else "class long, n long")


def class_links(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """Every link between two classes once: ``a, b``, the smallest ids of texts with these shingle sets, a < b."""
    _, classes = _classes(docs, n)
    return _compared(docs, classes, n, True)


def document_links(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """One row per row: ``doc_id, n_shingles, component_id, class_id`` (smallest id of an equal shingle set) and ``n_links`` (other documents similar to it)."""
    rows, classes = _classes(docs, n)
    linked = stored(_compared(docs, classes, n, False).groupBy("class").agg(F.sum("n").alias("n")), "class-links")
    whole = stored(classes.join(linked, "class", "left").select("class", "class_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "class-counts")
    has_id = F.col("doc_id").isNotNull()
    return (rows.join(whole, "class", "left")
            .select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.when(has_id, F.coalesce("class_id", "doc_id")).alias("class_id"),
                    F.when(has_id, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links")))


@query("op3_ngram_join", """
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM worded),
single AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, hash(unnest(shingles)) AS s FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS n FROM single a JOIN single b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT x, y FROM common WHERE 100 * n >= 75 * (nx + ny - n) UNION ALL SELECT y, x FROM common WHERE 100 * n >= 75 * (nx + ny - n)),
reached AS (SELECT x AS doc_id, x AS other FROM links UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other),
parts AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(p.component_id, s.doc_id) AS component_id FROM sets s LEFT JOIN parts p ON p.doc_id = s.doc_id""")
def op3_ngram_join(spark, folder):
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, folder, "documents"))


@query("op3_ngram_links", ORACLES["op3_ngram_join"].rsplit("SELECT s.doc_id", 1)[0] + """,
classes AS (SELECT doc_id, CASE WHEN len(shingles) > 0 THEN min(doc_id) OVER (PARTITION BY list_sort(shingles)) ELSE doc_id END AS class_id FROM sets),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(p.component_id, s.doc_id) AS component_id, c.class_id, coalesce(l.n, 0)::BIGINT AS n_links
FROM sets s JOIN classes c ON c.doc_id = s.doc_id LEFT JOIN parts p ON p.doc_id = s.doc_id LEFT JOIN counted l ON l.x = s.doc_id""")
def op3_ngram_links(spark, folder):
    """Components, classes and numbers of links of all documents."""
    return document_links(table(spark, folder, "documents"))
