"""Ranked lexical search by dense matrix products over tiles of items and documents.

1. The terms of all items are counted and the items cut into blocks of a bounded number of (item, term) pairs. All that
   follows is done for one block at a time; a block is what the driver and a worker hold, whatever the number of items.
2. One pass over the texts keeps, of each document, its number of terms and its counts of the block's terms.
3. Document frequencies are added up by term; with them the block's weights are known.
4. Documents meet the block in tiles: impacts of up to 1,024 documents times weights of up to 256 items over up to 1,024 of
   the terms that these items have. Impacts and weights are whole numbers below 2**53, as is every sum inside one product
   (a tile whose sums could be larger is split, by terms and then by weight), so BLAS adds them exactly in any order. The
   products are added as 64-bit integers.
5. A tile's scores at or above an item's current last place are its candidates, all ties among them; they are ordered by
   score and document, so that the best of all tiles are the best of all documents. A task gives at most ``limit`` rows
   per item; those are merged in two steps.

Edge cases: null and empty texts have no terms and are in no count; an item without terms has no rows; rows that share an
item id are one item with the terms of all of them; each row of ``documents`` is a document, repeated ids and rows too;
documents without an id come last among equal scores; no rows give no rows; other columns are not read. Terms are told
apart by 64-bit hashes: one of a block's V terms is taken for one of D other terms with a chance of V * D / 2**64.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import small
from .common import prepare, query, stored, table
from .kernels import ALPHANUMERIC, SpanHash, block_of, find_words, pieces, signed

LIMIT = 20
BLOCK_ENTRIES = 1 << 16  # (item, term) pairs of a block; one item's pairs more where it is the last
BUCKET_ENTRIES = 1 << 20  # pairs that are numbered together
ITEM_TILE = 256
TERM_TILE = 1024
DOCUMENT_TILE = 1024
MERGED_BY = 64  # parts in which the candidates of an item are merged first

_EXACT = 1 << 53
_IMPACT = 1_000_000  # above every impact
_NO_ID = (1 << 63) - 1


def _terms(block):
    words = find_words(block, ALPHANUMERIC)
    return words, SpanHash(block.data, fold=True).of(words.starts, words.ends)


def item_terms(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """``item, term, times``: terms are hashes."""
    def count(batches):
        for batch in batches:
            for part in pieces(batch):
                words, hashes = _terms(block_of(part.column(1)))
                yield pa.record_batch([part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), np.diff(words.first)))), pa.array(signed(hashes))], names=["item", "term"])

    rows = items.select(F.col(f"`{id_column}`").alias("item"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    found = rows.mapInArrow(count, f"item {rows.schema['item'].dataType.simpleString()}, term long")
    return found.groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


def blocks_of(entries: DataFrame, block_entries: int = BLOCK_ENTRIES, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """``item, bucket, block, no``: items dealt to blocks, numbered 0, 1, ... in each."""
    total = entries.count()
    bucket = F.pmod(F.xxhash64("item"), F.lit(max(1, total // bucket_entries)))
    sizes = entries.groupBy("item").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", bucket)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sizes.withColumn("block", F.floor(before / block_entries))
    return cut.withColumn("no", F.row_number().over(Window.partitionBy("bucket", "block").orderBy("item")) - 1).select("item", "bucket", "block", "no")


def _document_terms(vocabulary):
    """Rows (doc, n, terms, times): places of a document's terms in the sorted vocabulary."""
    def count(batches):
        known = vocabulary.value
        for batch in batches:
            for part in pieces(batch):
                words, hashes = _terms(block_of(part.column(1)))
                n = np.diff(words.first)
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                met = known[place] == hashes
                row = np.repeat(np.arange(len(n)), n)[met]
                keys, times = np.unique(row * len(known) + place[met], return_counts=True)
                row, place = np.divmod(keys, len(known))
                offsets = pa.array(np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32))
                yield pa.record_batch([part.column(0), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(times))],
                                      names=["doc", "n", "terms", "times"])

    return count


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end and how many each row has."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _frequencies(size: int):
    """Rows (term, n): in how many documents of a task a term is."""
    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0))[0], minlength=size)
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["term", "n"])

    return count


def term_tiles(number: np.ndarray, term: np.ndarray, value: np.ndarray, width: int = TERM_TILE, most: int = (_EXACT - 1) // _IMPACT):
    """(terms, place of each entry's term, entry's item, entry's value) of tiles of at most ``width`` terms in which no item has more than ``most``."""
    while len(value):
        now = np.minimum(value, most)  # what is above goes to further tiles of the same terms
        names, place = np.unique(term, return_inverse=True)
        stack = [(i, min(i + width, len(names))) for i in range(0, len(names), width)][::-1]
        while stack:
            low, high = stack.pop()
            mine = (place >= low) & (place < high)
            if high - low > 1 and np.bincount(number[mine], now[mine].astype(np.float64)).max() > most:
                middle = (low + high) // 2
                stack += [(middle, high), (low, middle)]
                continue
            yield names[low:high], place[mine] - low, number[mine], now[mine]
        rest = value > most
        number, term, value = number[rest], term[rest], value[rest] - most


class Best:
    """The best documents of numbered items, ties by document."""

    def __init__(self, items: int, limit: int):
        self.limit = limit
        self.last = np.ones(items, np.int64)  # scores below are out
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, docs: np.ndarray, first: int) -> None:
        """Scores (documents x items) of items ``first`` and following."""
        row, column = np.nonzero(scores >= self.last[first:first + scores.shape[1]])
        if not len(row):
            return
        item = np.concatenate([self.item, column + first])
        score, doc = np.concatenate([self.score, scores[row, column]]), np.concatenate([self.doc, docs[row]])
        order = np.lexsort((doc, -score, item))
        item = item[order]
        starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        place = np.arange(len(item)) - np.repeat(starts, np.diff(np.append(starts, len(item))))
        order, item = order[place < self.limit], item[place < self.limit]
        self.item, self.score, self.doc = item, score[order], doc[order]
        full = place[place < self.limit] == self.limit - 1
        self.last[item[full]] = self.score[full]


def _ranked(block, limit: int):
    """Rows (no, doc, score): a task's best documents of each item."""
    def rank(batches):
        number, term, value, documents, length, vocabulary = block.value
        items = int(number.max()) + 1
        best, place_of, tiles = Best(items, limit), np.full(vocabulary, -1), []
        for first in range(0, items, ITEM_TILE):
            mine = (number >= first) & (number < first + ITEM_TILE)
            tiles.append((first, min(ITEM_TILE, items - first), list(term_tiles(number[mine] - first, term[mine], value[mine]))))
        for batch in batches:
            for start in range(0, batch.num_rows, DOCUMENT_TILE):
                tile = batch.slice(start, DOCUMENT_TILE)
                doc = np.where(tile.column(0).is_null(), _NO_ID, tile.column(0).fill_null(0).to_numpy()).astype(np.int64)
                terms, sizes = _flat(tile.column(2))
                times = _flat(tile.column(3))[0]
                row = np.repeat(np.arange(len(doc)), sizes)
                size = 75 + (25 * tile.column(1).to_numpy() * documents) // length
                impact = (1_000_000_000 * times) // (1000 * times + 12 * size[row])
                for first, width, parts in tiles:
                    scores = np.zeros((len(doc), width), np.int64)
                    for names, place, item, weight in parts:
                        place_of[names] = np.arange(len(names))
                        at = place_of[terms]
                        met = at >= 0
                        place_of[names] = -1
                        impacts, weights = np.zeros((len(doc), len(names))), np.zeros((len(names), width))
                        impacts[row[met], at[met]] = impact[met]
                        weights[place, item] = weight
                        scores += (impacts @ weights).astype(np.int64)
                    best.add(scores, doc, first)
        yield pa.record_batch([pa.array(best.item.astype(np.int32)), pa.array(best.doc), pa.array(best.score)], names=["no", "doc", "score"])

    return rank


def _block_results(docs: DataFrame, pairs, limit: int) -> DataFrame:
    """``no, doc_id, score, rank`` of a block's items; ``pairs`` are its (no, term, times)."""
    spark = docs.sparkSession
    number, term, times = (np.array(x, np.int64) for x in zip(*pairs))
    known, place = np.unique(term.view(np.uint64), return_inverse=True)
    counted = stored(docs.mapInArrow(_document_terms(spark.sparkContext.broadcast(known)), "doc long, n long, terms array<int>, times array<long>"), "document-terms")
    totals = counted.where("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    frequency = np.zeros(len(known), np.int64)
    for r in counted.select("terms").mapInArrow(_frequencies(len(known)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # the block's terms
        frequency[r["term"]] = r["n"]
    weight = np.array([math.floor(1000 * math.log((2 * totals["documents"] + 2) / (2 * n + 1))) for n in frequency.tolist()], np.int64)
    value = times * weight[place]
    useful = (frequency[place] > 0) & (value > 0)
    block = spark.sparkContext.broadcast((number[useful], place[useful], value[useful], totals["documents"], totals["length"] or 1, len(known)))
    if not useful.any():
        return None
    found = counted.where(F.size("terms") > 0).mapInArrow(_ranked(block, limit), "no int, doc long, score long")
    best = [F.col("score").desc(), F.col("doc")]
    part = found.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(MERGED_BY)))
    merged = part.withColumn("rank", F.row_number().over(Window.partitionBy("no", "part").orderBy(*best))).where(F.col("rank") <= limit).drop("part")
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(*best))).where(F.col("rank") <= limit)
    return stored(ranked.select("no", F.nullif("doc", F.lit(_NO_ID)).alias("doc_id"), "score", "rank"), "ranked")


def ranked_search(docs: DataFrame, items: DataFrame, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
                  item_text_column: str = "text", block_entries: int = BLOCK_ENTRIES, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``limit`` documents of the highest score above 0 for every item."""
    prepare(docs.sparkSession)
    entries = stored(item_terms(items, item_column, item_text_column), "item-terms")
    places = stored(blocks_of(entries, block_entries, bucket_entries), "item-blocks")
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    placed = stored(entries.withColumnRenamed("item", "_item").join(small(places), F.col("_item").eqNullSafe(F.col("item"))).select("bucket", "block", "no", "term", "times"), "placed-terms")
    out = None
    for bucket, block in sorted(tuple(r) for r in places.select("bucket", "block").distinct().collect()):  # one row for BLOCK_ENTRIES pairs
        mine = (F.col("bucket") == bucket) & (F.col("block") == block)
        found = _block_results(texts, placed.where(mine).select("no", "term", "times").collect(), limit)  # bounded by the block
        if found is not None:
            named = found.join(small(places.where(mine).select("no", "item")), "no").select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
            out = named if out is None else out.union(named)
    if out is None:
        return places.where("false").select(F.col("item").alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return out


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


@query("op12_dense_search", f"""
WITH worded AS MATERIALIZED (SELECT doc_id, {_WORDS} AS words FROM documents),
totals AS (SELECT count(*) AS documents, sum(len(words))::BIGINT AS length FROM worded WHERE len(words) > 0),
wanted AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY item_id, term),
postings AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM worded) WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
sizes AS (SELECT doc_id, 75 + (25 * len(words)::BIGINT * documents) // length AS m FROM worded, totals),
impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS part FROM postings JOIN sizes USING (doc_id) JOIN weights USING (term)),
scored AS (SELECT item_id, doc_id, sum(times * part)::BIGINT AS score FROM wanted JOIN impacts USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 20""")
def op12_dense_search(spark, folder):
    """All documents ranked for each benchmark item."""
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
