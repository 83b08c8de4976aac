"""Passages that repeat across documents, found level by level at doubling lengths.

A window of ``length`` words can only repeat if the windows inside it do. Level one looks at half the length: every
full window names one half-length window inside it, the one of smallest hash (equal windows name the same one), so
about one start in fourteen is counted and none is lost. Half-length windows met in one document only end there.
Around the others the work is extended to twice the length: first whole spans (all full windows that name one
occurrence), as a span that an earlier document has needs no closer look, then single windows of the spans left.
When no candidates survive, nothing is left to do.

Counts are minima and maxima per hash (combined before the shuffle) and joins that adaptive execution splits, so a
passage that a third of all documents hold is no single task. Equal means equal 64-bit hashes of word sequences
hashed from 64-bit word hashes; one pair of different windows is taken as equal with a chance of 2**-64.

Edge cases: null texts have no words; a text shorter than a window keeps every word; a repeat inside one document is
no repeat; rows that share an id count as one document, each of them gives a row; rows without an id are kept whole
and compared with nothing; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import keyed_texts, query, stored, table
from .kernels import Block, SpanHash, block_of, find_words, pieces, ranges, rows_of, signed, window_hashes, _power_tables, mix

WINDOW_WORDS = 50


def _word_hashes(block: Block):
    words = find_words(block)
    return words, SpanHash(block.data).of(words.starts, words.ends)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of each ``width`` consecutive values."""
    low, at, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        later = low[step:] < low[:len(low) - step]
        at = np.where(later, at[step:], at[:len(at) - step])
        low = np.minimum(low[step:], low[:len(low) - step])
        size += step
    return at


def _named_windows(length: int):
    """Rows (anchor, span, doc_id, first, last): a half-length window and the full windows first..last that name it."""
    half = -(-length // 2)

    def name(batches):
        for batch in batches:
            for part in pieces(batch):
                words, hashes = _word_hashes(block_of(part.column(1)))
                starts, counts = rows_of(words.first, length)
                if not len(starts):
                    continue
                halves = window_hashes(hashes, half)
                named = sliding_argmin(halves, length - half + 1)[starts]
                row = np.repeat(np.arange(len(counts)), counts)
                new = np.flatnonzero(np.concatenate([[True], (named[1:] != named[:-1]) | (row[1:] != row[:-1])]))
                last = np.concatenate([new[1:], [len(starts)]]) - 1
                first, stop, origin = starts[new], starts[last], words.first[row[new]]
                up, down = _power_tables(len(hashes) + 1)
                sums = np.zeros(len(hashes) + 1, np.uint64)
                np.cumsum(hashes * up[:len(hashes)], out=sums[1:])
                span = mix((sums[stop + length] - sums[first]) * down[first] + (named[new] - first).astype(np.uint64))
                yield pa.record_batch([pa.array(signed(halves[named[new]])), pa.array(signed(span)), part.column(0).take(pa.array(row[new])),
                                       pa.array((first - origin).astype(np.int32)), pa.array((stop - origin).astype(np.int32))],
                                      names=["anchor", "span", "doc_id", "first", "last"])

    return name


def _windows_of_spans(length: int):
    """Rows (window, doc_id, first) of all full windows in the listed spans of each text."""
    def expand(batches):
        for batch in batches:
            for part in pieces(batch):
                words, hashes = _word_hashes(block_of(part.column(1)))
                if len(hashes) < length:
                    continue
                full = window_hashes(hashes, length)
                spans = part.column(2)
                sizes = np.diff(spans.offsets.to_numpy())
                flat = spans.flatten()
                first, last = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                origin = np.repeat(words.first[:-1], sizes)
                room = np.repeat(np.diff(words.first), sizes) - length + 1  # rows that share an id may be shorter
                counts = np.maximum(np.minimum(last + 1, room) - first, 0)
                at = ranges(first + origin, counts)
                row = np.repeat(np.repeat(np.arange(len(sizes)), sizes), counts)
                yield pa.record_batch([pa.array(signed(full[at])), part.column(0).take(pa.array(row)), pa.array((at - words.first[row]).astype(np.int32))],
                                      names=["window", "doc_id", "first"])

    return expand


def _cut_out(with_text: bool):
    """Rows with the words outside the listed intervals."""
    def cut(batches):
        for batch in batches:
            for part in pieces(batch):
                block = block_of(part.column(1))
                words = find_words(block)
                n, total = np.diff(words.first), len(words.starts)
                found = part.column(2)
                sizes = np.diff(found.offsets.to_numpy()) if not found.null_count else np.array([0 if x is None else len(x) for x in found.to_pylist()])
                flat = found.flatten()
                first, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                row = np.repeat(np.arange(len(sizes)), sizes)
                change = np.zeros(total + 1, np.int64)
                np.add.at(change, np.minimum(first, n[row]) + words.first[row], 1)
                np.add.at(change, np.minimum(end, n[row]) + words.first[row], -1)
                stay = np.cumsum(change)[:total] == 0
                raw, starts, ends = block.data.tobytes(), words.starts.tolist(), words.ends.tolist()
                texts = []
                for i in range(len(n)):
                    at = (np.flatnonzero(stay[words.first[i]:words.first[i + 1]]) + words.first[i]).tolist()
                    texts.append(b" ".join([raw[starts[j]:ends[j]] for j in at]))
                kept = np.add.reduceat(np.concatenate([stay, [False]]).astype(np.int64), words.first[:-1]) if len(n) else np.zeros(0, np.int64)
                kept = np.where(n > 0, kept, 0)
                columns = [part.column(0), pa.array(n), pa.array(n - kept), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array([x.decode("utf-8", "replace") for x in texts], pa.string()))
                    names.append("kept_text")
                yield pa.record_batch(columns, names=names)

    return cut


def repeated_intervals(docs: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """Word intervals ``[first, stop)`` of documents that an earlier document (smaller id) has as well, every full window covered.

    ``docs`` has ``doc_id`` (not null) and ``text`` only.
    """
    # level one: half-length windows
    named = stored(docs.mapInArrow(_named_windows(length), "anchor long, span long, doc_id long, first int, last int"), "half-windows")
    # aggregates are stored before they are joined: both sides of a join then are shuffles that can be split at a hot key
    repeated = stored(named.groupBy("anchor").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"))
                      .where("earliest < latest").select("anchor", "earliest"), "repeated-anchors")
    left = stored(named.join(repeated, "anchor"), "repeated-halves")
    # level two: whole spans, then the windows of spans that no earlier document has although it has their anchor
    spans = stored(left.groupBy("anchor", "span").agg(F.min("doc_id").alias("span_earliest")), "spans")
    judged = stored(left.join(spans, ["anchor", "span"]), "judged-spans")
    whole = judged.where("doc_id > span_earliest").select("doc_id", "first", (F.col("last") + length).alias("stop"))
    original = judged.where("doc_id = span_earliest")
    open_anchors = stored(original.where("doc_id > earliest").select("anchor").distinct(), "open-anchors")
    listed = (original.join(open_anchors, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("spans")))
    windows = docs.join(listed.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "spans")
    windows = stored(windows.mapInArrow(_windows_of_spans(length), "window long, doc_id long, first int"), "full-windows")
    met = stored(windows.groupBy("window").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest")).where("earliest < latest")
                 .select("window", "earliest"), "repeated-windows")
    single = (windows.join(met, "window").where("doc_id > earliest")
              .select("doc_id", "first", (F.col("first") + length).alias("stop")))
    return whole.unionByName(single)


def without_repeats(docs: DataFrame, length: int = WINDOW_WORDS, with_text: bool = False) -> DataFrame:
    """Per row ``doc_id, n_words, n_removed, kept_sha256`` (of the words that stay, joined by one space) and, if asked, ``kept_text``."""
    texts = keyed_texts(docs)
    known = texts.where("doc_id IS NOT NULL")
    cuts = repeated_intervals(known, length).groupBy("doc_id").agg(F.collect_set(F.struct("first", "stop")).alias("cuts"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    empty = F.array().cast("array<struct<first:int,stop:int>>")
    found = known.join(cuts.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", F.coalesce("cuts", empty).alias("cuts"))
    unknown = texts.where("doc_id IS NULL").select("doc_id", "text", empty.alias("cuts"))
    return found.unionByName(unknown).mapInArrow(_cut_out(with_text), schema)


@query("op8_substring_doubling", """
WITH worded AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i, len(words) AS n FROM worded),
windows AS MATERIALIZED (
  SELECT doc_id, i, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM placed QUALIFY i + 50 <= n),
earliest AS MATERIALIZED (SELECT h, min(doc_id) AS d FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
marks AS MATERIALIZED (SELECT w.doc_id, w.i FROM windows w JOIN earliest e ON w.h = e.h AND w.doc_id > e.d),
judged AS (
  SELECT p.doc_id, p.i, p.word, coalesce(max(m.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), -1) >= 0 AS gone
  FROM placed p LEFT JOIN marks m ON m.doc_id = p.doc_id AND m.i = p.i),
kept AS (SELECT doc_id, sum(gone::INT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS body FROM judged GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM worded w LEFT JOIN kept k ON k.doc_id = w.doc_id""")
def op8_substring_doubling(spark, folder):
    """Words of all documents outside 50-word windows that an earlier document has as well."""
    return without_repeats(table(spark, folder, "documents"))
