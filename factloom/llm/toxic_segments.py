"""Toxic passages by maximum-scoring segments over token log-odds, and a calibrated score per text.

Learning. Of the labelled rows at most ``LABELLED`` are used, those of smallest hash (a documented bound; everything
else covers all data). A token's features are the folded word and its leading 4 to 7 bytes, so forms of one stem help
each other. Features that at least ``SUPPORT`` toxic texts hold get the log-odds of their text counts under a Dirichlet
prior that leans on the overall rate (Monroe, Colaresi, Quinn 2008); those far enough above zero in standard errors make
the lexicon, whose size the labelled sample bounds. In toxic texts only occurrences between words
of their own count, so passages that copies share do not make their words toxic.

Scoring. A token scores its best feature's log-odds (its k-th occurrence a k-squared part), any other token a small
negative constant. The linear-time scan of
Ruzzo and Tompa finds all maximal segments. Scores are log-odds, so a text of n tokens has about n * exp(-S) segments of
score S by chance (Karlin and Altschul); a passage is significant if that is below one. A text's evidence is the sum of
S - ln(n) over its significant passages, else that of its best segment. Evidence becomes a probability by a logistic
curve fitted on texts that the lexicon behind it has not seen (two folds learn for each other).

Edge cases: null and empty texts have no tokens and the lowest evidence; labels that are null are not used, of several
labels of one id the largest counts; equal labelled texts count once; without labels of both kinds every score is 0 (to rounding);
a null id is scored and counts as held out; repeated rows are scored one by one; no rows give no rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import keyed_texts, query, stored, table
from .kernels import ALPHANUMERIC, Block, SpanHash, block_of, find_words, mix, pieces, signed

LABELLED = 40_000
SUPPORT = 3
SURE = 2.5  # standard errors above zero
LEAST_ODDS = 3.0  # log-odds of a lexicon feature
PRIOR = 10.0  # documents of overall rate added to each class
FLOOR = 0.5  # documents added besides
STEMS = (4, 5, 6, 7)
SHARE = 0.05  # of lexicon tokens in a toxic passage
THRESHOLD = 0.7
_LOW, _HIGH, _STEP = -15.0, 25.0, 0.25  # evidence is counted in bins for the calibration


class Model(NamedTuple):
    """Feature hashes (sorted), their log-odds, and the logistic curve over the evidence."""

    keys: np.ndarray
    odds: np.ndarray
    slope: float
    offset: float


def _features(block: Block):
    """Words of a block and, for each kind of feature, (token numbers, hashes). Latin capitals count as small letters."""
    data = block.data.copy()
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    capital = lead[(data[lead + 1] >= 0x80) & (data[lead + 1] <= 0x9E) & (data[lead + 1] != 0x97)] + 1
    data[capital] += 0x20
    block = Block(data, block.bounds)
    words = find_words(block, ALPHANUMERIC)
    spans = SpanHash(block.data, fold=True)
    found = [(np.arange(len(words.starts)), spans.of(words.starts, words.ends))]
    for k in STEMS:
        at = np.flatnonzero(words.ends - words.starts >= k)
        found.append((at, mix(spans.of(words.starts[at], words.starts[at] + k) + np.uint64(k))))
    return words, found


def _distinct_features(block) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once."""
    words, found = _features(block)
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    rows, keys = np.concatenate([row[at] for at, _ in found]), np.concatenate([h for _, h in found])
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], keys[new]


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(True))


def labelled_texts(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """``text, toxic, fold`` of at most ``limit`` labelled rows outside the held-out third, equal texts once."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out()).select(F.col("doc_id").cast("long"), "toxic")
    one = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    joined = keyed_texts(docs).join(F.broadcast(chosen), "doc_id")  # at most ``limit`` rows of twelve bytes
    once = joined.groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    return stored(once.select("text", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold")), "labelled")


def _supported(train: DataFrame, support: int) -> np.ndarray:
    """Features of at least ``support`` toxic texts, with counts per fold: columns key, n0, n1."""
    def count(batches):
        for batch in batches:
            for part in pieces(batch):
                rows, keys = _distinct_features(block_of(part.column(0)))
                fold = part.column(1).to_numpy()[rows]
                distinct, which = np.unique(keys, return_inverse=True)
                n1 = np.bincount(which, weights=fold, minlength=len(distinct)).astype(np.int64)
                n0 = np.bincount(which, minlength=len(distinct)) - n1
                yield pa.record_batch([pa.array(signed(distinct)), pa.array(n0), pa.array(n1)], names=["key", "n0", "n1"])

    counted = train.where("toxic > 0").select("text", "fold").mapInArrow(count, "key long, n0 long, n1 long")
    found = counted.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= support).toArrow()
    order = np.argsort(found["key"].to_numpy().view(np.uint64))
    return np.stack([found[c].to_numpy()[order] for c in ("key", "n0", "n1")])


def _clean_counts(train: DataFrame, keys: np.ndarray) -> np.ndarray:
    """How many clean texts of either fold have each feature of ``keys`` (sorted)."""
    def count(batches):
        held = np.zeros((2, len(keys)), np.int64)
        for batch in batches:
            for part in pieces(batch):
                rows, found = _distinct_features(block_of(part.column(0)))
                at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                known = keys[at] == found
                fold = part.column(1).to_numpy()[rows[known]]
                for k in (0, 1):
                    held[k] += np.bincount(at[known][fold == k], minlength=len(keys))
        used = np.flatnonzero(held.sum(axis=0))
        for a in range(0, len(used), 1 << 16):
            some = used[a:a + (1 << 16)]
            yield pa.record_batch([pa.array(some), pa.array(held[0, some]), pa.array(held[1, some])], names=["place", "n0", "n1"])

    out = np.zeros((2, len(keys)), np.int64)
    if len(keys):
        counted = train.where("toxic <= 0").select("text", "fold").mapInArrow(count, "place long, n0 long, n1 long")
        rows = counted.groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # at most one row per supported feature
        out[:, rows["place"].to_numpy()] = [rows["n0"].to_numpy(), rows["n1"].to_numpy()]
    return out


def _independent(train: DataFrame, keys: np.ndarray) -> np.ndarray:
    """How often each feature of ``keys`` (sorted) stands in toxic texts between words of its own, per fold.

    An occurrence is independent if no other one of the feature has the same two words before it, nor the same two
    after it; all others together count once.
    """
    def collect(batches):
        for batch in batches:
            for part in pieces(batch):
                words, found = _features(block_of(part.column(0)))
                own = found[0][1]
                row = np.repeat(np.arange(part.num_rows), np.diff(words.first))
                beside = []
                for near, far in ((-1, -2), (1, 2)):
                    mark = np.full(len(own), np.uint64(abs(far)))
                    for step in (near, far):
                        at = np.arange(len(own)) + step
                        inside = (at >= 0) & (at < len(own))
                        inside[inside] = row[at[inside]] == row[inside]
                        mark = mix(mark * np.uint64(3) + np.where(inside, own[np.clip(at, 0, max(len(own) - 1, 0))], np.uint64(0)))
                    beside.append(signed(mark))
                fold = part.column(1).to_numpy()[row]
                for at, hashes in found:
                    place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                    hit = keys[place] == hashes
                    yield pa.record_batch([pa.array(place[hit]), pa.array(beside[0][at[hit]]), pa.array(beside[1][at[hit]]), pa.array(fold[at[hit]])],
                                          names=["place", "before", "after", "fold"])

    out = np.zeros((2, len(keys)), np.int64)
    if len(keys):
        seen = stored(train.where("toxic > 0").select("text", "fold").mapInArrow(collect, "place long, before long, after long, fold int"), "surroundings")
        for side in ("before", "after"):
            seen = seen.join(seen.groupBy("place", side).agg(F.count(F.lit(1)).alias(f"n_{side}")), ["place", side])
        alone = (F.col("n_before") == 1) & (F.col("n_after") == 1)
        rows = seen.groupBy("place", "fold").agg(F.sum(alone.cast("long")).alias("n"), F.max((~alone).cast("long")).alias("more")).toArrow()  # two rows per feature at most
        out[rows["fold"].to_numpy(), rows["place"].to_numpy()] = rows["n"].to_numpy() + rows["more"].to_numpy()
    return out


def log_odds(toxic: np.ndarray, clean: np.ndarray, toxic_texts: int, clean_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of being in a toxic text against a clean one under the Dirichlet prior, and their standard errors."""
    prior = FLOOR + PRIOR * (toxic + clean) / max(1, toxic_texts + clean_texts)
    total = PRIOR + 2 * FLOOR
    odds = np.log((toxic + prior) / np.maximum(toxic_texts + total - toxic - prior, FLOOR)) - np.log((clean + prior) / np.maximum(clean_texts + total - clean - prior, FLOOR))
    return odds, np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))


def _lexicon(keys, toxic, clean, toxic_texts, clean_texts, support) -> tuple[np.ndarray, np.ndarray]:
    odds, error = log_odds(toxic, clean, toxic_texts, clean_texts)
    good = (odds >= SURE * error) & (odds >= LEAST_ODDS) & (toxic >= support)
    return keys[good], odds[good]


def maximal_segments(places: list[int], scores: list[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, stop, score) where tokens at ``places`` score ``scores`` and all others ``gap`` < 0."""
    held: list[tuple[int, int, float, float]] = []  # first, stop, score before it, score up to its end
    total, at = 0.0, 0
    for place, score in zip(places, scores):
        before = total + gap * (place - at)
        total, at = before + score, place + 1
        first, left, right = place, before, total
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j -= 1
            if j < 0 or held[j][3] >= right:
                break
            first, left = held[j][0], held[j][2]
            del held[j:]
        held.append((first, place + 1, left, right))
    return [(first, stop, right - left) for first, stop, left, right in held]


def _scan(block, keys: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Tokens of every row, and the segments of rows that have any."""
    words, found = _features(block)
    n = np.diff(words.first)
    segments: list[list[tuple[int, int, float]]] = [[] for _ in n]
    if len(keys):
        score = np.zeros(len(words.starts))
        for at, hashes in found:
            place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = keys[place] == hashes
            np.maximum.at(score, at[hit], odds[place[hit]])
        toxic = np.flatnonzero(score > 0)
        row = np.searchsorted(words.first, toxic, side="right") - 1
        gap = math.log1p(-SHARE)
        for r in np.unique(row).tolist():
            mine = toxic[np.searchsorted(row, r):np.searchsorted(row, r, side="right")]
            # the k-th occurrence of a word in a text adds a k-squared part: repetition alone is no evidence
            own = found[0][1][mine]
            order = np.argsort(own, kind="stable")
            start = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]]))
            nth = np.empty(len(mine), np.int64)
            nth[order] = np.arange(len(mine)) - np.repeat(start, np.diff(np.append(start, len(mine)))) + 1
            segments[r] = maximal_segments((mine - words.first[r]).tolist(), (score[mine] / nth ** 2).tolist(), gap)
    return n, segments


def _evidence(n: int, segments: list[tuple[int, int, float]]) -> tuple[float, int]:
    """Sum of the significant passages' scores above chance, else that of the best segment; and how many are significant."""
    chance = math.log(max(n, 1))
    above = [s - chance for _, _, s in segments if s > chance]
    best = max((s for _, _, s in segments), default=0.0) - chance
    return (sum(above) if above else min(best, 0.0) if n else _LOW), len(above)


def _calibrated(bins: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Platt's logistic curve over binned evidence by Newton steps, with his smoothed targets and a small ridge."""
    x, n = bins / 10, toxic + clean
    high, low = (toxic.sum() + 1) / (toxic.sum() + 2), 1 / (clean.sum() + 2)
    target = (toxic * high + clean * low) / n
    a, b = 1.0, math.log((toxic.sum() + 1) / (clean.sum() + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        w = n * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(n * (p - target) * x).sum() + 1e-3 * a, (n * (p - target)).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        size = np.abs(step).max()
        a, b = a - step[0] * min(1, 2 / max(size, 1e-12)), b - step[1] * min(1, 2 / max(size, 1e-12))
        if size < 1e-6:
            break
    return max(a, 1e-6) / 10, b


def learn(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, support: int = SUPPORT) -> Model:
    """The lexicon and the calibration from labelled rows outside the held-out third."""
    train = labelled_texts(docs, labels, limit)
    sizes = {(r["toxic"] > 0, r["fold"]): r["n"] for r in train.groupBy((F.col("toxic") > 0).cast("int").alias("toxic"), "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = [[sizes.get((kind, fold), 0) for fold in (0, 1)] for kind in (True, False)]
    if not sum(texts[0]) or not sum(texts[1]):
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, -math.inf)
    signed_keys, *toxic = _supported(train, support)
    keys = signed_keys.view(np.uint64)
    clean = _clean_counts(train, keys)
    odds, error = log_odds(toxic[0] + toxic[1], clean.sum(axis=0), sum(texts[0]), sum(texts[1]))
    likely = np.flatnonzero(odds >= SURE * error)
    keys, clean = keys[likely], clean[:, likely]
    toxic = np.minimum([x[likely] for x in toxic], _independent(train, keys))
    # each fold is judged by the lexicon of the other
    folds = [_lexicon(keys, toxic[1 - k], clean[1 - k], texts[0][1 - k], texts[1][1 - k], max(1, support - 1)) for k in (0, 1)]

    def judge(batches):
        for batch in batches:
            for part in pieces(batch):
                fold, kind = part.column(1).to_numpy(), part.column(2).to_numpy() > 0
                seen = np.zeros(part.num_rows)
                for k in (0, 1):
                    mine = np.flatnonzero(fold == k)
                    n, segments = _scan(block_of(part.column(0).take(pa.array(mine))), *folds[k])
                    seen[mine] = [_evidence(int(c), s)[0] for c, s in zip(n, segments)]
                bins = np.floor((np.clip(seen, _LOW, _HIGH) - _LOW) / _STEP).astype(np.int64)
                yield pa.record_batch([pa.array(bins), pa.array(kind.astype(np.int64))], names=["bin", "toxic"])

    counted = (train.select("text", "fold", "toxic").mapInArrow(judge, "bin long, toxic long").groupBy("bin")
               .agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).toArrow())  # at most 301 bins
    at, bad, n = (counted[c].to_numpy().astype(float) for c in ("bin", "toxic", "n"))
    slope, offset = _calibrated(_LOW + (at + 0.5) * _STEP, bad, n - bad)
    return Model(*_lexicon(keys, toxic[0] + toxic[1], clean.sum(axis=0), sum(texts[0]), sum(texts[1]), support), slope, offset)


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: ``doc_id, held_out, score, predicted, n_tokens, n_passages, passage_start, passage_stop, passage_score`` (of the best passage)."""
    def judge(batches):
        for batch in batches:
            for part in pieces(batch):
                n, segments = _scan(block_of(part.column(1)), model.keys, model.odds)
                judged = [_evidence(int(c), s) for c, s in zip(n, segments)]
                logit = np.clip(model.slope * np.clip([x for x, _ in judged], _LOW, _HIGH) + model.offset, -700, 700) if part.num_rows else np.zeros(0)
                score = 1 / (1 + np.exp(-logit))
                best = [max(s, key=lambda x: x[2], default=None) if k else None for s, (_, k) in zip(segments, judged)]
                yield pa.record_batch(
                    [part.column(0), part.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(n),
                     pa.array([k for _, k in judged], pa.int64()), *(pa.array([b and b[i] for b in best], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64())))],
                    names=["doc_id", "held_out", "score", "predicted", "n_tokens", "n_passages", "passage_start", "passage_stop", "passage_score"])

    return keyed_texts(docs).withColumn("held_out", held_out()).mapInArrow(
        judge, "doc_id long, held_out boolean, score double, predicted int, n_tokens long, n_passages long, passage_start long, passage_stop long, passage_score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with all their columns; nothing is shuffled."""
    text = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            for part in pieces(batch):
                n, segments = _scan(block_of(part.column(text)), model.keys, model.odds)
                evidence = np.clip([_evidence(int(c), s)[0] for c, s in zip(n, segments)], _LOW, _HIGH) if part.num_rows else np.zeros(0)
                score = 1 / (1 + np.exp(-np.clip(model.slope * evidence + model.offset, -700, 700)))
                yield part.filter(pa.array(score < threshold, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def toxic_passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage: ``doc_id, start, stop, score, expected`` (passages of that score by chance)."""
    def find(batches):
        for batch in batches:
            for part in pieces(batch):
                n, segments = _scan(block_of(part.column(1)), model.keys, model.odds)
                rows = [(r, a, b, s, c * math.exp(-s)) for r, (c, found) in enumerate(zip(n.tolist(), segments)) for a, b, s in found if c * math.exp(-s) < 1]
                r, a, b, s, e = zip(*rows) if rows else ([], [], [], [], [])
                yield pa.record_batch([part.column(0).take(pa.array(r, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64()), pa.array(e, pa.float64())],
                                      names=["doc_id", "start", "stop", "score", "expected"])

    return keyed_texts(docs).mapInArrow(find, "doc_id long, start long, stop long, score double, expected double")


@query("op4_toxic_segments")
def op4_toxic_segments(spark, folder):
    """Toxicity of all documents, learned from the labels outside the held-out third."""
    docs = table(spark, folder, "documents")
    return toxicity(docs, learn(docs, table(spark, folder, "labels")))
