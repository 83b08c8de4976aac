"""Names found by prefix: sorted starts of names, where a prefix is an interval.

``name_starts`` has one row per name and distinct start (the whole phrase, or a word), not one per prefix. Rows that start
with a key lie side by side in the order of the starts, so a key is found by two binary searches. A name is given once per
key: its starts are sorted, and each row knows how many leading characters the start before it has in common with it; a key
no longer than that has met the name already.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, row_bound
from .projection import named_literals

LISTED = 10_000  # keys that go to every scanning task
_LAST = "\U0010ffff"  # sorts behind every character


def _common(a: Column, b: Column) -> Column:
    """How many leading characters two texts share; quadratic in the shorter one, a word."""
    shorter = F.least(F.length(a), F.length(b))
    places = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda n: F.left(a, n) == F.left(b, n)))


def name_starts(statements: DataFrame) -> DataFrame:
    """(start, after, resource_id, predicate, value, lang, cassette_id, phrase): a key longer than ``after`` with which ``start`` begins
    finds the name here."""
    rows = named_literals(statements).withColumn("phrase", F.array_join("words", " "))
    starts = F.array_sort(F.array_distinct(F.concat(F.array("phrase"), F.col("words"))))
    listed = rows.withColumn("starts", starts).where("phrase <> ''")
    before = lambda i: F.coalesce(F.get("starts", i - 1), F.lit(""))
    placed = F.transform("starts", lambda s, i: F.struct(s.alias("start"), _common(s, before(i)).alias("after")))
    return listed.select(F.explode(placed).alias("s"), "resource_id", "predicate", "value", "lang", "cassette_id", "phrase").select(
        "s.start", "s.after", "resource_id", "predicate", "value", "lang", "cassette_id", "phrase")


_FOUND = "search_key string, resource_id string, predicate string, value string, lang string, cassette_id string, phrase string"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _meet(found: list[str]):
    """Batches of starts to the rows that the sorted keys find. Nested, so that executors get it by value."""
    last, names = _LAST, _NAMES

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        keys, ends = np.array(found, object), np.array([k + last for k in found], object)
        lengths, listed = np.array([len(k) for k in found]), pa.array(found, pa.string())
        for batch in batches:
            starts, after = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            order = np.argsort(starts, kind="stable")  # sorted already where it comes from one file
            low, high = (np.searchsorted(starts, k, sorter=order) for k in (keys, ends))
            counts = high - low
            key = np.repeat(np.arange(len(keys)), counts)
            row = order[np.arange(len(key)) + np.repeat(low - np.cumsum(counts) + counts, counts)]
            new = lengths[key] > after[row]
            taken = batch.take(pa.array(row[new]))
            yield pa.RecordBatch.from_arrays([listed.take(pa.array(key[new])), *taken.columns[2:]], names=names)

    return scan


def rows_under(starts: DataFrame, keys: DataFrame, listed: int = LISTED) -> DataFrame:
    """(search_key, resource_id, predicate, value, lang, cassette_id, phrase) of every name and key (column ``search_key``) it is found by.

    Up to ``listed`` keys go to the tasks that scan the starts; files outside the keys' spans are skipped, and in every
    batch the keys' intervals are found by binary search. More keys are joined: starts are cut to the lengths that keys
    have, and meet them by equality, which adaptive execution splits where a key finds very many names.
    """
    wanted = keys.select("search_key").where("search_key <> ''").distinct()
    if row_bound(wanted, listed):
        found = sorted(r["search_key"] for r in wanted.collect())  # bounded just above
        spans = F.lit(False)
        for low, high in _spans(found):
            spans = spans | F.col("start").between(low, high + _LAST)
        return starts.where(spans).select("start", "after", *_NAMES[1:]).mapInArrow(_meet(found), _FOUND)
    wanted = cut_lineage(wanted)
    lengths = F.array(*[F.lit(r[0]) for r in wanted.select(F.length("search_key")).distinct().collect()])  # no more than the longest key has characters
    fitting = F.filter(lengths, lambda n: (n > F.col("after")) & (n <= F.length("start")))
    cut = starts.withColumn("n", F.explode(fitting)).withColumn("search_key", F.left("start", F.col("n")))
    return cut.select(*_NAMES).join(wanted, "search_key")


def _spans(found: list[str], most: int = 50) -> list[tuple[str, str]]:
    """At most ``most`` spans that cover all keys: the sorted keys in runs."""
    step = max(1, -(-len(found) // most))
    return [(found[i], found[min(i + step, len(found)) - 1]) for i in range(0, len(found), step)]
