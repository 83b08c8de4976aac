"""Word search over posting lists: per word blocks of resource numbers, not one row per word and text.

Current records are numbered, neighbours in a partition next to each other. A posting block holds the resources of one word, one cassette and
one stretch of 65,536 numbers, ascending from the first; so a block is bounded however frequent the word, and the index
grows with the distinct words of the texts and not with the texts' length times their words. On disk the ascending offsets
are stored as differences (Parquet's delta encoding).

Search counts words by resource number, keeps per query the scores of the first ``limit`` places with all ties, and only
then reads heads and names of what is left, and the texts of what is shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, functions as F

from .. import vocab as v
from ..functions import text
from ..session import cut_lineage, lookup, row_bound, small
from .access import visible
from .portrait import _of, display_names, with_type
from .projection import worded_literals
from .search import RESULT, check_limit, first_places, query_words, top_rows

BLOCK = 1 << 16
STRETCH = 1 << 12  # numbers whose heads are read or left out together


def dealt_by_id(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows dealt to the partitions by ``resource_id`` and sorted by it."""
    return rows.repartition(partitions, "resource_id").sortWithinPartitions("resource_id")


def numbered(dealt: DataFrame) -> DataFrame:
    """Adds ``number`` to dealt records, ascending with the id inside each partition; the same whenever it is run."""
    return dealt.withColumn("number", F.monotonically_increasing_id())


def numbered_by_id(current: DataFrame, partitions: int) -> DataFrame:
    """Records dealt by their id, with their ``number``."""
    return numbered(dealt_by_id(current, partitions))


def number_records(current: DataFrame) -> DataFrame:
    """Records with a ``number``, kept."""
    return cut_lineage(numbered_by_id(current, int(current.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def postings(current: DataFrame) -> DataFrame:
    """(word, cassette_id, block, n, offsets) of numbered records: resources ``block * BLOCK + offset`` hold the word."""
    wanted = F.filter("props", lambda p: (p["kind"] == v.LITERAL) & p["predicate"].isin(*v.WORD_PREDICATES))
    texts = current.select("number", F.coalesce("cassette_id", F.lit(v.SYSTEM_CASSETTE)).alias("cassette_id"), F.explode(wanted).alias("p"))
    words = texts.select("number", "cassette_id", F.explode(F.array_distinct(text.tokens("p.value"))).alias("word"))
    block, offset = F.expr(f"number div {BLOCK}"), (F.col("number") % BLOCK).cast("int")
    gathered = words.groupBy("word", "cassette_id", block.alias("block")).agg(F.sort_array(F.collect_set(offset)).alias("offsets"))  # at most BLOCK of them
    return gathered.select("word", "cassette_id", "block", F.size("offsets").alias("n"), "offsets")


def delta_coded(writer: DataFrameWriter) -> DataFrameWriter:
    """Offsets of posting blocks as differences in the Parquet files."""
    return writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#offsets.list.element", "false")


def posting_rows(index: DataFrame) -> DataFrame:
    """(word, cassette_id, number): the blocks written out."""
    return index.select("word", "cassette_id", "block", F.explode("offsets").alias("offset")).select(
        "word", "cassette_id", (F.col("block") * BLOCK + F.col("offset")).alias("number"))


def scored_resources(words: DataFrame, index: DataFrame, allowed, limit: int | None) -> DataFrame:
    """(query_id, number, score): resources by the number of query words found; with a limit, those of the first places with all ties."""
    # blocks of a frequent word lie in one file: they are dealt before their resources are written out, and so that these need not be
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = lookup(visible(index, allowed), words, "word").repartition(tasks, "block").join(small(words), "word")
    met = blocks.select("query_id", "block", F.explode("offsets").alias("offset"))
    scored = met.groupBy("query_id", "block", "offset").agg(F.count(F.lit(1)).alias("score"))
    return first_places(scored, limit).select("query_id", (F.col("block") * BLOCK + F.col("offset")).alias("number"), "score")


def _near(heads: DataFrame, scored: DataFrame) -> DataFrame:
    """Heads in a stretch of numbers that holds a scored one, before they are dealt by number: records next to each other in the order of
    their ids are often found together, so most others are not shuffled."""
    stretch = F.expr(f"number div {STRETCH}").alias("stretch")
    wanted = scored.select(stretch).distinct()
    return heads.withColumn("stretch", stretch).join(F.broadcast(wanted), "stretch", "left_semi").drop("stretch") if row_bound(wanted) else heads


def _evidence(kept: DataFrame, words: DataFrame, triples: DataFrame, allowed) -> DataFrame:
    """Adds ``matches``: the texts of kept resources that hold a word of their query."""
    texts = worded_literals(visible(_of(triples, small(kept.select("resource_id").distinct())), allowed))
    asked = words.groupBy("query_id").agg(F.collect_set("word").alias("asked"))  # a query's own words
    keys = ["query_id", "resource_id"]
    met = (kept.select(*keys).join(small(asked), "query_id").join(texts.select("resource_id", "predicate", "value", "lang", "words"), "resource_id")
           .where(F.arrays_overlap("asked", "words")))
    found = met.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("predicate", "value", "lang"))).alias("matches"))
    return kept.join(found, keys, "left")


def search_postings(queries: DataFrame, index: DataFrame, heads: DataFrame, triples: DataFrame, terms: DataFrame, allowed, limit: int | None = 50,
                    language: str = "ru") -> DataFrame:
    """``search.search_words`` over posting blocks; ``heads`` have the records' ``number``. The index holds current resources only,
    so what is not in an allowed cassette is all that is passed over."""
    check_limit(limit)
    words = cut_lineage(query_words(queries))
    scored = cut_lineage(scored_resources(words, index, allowed, limit))
    there = _near(visible(heads, allowed).select("number", "resource_id", "cassette_id"), scored)
    candidates = cut_lineage(scored.join(there, "number").drop("number"))
    ids = small(candidates.select("resource_id").distinct())
    shown = candidates.join(display_names(triples, allowed, language, ids), "resource_id", "left").withColumn("display_name", F.coalesce("display_name", "resource_id"))
    kept = cut_lineage(top_rows(shown, limit, F.desc("score"), F.upper("display_name"), "resource_id"))
    return with_type(_evidence(kept, words, triples, allowed), triples, terms, allowed, language, small(kept.select("resource_id").distinct())).select(*RESULT)
