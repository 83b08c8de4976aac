"""Benchmark decontamination over a distributed positional index of the training texts.

Words, postings and matches are DataFrame expressions throughout; there is no Python on the main path.

1. The collection frequency of every benchmark term is counted over all texts. A window with a term that never occurs
   cannot occur.
2. Each window is entered by its two rarest terms; the postings (term, document, position) of such terms are stored.
3. Their lists, shifted by the terms' offsets in the window, are intersected: what remains are possible starts.
4. A start is a match if the text has the whole window there. Texts without a possible start are not read for this.

The benchmark's tables are stored first, so Spark broadcasts them by their known size and shuffles where they are too
large. Frequent terms are never entered unless a window has nothing rarer; lists are joined, never collected.

Edge cases: null texts have no words; a benchmark item of fewer words than a window is one window, one without words
is none; an item without an id is called ``null``; rows that share an id are judged each by its own text; rows without
an id are judged as well; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import small
from .common import query, stored, table

WINDOW_WORDS = 10
LISTED_ROWS = 1_000_000  # candidate documents (two numbers each) that may be broadcast to thin out the texts

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(1 << 63)


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; ASCII texts take the faster function."""
    text = F.coalesce(text, F.lit(""))
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(folded, _BREAKS), "")


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows told apart by id and text."""
    return docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(F.coalesce(text_column, F.lit(""))).alias("copy"),
                       F.col(text_column).alias("text"))


def windows_of(items: DataFrame, length: int = WINDOW_WORDS, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """``item, window, terms``: every window of every item, numbered by content."""
    worded = items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("item"), words_of(F.col(text_column)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - length + 1, F.lit(1)))
    listed = worded.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), F.lit(length)).alias("terms"))
    return listed.distinct().withColumn("window", F.sha2(F.array_join("terms", " "), 256))


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc", "copy", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))


class PositionalIndex:
    """Stored postings of the terms by which the items' windows are entered."""

    def __init__(self, docs: DataFrame, items: DataFrame, length: int = WINDOW_WORDS, id_column: str = "doc_id", text_column: str = "text"):
        self.docs = _keyed(docs, id_column, text_column)
        self.windows = stored(windows_of(items, length), "windows")
        vocabulary = stored(self.windows.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
        counted = _tokens(self.docs).join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        self.frequency = stored(vocabulary.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n")), "frequency")
        contents = self.windows.select("window", "terms").distinct()
        ranked = (contents.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term")).join(self.frequency, "term")
                  .withColumns({"rank": F.row_number().over(Window.partitionBy("window").orderBy("n", "term", "offset")),
                                "least": F.min("n").over(Window.partitionBy("window"))}))
        self.entries = stored(ranked.where("rank <= 2 AND least > 0").select("window", "size", "rank", "offset", "term"), "window-entries")
        entered = stored(self.entries.select("term").distinct(), "entered-terms")
        self.postings = stored(_tokens(self.docs).join(entered, "term"), "postings")

    def possible_starts(self) -> DataFrame:
        """``doc, copy, window, start`` where both of a window's rarest terms stand at their offsets."""
        shifted = (self.postings.join(self.entries, "term")
                   .select("doc", "copy", "window", "size", "rank", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0"))
        first = shifted.where("rank = 1").drop("rank")
        second = shifted.where("rank = 2").select("doc", "copy", "window", "start")
        return (first.where("size > 1").join(second, ["doc", "copy", "window", "start"], "left_semi").drop("size")
                .union(first.where("size = 1").drop("size")))

    def phrase_matches(self) -> DataFrame:
        """``doc, copy, item, start, size``: every exact occurrence of a window."""
        starts = self.possible_starts().join(self.windows.select("window", "terms").distinct(), "window")
        listed = stored(starts.groupBy("doc", "copy").agg(F.collect_set(F.struct("start", "window", "terms")).alias("starts")), "possible-starts")
        texts = self.docs.join(small(listed.select("doc", "copy"), LISTED_ROWS), ["doc", "copy"], "left_semi").dropDuplicates(["doc", "copy"])
        worded = texts.select("doc", "copy", words_of(F.col("text")).alias("words")).join(listed, ["doc", "copy"])
        right = F.filter("starts", lambda s: F.slice(F.col("words"), s["start"] + 1, F.size(s["terms"])) == s["terms"])
        found = worded.select("doc", "copy", F.explode(right).alias("m")).select("doc", "copy", "m.window", "m.start", F.size("m.terms").alias("size"))
        return stored(found.join(self.windows.select("item", "window"), "window").select("doc", "copy", "item", "start", "size"), "matches")

    def near_matches(self, within: int = 20) -> DataFrame:
        """``doc, copy, item``: items of which a window's terms stand within ``within`` words in any order.

        Terms that the texts lack are left out; a window with fewer than half of its terms in the texts is not looked for.
        Windows are entered by their two rarest terms that occur, then all that occur are looked for around the rarest.
        """
        contents = self.windows.select("window", F.array_distinct("terms").alias("terms")).distinct()
        ranked = (contents.select("window", F.size("terms").alias("of"), F.explode("terms").alias("term")).join(self.frequency.where("n > 0"), "term")
                  .withColumns({"rank": F.row_number().over(Window.partitionBy("window").orderBy("n", "term")),
                                "present": F.count(F.lit(1)).over(Window.partitionBy("window"))}))
        wanted = stored(ranked.where("2 * present >= of").select("window", "term", "rank", "present"), "near-terms")
        entries = wanted.where("rank <= 2")
        postings = stored(_tokens(self.docs).join(small(entries.select("term").distinct()), "term"), "near-postings")
        met = postings.join(small(entries), "term").select("doc", "copy", "window", "rank", "present", "pos", F.floor(F.col("pos") / within).alias("part"))
        parts = F.array(*[F.col("part") + k for k in (-1, 0, 1)])
        first = met.where("rank = 1")
        second = met.where("rank = 2").select("doc", "copy", "window", "part")
        anchors = (first.where("present > 1").withColumn("part", F.explode(parts)).join(second, ["doc", "copy", "window", "part"], "left_semi")
                   .union(first.where("present = 1").select("doc", "copy", "window", "part", "rank", "present", "pos")).select("doc", "copy", "window", "pos").distinct())
        terms = wanted.groupBy("window").agg(F.collect_set("term").alias("terms"))  # at most a window's words
        listed = stored(anchors.join(terms, "window").groupBy("doc", "copy").agg(F.collect_set(F.struct("pos", "window", "terms")).alias("anchors")), "near-anchors")
        texts = self.docs.join(small(listed.select("doc", "copy"), LISTED_ROWS), ["doc", "copy"], "left_semi").dropDuplicates(["doc", "copy"])
        worded = texts.select("doc", "copy", words_of(F.col("text")).alias("words")).join(listed, ["doc", "copy"])
        right = F.filter("anchors", lambda s: F.exists(F.sequence(F.greatest(s["pos"] - within + 2, F.lit(1)), s["pos"] + 1),
                                                       lambda k: F.size(F.array_except(s["terms"], F.slice(F.col("words"), k, within))) == 0))
        found = worded.select("doc", "copy", F.explode(F.array_distinct(F.transform(right, lambda s: s["window"]))).alias("window"))
        return stored(found.join(self.windows.select("item", "window"), "window").select("doc", "copy", "item").distinct(), "near-matches")

    def proximity_matches(self, terms: int = 3, within: int = 20) -> DataFrame:
        """``doc, copy, item, start, stop``: places where the item's ``terms`` rarest entered terms stand within ``within`` words."""
        rank = F.row_number().over(Window.partitionBy("item").orderBy("n", "term"))
        wanted = (self.windows.select("item", F.explode("terms").alias("term")).distinct().join(self.entries.select("term").distinct(), "term")
                  .join(self.frequency, "term").withColumn("place", rank).where(F.col("place") <= terms))
        full = wanted.groupBy("item").agg(F.count(F.lit(1)).alias("of"))
        met = self.postings.join(wanted.join(full, "item").select("item", "term", "place", "of"), "term")
        upto = Window.partitionBy("doc", "copy", "item").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        last = [F.last(F.when(F.col("place") == k, F.col("pos")), ignorenulls=True).over(upto) for k in range(1, terms + 1)]
        seen = met.select("doc", "copy", "item", "of", F.col("pos").alias("stop"), F.array(*last).alias("last")).withColumn("last", F.array_compact("last"))
        return (seen.where((F.size("last") == F.col("of")) & (F.col("stop") - F.array_min("last") < within))
                .select("doc", "copy", "item", F.array_min("last").alias("start"), (F.col("stop") + 1).alias("stop")))


def contamination(docs: DataFrame, items: DataFrame, length: int = WINDOW_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    index = PositionalIndex(docs, items, length, id_column, text_column)
    matches = index.phrase_matches()
    hit = (matches.select("doc", "copy", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
           .groupBy("doc", "copy").agg(F.count(F.lit(1)).alias("n_hit")))
    found = matches.groupBy("doc", "copy").agg(F.sort_array(F.collect_set("item")).alias("items"))
    counted = index.docs.select("doc", "copy", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return (counted.join(hit.join(found, ["doc", "copy"]), ["doc", "copy"], "left")
            .select(F.nullif("doc", F.lit(_NO_ID)).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
                    F.col("n_hit").isNotNull().alias("contaminated")))


def near_items(docs: DataFrame, items: DataFrame, length: int = WINDOW_WORDS, within: int = 20) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_near_items`` (items with a window near, exactly or in other order or with unknown words)."""
    index = PositionalIndex(docs, items, length)
    found = index.near_matches(within).groupBy("doc", "copy").agg(F.count(F.lit(1)).alias("n"))
    return (index.docs.select("doc", "copy").join(found, ["doc", "copy"], "left")
            .select(F.nullif("doc", F.lit(_NO_ID)).alias("doc_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_near_items")))


def clean_documents(docs: DataFrame, items: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with all their columns."""
    doc, copy = "_doc", "_copy"
    while {doc, copy} & set(docs.columns):
        doc, copy = doc + "_", copy + "_"
    matches = PositionalIndex(docs, items, length).phrase_matches().select(F.col("doc").alias(doc), F.col("copy").alias(copy)).distinct()
    return docs.join(matches, (F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)) == matches[doc])
                     & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == matches[copy]), "left_anti")


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


@query("op5_positional_index", f"""
WITH items AS MATERIALIZED (SELECT item_id::VARCHAR AS item, {_WORDS} AS words FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item, least(10, len(words)) AS size, array_to_string(words[i:i + 9], ' ') AS body
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items WHERE len(words) > 0)),
worded AS MATERIALIZED (SELECT doc_id, {_WORDS} AS words FROM documents),
lengths AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM worded, lengths WHERE len(words) >= size),
matches AS MATERIALIZED (
  SELECT p.doc_id, w.item, p.i, p.size FROM (SELECT doc_id, i, size, array_to_string(words[i:i + size - 1], ' ') AS body FROM places) p
  JOIN windows w ON w.body = p.body AND w.size = p.size),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM matches) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM matches) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(f.n, 0)::BIGINT AS n_items,
       sha256(coalesce(f.listed, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM worded d LEFT JOIN hits h USING (doc_id) LEFT JOIN found f USING (doc_id)""")
def op5_positional_index(spark, folder):
    """Benchmark windows in all documents."""
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_near_items")
def op5_near_items(spark, folder):
    """Benchmark items near in all documents."""
    return near_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
