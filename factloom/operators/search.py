"""Name and word search, class instances and result shaping, for whole tables of queries at once.

``queries`` has (query_id, query). Every ranking keeps the top rows per query with a window whose limit Spark
applies before the shuffle, so a query that matches a third of all resources moves no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab as v
from ..functions import text
from ..session import cut_lineage, lookup, small
from .access import visible
from .match import visible_heads
from .ontology import descendants
from .portrait import best_name, display_names, summaries, with_type
from .prefix_intervals import rows_under

_EVIDENCE = ("predicate", "value", "lang")


def check_limit(limit: int | None) -> None:
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1, or none for all rows")


def top_rows(rows: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return placed if limit is None else placed.where(F.col("place") <= limit)


def first_places(scored: DataFrame, limit: int | None) -> DataFrame:
    """Rows whose score is among the first ``limit`` of their query, all ties included: what names can still decide."""
    if limit is None:
        return scored
    return scored.withColumn("place", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("place") <= limit).drop("place")


def _ids(kept: DataFrame) -> DataFrame:
    """Ids of kept, materialized results, to read only the statements about them."""
    return small(kept.select("resource_id").distinct())


def query_variants(queries: DataFrame) -> DataFrame:
    """(query_id, search_key, rank): normalized spellings with their best rank."""
    spelled = queries.select("query_id", F.explode(text.spellings("query")).alias("s"))
    return (spelled.select("query_id", text.phrase("s.text").alias("search_key"), F.col("s.rank").alias("rank"))
            .where("search_key <> ''").groupBy("query_id", "search_key").agg(F.max("rank").alias("rank")))


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, word) distinct."""
    return queries.select("query_id", F.explode(F.array_distinct(text.tokens("query"))).alias("word"))


def name_hits(queries: DataFrame, names: DataFrame, allowed) -> DataFrame:
    """Names under any spelling of a query, with ``score`` (3 whole, 2 start, 1 word) and ``rank``.

    ``names`` are ``name_starts``, or ``name_keys`` where all prefixes were written out.
    """
    score = text.name_score("phrase", "search_key")
    variants = cut_lineage(query_variants(queries))
    rows = visible(names, allowed)
    found = rows_under(rows, variants) if "start" in names.columns else lookup(rows, variants, "search_key")
    return (found.join(small(variants), "search_key")
            .select("query_id", "resource_id", *_EVIDENCE, score.alias("score"), (F.col("rank") + score).alias("rank")))


def _evidence(results: DataFrame, hits: DataFrame) -> DataFrame:
    """Adds ``matches``: the distinct matching literals of each kept result, sorted.

    Gathered for kept rows only; a group is one resource's own names or texts.
    """
    keys = ["query_id", "resource_id"]
    found = (hits.select(*keys, *_EVIDENCE).join(small(results.select(*keys)), keys, "left_semi")
             .groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(*_EVIDENCE))).alias("matches")))
    return results.join(found, keys, "left")


RESULT = ("query_id", "place", "resource_id", "display_name", "type", "type_label", "score", "cassette_id", "matches")


def search_names(queries: DataFrame, name_keys: DataFrame, heads: DataFrame, triples: DataFrame, terms: DataFrame,
                 allowed, limit: int | None = 50, language: str = "ru") -> DataFrame:
    """Resources by name or alias: rank, name, id; the name shown is the best of the matching ones. No limit: all of them."""
    check_limit(limit)
    hits = cut_lineage(name_hits(queries, name_keys, allowed))
    candidates = hits.groupBy("query_id", "resource_id").agg(
        F.max("score").alias("score"), F.max("rank").alias("rank"),
        best_name("predicate", "value", "lang", language).alias("display_name"))
    shown = candidates.join(visible_heads(heads, allowed).select("resource_id", "cassette_id"), "resource_id")
    kept = cut_lineage(top_rows(shown, limit, F.desc("rank"), F.upper("display_name"), "resource_id"))
    return with_type(_evidence(kept, hits), triples, terms, allowed, language, _ids(kept)).select(*RESULT)


def search_words(queries: DataFrame, word_index: DataFrame, heads: DataFrame, triples: DataFrame, terms: DataFrame,
                 allowed, limit: int | None = 50, language: str = "ru", preselected: int | None = None) -> DataFrame:
    """Resources by words: score is the number of query words found, then name and id. No limit: all of them.

    ``preselected`` keeps only so many candidates per query, by score and id, before visibility and names count; a
    service that wants short answers may trade results for it.
    """
    check_limit(limit)
    check_limit(preselected)
    words = cut_lineage(query_words(queries))
    hits = lookup(visible(word_index, allowed), words, "word").join(small(words), "word")
    scored = hits.groupBy("query_id", "resource_id").agg(F.size(F.collect_set("word")).cast("long").alias("score"))  # at most the query's words
    if preselected is not None:
        scored = top_rows(scored, preselected, F.desc("score"), "resource_id").drop("place")
    there = scored.join(visible_heads(heads, allowed).select("resource_id", "cassette_id"), "resource_id")
    candidates = cut_lineage(first_places(there, limit))
    shown = candidates.join(display_names(triples, allowed, language, _ids(candidates)), "resource_id", "left").withColumn(
        "display_name", F.coalesce("display_name", "resource_id"))
    kept = cut_lineage(top_rows(shown, limit, F.desc("score"), F.upper("display_name"), "resource_id"))
    return with_type(_evidence(kept, hits), triples, terms, allowed, language, _ids(kept)).select(*RESULT)


def merge_results(names: DataFrame, words: DataFrame, limit: int | None = 50) -> DataFrame:
    """Name results first, then word results not among them; scores by maximum, matches joined by value."""
    keys = ["query_id", "resource_id"]
    n = names.select(*keys, F.col("place").alias("n_place"), F.struct("display_name", "type", "type_label", "cassette_id").alias("n_row"),
                     F.col("score").alias("n_score"), F.col("matches").alias("n_matches"))
    w = words.select(*keys, F.col("place").alias("w_place"), F.struct("display_name", "type", "type_label", "cassette_id").alias("w_row"),
                     F.col("score").alias("w_score"), F.col("matches").alias("w_matches"))
    both = n.join(w, keys, "full_outer")
    new = F.filter("w_matches", lambda x: ~F.exists("n_matches", lambda y: y["value"] == x["value"]))
    matches = (F.when(F.col("n_matches").isNull(), F.col("w_matches")).when(F.col("w_matches").isNull(), F.col("n_matches"))
               .otherwise(F.concat("n_matches", new)))
    merged = both.select(*keys, "n_place", "w_place", F.coalesce("n_row", "w_row").alias("row"),
                         F.greatest("n_score", "w_score").alias("score"), matches.alias("matches"))
    kept = top_rows(merged, limit, F.col("n_place").asc_nulls_last(), F.col("w_place").asc_nulls_last())
    return kept.select("query_id", "place", "resource_id", "row.*", "score", "matches").select(*RESULT)


def type_facets(results: DataFrame) -> DataFrame:
    """(query_id, type, label, n) of results, the unknown type as its own facet; order: n down, label, type."""
    label = F.coalesce(F.when(F.trim("type_label") != "", F.trim("type_label")), "type", F.lit(v.LABEL_NO_TYPE))
    return results.groupBy("query_id", F.coalesce("type", F.lit(v.UNKNOWN_TYPE)).alias("type")).agg(
        F.min(label).alias("label"), F.count("*").alias("n"))


def filter_by_type(results: DataFrame, selected: str | None) -> DataFrame:
    """Results of one facet; null selects all."""
    if selected is None:
        return results
    wanted = None if selected == v.UNKNOWN_TYPE else selected
    return results.where(F.col("type").eqNullSafe(F.lit(wanted)))


def shown_matches(results: DataFrame) -> DataFrame:
    """Results as given out: matches reduced to their distinct values, in order."""
    return results.withColumn("matches", F.array_distinct(F.transform("matches", lambda m: m["value"])))


def class_instances(heads: DataFrame, triples: DataFrame, terms: DataFrame, closure: DataFrame, allowed,
                    class_id: str, language: str = "ru") -> DataFrame:
    """Summaries of all visible resources typed with the class or a descendant; an unknown class is an error."""
    kinds = descendants(closure, class_id).select(F.col("class_id").alias("object_value"))
    if kinds.isEmpty():
        raise ValueError(f"unknown class: {class_id}")
    typed = visible(triples, allowed).where((F.col("predicate") == v.RDF_TYPE) & (F.col("object_kind") == v.IRI))
    ids = typed.join(small(kinds), "object_value", "left_semi").select(F.col("subject").alias("resource_id")).distinct()
    return summaries(heads, triples, terms, allowed, language, ids)


def class_page(instances: DataFrame, offset: int = 0, limit: int | None = 50) -> DataFrame:
    """One page by name and id, with the total on every row; a range sort, no global window.

    A page past the end is one row that has the total only.
    """
    check_limit(limit)
    if offset < 0:
        raise ValueError("offset must not be negative")
    found = cut_lineage(instances)
    page = found.orderBy(F.lower("display_name"), "display_name", "resource_id").offset(offset)
    if limit is not None:
        page = page.limit(limit)
    return page.withColumn("total", F.lit(found.count()).cast("long")) if not page.isEmpty() else found.agg(F.count("*").alias("total")).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields], "total")
