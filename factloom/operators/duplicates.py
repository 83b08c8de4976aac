"""Resources that may already hold a value about to be entered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import vocab as v
from ..functions import text
from ..session import cut_lineage, small
from .access import visible
from .match import visible_heads
from .search import check_limit, name_hits, query_variants

MAX_LENGTH = 512


def _on_text_properties(requests: DataFrame, terms: DataFrame) -> DataFrame:
    """Requests (request_id, type, predicate, value) on text properties, values trimmed."""
    non_text = F.array(*[F.lit(r) for r in v.NON_TEXT_RANGES])
    fit = terms.where((F.col("kind") == v.DATATYPE_PROPERTY) & (F.size("states") == 0) & ~F.arrays_overlap("ranges", non_text))
    asked = requests.withColumn("value", F.regexp_replace("value", r"(?U)^\s+|\s+$", ""))
    return asked.join(small(fit.select(F.col("id").alias("predicate"))), "predicate", "left_semi")


def comparable_requests(requests: DataFrame, terms: DataFrame) -> DataFrame:
    """Requests on text properties with a value of 1 to ``MAX_LENGTH`` characters."""
    return _on_text_properties(requests, terms).where(F.length("value").between(1, MAX_LENGTH))


def refused_requests(requests: DataFrame, terms: DataFrame) -> DataFrame:
    """(request_id, reason) of the requests that are not compared: ``no_text_property``, ``no_value``, ``value_too_long``."""
    fit = _on_text_properties(requests, terms)
    other = requests.join(fit.select("request_id"), "request_id", "left_anti").select("request_id", F.lit("no_text_property").alias("reason"))
    reason = F.when(F.coalesce(F.length("value"), F.lit(0)) == 0, "no_value").when(F.length("value") > MAX_LENGTH, "value_too_long")
    return other.unionByName(fit.select("request_id", reason.alias("reason")).where("reason is not null"))


def potential_duplicates(requests: DataFrame, nodes: DataFrame, heads: DataFrame, triples: DataFrame, name_keys: DataFrame,
                         terms: DataFrame, closure: DataFrame, allowed, limit: int | None = None, language: str = "ru") -> DataFrame:
    """(request_id, place, resource_id, display_name, type, type_label, predicate, matched_value, alternative).

    Exact values of the same property, then, for names and aliases, the same or another spelling of the whole value.
    Only resources of the requested type or below it. A resource keeps its best match: exact, same words, alternative.
    Equal requests are answered once and fanned out at the end; ``limit`` keeps the first of each request.
    """
    check_limit(limit)
    requested = comparable_requests(requests, terms)
    asked = cut_lineage(requested.select("type", "predicate", "value").distinct())
    values = asked.select("predicate", "value").distinct()
    literals = visible(triples, allowed, system=False).where(F.col("object_kind") == v.LITERAL)
    keys = ["predicate", "value"]
    exact = (literals.select(F.col("subject").alias("resource_id"), "predicate", F.col("object_value").alias("value"))
             .join(values, keys, "left_semi").distinct().select("resource_id", *keys, F.col("value").alias("matched"), F.lit(0).alias("kind")))

    # other spellings of the whole value: name hits one of whose own spellings is one of the value's
    names = values.where(F.col("predicate").isin(*v.NAME_PREDICATES)).select("value").distinct()
    queries = names.select(F.col("value").alias("query_id"), F.col("value").alias("query"))
    found = cut_lineage(
        name_hits(queries, name_keys, allowed).join(visible_heads(heads, allowed).select("resource_id"), "resource_id", "left_semi")
        .select(F.col("query_id").alias("entered"), "resource_id", "predicate", F.col("value").alias("matched")).distinct()
        .join(values.select("predicate", F.col("value").alias("entered")), ["predicate", "entered"], "left_semi"))
    written = query_variants(found.select(F.col("matched").alias("query_id"), F.col("matched").alias("query")).distinct()).select(
        F.col("query_id").alias("matched"), "search_key")
    spellings = query_variants(queries).select(F.col("query_id").alias("entered"), "search_key")
    same = found.select("entered", "matched").distinct().join(written, "matched").join(spellings, ["entered", "search_key"]).select("entered", "matched").distinct()
    spelled = found.join(same, ["entered", "matched"]).select(
        "resource_id", "predicate", F.col("entered").alias("value"), "matched",
        F.when(text.phrase("matched") != text.phrase("entered"), 2).otherwise(1).alias("kind"))

    best = (exact.unionByName(spelled).groupBy("resource_id", *keys).agg(F.min(F.struct("kind", "matched")).alias("c"))
            .select("resource_id", *keys, (F.col("c.kind") == 2).alias("alternative"), F.col("c.matched").alias("matched_value")))
    shown = nodes.select("resource_id", "display_name", "type", "type_label")
    below = small(closure.select(F.col("class_id").alias("type"), F.col("ancestor_id").alias("wanted")))
    typed = (best.join(shown, "resource_id").join(asked.withColumnRenamed("type", "wanted"), keys)
             .join(below, ["type", "wanted"], "left_semi"))
    order = Window.partitionBy("wanted", *keys).orderBy("alternative", F.lower("matched_value"), "matched_value", "resource_id")
    placed = typed.withColumn("place", F.row_number().over(order))
    kept = placed if limit is None else placed.where(F.col("place") <= limit)
    return (kept.join(requested.select("request_id", F.col("type").alias("wanted"), *keys), ["wanted", *keys])
            .select("request_id", "place", "resource_id", "display_name", "type", "type_label", "predicate", "matched_value", "alternative"))
