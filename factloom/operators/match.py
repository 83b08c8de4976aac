"""Lookups over heads, triples and search tables. All are filters or equi-joins the scan can prune by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab as v
from ..functions.ids import is_blank
from ..session import lookup, small
from .access import visible

_BOUND = ("subject", "predicate", "object_kind", "object_value")


def find_triples(triples: DataFrame, allowed, subject=None, predicate=None, object_kind=None, object_value=None) -> DataFrame:
    """Statements with the given parts, in the allowed cassettes. No built-in cassette is added here."""
    found = visible(triples, allowed, system=False)
    for name, value in zip(_BOUND, (subject, predicate, object_kind, object_value)):
        if value is not None:
            found = found.where(F.col(name) == value)
    return found


FILTER_BITS = 1 << 17  # of the filter of one combination of bound parts


def _may_match(patterns: DataFrame, shape: Column, bound: str) -> Column:
    """True for statements whose bound parts hash to a bit that some pattern of the shape has set."""
    parts = [c for c, b in zip(_BOUND, bound) if b == "+"]
    if not parts:
        return F.lit(True)
    place = F.pmod(F.xxhash64(*parts), F.lit(FILTER_BITS))
    words = [0] * (FILTER_BITS // 64)
    for (at,) in patterns.where(shape == bound).select(place).distinct().collect():  # no more rows than bits
        words[at // 64] |= 1 << at % 64
    # one literal text, folded to an array when the plan is optimized
    bits = F.split(F.lit(",".join(str(w - (1 << 64) if w >> 63 else w) for w in words)), ",").cast("array<bigint>")
    word = F.get(bits, F.floor(place / 64).cast("int"))
    return F.getbit(word, (place % 64).cast("int")) == 1


def match_patterns(triples: DataFrame, patterns: DataFrame, allowed) -> DataFrame:
    """All (pattern_id, statement) matches of a table of patterns, where a null part matches anything.

    Every statement is keyed once per combination of bound parts that occurs among the patterns, so the triples
    are read once and matched by one equi-join. Before that, a filter of each combination's hashes passes over the
    statements, and the combinations of a statement, that no pattern can match. A pattern that binds nothing matches
    every statement, as it must.
    """
    rows = visible(triples, allowed, system=False)
    shape = F.concat(*[F.when(F.col(c).isNull(), "-").otherwise("+") for c in _BOUND])
    shapes = sorted(r["shape"] for r in patterns.select(shape.alias("shape")).distinct().limit(16).collect())  # 2^4 at most
    wanted = small(patterns.select("pattern_id", shape.alias("shape"), *[F.col(c).alias(f"want_{c}") for c in _BOUND]))

    def key(bound: str) -> Column:
        return F.struct(F.lit(bound).alias("shape"), *[
            (F.col(c) if b == "+" else F.lit(None).cast("string")).alias(f"want_{c}") for c, b in zip(_BOUND, bound)])

    may = {s: _may_match(patterns, shape, s) for s in shapes}
    flagged = rows.withColumns({f"_may{i}": m for i, m in enumerate(may.values())})
    possible = F.array_compact(F.array(*[F.when(F.col(f"_may{i}"), key(s)) for i, s in enumerate(shapes)])) if shapes else F.array(key("----"))
    any_ = F.lit(not shapes)
    for i in range(len(shapes)):
        any_ = any_ | F.col(f"_may{i}")
    keyed = flagged.where(any_).withColumn("key", F.explode(possible)).select(*triples.columns, "key.*")
    same = keyed["shape"] == wanted["shape"]
    for c in _BOUND:
        same = same & keyed[f"want_{c}"].eqNullSafe(wanted[f"want_{c}"])
    return keyed.join(wanted, same).select("pattern_id", *[keyed[c] for c in triples.columns])


def find_heads(heads: DataFrame, ids: DataFrame | str) -> DataFrame:
    """Heads of one id, or of a table whose first column holds ids."""
    if isinstance(ids, str):
        return heads.where(F.col("resource_id") == ids)
    return lookup(heads, ids.select(F.col(ids.columns[0]).alias("resource_id")), "resource_id")


def visible_heads(heads: DataFrame, allowed) -> DataFrame:
    return visible(heads.where(~F.col("is_deleted")), allowed)


_NAME_HIT = ("resource_id", "predicate", "value", "lang", "cassette_id")


def names_by_key(name_keys: DataFrame, keys: DataFrame, allowed) -> DataFrame:
    """Name rows stored under the normalized keys (first column of ``keys``)."""
    wanted = keys.select(F.col(keys.columns[0]).alias("search_key"))
    return lookup(visible(name_keys, allowed, system=False), wanted, "search_key").select("search_key", *_NAME_HIT)


def names_by_resource(name_keys: DataFrame, ids: DataFrame, allowed) -> DataFrame:
    """Distinct names of the resources."""
    wanted = ids.select(F.col(ids.columns[0]).alias("resource_id"))
    return (visible(name_keys, allowed, system=False).join(wanted, "resource_id", "left_semi")
            .select(*_NAME_HIT).distinct())


def find_words(word_index: DataFrame, words: DataFrame, allowed) -> DataFrame:
    """Word rows of the normalized words (first column of ``words``)."""
    wanted = words.select(F.col(words.columns[0]).alias("word"))
    return lookup(visible(word_index, allowed, system=False), wanted, "word").select("word", *_NAME_HIT)


def resource_types(triples: DataFrame, allowed) -> DataFrame:
    """(resource_id, type) distinct."""
    rows = visible(triples, allowed).where((F.col("predicate") == v.RDF_TYPE) & (F.col("object_kind") == v.IRI))
    return rows.select(F.col("subject").alias("resource_id"), F.col("object_value").alias("type")).distinct()


def first_type(triples: DataFrame, allowed) -> DataFrame:
    """(resource_id, type): the alphabetically first type."""
    rows = visible(triples, allowed).where((F.col("predicate") == v.RDF_TYPE) & (F.col("object_kind") == v.IRI))
    return rows.groupBy(F.col("subject").alias("resource_id")).agg(F.min("object_value").alias("type"))


def links(triples: DataFrame, allowed, predicate: str | None = None) -> DataFrame:
    """(source_id, predicate, target_id, cassette_id) of resource-valued statements other than types."""
    rows = visible(triples, allowed).where((F.col("object_kind") == v.IRI) & (F.col("predicate") != v.RDF_TYPE))
    if predicate is not None:
        rows = rows.where(F.col("predicate") == predicate)
    return rows.select(F.col("subject").alias("source_id"), "predicate", F.col("object_value").alias("target_id"), "cassette_id")


def direct_targets(triples: DataFrame, allowed, predicate: str) -> DataFrame:
    """(resource_id, target_id) distinct, along the predicate."""
    return links(triples, allowed, predicate).select(F.col("source_id").alias("resource_id"), "target_id").distinct()


def inverse_sources(triples: DataFrame, allowed, predicate: str) -> DataFrame:
    """(resource_id, source_id) distinct, against the predicate."""
    return links(triples, allowed, predicate).select(F.col("target_id").alias("resource_id"), "source_id").distinct()


def existing_links(triples: DataFrame, wanted: DataFrame, allowed) -> DataFrame:
    """Those rows of ``wanted`` (subject, predicate, target_id) that the triples hold."""
    held = (visible(triples, allowed, system=False).where(F.col("object_kind") == v.IRI)
            .select("subject", "predicate", F.col("object_value").alias("target_id")))
    return wanted.join(held, ["subject", "predicate", "target_id"], "left_semi")


def first_literal(triples: DataFrame, allowed, predicate: str) -> DataFrame:
    """(resource_id, value): first non-blank literal by language, then text."""
    rows = visible(triples, allowed).where(
        (F.col("object_kind") == v.LITERAL) & (F.col("predicate") == predicate) & ~is_blank("object_value"))
    first = F.min(F.struct(F.coalesce("lang", F.lit("")).alias("lang"), "object_value"))
    return rows.groupBy(F.col("subject").alias("resource_id")).agg(first["object_value"].alias("value"))
