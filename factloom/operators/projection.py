"""Current records to heads, triples and the two search tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab as v
from ..functions import text
from ..functions.ids import stable_id


def _with_source(current: DataFrame) -> DataFrame:
    return (
        current
        .withColumn("cassette_id", F.coalesce("cassette_id", F.lit(v.SYSTEM_CASSETTE)))
        .withColumn("source_path", F.coalesce("source_path", F.lit(v.SYNTHETIC_PATH))))


def _record_id(resource: str) -> Column:
    ordinal = F.coalesce(F.col("ordinal").cast("string"), F.lit(v.SYNTHETIC_ORDINAL))
    return stable_id(F.lit("source-record"), "cassette_id", "source_path", ordinal, resource)


def plain_heads(current: DataFrame, *more: str) -> DataFrame:
    """Heads without their ids, but with the ``ordinal`` that ids are made of: what is stored."""
    return _with_source(current).select(
        "resource_id", "cassette_id", "source_path", "modified_at", F.lit(False).alias("is_deleted"), "ordinal", *more)


def heads_with_ids(plain: DataFrame, *more: str) -> DataFrame:
    """Heads of ``plain_heads``; ids are hashes computed only where selected."""
    return plain.select(
        "resource_id", _record_id("resource_id").alias("source_record_id"), "cassette_id", "source_path", "modified_at",
        "is_deleted", *more)


def heads(current: DataFrame, *more: str) -> DataFrame:
    """One row per current resource with its source, and ``more`` columns of the record."""
    return heads_with_ids(plain_heads(current, *more), *more)


def _statements(current: DataFrame, *more: str) -> DataFrame:
    """The type statement and one statement per property, with their place ``pos`` in the record (the type has -1)."""
    no_text = F.lit(None).cast("string")
    type_row = F.struct(
        F.lit(v.RDF_TYPE).alias("predicate"), F.lit(v.RESOURCE).alias("kind"), F.col("type").alias("value"),
        no_text.alias("lang"), no_text.alias("datatype"))
    rows = _with_source(current).select(
        "resource_id", "ordinal", *more, "cassette_id", "source_path", "modified_at",
        F.posexplode(F.concat(F.array(type_row), "props")).alias("pos", "p"))
    return rows.select(
        F.col("resource_id").alias("subject"), F.col("p.predicate").alias("predicate"),
        F.when(F.col("p.kind") == v.RESOURCE, F.lit(v.IRI)).otherwise(F.lit(v.LITERAL)).alias("object_kind"),
        F.col("p.value").alias("object_value"), F.col("p.lang").alias("lang"), F.col("p.datatype").alias("datatype"),
        (F.col("pos") - 1).alias("pos"), *[c for c in rows.columns if c not in ("resource_id", "pos", "p")])


def plain_triples(current: DataFrame) -> DataFrame:
    """Statements without their ids, but with the ``ordinal`` and ``pos`` that ids are made of: what is stored."""
    return _statements(current)


def _with_triple_id(statements: DataFrame) -> DataFrame:
    return statements.select(
        stable_id(F.lit("triple"), "source_record_id", F.col("pos").cast("string"), "subject", "predicate",
                  F.when(F.col("object_kind") == v.IRI, F.lit("1")).otherwise(F.lit("2")), "object_value", "lang", "datatype").alias("triple_id"),
        "subject", "predicate", "object_kind", "object_value", "lang", "datatype", "source_record_id", "cassette_id", "source_path",
        "modified_at")


def triples_with_ids(plain: DataFrame) -> DataFrame:
    """Statements of ``plain_triples`` with their ids, hashes computed only where selected."""
    return _with_triple_id(plain.withColumn("source_record_id", _record_id("subject")))


def triples(current: DataFrame) -> DataFrame:
    """The type statement and one statement per property; ids are hashes computed only where selected, a record's once for all of its."""
    numbered = _with_source(current).withColumn("source_record_id", _record_id("resource_id"))
    return _with_triple_id(_statements(numbered, "source_record_id"))


def _search_rows(statements: DataFrame, predicates: tuple[str, ...]) -> DataFrame:
    lang = F.when(F.col("lang") != "", F.col("lang"))
    return (statements.where((F.col("object_kind") == v.LITERAL) & F.col("predicate").isin(*predicates))
            .select("triple_id", F.col("subject").alias("resource_id"), "predicate",
                    F.col("object_value").alias("value"), lang.alias("lang"), "cassette_id",
                    text.tokens("object_value").alias("words")))


def named_literals(statements: DataFrame) -> DataFrame:
    """Names and aliases with their ``words``."""
    return _search_rows(statements, v.NAME_PREDICATES)


def worded_literals(statements: DataFrame) -> DataFrame:
    """Literals that word search looks at, with their ``words``."""
    return _search_rows(statements, v.WORD_PREDICATES)


def name_keys(statements: DataFrame) -> DataFrame:
    """One row per name literal and distinct prefix of its phrase or of one of its words: a view for lookups of single keys.

    What is stored for search is ``prefix_intervals.name_starts``. ``phrase`` is the normalized whole name, kept so that
    ranking need not normalize again.
    """
    return named_literals(statements).select(
        "triple_id", F.explode(text.prefix_keys("words")).alias("search_key"), "resource_id", "predicate", "value",
        "lang", "cassette_id", F.array_join("words", " ").alias("phrase")).select(
        stable_id(F.lit("name-search"), "triple_id", "search_key").alias("row_id"),
        "search_key", "resource_id", "predicate", "value", "lang", "cassette_id", "phrase")


def word_index(statements: DataFrame) -> DataFrame:
    """One row per searchable literal and distinct word: a view; what is stored for search are ``postings``."""
    return worded_literals(statements).select(
        "triple_id", F.explode(F.array_distinct("words")).alias("word"), "resource_id", "predicate", "value", "lang",
        "cassette_id").select(
        stable_id(F.lit("word-search"), "triple_id", "word").alias("row_id"),
        "word", "resource_id", "predicate", "value", "lang", "cassette_id")


def build_counts(head_rows: DataFrame, statements: DataFrame, names: DataFrame, words: DataFrame) -> DataFrame:
    """(part, n_rows) of the four derived tables."""
    parts = (("resources", head_rows), ("triples", statements), ("name_keys", names), ("word_index", words))
    out = None
    for part, df in parts:
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(part).alias("part"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out
