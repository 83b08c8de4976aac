"""Ontology files: classes, properties and enumerations as ``schemas.TERMS`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import vocab as v
from ..functions.ids import is_blank
from ..operators.ontology import unique_terms
from .files import read_elements

_KINDS = (v.CLASS, v.DATATYPE_PROPERTY, v.OBJECT_PROPERTY, v.ENUMERATION)


def read_ontology(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """Terms of the file or folder with their ``position``; a term without id or a repeated id is an error."""
    elements = read_elements(spark, [path], glob).where(F.col("name").isin(*_KINDS))

    def attr(of: Column, name: str) -> Column:
        return F.try_element_at(of, F.lit(name))

    def children(name: str) -> Column:
        return F.filter("children", lambda x: x["name"] == name)

    def labels(name: str) -> Column:
        return F.transform(children(name), lambda x: F.struct(x["value"].alias("value"), attr(x["attrs"], "xml:lang").alias("lang")))

    def resources(name: str) -> Column:
        return F.array_distinct(F.filter(F.transform(children(name), lambda x: attr(x["attrs"], "rdf:resource")), lambda x: ~is_blank(x)))

    def flag(name: str, kinds: tuple[str, ...]) -> Column:
        return F.col("name").isin(*kinds) & F.coalesce(F.lower(attr(F.col("attrs"), name)).isin("yes", "true", "1"), F.lit(False))

    states = F.filter(
        F.transform(children("state"), lambda x: F.struct(
            attr(x["attrs"], "value").alias("value"), x["value"].alias("label"), attr(x["attrs"], "xml:lang").alias("lang"))),
        lambda s: ~is_blank(s["value"]))
    about = attr(F.col("attrs"), "rdf:about")
    terms = elements.select(
        F.coalesce(about, F.raise_error(F.concat(F.lit("term without id in "), "source_path")).cast("string")).alias("id"),
        F.col("name").alias("kind"), labels("label").alias("labels"), labels("inverse-label").alias("inverse_labels"),
        attr(F.col("attrs"), "priority").alias("priority"),
        attr(F.get(children("SubClassOf"), 0)["attrs"], "rdf:resource").alias("parent"),
        resources("domain").alias("domains"), resources("range").alias("ranges"), states.alias("states"),
        flag("abstract", (v.CLASS,)).alias("is_abstract"), flag("essential", (v.DATATYPE_PROPERTY, v.OBJECT_PROPERTY)).alias("is_essential"),
        F.col("ordinal").alias("position"))
    return unique_terms(terms)
