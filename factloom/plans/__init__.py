"""Registered queries over the star-schema tables."""

from . import graph_queries, log_queries, ontology_queries, portrait_queries, quality_queries, relation_queries, search_queries, source_queries  # noqa: F401  (register themselves)
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
