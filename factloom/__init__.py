"""Fact-graph analytics on Spark: append-only revision logs to current records, search, portraits and reports."""

__version__ = "0.1.0"
