"""All queries of the subpackage, registered on import."""

from . import best_fit_packing, chat_format, content_sort, dense_search, fertility_rules, license_scan, ngram_join, positional_index, prefix_trie, separator_scan, substring_doubling, toxic_segments, warc_writer  # noqa: F401  (register themselves)
from .common import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
