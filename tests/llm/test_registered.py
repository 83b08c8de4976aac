"""Every registered query of the subpackage has SQL, or a test against a brute-force version."""

import __spark_entry__ as entry_point
from factloom.llm import queries

from . import test_advice_r02, test_documents, test_fertility_rules, test_pipeline, test_toxic_segments

# queries that SQL cannot express, and their tests
BRUTE_FORCE = {
    "op1_separator_scan": test_documents.test_separator_scan, "op4_toxic_segments": test_toxic_segments.test_held_out_accuracy,
    "op5_near_items": test_advice_r02.test_near_items, "op7_best_fit_packing": test_documents.test_packing,
    "op9_license_windows": test_advice_r02.test_notices_against_all_windows, "op13_tokenizer_fertility": test_fertility_rules.test_measures_against_plain_versions,
    "pipeline": test_pipeline.test_pipeline_against_brute_force}


def test_sql_or_brute_force():
    assert {*queries.queries(), "pipeline"} == {*queries.oracle_sql(), *BRUTE_FORCE} and all(callable(x) for x in BRUTE_FORCE.values())


def test_all_dealt_operators_are_registered():
    numbers = {int(name[2:].split("_")[0]) for name in queries.queries()}
    assert numbers == set(range(1, 14)) and {*queries.queries(), "pipeline"} <= {*entry_point.queries()}
