"""Registered queries against their SQL on the smallest driver tables, where those are present."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")

import __spark_entry__ as entry_point  # noqa: E402

# one or two of every family; tools/check.py runs all of them
CHOSEN = ("m2_substitution_closure", "m8_current_records", "m9_statistics", "p1_stable_ids", "p3_triples", "p5_name_keys", "p6_document_words",
          "q1_match_patterns", "q9_first_literal", "a1_cassette_rights", "a7_configuration_faults", "f1_query_variants", "f6_search_names", "f7_search_words",
          "f9_merge_results", "f12_suggest_classes", "h1_ancestors", "h8_validation_issues", "r1_portraits", "r8_presented", "g2_collection_contents",
          "g5_potential_duplicates", "g13_merged_links", "g14_relation_entries", "g17_photo_cards", "g23_completed_entries", "c2_revision_times",
          "d2_document_locations", "d7_preview_backlog", "v2_write_violations", "w1_append_revisions", "x1_incremental_current")


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for name in os.listdir(FOLDER):
        found.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return found


@pytest.mark.parametrize("name", CHOSEN)
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    df = entry_point.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_every_query_has_sql():
    from factloom import plans

    assert set(plans.queries()) == set(plans.oracle_sql())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
