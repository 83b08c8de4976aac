"""Statements are published in rounds of predicates: no round shuffles more than its share, and none is lost."""

from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from factloom.operators import materialize, projection as p
from factloom.sources import published

from .helpers import prop, records, ref


def test_rounds_hold_every_predicate_once(spark):
    counts = {"type": 50, "name": 20, "a": 9, "b": 8, "c": 7, "d": 5, None: 1}
    statements = spark.createDataFrame([(x,) for x, n in counts.items() for _ in range(n)], "predicate string")
    rounds = published.predicate_rounds(statements, 4)
    assert Counter(x for r in rounds for x in r) == Counter(list(counts))
    assert rounds[0] == ["type"] and all(sum(counts[x] for x in r) <= 25 for r in rounds[1:])
    assert sum(published._of_round(statements, r).count() for r in rounds) == 100
    assert published.predicate_rounds(statements.limit(0)) == []


def test_statements_are_written_round_by_round(spark, tmp_path, monkeypatch):
    made = [("resource", f"id{i}", 2020, [prop("name", f"Name {i}"), ref("friend", f"id{i // 2}"), *[prop(f"p{k}", str(i)) for k in range(8)]]) for i in range(30)]
    current = materialize.current_records(records(spark, *made))
    seen, held = [], published._of_round
    monkeypatch.setattr(published, "_of_round", lambda rows, some: seen.append(some) or held(rows, some))
    done = published.publish(current, str(tmp_path), "v1", 2)
    assert len(seen) >= published.ROUNDS - 1
    shown = lambda df: sorted(map(str, df.select([F.col(c).cast("string") for c in df.columns]).collect()))
    assert shown(done.read(spark, "triples")) == shown(p.triples(current))
    assert done.counts["triples"] == done.counts["triples_by_subject"] == p.triples(current).count()


def test_ids_are_stored_as_differences(spark, tmp_path):
    current = materialize.current_records(records(spark, *[("resource", f"a long name that all have {i:06d}", 2020, [prop("name", "N")]) for i in range(3000)]))
    done = published.publish(current, str(tmp_path), "v1", 1)
    path = spark.read.parquet(f"{done.path}/heads").inputFiles()[0].removeprefix("file://")
    meta = pq.ParquetFile(path).metadata
    column = next(meta.row_group(0).column(i) for i in range(meta.num_columns) if meta.schema.column(i).name == "resource_id")
    assert column.compression == "ZSTD" and column.total_uncompressed_size < 3000 * 31
    assert "PLAIN_DICTIONARY" not in column.encodings
