import collections

import pytest

import corpus_pipeline
from factloom.llm import best_fit_packing, toxic_segments

from . import cases
from .test_toxic_segments import toxic_corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = toxic_corpus(400, 3)
    rows += [(1000 + i, t) for i, t in cases.corpus(4, groups=2, size=6)]
    path = tmp_path_factory.mktemp("tables")
    items = [(i, " ".join(rows[500 + i][1].split()[:15])) for i in range(3) if rows[500 + i][1]] if len(rows) > 503 else [(1, " ".join(rows[7][1].split()[:15]))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, labels, items


def test_pipeline_against_brute_force(spark, folder):
    path, rows, labels, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = toxic_segments.learn(docs, spark.read.parquet(f"{path}/labels.parquet"))
    toxic = {r.doc_id for r in toxic_segments.toxicity(docs, model).where("predicted = 1").collect()}
    assert len(toxic) > 40
    left = [r for r in rows if r[0] not in toxic]
    first = {}
    for i, t in left:
        first[t or ""] = min(i, first.get(t or "", i))
    left = [(i, t) for i, t in left if first[t or ""] == i]
    parts = cases.near_components(left)
    left = [(i, t) for i, t in left if parts[i][1] == i]
    hit = {i for i, _, n, _ in cases.contamination(left, items) if n}
    assert hit
    left = [r for r in left if r[0] not in hit]

    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, path)
        assert now.columns == COLUMNS, name
    assert sorted(map(tuple, now.select("doc_id", "text").collect())) == sorted(left)

    packed = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in left}
    pieces = {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in packed}
    alone = best_fit_packing.token_pieces(now).collect()
    assert pieces == {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in alone}
    used = collections.Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_empty_and_odd_documents_pass_every_stage(spark, folder):
    path = folder[0]
    schema = spark.read.parquet(f"{path}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None)] * 2 + [(1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b", None, None, None)]):
        now = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, path)
        assert {r.doc_id for r in now.collect()} == ({None, 2} if rows else set()) or {r.doc_id for r in now.collect()} == ({1, 2} if rows else set())
