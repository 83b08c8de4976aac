"""Base rules and fertility measures against plain versions, bands against numpy, verdicts on labelled documents."""

import collections
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import fertility_rules as rules

from . import cases

TABLES = "/root/testdata/sf0.1"


def base_rules(text):
    text = text or ""
    words = cases.SOLID.findall(text)
    lines = [x for x in text.split("\n") if cases.SOLID.search(x)]
    times = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = {k for i in range(len(words) - 4) if times[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def fertility(text, coder):
    ids = [i for w in cases.SOLID.findall(text or "") for k in range(0, len(w), rules._LONGEST) for i in coder.encode([w[k:k + rules._LONGEST]])[0]]
    if not ids:
        return 0, 0, None
    n = len(ids)
    return n, sum(bool(coder.bytes[i]) for i in ids), -sum(c / n * math.log2(c / n) for c in collections.Counter(ids).values())


def mixed_rows():
    rng = random.Random(5)
    rows = cases.corpus(5, groups=3, size=6)
    odd = ["a b c d e " * 6, "x\nx\n\n \nx\r\nx", "\nline one\nline two\nline one", "line one", "# * $ % & | < > ## <a>", "Ünï çødé Ελληνικά κείμενο λόγος", "это русский текст для проверки слов и знаков ещё раз",
           "汉字没有空格" * 900, "w" * 5000 + " ẁ̀ \U0001F600 ", "one two three four five one two three four five six", "\n\n", "\x00 \x1f \x85  ",
           "<s> </s> [INST] <|endoftext|> ok", " ".join(f"v{rng.randrange(30)}" for _ in range(400)), "Dup\nDup\nDup", "end\n", "\nend"]
    return rows + [(1000 + i, t) for i, t in enumerate(odd)] + [(None, "no id here"), (3, "an id twice"), (3, "an id twice"), (2000, "q " * 600_000)]


def test_measures_against_plain_versions(spark):
    rows = mixed_rows()
    paths = rules.default_paths()
    found = rules.measures(cases.documents(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, "aa"))).collect()
    coders = {p: rules.vocabulary(x) for p, x in paths.items()}
    expected = []
    for i, t in rows:
        counts = [x for p in paths for x in fertility(t, coders[p])]
        expected.append((i, *base_rules(t), *counts))
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
            *[x for p in paths for x in (r[f"{p}_tokens"], r[f"{p}_bytes"], r[f"{p}_entropy"])]) for r in found]
    key = lambda r: (repr(r[:7]), r[7])
    for a, b in zip(sorted(got, key=key), sorted(expected, key=key), strict=True):
        assert a[:9] == b[:9] and a[10:12] == b[10:12]
        for x, y in ((a[9], b[9]), (a[12], b[12])):
            assert (x is None) == (y is None) and (x is None or abs(x - 1000 * y) <= 0.6)
    names = {r.doc_id: r.script for r in found}
    assert (names[1005], names[1006], names[1007], names[1010]) == ("Greek", "Cyrillic", "Han", "none")
    assert {r.lang for r in found} == {"", "aa"}


def test_bands_against_numpy(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(cases.words(rng, rng.choice([30, 60, 200])))) for i in range(400)] + [(500 + i, "the same text again and again in very many rows of it") for i in range(300)]
    docs = cases.documents(spark, rows, False).withColumn("lang", F.when(F.col("doc_id") < 8, "rare").otherwise("usual"))
    paths = dict(list(rules.default_paths().items())[:1])
    name = next(iter(paths))
    measured = rules.measures(docs, paths)
    limits = {(r.script, r.lang, r.size_class): r.limits for r in rules.bands(measured, paths, 4.5, 50).collect()}
    texts = {(r.content, r.content_folded): r for r in measured.collect() if not r.base_failed}.values()
    assert len(limits) == len({(r.script, r.lang, r.size_class) for r in texts}) > 2
    for script, lang, size in limits:
        for level in (lambda r: (r.script, r.lang, r.size_class) == (script, lang, size), lambda r: (r.script, r.size_class) == (script, size), lambda r: r.size_class == size, lambda r: True):
            values = np.array([r[f"{name}_chars"] for r in texts if level(r)])
            if len(values) >= 50:
                break
        mid = np.median(values)
        half = max(4.5 * 1.4826 * np.median(abs(values - mid)), 0.04 * mid)
        assert limits[script, lang, size][f"{name}_chars"] == pytest.approx((mid - half, mid + half))
    verdicts = {r.doc_id: r for r in rules.quality_rules(docs, paths).collect()}
    assert all(r.kept == (not r.base_failed and all(limits[r.script, r.lang, max(4, min(16, int(math.log2(r[f"{name}_tokens"]))))][m][0] <= r[m] <= limits[r.script, r.lang, max(4, min(16, int(math.log2(r[f"{name}_tokens"]))))][m][1]
                                                    for m in rules._measured(paths))) for r in verdicts.values())


def test_empty_tables_and_few_texts(spark):
    docs = cases.documents(spark, [], True)
    assert rules.quality_rules(docs, lang_column=None).count() == 0
    few = [(1, " ".join(f"word{i}" for i in range(20))), (2, "zq" * 40 + " a b c d e f g h i j k"), (3, None)]
    assert {r.doc_id: r.kept for r in rules.quality_rules(cases.documents(spark, few), lang_column=None).collect()} == {1: True, 2: True, 3: False}


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no driver tables")
def test_labelled_documents(spark):
    found = rules.op13_tokenizer_fertility(spark, TABLES)
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    seen = {(r.quality, r.kept): r.n for r in found.where("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert seen[1, True] > 0.99 * (seen[1, True] + seen[1, False])
    assert seen[0, False] > 0.85 * (seen.get((0, True), 0) + seen[0, False])
