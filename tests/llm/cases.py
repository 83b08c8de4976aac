"""Small corpora and brute-force versions for the text operators."""

import collections
import random
import re

from pyspark.sql.types import LongType, StringType, StructField, StructType

SOLID = re.compile("[^\x20\x09-\x0D]+")
PLAIN = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
# names that operators use inside
CLASHING = ["anchor", "span", "key", "part", "run", "opens", "edge", "sha256", "doc", "copy", "window", "start", "n", "size", "salt", "a", "b", "_doc", "_copy", "component", "Head", "_normalhead", "Normal", "c0", "C1", "Edges", "labels", "Score", "shingle", "Piece"]


def documents(spark, rows, clashing=True):
    """A table of (doc_id, text) with further columns whose names operators use themselves."""
    names = CLASHING if clashing else []
    schema = StructType([*DOCS.fields, *(StructField(c, StringType()) for c in names)])
    return spark.createDataFrame([(*r, *[f"{c}{i}" for c in names]) for i, r in enumerate(rows)], schema)


def words(rng, n, vocabulary=400):
    return [f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n)]


def corpus(seed=0, groups=6, size=12):
    """Texts with exact copies, near copies, shared passages, nulls, empty, short and long texts."""
    rng = random.Random(seed)
    texts, passage = [], words(rng, 60)
    for _ in range(groups):
        base = words(rng, 90)
        texts.append(" ".join(base))
        texts += [" ".join(base)] * 2
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10 ** 6)}"
            texts.append(" ".join(copy))
    for i in range(12):
        own = words(rng, 40)
        texts.append(" ".join(own[:20] + passage + own[20:]))
    texts += [" ".join(words(rng, 5000)), "", None, None, " \t\n", "one", "One", "two words", "a b c d", "a b c d", "É é", "a  b\tc\nd"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def shingles(text, n=5):
    w = SOLID.findall((text or "").translate(FOLD))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_components(rows):
    """doc_id -> (set size, smallest linked id), by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                common = len(sets[x] & sets[y])
                if 100 * common >= 75 * (len(sets[x]) + len(sets[y]) - common):
                    a, b = root(x), root(y)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeated_words(rows, length=50):
    """Per row (doc_id, words, kept words)."""
    worded = [(i, SOLID.findall(t or "")) for i, t in rows]
    earliest = {}
    for i, w in worded:
        for k in range(len(w) - length + 1):
            key = tuple(w[k:k + length])
            earliest[key] = min(i, earliest.get(key, i))
    out = []
    for i, w in worded:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if earliest[tuple(w[k:k + length])] < i:
                gone[k:k + length] = [True] * length
        out.append((i, w, [x for x, g in zip(w, gone) if not g]))
    return out


def contamination(rows, items, length=10):
    """Per row (doc_id, n_words, n_hit, sorted items)."""
    windows = collections.defaultdict(set)
    for item, text in items:
        w = PLAIN.findall((text or "").translate(FOLD))
        for k in range(max(len(w) - length, 0) + 1 if w else 0):
            windows[tuple(w[k:k + length])].add("null" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for i, text in rows:
        w = PLAIN.findall((text or "").translate(FOLD))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def pairs(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
