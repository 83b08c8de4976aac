"""The parts that the second advice found missing, against brute force."""

from factloom.llm import license_scan, ngram_join, positional_index

from . import cases

HEADER = license_scan.NOTICES["GPL-3.0 header"]


def test_notices_inside_other_words(spark):
    rows = [(1, "Copyright (c) 2020 Acme Inc. All rights reserved."), (2, "Example Tool. Released under the MIT License. See the file for details."),
            (3, "Text by J. Doe, licensed under CC BY-SA 4.0."), (4, "no notice of any kind"), (5, None),
            (6, "#!/bin/sh\n# tool - does things\n#\n" + "\n".join("# " + HEADER[k:k + 70] for k in range(0, len(HEADER), 70)) + "\n#\n# This program is distributed in the hope that it will be useful,\n"
                "# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.\n")]
    rows += [(10 + i, f"some words before {license_scan.NOTICES[k]} and some after them, as many as fit on a line of a text file that is no licence at all")
             for i, k in enumerate(("GPL-2.0 header", "GPL-3.0 header", "LGPL-2.1 header", "LGPL-3.0 header", "AGPL-3.0 header", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-NC-SA-3.0", "GPL-2.0 opening"))]
    found = {r.doc_id: r.license for r in license_scan.notices_of_documents(cases.documents(spark, rows)).collect()}
    wanted = {1: "All-Rights-Reserved", 2: "MIT notice", 3: "CC-BY-SA-4.0 notice", 4: None, 5: None, 6: "GPL-3.0 header"}
    wanted |= dict(zip(range(10, 19), ("GPL-2.0 header", "GPL-3.0 header", "LGPL-2.1 header", "LGPL-3.0 header", "AGPL-3.0 header", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-NC-SA-3.0", "GPL-2.0 opening")))
    assert found == wanted


def test_notices_against_all_windows(spark):
    import random

    rng = random.Random(3)
    templates = {"one": "a b c d e f g h", "two": "x y z", "loop": "a b a b c a"}
    sets = {k: {tuple(v.split()[i:i + 2]) for i in range(len(v.split()) - 1)} for k, v in templates.items()}
    rows = []
    for i in range(150):
        parts = [rng.choice([*templates.values(), *(rng.choice("abcdefghxyzpq") for _ in range(4))]) for _ in range(rng.randint(1, 6))]
        rows.append((i, " ".join("q" if rng.random() < 0.05 else w for p in parts for w in p.split())))
    expected = set()
    for i, t in rows:
        w = t.split()
        for name, wanted in sets.items():
            for a in range(len(w)):
                for b in range(a + 2, min(len(w), a + 1 + int(len(wanted) * 1.5 + 1e-9)) + 1):
                    own = set(zip(w[a:b - 1], w[a + 1:b]))
                    if 2 * len(own & wanted) / (len(own) + len(wanted)) >= 0.8:
                        expected.add((i, a, b))
    kept = {}
    for r in license_scan.notice_matches(cases.documents(spark, rows), templates).collect():
        kept.setdefault(r.doc_id, []).append((r.first_word, r.first_word + r.n_words))
    # every similar window is a notice or overlaps one, and notices do not overlap
    assert len(expected) > 100 and all(any(a < y and x < b for x, y in kept.get(i, [])) for i, a, b in expected)
    assert all(p[1] <= q[0] for spans in kept.values() for p, q in zip(sorted(spans), sorted(spans)[1:]))


def similar_documents(rows):
    """doc_id -> ids of the other documents that are similar, by comparing all pairs."""
    sets = {i: cases.shingles(t) for i, t in rows}
    return {i: {j for j in sets if i != j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])} for i in sets}, sets


def test_links_inside_components(spark, monkeypatch):
    rows = cases.corpus(7)
    linked, sets = similar_documents(rows)
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    expected = sorted(((i, len(linked[i]), first[frozenset(sets[i])] if sets[i] else i) for i in sets), key=repr)
    assert any(len(linked[j]) != len(linked[i]) for i in linked for j in linked[i])  # links are not transitive here
    docs = cases.documents(spark, rows).repartition(5)
    pairs = sorted({(min(first[frozenset(sets[i])], first[frozenset(sets[j])]), max(first[frozenset(sets[i])], first[frozenset(sets[j])]))
                    for i in linked for j in linked[i] if sets[i] != sets[j]})
    assert cases.pairs(ngram_join.document_links(docs), "doc_id", "n_links", "class_id") == expected
    monkeypatch.setattr(ngram_join, "SPREAD_CLASSES", 2)  # several blocks and cells
    monkeypatch.setattr(ngram_join, "COLUMNS", 5)
    assert cases.pairs(ngram_join.document_links(docs), "doc_id", "n_links", "class_id") == expected
    assert sorted(cases.pairs(ngram_join.class_links(docs))) == pairs


def test_links_without_ids_and_with_shared_ids(spark):
    text, other = " ".join(f"t{i}" for i in range(30)), "other words than those before"
    docs = cases.documents(spark, [(None, text), (5, text), (5, other), (9, text), (7, other), (8, text + " more"), (3, None)])
    assert cases.pairs(ngram_join.document_links(docs), "doc_id", "component_id", "class_id", "n_links") == sorted(
        [(None, None, None, 0), (5, 5, 5, 2), (5, 5, 5, 1), (9, 5, 5, 2), (7, 5, 5, 1), (8, 5, 8, 2), (3, 3, 3, 0)], key=repr)
    assert cases.pairs(ngram_join.class_links(docs)) == [(5, 8)]


def test_near_items(spark):
    import random

    rng = random.Random(5)
    split = lambda t: cases.PLAIN.findall((t or "").translate(cases.FOLD))
    rows = [(i, " ".join(cases.words(rng, 60, 30))) for i in range(25)] + [(50, None), (51, "solo")]
    items = []
    for i in range(12):  # shuffled passages with words that no text has
        part = split(rows[i][1])[5:17]
        rng.shuffle(part)
        items.append((i, " ".join("unseen" if k % 5 == 0 else w for k, w in enumerate(part))))
    items += [(20, "Solo"), (21, "none of these anywhere"), (22, None)]
    held = {w for _, t in rows for w in split(t)}
    expected = []
    for d, t in rows:
        near = set()
        for i, q in items:
            w = split(q)
            for k in range(max(len(w) - 10, 0) + 1 if w else 0):
                own = set(w[k:k + 10])
                if 2 * len(own & held) >= len(own) and any(own & held <= set(split(t)[a:a + 20]) for a in range(len(split(t)))):
                    near.add(i)
        expected.append((d, len(near)))
    assert all(n for d, n in expected[:12])
    found = positional_index.near_items(cases.documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert cases.pairs(found) == sorted(expected, key=repr)
