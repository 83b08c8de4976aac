"""Licence texts and notices in documents, by Dice coefficient over word bigrams.

Every line, every paragraph (lines without an empty one between) and every whole text is a candidate unit. It is
normalised (words of ASCII letters, digits and other characters, A-Z lower-cased) and compared to each template as a
set of word bigrams: 2 |A n B| / (|A| + |B|). A coefficient of at least t needs sizes within t / (2 - t) of each other,
so a unit is only compared with templates in that range, and a unit with too few bigrams of any template with none.
Bigrams are looked up and counted for a whole block of texts at once; only what is left after that goes one by one.

A notice with other words around it is no unit. ``notice_matches`` also compares windows: for every template and every
place where one of its bigrams stands, the windows of at most 1 / (t / (2 - t)) times the template's bigrams that begin
there and end with one of its bigrams (cutting other ends off never lowers the coefficient). Places too far from
enough further bigrams of the template are left out first, as every match needs them. Line breaks, comment signs and
blank lines are no words, so they do not matter to a window. Of windows and units that overlap only the one that has
most bigrams in common with its template stays.

The templates are a parameter: a small table that the caller passes in and every task holds.

Edge cases: null and empty texts have no units; a unit of one word is one "bigram" of that word alone; of units with
equal coefficients the earliest stays, a line before a paragraph before a text, and of templates the first by name;
repeated rows are judged one by one; a null id is kept; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed_texts, query, table
from .kernels import ALPHANUMERIC, Block, SpanHash, block_of, find_words, mix, pieces, ranges, window_hashes

LEAST = 0.8

_PERMISSION = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
               "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
               "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:")
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."

# fixed values: public licence notices by name
TEMPLATES = {
    "All-Rights-Reserved": "All rights reserved.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                      "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
           "copyright notice and this permission notice appear in all copies.",
    "MIT": f"{_PERMISSION} {_MIT_NOTICE}",
    "MIT notice": "Released under the MIT License.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                      "You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
UNITS = ("line", "paragraph", "text")
GRID = 1 << 20  # window ends that are compared at once

_GNU = "you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation"
_LATER = "either version {0} of the License, or (at your option) any later version."
_BSD_2 = ("1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
          "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
          "in the documentation and/or other materials provided with the distribution.")
_BSD_3 = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
          "from this software without specific prior written permission.")
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
       "BY-ND": "Attribution-NoDerivatives", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

# fixed values: further families and versions; full texts by their openings
NOTICES = TEMPLATES | {
    "AGPL-3.0 header": f"This program is free software: {_GNU.format('Affero General Public License')}, {_LATER.format(3)}",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0 opening": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0 opening": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "BSD-2-Clause": f"{TEMPLATES['BSD-2-Clause conditions']} {_BSD_2}",
    "BSD-3-Clause": f"{TEMPLATES['BSD-2-Clause conditions']} {_BSD_2} 3. {_BSD_3}",
    "BSD-3-Clause clause": _BSD_3,
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0 header": f"This program is free software; {_GNU.format('General Public License')}; {_LATER.format(2)}",
    "GPL-2.0-only header": f"This program is free software; {_GNU.format('General Public License version 2')}.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 opening": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0 opening": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1 header": f"This library is free software; {_GNU.format('Lesser General Public License')}; {_LATER.format('2.1')}",
    "LGPL-2.1 opening": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0 header": f"This library is free software: {_GNU.format('Lesser General Public License')}, {_LATER.format(3)}",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0 opening": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MIT terms": "Licensed under the terms of the MIT License.",
    "MIT licensed": "Licensed under the MIT License.",
    "MPL-2.0 opening": "Mozilla Public License Version 2.0",
    **{f"CC-{k}-{v} notice": f"Licensed under CC {k} {v}." for k in _CC for v in ("2.0", "2.5", "3.0", "4.0") if f"CC-{k}-{v} notice" not in TEMPLATES},
    **{f"CC-{k}-{v}": f"Licensed under a Creative Commons {name} {v} {'International' if v == '4.0' else 'Unported'} License."
       for k, name in _CC.items() for v in ("3.0", "4.0")},
}


def _bigrams(block: Block):
    words = find_words(block, ALPHANUMERIC)
    hashes = SpanHash(block.data, fold=True).of(words.starts, words.ends)
    pairs = np.zeros(len(hashes), np.uint64)
    pairs[:-1] = window_hashes(hashes, 2)
    return words, hashes, pairs


def unit_bigrams(hashes: np.ndarray, pairs: np.ndarray, a: int, b: int) -> np.ndarray:
    """Distinct bigrams of words a..b; a single word stands for itself."""
    return np.unique(pairs[a:b - 1]) if b - a > 1 else mix(hashes[a:b])


class _Templates:
    def __init__(self, texts: dict[str, str], least: float):
        self.names = sorted(texts)
        self.sets, self.single = [], []
        for name in self.names:
            words, hashes, pairs = _bigrams(block_of(pa.array([texts[name]])))
            self.sets.append(unit_bigrams(hashes, pairs, 0, len(hashes)) if len(hashes) else np.zeros(0, np.uint64))
            self.single.append(len(hashes) == 1)
        self.sizes = np.array([len(x) for x in self.sets])
        self.all = np.unique(np.concatenate([*self.sets, np.zeros(0, np.uint64)]))
        self.least = least

    def best(self, unit: np.ndarray) -> tuple[float, str] | None:
        low, high = len(unit) * self.least / (2 - self.least) - 1e-9, len(unit) * (2 - self.least) / self.least + 1e-9
        found = None
        for i in np.flatnonzero((self.sizes >= low) & (self.sizes <= high)).tolist():  # size bounds
            score = 2 * len(np.intersect1d(unit, self.sets[i], assume_unique=True)) / (len(unit) + self.sizes[i])
            if score >= self.least and (found is None or score > found[0]):
                found = score, self.names[i]
        return found


def _has(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _scan(block: Block, templates: _Templates) -> list[list[tuple[float, int, int, int, str]]]:
    """For every row its units that match: (coefficient, kind, first word, words, template)."""
    words, hashes, pairs = _bigrams(block)
    found: list[list] = [[] for _ in range(len(block.bounds) - 1)]
    total = len(hashes)
    if not total:
        return found
    breaks = np.flatnonzero(block.data == 0x0A)
    line = np.searchsorted(breaks, words.starts)
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    # a bigram belongs to the units that hold both its words
    hit = _has(templates.all, pairs)
    hit[-1] = False
    alone = _has(templates.all, mix(hashes))
    step = {"line": (line[1:] != line[:-1]) | (row[1:] != row[:-1])}
    empty = np.zeros(total - 1, bool)  # two line breaks with nothing but white space between
    if total > 1:
        blank = np.flatnonzero(line[1:] - line[:-1] >= 2)
        raw = block.data
        for i in blank.tolist():
            between = raw[words.ends[i]:words.starts[i + 1]].tobytes().split(b"\n")
            empty[i] = any(not x.strip() for x in between[1:-1])
    step["paragraph"] = empty | (row[1:] != row[:-1])
    step["text"] = row[1:] != row[:-1]
    for kind, name in enumerate(UNITS):
        start = np.concatenate([[0], np.flatnonzero(step[name]) + 1])
        stop = np.append(start[1:], total)
        inner = hit.copy()
        inner[stop - 1] = False  # the bigram from one unit into the next
        hits = np.add.reduceat(inner.astype(np.int64), start) + ((stop - start == 1) & alone[start])
        start, stop = start[hits > 0], stop[hits > 0]
        for a, b in zip(*_enough_in_common(pairs, hit, start, stop, templates.least)):
            unit = unit_bigrams(hashes, pairs, a, b)
            match = templates.best(unit)
            if match:
                found[row[a]].append((match[0], kind, a - int(words.first[row[a]]), b - a, match[1]))
    return found


def _enough_in_common(pairs: np.ndarray, hit: np.ndarray, start: np.ndarray, stop: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """Units whose distinct bigrams that any template has are at least least / (2 - least) of their distinct bigrams, as every match needs."""
    counts = stop - start - 1
    at = ranges(start, counts)
    unit = np.repeat(np.arange(len(start)), counts)
    order = np.lexsort((pairs[at], unit))
    at, unit = at[order], unit[order]
    new = np.ones(len(at), bool)
    new[1:] = (pairs[at[1:]] != pairs[at[:-1]]) | (unit[1:] != unit[:-1])
    distinct = np.bincount(unit[new], minlength=len(start))
    common = np.bincount(unit[new], weights=hit[at[new]], minlength=len(start))
    good = (common * (2 - least) >= least * distinct - 1e-9) | (counts == 0)
    return start[good].tolist(), stop[good].tolist()


def _windows(block: Block, templates: _Templates) -> list[list[tuple[float, int, int, int, str]]]:
    """Like ``_scan`` for windows: of every start and template the window with the largest coefficient, the shortest of equal ones."""
    words, hashes, pairs = _bigrams(block)
    found: list[list] = [[] for _ in range(len(block.bounds) - 1)]
    total = len(hashes)
    if not total or not len(templates.all):
        return found
    counts = np.diff(words.first)
    row, stop = np.repeat(np.arange(len(counts)), counts), np.repeat(words.first[1:], counts)

    def add(starts, lengths, scores, name):
        for a, n, score in zip(starts.tolist(), lengths.tolist(), scores.tolist()):
            found[row[a]].append((score, len(UNITS), a - int(words.first[row[a]]), n, name))

    which = np.minimum(np.searchsorted(templates.all, pairs), len(templates.all) - 1)
    places = np.flatnonzero((templates.all[which] == pairs) & (np.arange(total) + 1 < stop))
    which, earlier = which[places], None
    for t, name in enumerate(templates.names):
        size = int(templates.sizes[t])
        if templates.single[t]:
            at = np.flatnonzero(mix(hashes) == templates.sets[t][0])
            add(at, np.ones(len(at), int), np.ones(len(at)), name)
            continue
        least = max(1, int(np.ceil(size * templates.least / (2 - templates.least) - 1e-9)))  # bigrams in common that a match needs
        most = int(size * (2 - templates.least) / templates.least + 1e-9)
        mine = places[_has(templates.sets[t], templates.all)[which]]
        if not size or len(mine) < least:
            continue
        starts, last = mine[:len(mine) - least + 1], mine[least - 1:]
        starts = starts[(last - starts < most) & (last < stop[starts])]
        if not len(starts):
            continue
        if earlier is None:  # where the same bigram stood before
            order = np.lexsort((np.arange(total), pairs))
            same = pairs[order][1:] == pairs[order][:-1]
            earlier = np.full(total, -1)
            earlier[order[1:][same]] = order[:-1][same]
        mark = np.zeros(total, bool)
        mark[mine] = True
        for some in np.array_split(starts, -(-len(starts) * most // GRID)):
            grid = some[:, None] + np.arange(most)
            inside = grid + 1 < stop[some][:, None]
            grid = np.minimum(grid, total - 1)
            new, hit = inside & (earlier[grid] < some[:, None]), inside & mark[grid]
            score = np.where(hit, 2 * np.cumsum(new & hit, axis=1) / (np.cumsum(new, axis=1) + size), 0)
            end = score.argmax(axis=1)
            score = score[np.arange(len(some)), end]
            good = score >= templates.least
            add(some[good], end[good] + 2, score[good], name)
    return found


def _notices(block: Block, templates: _Templates) -> list[list[tuple[float, int, int, int, str]]]:
    """Units and windows of every row without those that overlap one with more bigrams in common, that one first."""
    _, hashes, pairs = _bigrams(block)
    size = dict(zip(templates.names, templates.sizes.tolist()))
    first = find_words(block, ALPHANUMERIC).first
    out = []
    for r, (units, windows) in enumerate(zip(_scan(block, templates), _windows(block, templates))):
        ranked = []
        for dice, kind, a, n, name in units + windows:
            distinct = len(unit_bigrams(hashes, pairs, int(first[r]) + a, int(first[r]) + a + n))
            ranked.append((-round(dice * (distinct + size[name]) / 2), -dice, kind, a, n, name))
        taken, kept = np.zeros(int(first[r + 1] - first[r]), bool), []
        for _, dice, kind, a, n, name in sorted(ranked):
            if not taken[a:a + n].any():
                taken[a:a + n] = True
                kept.append((-dice, kind, a, n, name))
        out.append(kept)
    return out


_MATCHES = "doc_id long, license string, dice double, unit string, first_word long, n_words long"


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """Every unit that matches: ``doc_id, license, dice, unit, first_word, n_words``."""
    return keyed_texts(docs).mapInArrow(_reader(templates, least, False), _MATCHES)


def license_of_documents(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per row: its best match, nulls if none, and ``n_matches``."""
    return keyed_texts(docs).mapInArrow(_reader(templates, least, True), _MATCHES + ", n_matches long")


def notice_matches(docs: DataFrame, templates: dict[str, str] = NOTICES, least: float = LEAST) -> DataFrame:
    """Every notice, also one inside other words, once: ``doc_id, license, dice, unit, first_word, n_words``."""
    return keyed_texts(docs).mapInArrow(_reader(templates, least, False, True), _MATCHES)


def notices_of_documents(docs: DataFrame, templates: dict[str, str] = NOTICES, least: float = LEAST) -> DataFrame:
    """One row per row: its notice with most bigrams in common with a template, nulls if none, and ``n_matches``."""
    return keyed_texts(docs).mapInArrow(_reader(templates, least, True, True), _MATCHES + ", n_matches long")


def _reader(templates: dict[str, str], least: float, best_only: bool, windows: bool = False):
    kinds_of = (*UNITS, "window")

    def read(batches):
        known = _Templates(templates, least)
        for batch in batches:
            for part in pieces(batch):
                rows = []
                for i, found in enumerate((_notices if windows else _scan)(block_of(part.column(1)), known)):
                    if not windows:
                        found.sort(key=lambda m: (-m[0], m[1], m[2]))
                    if best_only:
                        dice, kind, first, words, name = found[0] if found else (None,) * 5
                        rows.append((i, name, dice, None if kind is None else kinds_of[kind], first, words, len(found)))
                    else:
                        rows += [(i, name, dice, kinds_of[kind], first, words) for dice, kind, first, words, name in found]
                columns = list(zip(*rows)) if rows else [()] * (7 if best_only else 6)
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                arrays[0] = part.column(0).take(arrays[0])
                yield pa.record_batch(arrays, names=["doc_id", "license", "dice", "unit", "first_word", "n_words", "n_matches"][:len(arrays)])

    return read


_SPLIT = "list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
_PAIRS = "CASE WHEN len(words) > 1 THEN list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) ELSE words END"
_LISTED = ", ".join("('" + n.replace("'", "''") + "', '" + t.replace("'", "''") + "')" for n, t in TEMPLATES.items())


@query("op9_license_scan", f"""
WITH templates AS (SELECT name, {_PAIRS} AS pairs FROM (SELECT name, {_SPLIT.format('body')} AS words FROM (VALUES {_LISTED}) AS t(name, body))),
texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
cut AS (SELECT doc_id, 0 AS kind, string_split(body, chr(10)) AS parts FROM texts
  UNION ALL SELECT doc_id, 1, regexp_split_to_array(body, '\n[ \t\r\x0b\f]*\n') FROM texts UNION ALL SELECT doc_id, 2, [body] FROM texts),
units AS (SELECT doc_id, kind, unnest(parts) AS body, unnest(range(len(parts))) AS i FROM cut),
worded AS (SELECT doc_id, kind, i, {_SPLIT.format('body')} AS words FROM units),
placed AS (SELECT doc_id, kind, words, {_PAIRS} AS pairs, coalesce(sum(len(words)) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_word FROM worded),
scored AS (SELECT doc_id, kind, first_word, len(words)::BIGINT AS n_words, name, 2 * len(list_intersect(p.pairs, t.pairs)) / (len(p.pairs) + len(t.pairs))::DOUBLE AS dice
  FROM placed p JOIN templates t ON len(p.pairs) > 0 AND len(p.pairs) BETWEEN len(t.pairs) * {LEAST} / (2 - {LEAST}) - 1e-9 AND len(t.pairs) * (2 - {LEAST}) / {LEAST} + 1e-9),
matched AS (SELECT * FROM scored WHERE dice >= {LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id, kind, first_word ORDER BY dice DESC, name) = 1),
best AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_matches FROM matched QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, kind, first_word) = 1)
SELECT d.doc_id, b.name AS license, b.dice, ['line', 'paragraph', 'text'][b.kind + 1] AS unit, b.first_word, b.n_words, coalesce(b.n_matches, 0) AS n_matches
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id""")
def op9_license_scan(spark, folder):
    """The best licence match of all documents."""
    return license_of_documents(table(spark, folder, "documents"))


@query("op9_license_windows")
def op9_license_windows(spark, folder):
    """The best licence notice of all documents, also inside other words."""
    return notices_of_documents(table(spark, folder, "documents"))
