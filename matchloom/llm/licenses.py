"""License scans: patience alignment of license templates with document words."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain

# License notices as their publishers word them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "gpl-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
}
COVERAGE = 0.8
WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given in order of the first member, whose second members increase."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        before[i] = piles[k - 1] if k else -1
        if k == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[k], piles[k] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matching positions of ``a`` and ``b``: equal ends, then words unique to both as anchors, then the gaps alike."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        left, right = Counter(a[a0:a1]), Counter(b[b0:b1])
        places = {w: i for i, w in enumerate(b[b0:b1], b0) if right[w] == 1}
        anchors = rising([(i, places[a[i]]) for i in range(a0, a1) if left[a[i]] == 1 and a[i] in places])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
    return sorted(out)


class Template:
    """Words of a template and its seeds: the longest words, just enough that every match must hold one of them."""

    def __init__(self, name: str, text: str, coverage: float):
        self.name, self.words = name, words_of(text)
        n, counts = len(self.words), Counter(self.words)
        spare, self.offsets, got = int((1 - coverage) * n + 1e-9), {}, 0
        for word in sorted(counts, key=lambda w: (-len(w), w)):
            if got > spare:
                break
            got += counts[word]
            self.offsets[word] = [i for i, w in enumerate(self.words) if w == word]
        self.slack = -(-n // 4)


def find(words: list[str], template: Template, coverage: float) -> list[tuple[int, int, int]]:
    """(start, end, matched) of occurrences, left to right, not overlapping.

    Each seed word lines the template up with the document; the words there, with a quarter of the template's length
    on either side, are aligned with it.
    """
    n, found, free = len(template.words), [], 0
    for p, word in enumerate(words):
        if p < free or word not in template.offsets:
            continue
        best = None
        for offset in template.offsets[word]:
            low, high = max(free, p - offset - template.slack), p - offset + n + template.slack
            pairs = patience(template.words, words[low:high])
            if len(pairs) >= coverage * n and (best is None or len(pairs) > best[2]):
                best = (low + pairs[0][1], low + pairs[-1][1] + 1, len(pairs))
        if best:
            found.append(best)
            free = best[1]
    return found


def scan(text: str, templates: list[Template], coverage: float) -> list[tuple[str, int, int, int, float]]:
    """Occurrences of all templates; one that lies inside a longer one is left out."""
    words = words_of(text)
    present = set(words)
    hits = [
        (start, end, matched, t) for t in templates if any(w in present for w in t.offsets) for start, end, matched in find(words, t, coverage)
    ]
    hits.sort(key=lambda h: (-h[2], h[0], h[3].name))
    out: list[tuple[int, int, int, Template]] = []
    for h in hits:
        if not any(o[0] <= h[0] and h[1] <= o[1] for o in out):
            out.append(h)
    return [(t.name, start, end, matched, matched / len(t.words)) for start, end, matched, t in sorted(out, key=lambda h: (h[0], h[3].name))]


def license_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE
) -> DataFrame:
    """(doc_id, license, start_word, end_word, matched, coverage): each place where a template covers ``coverage`` or more of its words.

    Words are runs of letters and digits in lower case. Null and empty texts have no places; templates without words
    are left out. Rows that repeat are scanned each; a null id is handed through. Texts are scanned whole, and every
    alignment spans about one and a half templates, whatever the text's length. Nothing is shuffled.
    """
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [t for t in (Template(k, v, coverage) for k, v in chosen.items()) if t.words]
        for batch in batches:
            rows = [(key, *hit) for key, text in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in scan(text.as_py(), known, coverage)]
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [batch.schema.types[0], pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "license", "start_word", "end_word", "matched", "coverage"]
            )

    rows = plain(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("text IS NOT NULL")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, license string, start_word long, end_word long, matched long, coverage double")
