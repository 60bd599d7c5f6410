"""License scans by patience alignment against templates.

Words that occur once in the text and once in the template are anchors; of these the
longest sequence that rises in both is kept, and the gaps between neighbouring anchors
are aligned the same way, after words that agree at the ends of a gap. What is aligned,
as a share of the template's words, is its coverage.

A notice may stand anywhere in a long text and more than once, so the alignment is made in
windows around every occurrence of as many places of the template as a notice may lack
and one more: those whose words are rarest in the text, and all places of its three
rarest words. A notice that reaches the coverage has one of these. A window is as wide as
the template and ``SLACK`` of it on either side; unless that aligns the whole template, a second
takes all that a notice with words put in may span, of whose words ``DENSITY`` at least must
be aligned. Sparse ends of an alignment are left out. Whole batches are sieved before: a template whose words do not reach the coverage even counted without
order cannot be aligned to it.

Where findings overlap, the one with most aligned words stands. Defined cases: null and
empty texts have no notice, and templates without words none that fits; ties go to the template first in the list; repeated rows repeat their
result; a null doc_id is passed on; other columns play no part, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec

COVERAGE = 0.85
DENSITY = 0.6
SLACK = 0.25

TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0"),
    ("BSD-3-Clause", "Released under the three clause BSD License"),
    ("BSD-2-Clause", "Released under the two clause BSD License"),
    ("ISC", "Released under the ISC License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "Released under CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file is prohibited"),
)

#: Whole grants and the notices that the licenses themselves ask for.
TEXTS: tuple[tuple[str, str], ...] = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
)

#: What op10_license_scan looks for: also the bare line, which has 3 of the 9 words that the long notice needs.
NOTICES = (*TEMPLATES, ("Proprietary", "All rights reserved"))
LICENSES = (*NOTICES, *TEXTS)


def read_templates(folder: str) -> list[tuple[str, str]]:
    """Templates from a folder of whole license texts, each named by its file, in the order of names."""
    return [(path.stem if path.suffix == ".txt" else path.name, path.read_text("utf-8", "replace")) for path in sorted(Path(folder).iterdir()) if path.is_file()]


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of ``pairs`` (by first member) whose second members rise."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        if k:
            back[i] = piles[k - 1]
        if k == len(tops):
            tops.append(y)
            piles.append(i)
        else:
            tops[k], piles[k] = y, i
    out = []
    i = piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: Sequence, template: Sequence) -> list[tuple[int, int]]:
    """Aligned positions (in text, in template), rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once = Counter(text[a:b])
        other = Counter(template[c:d])
        where = {w: i for i, w in enumerate(template[c:d], c) if other[w] == 1}
        anchors = rising([(i, where[w]) for i, w in enumerate(text[a:b], a) if once[w] == 1 and w in where])
        if not anchors:
            continue
        out += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(out)


def dense_part(pairs: list[tuple[int, int]], needed: float) -> list[tuple[int, int]]:
    """The most aligned words in a row, ``needed`` at least, that are ``DENSITY`` of the text they span; none if too sparse."""
    for size in range(len(pairs), int(needed) - 1, -1):
        spans = [(pairs[i + size - 1][0] + 1 - pairs[i][0], i) for i in range(len(pairs) - size + 1)]
        least, i = min(spans, default=(0, 0))
        if size and size >= DENSITY * least:
            return pairs[i : i + size]
    return []


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE):
        self.names = [name for name, _ in templates]
        self.coverage = coverage
        self.words = [textvec.words(pa.array([text], pa.string()))[0].tolist() for _, text in templates]
        self.vocabulary = np.unique(np.array([w for words in self.words for w in words], np.uint64))
        self.often = np.zeros((len(self.vocabulary), len(templates)), np.float32)
        for t, words in enumerate(self.words):
            np.add.at(self.often[:, t], np.searchsorted(self.vocabulary, np.array(words, np.uint64)), 1)
        self.needed = np.array([np.ceil(len(w) * coverage - 1e-9) if w else np.inf for w in self.words])
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def candidates(self, words: np.ndarray, first: np.ndarray) -> dict[int, list[int]]:
        """Templates by text whose words reach the coverage when order is left out."""
        at = np.flatnonzero(self.sieve[(words & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, words[at]), len(self.vocabulary) - 1)
        own = self.vocabulary[place] == words[at]
        at, place = at[own], place[own]
        present = np.zeros((len(first) - 1, len(self.vocabulary)), np.float32)
        present[np.searchsorted(first, at, "right") - 1, place] = 1
        rows, found = np.nonzero(present @ self.often >= self.needed)
        out: dict[int, list[int]] = {}
        for row, t in zip(rows.tolist(), found.tolist()):
            out.setdefault(row, []).append(t)
        return out

    def findings(self, words: list[int], templates: list[int]) -> list[tuple[int, int, int, int]]:
        """(template, first word, end, aligned words) in a text, without overlaps."""
        found: set[tuple[int, int, int, int]] = set()
        where: dict[int, list[int]] = {}
        wanted = {w for t in templates for w in self.words[t]}
        for i, w in enumerate(words):
            if w in wanted:
                where.setdefault(w, []).append(i)
        for t in templates:
            template = self.words[t]
            slack = max(2, int(len(template) * SLACK))
            order = sorted(range(len(template)), key=lambda p: (len(where.get(template[p], ())), p))
            spare = len(template) - int(self.needed[t]) + 1
            rare = sorted({w for w in template if w in where}, key=lambda w: (len(where[w]), template.index(w)))[:3]
            places = {*order[:spare], *(p for p in order if template[p] in rare)}
            wide = max(slack, int(len(template) / DENSITY) + 1 - len(template))
            for start in sorted({i - p for p in places for i in where.get(template[p], ())}):
                for reach in dict.fromkeys((slack, wide)):
                    low, high = max(0, start - reach), min(len(words), start + len(template) + reach)
                    pairs = dense_part(align(words[low:high], template), self.needed[t])
                    if pairs:
                        found.add((t, low + pairs[0][0], low + pairs[-1][0] + 1, len(pairs)))
                    if len(pairs) == len(template):
                        break
        out: list[tuple[int, int, int, int]] = []
        for f in sorted(found, key=lambda f: (-f[3], -f[3] / len(self.words[f[0]]), f[0], f[1])):
            if all(f[2] <= g[1] or f[1] >= g[2] for g in out):
                out.append(f)
        return sorted(out, key=lambda f: f[1])

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, str, float, int, int]]:
        """(row, license, coverage, first word, end) of every notice."""
        for at, part in textvec.chunks(texts):
            words, first = textvec.words(part)
            for row, templates in self.candidates(words, first).items():
                for t, start, end, aligned in self.findings(words[first[row] : first[row + 1]].tolist(), templates):
                    yield at + row, self.names[t], aligned / len(self.words[t]), start, end


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, start_word, end_word) of every license notice; end_word is exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            ids = batch.column(0)
            rows = [(ids[row].as_py(), name, round(share, 6), start, end) for row, name, share, start, end in scanner.scan(batch.column(1))]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([],) * 5, kinds)], names=["doc_id", "license", "coverage", "start_word", "end_word"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, coverage double, start_word long, end_word long")
