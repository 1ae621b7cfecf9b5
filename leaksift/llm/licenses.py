"""License scans: patience alignment of texts with license templates.

Words that occur once in a stretch of text and once in a template are anchors.
The longest run of anchors in the same order in both (by patience sorting) is
kept, and the gaps between them are aligned the same way, down to gaps without
anchors, which are aligned by their longest common subsequence. The share of
template words aligned is the coverage.

A text is only aligned where a template can reach the coverage: of its rarest
words, more than may be missing, one must occur. Templates are few and fixed;
each text is scanned on its own, so nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksift.llm.common import words_of

COVERAGE = 0.8
LCS_CELLS = 1 << 20

# Public license notices and texts.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
 with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
 agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
 KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT-short": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
 files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
 publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
 subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
 portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
 THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
 BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
 CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
 provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
 DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
 THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA
 OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
 PERFORMANCE OF THIS SOFTWARE.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
 conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
 disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
 in the documentation and/or other materials provided with the distribution.""",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
 License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
 is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
 FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
 distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
 compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
 non-commercial, and by any means.""",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "All rights reserved.",
}


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of one longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        before[i] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[at], piles[at] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence; for gaps without anchors."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        last, row = rows[-1], [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions of two word lists, in order."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, ii, j, jj = work.pop()
        while i < ii and j < jj and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ii and j < jj and a[ii - 1] == b[jj - 1]:
            ii, jj = ii - 1, jj - 1
            out.append((ii, jj))
        if i == ii or j == jj:
            continue
        once_a, once_b = Counter(a[i:ii]), Counter(b[j:jj])
        place = {w: p for p, w in enumerate(b[j:jj], j) if once_b[w] == 1}
        pairs = [(p, place[w]) for p, w in enumerate(a[i:ii], i) if once_a[w] == 1 and w in place]
        if not pairs:
            if (ii - i) * (jj - j) <= LCS_CELLS:
                out += [(i + x, j + y) for x, y in common_subsequence(a[i:ii], b[j:jj])]
            continue
        kept = [pairs[k] for k in longest_increasing([q for _, q in pairs])]
        out += kept
        for (p, q), (pp, qq) in zip([(i - 1, j - 1), *kept], [*kept, (ii, jj)]):
            work.append((p + 1, pp, q + 1, qq))
    return sorted(out)


class Scanner:
    """Templates with their telling words."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE) -> None:
        self.coverage = coverage
        self.items = [(name, words) for name, words in ((n, words_of(t)) for n, t in templates.items()) if words]
        spread = Counter(w for _, words in self.items for w in set(words))
        self.telling: dict[str, list[tuple[int, list[int]]]] = {}
        self.vocabulary = [set(words) for _, words in self.items]
        for t, (_, words) in enumerate(self.items):
            missing = int((1 - coverage) * len(words) + 1e-9)
            # One more word place than may be missing: long words that few templates have.
            order = sorted(range(len(words)), key=lambda p: (-len(words[p]), spread[words[p]], p))
            places: dict[str, list[int]] = {}
            for p in order[:missing + 1]:
                places.setdefault(words[p], []).append(p)
            for w, at in places.items():
                self.telling.setdefault(w, []).append((t, at))
        self.words = set(self.telling)

    def scan(self, words: list[str]) -> list[tuple[str, float, int, int]]:
        """License, coverage, first word and end of every match; of overlapping matches the one with most words."""
        seen = self.words.intersection(words)
        if not seen:
            return []
        at: dict[str, list[int]] = {w: [] for w in seen}
        for p, w in enumerate(words):
            if w in at:
                at[w].append(p)
        starts: dict[int, set[int]] = {}
        for w in seen:
            for t, places in self.telling[w]:
                starts.setdefault(t, set()).update(p - o for p in at[w] for o in places)
        found = []
        for t, begins in starts.items():
            name, template = self.items[t]
            n = len(template)
            slack = int(n * (1 / self.coverage - 1)) + 1
            need = self.coverage * n - 1e-9
            inside = np.cumsum([0, *(w in self.vocabulary[t] for w in words)])
            for begin in sorted(begins):
                lo, hi = max(0, begin - slack), min(len(words), begin + n + slack)
                if inside[hi] - inside[lo] < need:
                    continue
                pairs = patience(template, words[lo:hi])
                # Stray words far from the rest are no part of the license.
                while pairs and pairs[-1][1] - pairs[0][1] + 1 > n / self.coverage:
                    first, last = pairs[1][1] - pairs[0][1] if len(pairs) > 1 else 0, pairs[-1][1] - pairs[-2][1] if len(pairs) > 1 else 0
                    pairs = pairs[1:] if first >= last else pairs[:-1]
                if len(pairs) >= need:
                    found.append((len(pairs), len(pairs) / n, name, lo + pairs[0][1], lo + pairs[-1][1] + 1))
        out: list[tuple[str, float, int, int]] = []
        for _, share, name, lo, hi in sorted(found, key=lambda f: (-f[0], -f[1], f[3], f[2])):
            if all(hi <= a or lo >= b for _, _, a, b in out):
                out.append((name, share, lo, hi))
        return sorted(out, key=lambda f: f[2])


def license_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None,
                  coverage: float = COVERAGE) -> DataFrame:
    """Every license found: ``key``, ``license``, ``coverage``, ``begin`` and ``end`` (words, end exclusive).

    Words are lower-case runs of letters and digits. Matches of one text do not
    overlap: of two, that with more aligned words stays. A null or empty text
    has none; a null key stays null; repeated rows give repeated results; an
    empty table gives an empty one. Other columns are ignored.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(templates or TEMPLATES, coverage))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *f) for k, t in zip(batch["_key"], batch["_text"]) for f in scanner.value.scan(words_of(t))]
            yield pd.DataFrame(rows, columns=["_key", "license", "coverage", "begin", "end"])

    schema = f"_key {dict(docs.dtypes)[key]}, license string, coverage double, begin int, end int"
    return (docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInPandas(scan, schema)
            .withColumnRenamed("_key", key))
