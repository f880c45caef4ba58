"""Licence texts found by patience alignment.

A template is aligned with a stretch of a document: words that occur once in both are matched, the
longest increasing run of those matches is kept as anchors, and each gap between anchors is aligned
in the same way; where no such word is left, equal words at both ends of the gap are matched.
Coverage is the share of the template's words that are matched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import PUNCT, word_hashes

COVERAGE = 0.8
DENSITY = 0.6  # matched words of the stretch from the first to the last match

#: Licence templates (fixed values: public licence wordings).
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY
OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.""",
    "Apache-2.0": """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License.""",
    "BSD": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "GPL-3.0": """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "LGPL-2.1": """
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more
details.""",
    "MPL-2.0": """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",
    "Zlib": """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The
origin of this software must not be misrepresented; you must not claim that you wrote the original software.""",
}


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of two word lists, increasing in both."""
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
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if cb[w] == 1}
        pairs = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if ca[w] == 1 and w in where]
        chain = _increasing(pairs)
        if not chain:
            continue
        out += chain
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs that increases in the second place, by patience piles."""
    tops: list[int] = []
    top_at: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back[n] = top_at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(j)
            top_at.append(n)
        else:
            tops[pile], top_at[pile] = j, n
    out, n = [], top_at[-1] if top_at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


class Templates:
    def __init__(self, texts: dict[str, str] = TEMPLATES, coverage: float = COVERAGE):
        self.names = list(texts)
        self.words = [np.concatenate([h for _, h, _ in word_hashes(pa.array([t]), PUNCT, True)]) for t in texts.values()]
        self.vocab = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)
        self.need = [len(w) if len(w) <= 5 else int(np.ceil(coverage * len(w))) for w in self.words]
        self.has = np.zeros((len(self.vocab), len(self.words)), np.int32)
        for t, w in enumerate(self.words):
            self.has[np.searchsorted(self.vocab, w), t] = 1
        # a template covered to ``need`` words lacks at most the rest, so shows this many distinct ones
        self.least = self.has.sum(0) - np.array([len(w) - n for w, n in zip(self.words, self.need, strict=True)])

    def _grown(self, doc: np.ndarray, words: list, a: int, b: int) -> list[tuple[int, int]]:
        """Alignment of the stretch [a, b), drawn in to its matches and out by what the template lacks
        at either end, as long as that matches more words.  Places are those of the document."""
        best: list[tuple[int, int]] = []
        while True:
            found = [(a + i, j) for i, j in patience(doc[a:b].tolist(), words)]
            if len(found) <= len(best):
                return best
            best = found
            (first, head), (last, tail) = best[0], best[-1]
            a = max(0, first - int(head / DENSITY) - 1)
            b = min(len(doc), last + 2 + int((len(words) - 1 - tail) / DENSITY))

    def find(self, doc: np.ndarray, t: int, known: np.ndarray) -> list[tuple[int, int, int]]:
        """(first word, end, matched) of each place in a document, best first of those that overlap.

        Windows of the longest stretch a copy may take start at a grid of half that length, so each
        copy lies in one whole or nearly, and at each place where two of the template's first three
        words stand, so copies that follow each other align from their heads.
        """
        words = self.words[t]
        n, flat = len(words), words.tolist()
        hit = self.has[known, t].astype(bool) & (known >= 0)
        run = np.concatenate([[0], np.cumsum(hit)])
        longest = int(n / DENSITY) + 2
        grid = np.arange(0, max(1, len(doc)), max(1, longest // 2))
        head = np.flatnonzero(doc == words[0])
        if n > 1:
            near = [np.append(doc[k:], np.zeros(k, doc.dtype))[head] for k in (1, 2)]
            head = head[(near[0] == words[1]) | (near[1] == words[min(2, n - 1)])]
        starts = np.union1d(grid, head)
        ends = np.minimum(starts + longest + longest // 2, len(doc))
        full = run[ends] - run[starts] >= max(1, self.least[t])
        got = set()
        for a, b in zip(starts[full], ends[full], strict=True):
            if len(np.unique(doc[a:b][hit[a:b]])) >= self.least[t]:
                m = self._grown(doc, flat, int(a), int(b))
                if len(m) >= self.need[t] and len(m) >= DENSITY * (m[-1][0] - m[0][0] + 1):
                    got.add((-len(m), m[0][0], m[-1][0] + 1))
        out: list[tuple[int, int, int]] = []
        for m, a, b in sorted(got):
            at = bisect_left(out, (a, b, 0))
            if (at == len(out) or out[at][0] >= b) and (at == 0 or out[at - 1][1] <= a):
                out.insert(at, (a, b, -m))
        return out


def scan(docs: DataFrame, texts: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, start_word, end_word, matched, template_words, coverage for every place.

    Words are runs of letters, digits and non-ASCII bytes, lower-cased.  Templates of up to 5 words
    must match whole; longer ones to ``coverage``, with matches dense in their stretch.  Null and
    empty texts hold none.  Repeated rows each give their places.  Each text is read in windows of
    a fixed multiple of a template's length that overlap, so the work is linear in the text.  Other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Templates(texts, coverage))

    names = ["doc_id", "license", "start_word", "end_word", "matched", "template_words", "coverage"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tm = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for i, h, offs in word_hashes(batch.column(1), PUNCT, True):
                at = np.minimum(np.searchsorted(tm.vocab, h), max(0, len(tm.vocab) - 1))
                known = np.where(tm.vocab[at] == h, at, -1) if len(h) else np.zeros(0, int)
                in_v = np.flatnonzero(known >= 0)
                row = np.searchsorted(offs, in_v, "right") - 1
                shown = np.zeros((len(offs) - 1, len(tm.vocab)), np.int32)
                shown[row, known[in_v]] = 1
                for r, t in zip(*np.nonzero(shown @ tm.has >= np.maximum(1, tm.least)), strict=True):
                    own = slice(offs[r], offs[r + 1])
                    for a, b, m in tm.find(h[own], t, known[own]):
                        n = len(tm.words[t])
                        rows.append((batch.column(0)[int(i + r)].as_py(), tm.names[t], a, b, m, n, m / n))
            cols = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types, strict=True)], names=names)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    columns = "doc_id long, license string, start_word long, end_word long, matched long, template_words long, coverage double"
    return src.mapInArrow(run, columns)
