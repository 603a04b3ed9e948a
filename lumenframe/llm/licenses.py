"""License scans: winnowed fingerprints pick candidates, banded alignment reports spans.

Words are runs of ASCII letters and digits and of other non-ASCII bytes, A-Z lowered.
The fingerprints of a text are the least hashes of every ``WINDOW`` neighbouring
``GRAM``-word hashes, so a run of GRAM + WINDOW - 1 words that a text shares with a
template always shares a fingerprint.  The templates' fingerprints form an inverted index
of fixed size that every task holds.  Hits of a template on nearby diagonals are one
candidate; a local alignment in a band around them counts equal words and gives the span.
What is left and right of a span is aligned again, and diagonals half a template apart are
never one candidate, so that short statements on neighbouring lines stay apart.

Defined cases: null and empty texts match nothing; a template that occurs several times
is reported each time; matches with equal span prefer the higher coverage, then the name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import common
from lumenframe.llm.textvec import Words, mix, runs

GRAM, WINDOW, BAND = 3, 3, 8
LEAST = 0.75  # share of a template's words that must match
_U = np.uint64

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_WARRANTY_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_FSF = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a copy of the {0} along with this program. If not, see"


def _fsf(name: str, version: str) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. " + _FSF.format(name)


#: License identifier and kind (text, notice or statement) of each template.
TEMPLATES: dict[tuple[str, str], str] = {
    ("MIT", "text"): 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _WARRANTY_MIT,
    ("ISC", "text"): 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ("BSD-2-Clause", "text"): _BSD_HEAD + " " + _BSD_TAIL,
    ("BSD-3-Clause", "text"): _BSD_HEAD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL,
    ("Zlib", "text"): "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ("Unlicense", "text"): "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ("BSL-1.0", "text"): "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ("Apache-2.0", "notice"): 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ("MPL-2.0", "notice"): "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ("GPL-2.0-or-later", "notice"): _fsf("GNU General Public License", "2"),
    ("GPL-3.0-or-later", "notice"): _fsf("GNU General Public License", "3"),
    ("LGPL-3.0-or-later", "notice"): _fsf("GNU Lesser General Public License", "3"),
    ("AGPL-3.0-or-later", "notice"): _fsf("GNU Affero General Public License", "3"),
    ("MIT", "statement"): "Released under the MIT License",
    ("MIT", "statement 2"): "Licensed under the MIT License",
    ("Apache-2.0", "statement"): "Licensed under the Apache License, Version 2.0",
    ("GPL-3.0", "statement"): "licensed under the GNU General Public License, version 3",
    ("GPL-2.0", "statement"): "licensed under the GNU General Public License, version 2",
    ("BSD-3-Clause", "statement"): "Licensed under the BSD 3-Clause License",
    ("CC-BY-NC-4.0", "statement"): "Licensed under CC BY-NC 4.0",
    ("CC-BY-4.0", "statement"): "Licensed under CC BY 4.0",
    ("CC-BY-SA-4.0", "statement"): "Licensed under CC BY-SA 4.0",
    ("CC-BY-4.0", "statement 2"): "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ("CC0-1.0", "statement"): "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain",
    ("MPL-2.0", "statement"): "Licensed under the Mozilla Public License, version 2.0",
}


def winnow(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of the fingerprints, documents apart."""
    at, doc, h = w.windows(GRAM)
    n = len(h)
    if not n:
        return at, h
    # of windows that reach over a text's end only the part inside it counts
    pick = np.zeros(n, bool)
    best, where = h.copy(), np.arange(n)
    for k in range(1, WINDOW):
        j = np.arange(n) + k
        ok = j < n
        j[~ok] = 0
        ok &= (doc[j] == doc) & (h[j] < best)
        best[ok], where[ok] = h[j][ok], j[ok]
    full = np.zeros(n, bool)
    last = np.arange(n) + WINDOW - 1
    full[last < n] = doc[last[last < n]] == doc[: n - WINDOW + 1]
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    pick[where[full | first]] = True
    return at[pick], h[pick]


class Index:
    """The templates' words and their fingerprints in one sorted array."""

    def __init__(self, templates: dict[tuple[str, str], str] = TEMPLATES):
        self.names = list(templates)
        w = Words(pa.array(list(templates.values())), lower=True, inside=WORD)
        self.words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.size = np.diff(w.first)
        at, h = winnow(w)
        o = np.lexsort((at, h))
        self.print = h[o]
        self.owner = np.searchsorted(w.first, at[o], "right") - 1
        self.place = at[o] - w.first[self.owner]

    def candidates(self, w: Words) -> Iterator[tuple[int, int, int, int]]:
        """(document, template, least and greatest diagonal) of groups of hits."""
        at, h = winnow(w)
        lo, hi = np.searchsorted(self.print, h), np.searchsorted(self.print, h, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return
        n = (hi - lo)[hit]
        who = np.repeat(at[hit], n)
        e = np.concatenate([np.arange(a, b) for a, b in zip(lo[hit], hi[hit], strict=True)])
        doc = np.searchsorted(w.first, who, "right") - 1
        diag = who - w.first[doc] - self.place[e]
        o = np.lexsort((diag, self.owner[e], doc))
        doc, own, diag = doc[o], self.owner[e][o], diag[o]
        gap = np.minimum(BAND, (self.size[own] - 1) // 2)
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]) | (diag[1:] - diag[:-1] > gap[1:])])
        head = np.flatnonzero(new)
        for a, b in zip(head, np.append(head[1:], len(doc)), strict=True):
            yield int(doc[a]), int(own[a]), int(diag[a]), int(diag[b - 1])


def align(text: np.ndarray, template: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment on diagonals low - BAND .. high + BAND: equal words, first and last word (exclusive) in the text."""
    lo, hi = low - BAND, high + BAND
    width = hi - lo + 1
    # cell: (score, equal words, begin), by diagonal; score 2 a match, -1 a mismatch or gap
    prev = [(0, 0, -1)] * (width + 2)
    best = (0, 0, -1, 0)
    for i, t in enumerate(template.tolist()):
        cur = [(0, 0, -1)] * (width + 2)
        for k in range(width):
            j = i + lo + k
            if not 0 <= j < len(text):
                continue
            s, eq, b = prev[k + 1]  # the cell before both
            same = int(text[j]) == t
            one = (s + 2, eq + 1, b if s > 0 else j) if same else (s - 1, eq, b)
            up = prev[k + 2]  # template word without a partner
            left = cur[k]  # text word without a partner
            two, three = (up[0] - 1, up[1], up[2]), (left[0] - 1, left[1], left[2])
            x = max(one, two, three, key=lambda c: c[0])
            if x[0] <= 0:
                x = (0, 0, -1)
            cur[k + 1] = x
            if same and x[0] > best[0]:
                best = (x[0], x[1], x[2], j + 1)
        prev = cur
    return best[1], best[2], best[3]


def matches(index: Index, arr: pa.Array, least: float = LEAST) -> list[tuple[int, str, str, int, float, int, int]]:
    """(text number, license, kind, matched words, coverage, first and last code point) of each match."""
    w = Words(arr, lower=True, inside=WORD)
    found = []
    for d, k, low, high in index.candidates(w):
        a = int(w.first[d])
        text = w.hash[a : int(w.first[d + 1])]
        n = len(index.words[k])
        todo = [(max(0, low - BAND), min(len(text), high + n + BAND))]
        while todo:
            begin, end = todo.pop()
            if end - begin < max(1, least * n):
                continue
            equal, i, j = align(text[begin:end], index.words[k], low - begin, high - begin)
            if equal >= max(1, least * n):
                found.append((d, *index.names[k], equal, equal / n, int(w.start[a + begin + i]), int(w.end[a + begin + j - 1])))
                todo += [(begin, begin + i), (begin + j, end)]
    lead = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)]) if found else None
    found = [(*x[:5], *(int(lead[y] - lead[w.off[x[0]]]) for y in x[5:])) for x in set(found)]
    # one report a span: a statement inside a fuller match, or two versions of one notice, give way
    found.sort(key=lambda x: (x[0], -(x[3]), -x[4], x[1], x[2], x[5], x[6]))
    kept: list = []
    near: dict[tuple[int, int], list] = {}  # the kept spans that reach into a stretch of 256 code points
    for x in found:
        cells = [(x[0], c) for c in range(x[5] >> 8, (x[6] >> 8) + 1)]
        if not any(min(y[6], x[6]) - max(y[5], x[5]) > 0.5 * (x[6] - x[5]) for c in cells for y in near.get(c, ())):
            kept.append(x)
            for c in cells:
                near.setdefault(c, []).append(x)
    return sorted(kept, key=lambda x: (x[0], x[5]))


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per match: id, license, kind, matched_words, coverage, begin, end (code points); map-only."""
    kind = df.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    names = [id_col, "license", "kind", "matched_words", "coverage", "begin", "end"]

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index()
        for b in it:
            for i, j in runs(b.column(1)):
                m = matches(index, b.column(1).slice(i, j - i), least)
                ids = b.column(0).slice(i, j - i).take(pa.array([x[0] for x in m], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[k] for x in m], t) for k, t in ((1, pa.string()), (2, pa.string()), (3, pa.int64()), (4, pa.float64()), (5, pa.int64()), (6, pa.int64())))], names=names)

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(work, f"`{id_col}` {kind}, license string, kind string, matched_words bigint, coverage double, begin bigint, end bigint")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))
