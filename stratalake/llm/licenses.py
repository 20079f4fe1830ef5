"""Operator 5: license scan by Dice similarity of word bigrams between normalised text and licence templates.

Windows of words, regardless of lines, are compared with the templates. A window of s bigrams can reach similarity d with a
template of t only if s * d / (2 - d) <= t <= s * (2 - d) / d (windows are held to that many bigrams, repeated ones
counted), so it holds t * d / (2 - d) of the template's bigrams within
t * (2 - d) / d places; only where this is so, all windows that begin and end with a bigram of the template (others are no
better) are compared, all windows of one beginning at once: distinct bigrams are counted by the place of their last occurrence
before. All is done inside the row: no shuffle. Time grows with the text times the longest template that it resembles.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chained, pieces, span_hashes, table, text_bytes

DICE = 0.75
#: What GNU notices say after their first sentence; {} is the licence's name (fixed value).
_HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details."
#: The conditions and the disclaimer that BSD licences share (fixed values).
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."


def _gnu(name: str, program: str, version: str, mark: str) -> str:
    """First sentence of a GNU licence's notice."""
    return f"{program} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{',' if mark == ':' else ';'} either version {version} of the License, or (at your option) any later version."


_GNU = {
    "GPL-2.0": _gnu("GNU General Public License", "This program", "2", ";"),
    "GPL-3.0": _gnu("GNU General Public License", "This program", "3", ":"),
    "LGPL-2.1": _gnu("GNU Lesser General Public License", "This library", "2.1", ";"),
    "LGPL-3.0": _gnu("GNU Lesser General Public License", "This program", "3", ":"),
    "AGPL-3.0": _gnu("GNU Affero General Public License", "This program", "3", ":"),
}
_NAMES = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
#: Licence notices and texts to look for (fixed values): (id, text). Short notices, standard headers, and whole texts of
#: the licences that are short enough to stand in a file's head.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", _BSD), ("BSD-2-Clause", f"{_BSD} {_BSD_AS_IS}"), ("BSD-3-Clause", f"{_BSD} {_BSD_3}"), ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_BSD_AS_IS}"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", _ISC), ("ISC", f"{_ISC} {_ISC_AS_IS}"),
    ("MIT", "Released under the MIT License."), ("MIT", _MIT), ("MIT", f"{_MIT} {_MIT_AS_IS}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *[(k, f"This work is licensed under the {_NAMES[k.split('-')[0]]}, version {k.split('-')[1].removesuffix('.0')}.") for k in _GNU],
    *[(k, v) for k, v in _GNU.items()],
    *[(k, f"{v} {_HOPE.format(_NAMES[k.split('-')[0]])}") for k, v in _GNU.items()],
]



def whole_texts() -> list[tuple[str, str]]:
    """(id, text) of the licences that are kept as files beside this module, as they are published."""
    files = sorted((f for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in files]


#: Letters, digits and bytes beyond ASCII are kept, A-Z lower-cased; all else parts words. Newlines stay.
_NORMAL = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _NORMAL[_b] = _b
for _b in range(65, 91):
    _NORMAL[_b] = _b + 32
_NORMAL[10] = 10


class _Lines:
    """Words and bigrams of every line of some texts."""

    def __init__(self, texts: pa.Array):
        raw, off = text_bytes(texts)
        b = _NORMAL[raw]
        n = len(b)
        solid = (b != 32) & (b != 10)
        first = np.zeros(n + 1, bool)
        first[off] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        before &= ~first[:n]
        after &= ~first[1:]
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.hash = span_hashes(b, self.starts, self.ends)
        breaks = (b == 10).astype(np.int64)
        breaks[off[1:-1][off[1:-1] < n]] += 1  # a new document begins a new line
        line = np.cumsum(breaks)
        self.line = line[self.starts]
        self.doc = np.searchsorted(off, self.starts, "right") - 1
        self.off = off


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], dice: float):
        self.names, self.dice = [n for n, _ in templates], dice
        self.sets, self.most = [], []
        for _, text in templates:
            words = _Lines(pa.array([text.replace("\n", " ")]))
            grams = chained(words.hash, 2, 61)
            self.sets.append(np.unique(grams))
            self.most.append(int(len(grams) * (2 - dice) / dice + 1e-9))
        # index: for each bigram of any template, the templates that hold it
        gram = np.concatenate([np.zeros(0, np.uint64), *self.sets])
        owner = np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])
        order = np.lexsort((owner, gram))
        self.all, self.first, self.n = np.unique(gram[order], return_index=True, return_counts=True)
        self.owner = owner[order]

    def windows(self, before: np.ndarray, own: np.ndarray, doc: np.ndarray, i: int) -> list[tuple[float, float, int, int, int]]:
        """(weight, similarity, template, first, last bigram) of the best window from each place where one reaches dice. own:
        places of the template's bigrams; before: the place of each bigram's last occurrence before."""
        t, most = len(self.sets[i]), self.most[i]
        need = max(1, math.ceil(t * self.dice / (2 - self.dice) - 1e-9))
        if len(own) < need:
            return []
        d = doc[own]
        near = np.flatnonzero((own[need - 1 :] - own[: len(own) - need + 1] < most) & (d[need - 1 :] == d[: len(own) - need + 1]))
        if not len(near):
            return []
        mine = np.zeros(len(before), bool)
        mine[own] = True
        stop = np.minimum(own[near] + most, np.searchsorted(doc, d[near], "right") - 1)
        until = np.searchsorted(own, stop)
        out = []
        for k, a, end, m in zip(near.tolist(), own[near].tolist(), stop.tolist(), until.tolist(), strict=True):
            new = before[a:end] < a
            last = own[k:m] - a
            same = np.cumsum(new & mine[a:end])[last]
            dice = 2 * same / (np.cumsum(new)[last] + t)
            j = len(dice) - 1 - int(dice[::-1].argmax())  # of equally similar windows the longest
            if dice[j] >= self.dice:
                out.append((float(same[j] * dice[j]), float(dice[j]), i, a, int(own[k + j])))
        return out

    def __call__(self, texts: pa.Array) -> list[list[tuple[str, float, int, int]]]:
        """Per text: (licence, similarity, byte span) of its matching windows, none over another: those that share more of
        their template first."""
        w, out = _Lines(texts), [[] for _ in range(len(texts))]
        if len(w.hash) < 2 or not len(self.all):
            return out
        grams = chained(w.hash, 2, 61)
        at = np.minimum(np.searchsorted(self.all, grams), len(self.all) - 1)
        hit = np.flatnonzero((w.doc[1:] == w.doc[:-1]) & (self.all[at] == grams))
        n = self.n[at[hit]]
        place = np.repeat(hit, n)
        of = self.owner[np.repeat(self.first[at[hit]], n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)]
        place = place[np.argsort(of, kind="stable")]
        edge = np.cumsum(np.bincount(of, minlength=len(self.sets)))
        before = np.full(len(grams), -1, np.int64)
        order = np.argsort(grams, kind="stable")
        again = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
        before[order[again + 1]] = order[again]
        found = [x for i, own in enumerate(np.split(place, edge[:-1])) for x in self.windows(before, own, w.doc, i)]
        taken: list[tuple[int, int]] = []  # in order, none over another: only the last one that begins before an end can overlap
        for _, dice, i, a, b in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
            d = int(w.doc[a])
            k = bisect_right(taken, (b + 1, len(w.hash)))
            if k and a <= taken[k - 1][1] + 1 and w.doc[taken[k - 1][0]] == d:
                continue
            taken.insert(k, (a, b))
            begin = int(w.off[d])
            out[d].append((self.names[i], dice, int(w.starts[a]) - begin, int(w.ends[b + 1]) - begin))
        return [sorted(x, key=lambda y: y[2]) for x in out]


def scanned(docs: DataFrame, templates: list[tuple[str, str]] | None = None, dice: float = DICE) -> DataFrame:
    """doc_id, found array<struct<license, dice, start, stop>> per row of docs (doc_id, text); other columns are ignored.

    found lists the matching windows by their place (byte offsets in UTF-8); it is empty for null, empty and unlicensed
    texts. Of overlapping windows the one that shares more of its template wins, then the more similar, then the template
    listed first, then the earlier. Repeated rows come back as often as they came, null doc_ids stay. An empty table gives an
    empty result. A text is worked on whole in one task, at some 60 bytes of memory for each of its bytes. templates: (id, text),
    by default notices and short texts (TEMPLATES) and whole_texts().
    """
    bounded_batches(docs.sparkSession)
    known = [*TEMPLATES, *whole_texts()] if templates is None else templates

    def run(batches):
        scan = Scanner(known, dice)
        kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())]))
        for rb in pieces(batches):
            found = [[dict(zip(("license", "dice", "start", "stop"), y, strict=True)) for y in x] for x in scan(rb.column("text"))]
            yield table(doc_id=rb.column("doc_id"), found=pa.array(found, kind))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, found array<struct<license: string, dice: double, start: long, stop: long>>")
