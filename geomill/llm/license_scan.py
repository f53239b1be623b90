"""License scans by patience alignment of texts with license templates.

A text and a template are words (runs of word characters, lower-cased).  Windows of a text
with enough words of a template are aligned with it: equal beginnings and ends are taken off;
words that occur once in both become anchors, of which the longest sequence increasing in both
is kept; the gaps between anchors are aligned the same way.  A gap without such a word is
aligned by the longest common subsequence, whatever its size (a window is at most 1.5 templates
and four words long, so memory is bounded).  Coverage is the share of the template's words that
are aligned.

A window can only reach the coverage sought if it holds that share of the template's words, each
no oftener than the template does; this number is kept for all windows by sliding counts, and windows with
fewer are passed over without loss.  Of the others the longest common subsequence is measured
in bits before any alignment.  It bounds the alignment, and it grows by no more than one from a
window to the next, so a window that lacks k words is followed by that k places on.  Windows go on
behind each find; a text may hold a license several times.

Cases: null or empty text, or one without words, has no license: a row with n_licenses 0 and
nulls; ties of coverage go to the template listed first, then to the earlier place; an empty
table gives an empty result; repeated rows get equal values; other columns pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

_words = re.compile(r"\w+").findall

# Whole short licenses and the notices by which texts name the long ones, as published.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.
You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}


def words_of(text: str) -> list[str]:
    return _words(text.lower())


def rising(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        back[i] = piles[p - 1] if p else -1
        if p == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[p], piles[p] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: rows of the table as bits, a bit of 0 where the length grows."""
    full, at = (1 << len(b)) - 1, {}
    for j, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << j
    rows = [full]
    for w in a:
        v = rows[-1]
        u = v & at.get(w, 0)
        rows.append(((v + u) | (v - u)) & full)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif length(i - 1, j) == length(i, j):
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in the text, in the template), increasing in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once_a, once_c = Counter(text[a:b]), Counter(template[c:d])
        at = {w: i for i, w in enumerate(text[a:b], a) if once_a[w] == 1}
        pairs = [(at[w], j) for j, w in enumerate(template[c:d], c) if once_c[w] == 1 and w in at]
        if pairs:
            anchors = [pairs[i] for i in rising([i for i, _ in pairs])]
            out += anchors
            ends = [(a - 1, c - 1), *anchors, (b, d)]
            gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:], strict=False)]
        else:
            out += [(a + i, c + j) for i, j in common_subsequence(text[a:b], template[c:d])]
    return sorted(out)


def places_of(template: list[str]) -> dict[str, int]:
    """Word -> its places in the template, as bits."""
    out: dict[str, int] = {}
    for i, w in enumerate(template):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_length(text: list[str], places: dict[str, int], m: int) -> int:
    """Length of the longest common subsequence with a template of ``m`` words (``places_of``)."""
    full = (1 << m) - 1
    row = full
    for w in text:
        at = places.get(w)
        if at:
            u = row & at
            row = (row + u | row - u) & full
    return m - row.bit_count()


def overlaps(words: list[str], counts: dict[str, int], width: int) -> np.ndarray:
    """For the window at each place: its words that the template has, each no oftener than there.

    The k-th occurrence of a word that the template has c times counts for the windows that begin behind
    the (k - c)-th one, and hold it."""
    n = len(words)
    change = np.zeros(n + 1, np.int64)
    where: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w in counts:
            where.setdefault(w, []).append(i)
    for w, at in where.items():
        p = np.array(at)
        first = np.maximum(p - width + 1, 0)
        c = counts[w]
        first[c:] = np.maximum(first[c:], p[:-c] + 1)
        np.add.at(change, first, 1)
        np.add.at(change, p + 1, -1)
    return np.cumsum(change[:n])


class Find(NamedTuple):
    license: str
    coverage: float
    first: int
    last: int


class Scanner:
    """Finds the templates in texts, at a coverage of ``least`` or more."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = 0.8):
        self.least = least
        self.templates = {k: words_of(v) for k, v in templates.items()}
        self.sets = {k: set(v) for k, v in self.templates.items()}
        self.counts = {k: Counter(v) for k, v in self.templates.items()}
        self.places = {k: places_of(v) for k, v in self.templates.items()}
        self.distinct = {k: self.missing(v) for k, v in self.templates.items()}

    def missing(self, template: list[str]) -> int:
        """Different words of the template that a text must have at least: without k of them, k places stay unaligned."""
        can_miss = int(len(template) * (1 - self.least) + 1e-9)
        return max(1, len(set(template)) - can_miss)

    def scan(self, text: str) -> list[Find]:
        words = words_of(text)
        here = set(words)
        out: list[Find] = []
        for name, template in self.templates.items():
            vocabulary = self.sets[name]
            if len(here & vocabulary) < self.distinct[name]:
                continue
            m = len(template)
            width, need = m + m // 2 + 4, -(-int(self.least * m * 1000) // 1000)
            hit = np.fromiter((w in vocabulary for w in words), bool, len(words))
            able = np.flatnonzero(hit & (overlaps(words, self.counts[name], width) >= need))
            past = 0
            for i in able.tolist():
                if i < past:
                    continue
                lack = need - common_length(words[i : i + width], self.places[name], m)
                if lack > 0:
                    past = i + lack
                    continue
                pairs = align(words[i : i + width], template)
                while pairs and pairs[0][0]:  # the window may have cut off the end: start at the find itself
                    i += pairs[0][0]
                    again = align(words[i : i + width], template)
                    pairs = again if len(again) >= len(pairs) else [(p - pairs[0][0], q) for p, q in pairs]
                if pairs and len(pairs) >= self.least * m - 1e-9:
                    out.append(Find(name, round(len(pairs) / m, 6), i + pairs[0][0], i + pairs[-1][0]))
                    past = i + pairs[-1][0] + 1
        return out


ADDED = [
    T.StructField("n_licenses", T.LongType()), T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("found", T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())]))),
]


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8, text: str = "text", drop: bool = False) -> DataFrame:
    """``docs`` with all finds, their number and the best one."""

    def make():
        scanner = Scanner(templates, least)
        rank = {k: i for i, k in enumerate(templates)}

        def each(arr: pa.Array) -> dict[str, pa.Array]:
            rows = [scanner.scan(t.as_py() or "") for t in arr]
            best = [min(r, key=lambda f: (-f.coverage, rank[f.license], f.first)) if r else None for r in rows]
            pick = lambda get, kind: pa.array([get(b) if b else None for b in best], kind)
            kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
            found = pa.array([[{"license": f.license, "coverage": f.coverage, "first_word": f.first, "last_word": f.last} for f in r] for r in rows], kind)
            return {"n_licenses": pa.array([len(r) for r in rows], pa.int64()), "license": pick(lambda b: b.license, pa.string()), "coverage": pick(lambda b: b.coverage, pa.float64()), "first_word": pick(lambda b: b.first, pa.int64()), "last_word": pick(lambda b: b.last, pa.int64()), "found": found}

        return each

    return append_columns(docs, text, make, ADDED, drop)


def finds(scanned: DataFrame, id: str = "doc_id") -> DataFrame:
    """One row for each find of ``scan_licenses``."""
    return scanned.select(id, F.explode("found").alias("f")).select(id, "f.*")
