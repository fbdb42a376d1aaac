"""License scans by patience alignment.

A text's words are aligned with a template's: words that stand once in both are anchors; the longest increasing
subsequence of their places is kept; the gaps between anchors, and the ends, are aligned the same way, after common words at
a gap's ends are matched. Coverage is the share of the template's words that are matched.

A match of a template of n words spans at most n * (1 + STRETCH) words of the text: this is what a match is, so words put into a notice
are allowed up to that number. Windows begin at words of the template, and only those that can reach the coverage are aligned: a text must have one of the words without which
it can't be reached, and the window enough words of the template. Both tests are exact bounds. Of these windows, overlapping ones too, the one of most
matched words counts (of equal ones the first); then what it matched is taken out and the rest is searched again, so that each notice of a text is found.
Each text is read whole, in its own row; there is no shuffle.

Defined results: a null, empty or unlicensed text gives no row; a very long text is read whole; repeated rows repeat
their results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches, read_table, text_of

MIN_COVERAGE = 0.8

#: Words of the text that a match may span beyond its template, as a share of the template's words.
STRETCH = 0.5

#: The notices that the licenses ask to be put into files, and the short licenses whole. The long licenses' own texts (Apache-2.0, GPL-3.0, MPL-2.0)
#: are not among them; license_spans() takes any dictionary of texts.
TEMPLATES = {
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
}

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of matched words, increasing in both; a worklist in place of recursion, so depth has no limit."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(b[b0:b1], b0) if cb[w] == 1 and ca[w] == 1}
        both = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if w in where]
        kept = [both[k] for k in increasing([j for _, j in both])]
        if not kept:
            continue
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        out += kept
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], min_coverage: float, stretch: float = STRETCH):
        self.min, self.stretch = min_coverage, stretch
        self.templates = {name: words(t) for name, t in templates.items()}
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in self.templates.values() for w in t), 1)}
        self.member, self.needed = {}, {}
        common = Counter(w for t in self.templates.values() for w in set(t))
        for name, t in self.templates.items():
            member = np.zeros(len(self.vocabulary) + 1, np.int32)
            member[[self.vocabulary[w] for w in t]] = 1
            self.member[name] = member
            # words that fill more of the template than may be missing: a text with none of them can't reach the coverage
            count, own, missing = Counter(t), [], 0
            for w in sorted(count, key=lambda w: (-len(w), common[w], w)):
                if missing > (1 - min_coverage) * len(t):
                    break
                own.append(w)
                missing += count[w]
            self.needed[name] = own
        self.triggers = sorted({w for own in self.needed.values() for w in own})

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, first and last matched word of the text) of each match, by template and place."""
        low = text.lower()
        seen = {w for w in self.triggers if w in low}
        names = [n for n, own in self.needed.items() if any(w in seen for w in own)]
        if not names:
            return []
        own = _WORD.findall(low)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in own), np.int64, len(own))
        out = []
        for name in names:
            work, found = [(0, len(own))], []
            inside = self.member[name][ids]
            while work:
                a, b = work.pop()
                if hit := self.best(name, own, inside, a, b):
                    found.append((name, *hit))
                    work += [(a, hit[2]), (hit[3] + 1, b)]
            out += sorted(found, key=lambda x: x[3])
        return out

    def best(self, name: str, own: list[str], inside: np.ndarray, a: int, b: int) -> tuple[float, int, int, int] | None:
        """Coverage, matched words, first and last matched word of the best window within own[a:b]."""
        t = self.templates[name]
        width = len(t) + int(len(t) * self.stretch)
        sums = np.concatenate([[0], np.cumsum(inside[a:b])])
        ends = np.minimum(np.arange(b - a) + width, b - a)
        most = sums[ends] - sums[:-1]
        may = np.flatnonzero((most >= self.min * len(t)) & (inside[a:b] > 0))
        out, matched = None, 0
        for p, limit in zip((may + a).tolist(), most[may].tolist()):
            if matched == len(t):
                break
            if limit <= matched:  # too few of the template's words to better the best window
                continue
            pairs = align(own[p : min(p + width, b)], t)
            if len(pairs) > matched and len(pairs) / len(t) >= self.min:
                matched = len(pairs)
                out = (matched / len(t), matched, p + pairs[0][0], p + pairs[-1][0])
        return out


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text", stretch: float = STRETCH) -> DataFrame:
    """A row for each match of a template in a document: doc_id, license_id, coverage, matched_words, first_word, last_word."""
    byte_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    templates = dict(templates or TEMPLATES)

    def run(batches):
        scanner = Scanner(templates, min_coverage, stretch)
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column("text")):
                for hit in scanner.scan(text.as_py()):
                    rows.append(i)
                    found.append(hit)
            cols = list(zip(*found)) or [()] * 5
            types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, types))], ["doc_id", "license_id", "coverage", "matched_words", "first_word", "last_word"])

    return source.mapInArrow(run, f"doc_id {id_type}, license_id string, coverage double, matched_words bigint, first_word bigint, last_word bigint")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans(read_table(spark, sf_dir, "documents"))
