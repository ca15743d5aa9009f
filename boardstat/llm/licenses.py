"""License scans by patience alignment of whole texts with license templates.

Text and template are aligned on words that occur once in both: the longest increasing subsequence of their places
fixes anchors, and the gaps between anchors are aligned the same way. Coverage is the part of the template's words
that are aligned. A template that stands together is aligned in windows of the text; one that other words tear apart is
aligned over the chain of its runs of words, however far these lie from one another.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Set
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .shared import as_bytes, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+")

#: License texts and notices by name.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-2.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option)
any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more
details.""",
    "LGPL-3.0": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more
details.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more
details.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License
2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",
    "MIT SPDX notice": "SPDX-License-Identifier: MIT",
    "ISC SPDX notice": "SPDX-License-Identifier: ISC",
    "Apache-2.0 SPDX notice": "SPDX-License-Identifier: Apache-2.0",
    "BSD-2-Clause SPDX notice": "SPDX-License-Identifier: BSD-2-Clause",
    "BSD-3-Clause SPDX notice": "SPDX-License-Identifier: BSD-3-Clause",
    "MPL-2.0 SPDX notice": "SPDX-License-Identifier: MPL-2.0",
    "EPL-2.0 SPDX notice": "SPDX-License-Identifier: EPL-2.0",
    "Unlicense SPDX notice": "SPDX-License-Identifier: Unlicense",
    "BSD-2-Clause short notice": "BSD 2-Clause License",
    "BSD-3-Clause short notice": "BSD 3-Clause License",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1 notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache notice": "Released under the Apache License.",
    "BSD notice": "Released under the BSD License.",
    "CC-BY-4.0 short notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0 notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0 notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0 notice": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-SA-4.0 long notice":
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 long notice":
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0 long notice":
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0 long notice":
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0 long notice":
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
}

#: Words that tell a license from its relatives: those a template has must be aligned, and a place where only such words
#: stand between two words that follow each other in the template is another license's.
NAMES = frozenset("mit apache bsd cc nc sa nd noncommercial sharealike noderivatives lesser affero".split())
NAMES |= frozenset("isc mpl epl unlicense mozilla eclipse spdx identifier endorse".split())
BETWEEN = NAMES | frozenset("non commercial share alike no derivatives derivs noderivs library".split())
NUMBER = re.compile(r"[0-9]+")
VERSIONED = frozenset("version v by attribution apache bsd mpl epl".split())
RUN = 5  # words of a run that counts as part of a license wherever it stands


def distinguishing(template: list[str]) -> set[str]:
    """A template's names and the numbers of its version, which follow `version`, a name, or one another."""
    found: list[int] = []
    for place, word in enumerate(template):
        before = template[place - 1] if place else ""
        if word in NAMES or (NUMBER.fullmatch(word) and (before in VERSIONED or place - 1 in found)):
            found.append(place)
    return {template[place] for place in found}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    below = [-1] * len(values)
    for place, value in enumerate(values):
        pile = bisect_left(tops, value)
        if pile == len(tops):
            tops.append(value)
            piles.append(place)
        else:
            tops[pile], piles[pile] = value, place
        below[place] = piles[pile - 1] if pile else -1
    found, at = [], piles[-1] if piles else -1
    while at >= 0:
        found.append(at)
        at = below[at]
    return found[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned places (text, template), both increasing.

    A gap with common unique words is cut at the longest increasing run of them; one without is aligned word by word,
    by its longest common subsequence. Gaps are kept in a list, not on the call stack.
    """
    pairs, gaps = [], [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        places = {w: p for p, w in enumerate(template[c:d], c) if there[w] == 1 and here[w] == 1}
        common = [(p, places[w]) for p, w in enumerate(text[a:b], a) if w in places]
        if not common:
            pairs += [(a + x, c + y) for x, y in _common_subsequence(text[a:b], template[c:d])]
            continue
        anchors = [common[k] for k in _increasing([q for _, q in common])]
        pairs += anchors
        for (x, y), (z, w) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
            if x + 1 < z and y + 1 < w:
                gaps.append((x + 1, z, y + 1, w))
    return sorted(pairs)


def _common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    seen = set(a) & set(b)
    left = [(p, w) for p, w in enumerate(a) if w in seen]
    right = [(p, w) for p, w in enumerate(b) if w in seen]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left) - 1, -1, -1):
        for j in range(len(right) - 1, -1, -1):
            best[i][j] = (best[i + 1][j + 1] + 1 if left[i][1] == right[j][1]
                          else max(best[i + 1][j], best[i][j + 1]))
    found, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        if left[i][1] == right[j][1]:
            found.append((left[i][0], right[j][0]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


class Scanner:
    """Templates with the words by which a text can hold them.

    A text whose coverage of a template of n words reaches the threshold has aligned more than n - m of them for any m
    words that together exceed the rest, so it has one of the template's longest words that make up such an m.
    """

    def __init__(self, templates: Mapping[str, str], coverage: float):
        self.coverage, self.templates, self.marks = coverage, {}, {}
        self.counts, self.needed = {}, {}
        for name, template in templates.items():
            known = words(template)
            if known:
                counts, marks, n = Counter(known), set(), 0
                for word in sorted(counts, key=lambda w: (-len(w), w)):
                    if n > (1 - coverage) * len(known) + 1e-9:
                        break
                    marks.add(word)
                    n += counts[word]
                self.templates[name], self.marks[name], self.counts[name] = known, marks, counts
                self.needed[name] = distinguishing(known)
        self.all_marks = sorted(set().union(*self.marks.values())) if self.marks else []
        self.runs: dict[tuple[str, ...], list[tuple[str, int]]] = {}
        for name, template in self.templates.items():
            for place in range(len(template) - 1, RUN - 2, -1):  # last places first: a chain rises
                first = place - RUN + 1
                self.runs.setdefault(tuple(template[first:place + 1]), []).append((name, first))

    def scan(self, text: str) -> Iterator[tuple[str, float, int, int, int]]:
        """(license, coverage, matched, first_word, end_word) of the best place of each template that reaches it.

        A word counts for one license: places are taken by aligned words, then coverage, and what a place has taken is
        no part of another; a place that loses words so is aligned again without them.
        """
        low = text.lower()
        if not any(mark in low for mark in self.all_marks):
            return
        found = WORD.findall(low)
        places: dict[str, list[int]] = {}
        marks = set(self.all_marks)
        for place, word in enumerate(found):
            if word in marks:
                places.setdefault(word, []).append(place)
        order = {name: k for k, name in enumerate(self.templates)}
        heap = []
        for name, template in self.templates.items():
            hits = sorted(p for mark in self.marks[name] for p in places.get(mark, ()))
            n = len(template)
            for block in sorted({k for p in hits for k in range(max(0, p // n - 2), p // n + 1)}):
                heap += self._place(found, name, order[name], block)
        chains = self._chains(found, set(self.templates) - {entry[5] for entry in heap})
        for name, chain in chains.items():
            heap += self._spread(found, name, order[name], chain)
        heapify(heap)
        best: dict[str, tuple] = {}
        taken: set[int] = set()
        while heap:
            matched, _, first, _, block, name, words_at = heappop(heap)
            if not taken.isdisjoint(words_at):
                for again in (self._spread(found, name, order[name], chains[name], taken) if block < 0
                              else self._place(found, name, order[name], block, taken)):
                    heappush(heap, again)
                continue
            taken.update(words_at)
            best.setdefault(name, (name, -matched / len(self.templates[name]), -matched, first, words_at[-1] + 1))
        yield from (best[name] for name in self.templates if name in best)

    def _place(self, found: list[str], name: str, order: int, block: int, taken: Set[int] = frozenset()) -> list[tuple]:
        """The alignment in a window of three template lengths as an entry of the heap, if it reaches the threshold;
        consecutive windows overlap by two lengths, so a place of up to two lengths is inside one."""
        template, counts = self.templates[name], self.counts[name]
        n, need = len(template), self.coverage * len(template) - 1e-9
        start = block * n
        window = found[start:start + 3 * n]
        if taken:
            window = ["" if start + k in taken else word for k, word in enumerate(window)]
        here = Counter(w for w in window if w in counts)
        if sum(min(k, counts[w]) for w, k in here.items()) < need:
            return []
        return self._entry(found, name, order, block, [(start + p, q) for p, q in align(window, template)], taken)

    def _entry(self, found: list[str], name: str, order: int, block: int, pairs: list[tuple[int, int]],
               taken: Set[int]) -> list[tuple]:
        """The heap entry of aligned places, if they reach the threshold and are no relative's."""
        template = self.templates[name]
        n = len(template)
        if len(pairs) < self.coverage * n - 1e-9 or not self.needed[name] <= {template[q] for _, q in pairs}:
            return []
        for (a, c), (b, d) in zip(pairs, pairs[1:]):
            if d == c + 1 and b > a + 1 and all(found[p] in BETWEEN and p not in taken for p in range(a + 1, b)):
                return []
        return [(-len(pairs), -len(pairs) / n, pairs[0][0], order, block, name, [p for p, _ in pairs])]

    def _chains(self, found: list[str], names: Set[str]) -> dict[str, list[tuple[int, int]]]:
        """Places (text, template) of all runs of the named templates that the text has words enough for."""
        here = Counter(found)
        names = {name for name in names if len(self.templates[name]) >= RUN and sum(
            min(here[w], k) for w, k in self.counts[name].items()) >= self.coverage * len(self.templates[name]) - 1e-9}
        chains: dict[str, list[tuple[int, int]]] = {}
        if names:
            for place in range(len(found) - RUN + 1):
                for name, first in self.runs.get(tuple(found[place:place + RUN]), ()):
                    if name in names:
                        chains.setdefault(name, []).append((place, first))
        return chains

    def _spread(self, found: list[str], name: str, order: int, hits: list[tuple[int, int]],
                taken: Set[int] = frozenset()) -> list[tuple]:
        """The alignment over the longest chain of runs, any number of words apart, as an entry of the heap. Words between
        two runs are aligned too unless far more stand between them than in the template."""
        template = self.templates[name]
        n = len(template)
        if taken:
            hits = [(p, q) for p, q in hits if taken.isdisjoint(range(p, p + RUN))]
        pairs: list[tuple[int, int]] = []
        for place in _increasing([q for _, q in hits]):
            for p, q in zip(range(hits[place][0], hits[place][0] + RUN), range(hits[place][1], n)):
                if not pairs or (p > pairs[-1][0] and q > pairs[-1][1]):
                    pairs.append((p, q))
        if not pairs:
            return []
        filled = list(pairs)
        (a, c), (b, d) = pairs[0], pairs[-1]
        ends = [(max(-1, a - 2 * c - 1), -1), *pairs, (min(len(found), b + 2 * (n - d) - 1), n)]
        for (a, c), (b, d) in zip(ends, ends[1:]):
            if b > a + 1 and d > c + 1 and b - a <= 2 * (d - c) + RUN:
                between = [found[p] if p not in taken else "" for p in range(a + 1, b)]
                filled += [(a + 1 + p, c + 1 + q) for p, q in align(between, template[c + 1:d])]
        return self._entry(found, name, order, -1, sorted(filled), taken)


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document and license whose words it covers: id, license, coverage, matched, first_word, end_word.

    The place is the one with the most aligned words, the first of several; words are lower-case runs of letters and
    digits. A place lies within two template lengths of text; a license without such a place is looked for over the whole
    text, as the longest chain of runs of RUN words any distance apart, with single words where a gap is about as long as
    in the template. The names and version of a template must be aligned, and a word counts for one license only. Null and empty texts have none; repeated
    rows are scanned each.
    """
    kind = dict(docs.dtypes)[id_column]
    names = ["license", "coverage", "matched", "first_word", "end_word"]
    types = [pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]

    def scan(batches):
        scanner = Scanner(templates, coverage)
        for batch in small_batches(batches):
            rows = [(at, *found) for at, text in enumerate(as_bytes(batch.column(1)))
                    for found in scanner.scan(text.decode())]
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())),
                 *(pa.array(c, t) for c, t in zip(columns[1:], types))], [id_column, *names])

    return docs.select(id_column, text_column).mapInArrow(
        scan, f"`{id_column}` {kind}, license string, coverage double, matched int, first_word long, end_word long")
