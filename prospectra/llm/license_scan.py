"""Licence scans: Dice coefficient over word bigrams against templates.

Any run of a text's words may be a licence, wherever sentences or lines end.
Of a run, the bigrams (a multiset) are compared with a template's.  A run can
only reach the threshold t if its bigrams number between t / (2 - t) and
(2 - t) / t times the template's and it shares t / (2 - t) of them; so a
template is pruned where so many of its bigrams don't lie in a stretch of so
few words, and a text that lacks the words of more than the tolerable share of
a template's bigrams skips it altogether.  From each start that is left, the
end with the best coefficient is taken; a run begins and ends with a bigram of
the template, as any other would score less.

The long licences stand as whole texts in the folder ``licences``; the others,
and notices and headers, are given here.  Of the AGPL there is no whole text:
it is reported by its header.

Results for special cases: null and empty texts, and texts of fewer than two
words, have no licence; equal rows each give a row; a licence found twice is
listed twice with its offsets (code points, end exclusive); of overlapping runs
the best (then the longest, then the first by name) is reported, but a header
or notice inside the whole text that holds it is not told from that.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import cache
from importlib.resources import files

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

THRESHOLD = 0.8
WORD = re.compile(rb"[0-9a-z\x80-\xff]+(?:\.[0-9]+)*")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: The disclaimer that ends the BSD licences, and common licence notices, headers and texts.
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES = {
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "agpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General
Public License for more details.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution.
""" + BSD_DISCLAIMER,
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.
""" + BSD_DISCLAIMER,
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
Software is furnished to do so, all subject to the following:""",
    "bsd-3-clause-notice": "Released under the BSD 3-Clause License.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-long-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-1.0-notice": "Dedicated to the public domain under CC0 1.0.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
more details.""",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
more details.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "lgpl-3.0-opening": """This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the
GNU General Public License, supplemented by the additional permissions listed below.""",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit-notice": "Released under the MIT License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated
but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being
the original software. This notice may not be removed or altered from any source distribution.""",
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.translate(LOWER))


def bigrams(words: list) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum(min(n, b[k]) for k, n in a.items() if k in b) / total if total else 0.0


@cache
def whole_texts() -> dict[str, str]:
    """The whole texts of the long licences, by name."""
    folder = files(__package__).joinpath("licences")
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


class Templates:
    """Templates with their bigrams, sizes, and an index of bigrams; wholes names those that hold others as their parts."""

    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD, wholes: Iterable[str] = ()):
        self.t = threshold
        self.grams = {n: bigrams(words_of(x.encode())) for n, x in templates.items()}
        self.grams = {n: g for n, g in self.grams.items() if g}
        self.size = {n: sum(g.values()) for n, g in self.grams.items()}
        self.index: dict[tuple, set[str]] = defaultdict(set)
        self.anchors: set[bytes] = set()
        ratio = threshold / (2 - threshold)
        for n, g in self.grams.items():
            for k in g:
                self.index[k].add(n)
            # words of more of the bigrams than a match may lack: a text without any of them cannot match
            lack, taken = (1 - ratio) * self.size[n], 0
            for k in sorted(g, key=lambda k: (-max(map(len, k)), k)):
                self.anchors.add(max(k, key=len))
                taken += g[k]
                if taken > lack:
                    break
        #: The templates that a whole text holds, of half its size at most.
        self.parts = {n: {m for m, *_ in self.candidates(templates[n].encode()) if 2 * self.size[m] <= self.size[n]} for n in wholes}

    def bounds(self, name: str) -> tuple[float, float]:
        """Numbers of bigrams that a run may have."""
        ratio = self.t / (2 - self.t)
        return ratio * self.size[name], self.size[name] / ratio

    def runs(self, name: str, grams: list[tuple], at: list[int]):
        """(dice, first bigram, last bigram) of runs that reach the threshold, the best from each start."""
        size, counts = self.size[name], self.grams[name]
        low, high = self.bounds(name)
        need, most = math.ceil(low - 1e-9), math.floor(high + 1e-9)
        if len(at) < need:
            return
        places = np.array(at)
        starts = np.flatnonzero(places[need - 1 :] - places[: len(at) - need + 1] < most)
        if not len(starts):
            return
        # a bigram counts in a run if the one as many occurrences before as the template has lies before the run
        before, seen = np.full(len(at), -1), defaultdict(list)
        for h, i in enumerate(at):
            places_of = seen[grams[i]]
            n = counts[grams[i]]
            if len(places_of) >= n:
                before[h] = places_of[-n]
            places_of.append(h)
        for h in starts.tolist():
            end = np.searchsorted(places, places[h] + most)
            common = np.cumsum(before[h:end] < h)
            d = 2 * common / (places[h:end] - places[h] + 1 + size)
            best = int(d.argmax())
            if d[best] >= self.t - 1e-12:
                yield float(d[best]), at[h], at[h + best]

    def candidates(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """(template, dice, start, end) in bytes of every run that reaches the threshold, the best from each start."""
        low = text.translate(LOWER)
        if self.anchors.isdisjoint(WORD.findall(low)):
            return []
        tokens = [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]
        words = [t[0] for t in tokens]
        hits: dict[str, list[int]] = defaultdict(list)
        grams = list(zip(words, words[1:]))
        for i, k in enumerate(grams):
            for name in self.index.get(k, ()):
                hits[name].append(i)
        return [(name, d, tokens[i][1], tokens[j + 1][2]) for name, at in hits.items() for d, i, j in self.runs(name, grams, at)]

    def find(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """(template, dice, start, end) in bytes, by start."""
        found = self.candidates(text)
        # a header or notice inside the whole text that it is a part of is no licence of its own
        wholes = [f for f in found if self.parts.get(f[0])]
        found = [f for f in found if not any(f[0] in self.parts[w[0]] and w[2] <= f[2] and f[3] <= w[3] for w in wholes)] if len(found) > len(wholes) else found
        # of overlapping matches the best, then the longest, then the first by name
        kept: list = []
        for f in sorted(found, key=lambda f: (-round(f[1], 9), f[2] - f[3], f[0])):
            k = bisect_left(kept, f[2], key=lambda x: x[2])
            if (k == len(kept) or f[3] <= kept[k][2]) and (not k or kept[k - 1][3] <= f[2]):
                kept.insert(k, f)
        return kept


def license_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: n_licenses, the names (distinct, sorted), the best coefficient, and name:start:end of all."""

    def start():
        scan = Templates(templates, threshold) if templates else Templates(TEMPLATES | whole_texts(), threshold, whole_texts())

        def work(texts):
            out = {"n_licenses": [], "licenses": [], "best_dice": [], "license_spans": []}
            for t in texts:
                found = scan.find(t) if t else []
                place = (lambda x: x) if not found or t.isascii() else (lambda x: len(t[:x].decode()))
                out["n_licenses"].append(len(found))
                out["licenses"].append(",".join(sorted({f[0] for f in found})))
                out["best_dice"].append(max((f[1] for f in found), default=0.0))
                out["license_spans"].append(",".join(f"{n}:{place(a)}:{place(b)}" for n, _, a, b in found))
            return out

        return work

    return map_texts(docs, text, "n_licenses long, licenses string, best_dice double, license_spans string", start, {id_col: id_col})
