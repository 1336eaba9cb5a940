"""Licence scan: runs of words compared to licence templates by Dice over word bigrams.

All runs of a text's words are compared, across lines, comment signs and sentences, as the best begin and end with a
bigram of the template. A run can only reach the threshold with a template if their numbers of bigrams are within (2 - t) / t of each other,
and if it has one of any set of over (2 - 2t) / (2 - t) of the template's bigrams: such a set, of its longest ones, is
searched in the whole text first, which loses nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm import kernel
from trawl.llm.store import bounded_batches

DICE = 0.8
_NO_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."


def _gnu(kind: str, version: str, what: str = "program") -> str:
    """The notice that a file under one of the GNU licences begins with."""
    grant = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    warranty = f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."
    return f"{grant} {warranty} You should have received a copy of the GNU {kind} Public License along with this {what}. If not, see <https://www.gnu.org/licenses/>."


def _grant(kind: str, version: str, what: str = "program") -> str:
    return _gnu(kind, version, what).split(" This " + what + " is distributed")[0]


# Notices by which licences are granted and short licences as a whole, in their usual wording.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license."),
    "MIT-text": (_MIT, f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_NO_WARRANTY}"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", _grant("General", "3"), _gnu("General", "3")),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", _grant("General", "2"), _gnu("General", "2")),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", _grant("Lesser General", "3"), _gnu("Lesser General", "3")),
    "LGPL-2.1": (_grant("Lesser General", "2.1", "library"), _gnu("Lesser General", "2.1", "library")),
    "AGPL-3.0": (_grant("Affero General", "3"), _gnu("Affero General", "3")),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Use of this source code is governed by a BSD-style license."),
    "BSD-2-Clause": (f"{_BSD_TWO} {_BSD_WARRANTY}",),
    "BSD-3-Clause": (f"{_BSD_TWO} {_BSD_THIRD} {_BSD_WARRANTY}",),
    "ISC": (f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}"),
    "0BSD": (f"{_ISC}. {_ISC_WARRANTY}",),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released into the public domain under CC0 1.0.",),
    "Proprietary": ("All rights reserved.",),
}
_GAP = re.compile(r"[\W_]+")


def normalise(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def bigrams(text: str) -> Counter:
    """The multiset of word bigrams; a single word counts as one with itself."""
    words = normalise(text).split()
    return Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter((w, w) for w in words)


class Templates:
    def __init__(self, texts: dict[str, tuple[str, ...]], least: float):
        self.least = least
        self.known = [(name, bigrams(t)) for name, own in texts.items() for t in own]
        self.sizes = [b.total() for _, b in self.known]
        self.anchors = set()
        for _, b in self.known:
            missing = 0  # bigrams, repeats included, of a text that has none of the anchors so far
            for g in sorted(b, key=lambda g: (-len(" ".join(g)), g)):
                if missing > b.total() * (2 - 2 * least) / (2 - least) + 1e-9:
                    break
                self.anchors.add(f" {' '.join(dict.fromkeys(g))} ")
                missing += b[g]
        self.having: dict[tuple[str, str], list[int]] = {}
        for i, (_, b) in enumerate(self.known):
            for g in b:
                self.having.setdefault(g, []).append(i)
        # a template of one word has it as its bigram with itself
        self.single = {g[0]: own for _, b in self.known for g in b if (own := [i for i in self.having[g] if self.sizes[i] == 1 and g[0] == g[1]])}

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k != "automaton"}

    def search(self, text: str) -> bool:
        if "automaton" not in vars(self):
            self.automaton = ahocorasick.Automaton()
            for a in self.anchors:
                self.automaton.add_word(a, True)
            self.automaton.make_automaton()
        return next(self.automaton.iter(f" {normalise(text)} "), None) is not None

    def windows(self, template: int, at: list[int], grams: list[tuple[str, str]]) -> Iterator[tuple[int, float, int, int]]:
        """(bigrams in common, similarity, first, last bigram) of the best run from each start; at are places of the template's bigrams."""
        b, size = self.known[template][1], self.sizes[template]
        longest, common = size * (2 - self.least) / self.least + 1e-9, size * self.least / (2 - self.least) - 1e-9
        for k, start in enumerate(at):
            end = bisect_right(at, start + longest - 1)
            if end - k < common:
                continue
            left, shared, best = dict(b), 0, (0.0, 0, 0)
            for p in at[k:end]:
                if left[grams[p]]:
                    left[grams[p]] -= 1
                    shared += 1
                    best = max(best, (2 * shared / (size + p - start + 1), -p, shared))
            if best[0] >= self.least:
                yield best[2], best[0], start, -best[1]

    def runs(self, words: list[str]) -> Iterator[tuple[str, int, float, int, int]]:
        """(licence, bigrams in common, similarity, first, last bigram) of runs of words that reach the threshold, the
        best from each start among them."""
        grams = list(zip(words, words[1:], strict=False))
        places: dict[int, list[int]] = {}
        for p, g in enumerate(grams):
            for i in self.having.get(g, ()):
                places.setdefault(i, []).append(p)
        for i, at in places.items():
            if self.sizes[i] > 1 or i not in self.single.get(grams[at[0]][0], ()):
                yield from ((self.known[i][0], *w) for w in self.windows(i, at, grams))
        for p, w in enumerate(words if self.single else ()):
            yield from ((self.known[i][0], 1, 1.0, p, p - 1) for i in self.single.get(w, ()))

    def notices(self, text: str) -> dict[str, tuple[float, int, int]]:
        """By licence: the best similarity of a run of words, the first line where one begins, and the number of lines
        where one begins. Of runs that overlap, of any licence, the one with most bigrams in common counts, then the
        most similar, so a licence isn't found as others whose notices resemble its own."""
        words, lines = [], []
        for number, own in enumerate(text.split("\n")):
            own = normalise(own).split()
            words += own
            lines += [number] * len(own)
        taken, found = set(), {}
        for name, _, d, first, last in sorted(self.runs(words), key=lambda r: (-r[1], -r[2], r[3], r[0])):
            # places of words: one more than of bigrams
            own = range(first, last + 2)
            if taken.isdisjoint(own):
                taken.update(own)
                found.setdefault(name, {}).setdefault(lines[first], d)
        return {name: (best := max(kept.values()), min(k for k, d in kept.items() if d == best), len(kept)) for name, kept in found.items()}


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, least: float = DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, dice, line, n_lines): a row for each licence that a run of a document's words reaches.

    line is where the first of the best runs begins, n_lines the number of lines where runs that don't overlap begin. Null and empty texts have none; repeated rows are reported as often; ties go to the first line; a null id stays
    null; an empty table gives no rows; other columns of docs don't matter.
    """
    bounded_batches(docs.sparkSession)
    known = Templates(TEMPLATES if templates is None else templates, least)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("dice", pa.float64()), ("line", pa.int64()), ("n_lines", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part in kernel.pieces(batch, "text"):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if text and known.known and known.search(text):
                        rows += [(doc, name, round(d, 6), line, n) for name, (d, line, n) in sorted(known.notices(text).items())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, dice double, line long, n_lines long")
