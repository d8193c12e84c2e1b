"""Licence scan: word bigrams of normalised text against licence templates, by the Dice coefficient.

A document's units are its lines, its paragraphs (between blank lines) and the whole text. A unit is
normalised (lower case, runs of letters and digits), and compared as a multiset of word bigrams: the Dice coefficient is
twice the bigrams in common over the bigrams of both. A coefficient of t needs sizes a and b with
a * t / (2 - t) <= b <= a * (2 - t) / t, so templates outside these bounds are pruned by size alone, and a unit
with none inside is not even cut into bigrams. The rest meet an index from bigrams to templates.

A licence inside a larger unit is found by windows of words. A template is sought in a text only where the bigrams in common
with the whole text reach a * t / (2 - t); then windows that begin and end at its bigrams, within the size bounds, are
counted as they slide. A window is listed where no unit of the same licence or of an equal coefficient overlaps it.

Templates are full licence texts, headers of source files, identifier lines, and notices of one line (forms by licence names); their number
is fixed, and they travel with the function. AGPL-3.0, EPL-2.0, Unlicense and CC-BY* are known by notices alone.
Each document is judged by itself: no shuffle.

Defined results: a null, empty or blank text has no units and no licence; of equal coefficients the larger template
wins, then the first licence in code-point order; rows stay as they are, repeated or not; a very long text is one unit besides its lines and
paragraphs, cut into bigrams only where its size or what it has in common with a template allows; columns may have any names; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

SIMILARITY = 0.8

#: Names that notices give to licences, after "the" where a form has it.
NAMES = {
    "MIT": ["MIT License", "MIT Licence", "Expat License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL version 2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "Modified BSD License", "New BSD License"],
    "ISC": ["ISC License"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
FORMS = [
    "Licensed under {}.",
    "Licensed under the {}.",
    "Released under {}.",
    "Released under the {}.",
    "Distributed under the {}.",
    "This work is licensed under {}.",
    "This work is licensed under the {}.",
    "This work is licensed under a {}.",
    "This project is licensed under the {}.",
    "This software is released under the {}.",
]
_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
    "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _DISCLAIMER + "OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
    "THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": _BSD_START + _BSD_END,
    "BSD-3-Clause": _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission. " + _BSD_END,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
    "notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
    "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
    "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy "
    "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
    "permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
    "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should "
    "have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
    "one at https://mozilla.org/MPL/2.0/.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
    "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
    "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use "
    "this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked "
    "as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

#: Files with the full texts of other licences.
FILES = {
    "Apache-2.0": "Apache-2.0",
    "GPL-2.0": "GPL-2",
    "GPL-3.0": "GPL-3",
    "LGPL-2.1": "LGPL-2.1",
    "LGPL-3.0": "LGPL-3",
    "CC0-1.0": "CC0-1.0",
    "MPL-2.0": "MPL-2.0",
}
#: Sizes of windows tried for a template, at most; between two of them the starts are tried one by one.
WIDTHS = 40

_word = re.compile(r"[^\W_]+").findall
_paragraph = re.compile(r"\n[^\S\n]*\n")


def templates() -> list[tuple[str, str]]:
    """(licence, text): each name in each form, the headers and the full texts."""
    notices = [(licence, form.format(name)) for licence, names in NAMES.items() for name in names for form in FORMS]
    notices += [(licence, f"SPDX-License-Identifier: {licence}") for licence in dict.fromkeys([*NAMES, *TEXTS])]
    folder = Path(__file__).parent / "licence_texts"
    return notices + list(TEXTS.items()) + [(licence, (folder / f"{name}.txt").read_text("utf-8")) for licence, name in FILES.items()]


def bigrams(text: str) -> Counter:
    words = _word(text.lower())
    return Counter(zip(words, words[1:]))


def units(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the lines, the paragraphs of more than one line, and the text if it is more than one paragraph."""
    at, paragraphs = 0, []
    for gap in _paragraph.finditer(text):
        paragraphs.append((at, gap.start()))
        at = gap.end()
    paragraphs.append((at, len(text)))
    for start, end in paragraphs:
        lines = 0
        at = start
        while at <= end:
            to = text.find("\n", at, end)
            to = end if to < 0 else to
            yield at, to
            lines += 1
            at = to + 1
        if lines > 1:
            yield start, end
    if len(paragraphs) > 1:
        yield 0, len(text)


class Scanner:
    """The index of the templates."""

    def __init__(self, known: list[tuple[str, str]], similarity: float = SIMILARITY):
        sized = sorted(((sum(b.values()), licence, b) for licence, b in ((licence, bigrams(t)) for licence, t in known) if b), key=lambda x: x[:2])
        self.sizes, self.names = [x[0] for x in sized], [x[1] for x in sized]
        self.low, self.high = similarity / (2 - similarity), (2 - similarity) / similarity
        self.similarity = similarity
        self.own = [x[2] for x in sized]
        self.index: dict = {}
        for k, (_, _, own) in enumerate(sized):
            for pair, n in own.items():
                self.index.setdefault(pair, []).append((k, n))

    def match(self, text: str) -> tuple[float, int, str] | None:
        """(coefficient, template size, licence) of the best template of enough similarity."""
        words = _word(text.lower())
        size = len(words) - 1
        first, last = bisect_left(self.sizes, size * self.low - 1e-9), bisect_right(self.sizes, size * self.high + 1e-9)
        if size < 1 or first >= last:
            return None
        pairs = list(zip(words, words[1:]))
        shared = self.index.keys() & set(pairs)
        if not shared:
            return None
        counts, common = Counter(p for p in pairs if p in shared), Counter()
        for pair, n in counts.items():
            for k, m in self.index[pair]:
                if first <= k < last:
                    common[k] += min(n, m)
        found = [(2 * n / (size + self.sizes[k]), self.sizes[k], self.names[k]) for k, n in common.items()]
        found = [x for x in found if x[0] >= self.similarity - 1e-12]
        return min(found, key=lambda x: (-x[0], -x[1], x[2])) if found else None


    def windows(self, text: str) -> list[tuple[int, int, tuple[float, int, str]]]:
        """(start, end, match) of the best windows of words that do not overlap each other."""
        words = _word(text.lower())
        pairs = list(zip(words, words[1:]))
        shared = self.index.keys() & set(pairs)
        if not shared:
            return []
        counts, common = Counter(p for p in pairs if p in shared), Counter()
        for pair, n in counts.items():
            for k, m in self.index[pair]:
                common[k] += min(n, m)
        found = []
        for k, n in common.items():
            if n >= self.sizes[k] * self.low - 1e-9:
                own = self.own[k]
                at = [i for i, p in enumerate(pairs) if p in shared and p in own]
                found += [(dice, self.sizes[k], self.names[k], a, b) for dice, a, b in self._windows(pairs, at, k)]
        found.sort(key=lambda x: (-x[0], -x[1], x[2], x[3]))
        kept: list = []
        for x in found:
            if all(x[4] < y[3] or x[3] > y[4] for y in kept):
                kept.append(x)
        places = _places(text) if kept else []
        return [(places[a][0], places[b + 1][1], (dice, size, name)) for dice, size, name, a, b in kept]

    def _windows(self, pairs: list, at: list[int], k: int) -> list[tuple[float, int, int]]:
        """(coefficient, first, last) of template k's windows; at: the places of its bigrams."""
        size, own = self.sizes[k], self.own[k]
        low, high = max(1, int(size * self.low)), int(size * self.high + 1e-9)
        step = max(1, -(-(high - low) // WIDTHS))
        ends: dict[int, float] = {}
        for width in range(low, high + step, step):
            inside: Counter = Counter()
            first = both = 0
            for last, place in enumerate(at):
                pair = pairs[place]
                inside[pair] += 1
                both += inside[pair] <= own[pair]
                while place - at[first] >= width:
                    gone = pairs[at[first]]
                    both -= inside[gone] <= own[gone]
                    inside[gone] -= 1
                    first += 1
                # of all starts that this width has over the last one, none is better than this
                best = 2 * both / (size + max(place - at[first] + 1 - step, both))
                if best >= self.similarity - 1e-12:
                    ends[last] = max(ends.get(last, 0.0), best)
        out: list[tuple[float, int, int]] = []
        for last in sorted(ends, key=lambda x: (-ends[x], x)):
            if any(a <= at[last] <= b for _, a, b in out):
                continue
            inside, both, top = Counter(), 0, (0.0, 0)
            for first in range(last, -1, -1):
                length = at[last] - at[first] + 1
                if length > high:
                    break
                pair = pairs[at[first]]
                inside[pair] += 1
                both += inside[pair] <= own[pair]
                top = max(top, (2 * both / (size + length), at[first]))
            if top[0] >= self.similarity - 1e-12:
                out.append((top[0], top[1], at[last]))
        return out


def _places(text: str) -> list[tuple[int, int]]:
    """(start, end) in the text of the words of its lower-case form."""
    lower = text.lower()
    found = [m.span() for m in re.finditer(r"[^\W_]+", lower)]
    if len(lower) == len(text):
        return found
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[s], origin[e - 1] + 1) for s, e in found]


def scan(docs: DataFrame, similarity: float = SIMILARITY, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, license (of the best unit, else null), dice (0 without one), n_matches and matches: licence:start:end of
    each matching unit, in order, joined by commas (code points, ends exclusive)."""
    known = templates() if known is None else known
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, similarity)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for value in batch.column(1):
                text, found = value.as_py() or "", []
                for start, end in units(text):
                    if best := scanner.match(text[start:end]):
                        found.append((start, end, best))
                for start, end, best in scanner.windows(text):
                    if not any(s < end and e > start and (b[2] == best[2] or b[0] >= best[0] - 1e-12) for s, e, b in found):
                        found.append((start, end, best))
                top = min((b for _, _, b in found), key=lambda x: (-x[0], -x[1], x[2]), default=(0.0, 0, None))
                listed = ",".join(f"{b[2]}:{s}:{e}" for s, e, b in sorted(found))
                for column, x in zip(out, (top[2], top[0], len(found), listed)):
                    column.append(x)
            types = (pa.string(), pa.float64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, types))], ["doc_id", "license", "dice", "n_matches", "matches"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, license string, dice double, n_matches long, matches string")
