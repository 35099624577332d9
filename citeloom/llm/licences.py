"""Licence scan: normalised text against licence templates by the Dice coefficient of word bigrams.

Text and templates are reduced to lower-case words of letters and digits. A template of m words is compared with the runs of m
words of a document (the whole document where it is shorter): 2 |A and B| / (|A| + |B|) over multisets of bigrams. Two
bounds keep that cheap without losing a match. A document with too few or too short runs for the least Dice cannot match a template (size
bound), and a run that reaches the threshold must hold one of the template's telling words, which are chosen so that the bigrams
without any of them fall short. What remains is counted by running sums of template bigrams before any run is compared.
Of matches that overlap, the best one stands (then the longer, then the first in template order).

Defined results: null and empty texts match nothing; repeated rows match alike; null ids stay null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "


def _fsf_header(work: str, kind: str, version: str, mark: str) -> str:
    """The notice that the FSF's licences give for source files; version 3 has other marks than version 2."""
    first, second = (":", ",") if mark == "3" else (";", ";")
    return (
        f"This {work} is free software{first} you can redistribute it and/or modify it under the terms of the GNU {kind} License as published by the Free Software Foundation{second} "
        f"either version {version} of the License, or (at your option) any later version."
    )


#: Public licence notices and texts. Full texts that are long lie in licence_texts, by name.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "ISC": [
        "Released under the ISC License.",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", _BSD_CONDITIONS + _BSD_DISCLAIMER],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        _BSD_CONDITIONS + _BSD_NAMES,
        _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER,
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        *[_fsf_header(work, "Lesser General Public", "2.1", "2") for work in ("library", "program")],
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        *[_fsf_header(work, "Lesser General Public", "3", "3") for work in ("library", "program")],
    ],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _fsf_header("program", "Affero General Public", "3", "3")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC0-1.0": ["Licensed under CC0 1.0 Universal."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}

for _file in sorted(Path(__file__).with_name("licence_texts").glob("*.txt")):
    TEMPLATES[_file.stem].append(_file.read_text(encoding="utf-8"))

_KEPT = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else 32 for c in range(256))


def normalise(text: str | None) -> list[bytes]:
    """Lower-case words of ASCII letters, digits and whatever lies beyond ASCII."""
    return (text or "").encode().lower().translate(_KEPT).split()


class Template:
    def __init__(self, licence: str, number: int, text: str, threshold: float):
        self.licence, self.number, self.words = licence, number, normalise(text)
        self.bigrams = Counter(zip(self.words, self.words[1:]))
        self.size = len(self.words) - 1
        #: Bigrams that a compared run must have at least for the threshold.
        self.least = self.size * threshold / (2 - threshold)


class Scanner:
    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        self.templates = [Template(k, i, t, threshold) for k, texts in templates.items() for i, t in enumerate(texts)]
        self.by_least = sorted(self.templates, key=lambda t: t.least)
        self.leasts = [t.least for t in self.by_least]
        spread = Counter(w for t in self.templates for w in set(t.words))
        self.telling: dict[bytes, list[Template]] = {}
        for t in self.templates:
            for word in self._telling(t, spread):
                self.telling.setdefault(word, []).append(t)
        self.keys = set(self.telling)

    @staticmethod
    def _telling(t: Template, spread: Counter) -> list[bytes]:
        """Words, longest and rarest among templates first, without whose bigrams the threshold is out of reach."""
        chosen: set[bytes] = set()
        for word in sorted(set(t.words), key=lambda w: (-len(w), spread[w], w)):
            without = sum(n for (a, b), n in t.bigrams.items() if a not in chosen and b not in chosen)
            if without < t.least:
                break
            chosen.add(word)
        return sorted(chosen)

    def matches(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(licence, first word, words, Dice) of the matches that stand, by place."""
        words = normalise(text)
        seen = self.keys.intersection(words)
        if not seen:
            return []
        told = {id(t) for w in seen for t in self.telling[w]}
        pairs = list(zip(words, words[1:]))
        # size bound: the document's bigrams are the most that any run has
        fit = {id(t) for t in self.by_least[: bisect_right(self.leasts, len(pairs))]}
        dice, size, order, at = [], [], [], []
        for k, t in enumerate(self.templates):
            if id(t) in told and id(t) in fit:
                run = min(t.size, len(pairs))
                score = 2 * shared_bigrams(pairs, t.bigrams, run) / (t.size + run)
                starts = np.flatnonzero(score >= self.threshold)
                dice.append(score[starts])
                at.append(starts)
                size.append(np.full(len(starts), run + 1))
                order.append(np.full(len(starts), k))
        if not dice:
            return []
        dice, size, order, at = map(np.concatenate, (dice, size, order, at))
        begins: list[int] = []
        taken: dict[int, tuple[int, int]] = {}
        out = []
        for i in np.lexsort((at, order, -size, -dice)).tolist():
            a, n = int(at[i]), int(size[i])
            k = bisect_left(begins, a + n)
            # of the matches that begin before this one's end only the last can reach into it
            if not k or taken[begins[k - 1]][1] <= a:
                begins.insert(k, a)
                taken[a] = (a, a + n)
                out.append((self.templates[order[i]].licence, a, n, float(dice[i])))
        return sorted(out, key=lambda m: m[1])


def shared_bigrams(pairs: list[tuple[bytes, bytes]], wanted: Counter, run: int) -> np.ndarray:
    """How many bigrams each run of ``run`` pairs shares with the template, repeats up to as often as the template has them.

    An occurrence counts in the runs that hold it and fewer than that many of its kind before it; these begin in one interval, so that all
    runs take one pass.
    """
    ids = {b: k for k, b in enumerate(wanted)}
    own = np.fromiter((ids.get(b, -1) for b in pairs), np.int64, len(pairs))
    place = np.flatnonzero(own >= 0)
    kind = own[place]
    if not len(place):
        return np.zeros(len(pairs) - run + 1, np.int64)
    by_kind = np.argsort(kind, kind="stable")
    often = np.fromiter(wanted.values(), np.int64, len(wanted))[kind[by_kind]]
    earlier = np.arange(len(by_kind)) - often
    same = (earlier >= 0) & (kind[by_kind[np.maximum(earlier, 0)]] == kind[by_kind])
    before = np.full(len(place), -1)
    before[by_kind] = np.where(same, place[by_kind[np.maximum(earlier, 0)]], -1)
    change = np.zeros(len(pairs) + 1, np.int64)
    np.add.at(change, np.maximum(before, place - run) + 1, 1)
    np.add.at(change, place + 1, -1)
    return np.cumsum(change[:-1])[: len(pairs) - run + 1]


def scan_licences(docs: DataFrame, *, templates: dict[str, list[str]] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per match: doc_id, licence, first_word (from 0), n_words, dice."""
    given = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given, threshold)
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
        for batch in batches:
            rows = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)) for m in scanner.matches(text.as_py())]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "licence", "first_word", "n_words", "dice"])

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(run, "doc_id bigint, licence string, first_word bigint, n_words bigint, dice double")
