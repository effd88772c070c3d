"""License scans by conditional compression.

Stretches of a text, across lines, that may hold a license template are aligned with it word by word, and those within
the limit of differing words are compressed with the template as a raw zstandard dictionary; of overlapping ones of one
template that with the fewest differences counts. Where stretches of several templates overlap, the template that saves
most, compared with no dictionary, wins, and what it leaves is searched again.
The words that differ are counted and reported.

Which stretches may hold a template follows from the limit alone: one of its longest words, of which one more is looked
for than may differ, stands near its place, and no more words are missing than may differ.

Defined results: null and empty texts have no findings; a null id stays null; rows that repeat are scanned each; a text
has as many findings as notices, and is read whole; ties in what is saved go to the wording with fewer differences, then
to the template first in name; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

#: Usual notices of public licenses, from one line to whole texts.
TEMPLATES = {
    "All-Rights-Reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-Notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-Notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
    "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
    "notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
    "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
    "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-Notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to "
    "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
    "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
    "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
    "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved. No part of this work may be reproduced without permission.",
}

#: Share of a stretch's compressed size that the winner has to save.
LEAST_GAIN = 0.3
#: Share of the template's words that may differ.
MOST_DIFFERENT = 0.25

WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words_in(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def costs(want: list[str], have: list[str]) -> np.ndarray:
    """[i, j]: the fewest changed words that make the first ``i`` of ``want`` out of words that end with the first ``j`` of ``have``."""
    number = {w: k for k, w in enumerate(dict.fromkeys(want))}
    codes, steps = np.array([number.get(w, -1) for w in have], np.int32), np.arange(len(have) + 1)
    unlike = [(codes != k).astype(np.int32) for k in range(len(number))]
    out = np.zeros((len(want) + 1, len(have) + 1), np.int32)
    for i, w in enumerate(want):
        above, row = out[i], out[i + 1]
        row[0] = i + 1
        np.minimum(above[:-1] + unlike[number[w]], above[1:] + 1, out=row[1:])
        # A word of the text that is left out costs one more than the place before it.
        np.add(np.minimum.accumulate(row - steps), steps, out=row)
    return out


def aligned(want: list[str], have: list[str]) -> tuple[int, int, int, list[tuple[int, int, int, int]]]:
    """(first, last, n, changes): the stretch of ``have`` that takes fewest changed words to become ``want``.

    ``changes`` are (a, b, c, d): ``want[a:b]`` stands where the text has ``have[c:d]``. Words are replaced rather than
    left out, also at the ends.
    """
    cost = costs(want, have)
    n = int(cost[-1].min())
    last = int(np.flatnonzero(cost[-1] == n)[-1])
    i, j, changes = len(want), last, []
    while i:
        c = cost[i, j]
        if j and c == cost[i - 1, j - 1] + (want[i - 1] != have[j - 1]):
            a, b = i - 1, j - 1
        elif c == cost[i - 1, j] + 1:
            a, b = i - 1, j
        else:
            a, b = i, j - 1
        if a == i or b == j or want[a] != have[b]:
            if changes and changes[-1][0] == i and changes[-1][2] == j:
                changes[-1] = (a, changes[-1][1], b, changes[-1][3])
            else:
                changes.append((a, i, b, j))
        i, j = a, b
    return j, last, n, changes[::-1]


@dataclass
class Scanner:
    templates: Mapping[str, str]
    least_gain: float = LEAST_GAIN
    most_different: float = MOST_DIFFERENT

    def __getstate__(self):
        return {"templates": dict(self.templates), "least_gain": self.least_gain, "most_different": self.most_different}

    @cached_property
    def wordings(self) -> dict[str, list[str]]:
        return {name: [w for w, _, _ in words_in(text)] for name, text in sorted(self.templates.items())}

    @cached_property
    def limits(self) -> dict[str, int]:
        """How many words of each template may differ."""
        return {name: int(self.most_different * len(words)) for name, words in self.wordings.items()}

    @cached_property
    def seeds(self) -> dict[str, list[str]]:
        """For each template its longest words, more of them than may differ: a stretch within the limit holds one at least."""
        out = {}
        for name, words in self.wordings.items():
            some: list[str] = []
            for w in sorted(set(words), key=lambda w: (-len(w), w)):
                if sum(words.count(v) for v in some) <= self.limits[name]:
                    some.append(w)
            out[name] = some
        return out

    @cached_property
    def rare(self) -> list[str]:
        """A text that has none of these is not looked at further."""
        every = {w for some in self.seeds.values() for w in some}
        return sorted(w for w in every if not any(v != w and v in w for v in every))

    @cached_property
    def compressors(self) -> dict[str | None, zstandard.ZstdCompressor]:
        raw = {name: zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for name, words in self.wordings.items()}
        return {None: zstandard.ZstdCompressor(level=3), **{name: zstandard.ZstdCompressor(level=3, dict_data=d) for name, d in raw.items()}}

    @cached_property
    def places(self) -> dict[str, list[tuple[str, int]]]:
        """word -> the (template, place) where it is one of the template's seeds."""
        out: dict[str, list[tuple[str, int]]] = {}
        for name, words in self.wordings.items():
            for at, w in enumerate(words):
                if w in self.seeds[name]:
                    out.setdefault(w, []).append((name, at))
        return out

    def stretches(self, words: list[str]) -> set[tuple[str, int, int]]:
        """(template, from, to): where a template may stand, with room for as many more words as may differ."""
        out = set()
        for i, w in enumerate(words):
            for name, at in self.places.get(w, ()):
                limit, want = self.limits[name], self.wordings[name]
                stretch = name, max(0, i - at - limit), min(len(words), i - at + len(want) + limit)
                if stretch not in out:
                    have = set(words[stretch[1] : stretch[2]])
                    if sum(v not in have for v in want) <= limit:
                        out.add(stretch)
        return out

    def saved(self, words: list[str], name: str) -> tuple[int, float]:
        """Bytes that the template saves, and as a share of what its own length could save at most."""
        data = " ".join(words).encode()
        plain = len(self.compressors[None].compress(data))
        saved = plain - len(self.compressors[name].compress(data))
        return saved, saved / min(plain, len(" ".join(self.wordings[name])))

    def confirm(self, words: list[str], name: str, start: int, stop: int) -> tuple | None:
        """The template's match between two places, the best sorting first, if it is within both limits."""
        want, have = self.wordings[name], words[start:stop]
        first, last, n, changes = aligned(want, have)
        if n > self.limits[name] or first == last:
            return None
        saved, gain = self.saved(have[first:last], name)
        if gain < self.least_gain:
            return None
        said = " ".join(f"[-{' '.join(want[a:b])}-]{{+{' '.join(have[c:d])}+}}" for a, b, c, d in changes)
        # Words replaced at either end may be another notice's own.
        head = changes[0][3] if changes and changes[0][0] == 0 else first
        tail = changes[-1][2] if changes and changes[-1][1] == len(want) else last
        return -saved, n, name, start + head, start + tail, start + first, start + last, gain, said, start, stop

    @staticmethod
    def apart(hits: list[tuple], n_words: int) -> list[tuple]:
        """Of one template's hits that overlap, those with the fewest differences: several stretches hold one notice."""
        taken: dict[str, bytearray] = {}
        out = []
        for hit in sorted(hits, key=lambda h: (h[1], h)):
            name, first, last = hit[2], *hit[5:7]
            own = taken.setdefault(name, bytearray(n_words))
            if not any(own[first:last]):
                own[first:last] = b"\1" * (last - first)
                out.append(hit)
        return out

    def scan(self, text: str | None) -> list[tuple[int, int, str, float, int, str]]:
        """(start, end, template, gain, differing words, differences), in order; no two overlap."""
        lowered = (text or "").lower()
        if not any(w in lowered for w in self.rare):
            return []
        placed = words_in(text)
        words = [w for w, _, _ in placed]
        hits = self.apart([hit for name, start, stop in self.stretches(words) if (hit := self.confirm(words, name, start, stop))], len(words))
        heapq.heapify(hits)
        taken, found = bytearray(len(words)), []
        while hits:
            hit = heapq.heappop(hits)
            name, head, tail, start, stop = *hit[2:5], *hit[-2:]
            if not any(taken[head:tail]):
                taken[head:tail] = b"\1" * (tail - head)
                found.append(hit)
                continue
            for free in re.finditer(rb"\0+", taken[start:stop]):
                again = self.confirm(words, name, start + free.start(), start + free.end())
                if again:
                    heapq.heappush(hits, again)
        found.sort(key=lambda hit: hit[3])
        out, end = [], 0
        for k, hit in enumerate(found):
            start, stop = max(hit[-2], end), min(hit[-1], found[k + 1][3] if k + 1 < len(found) else len(words))
            _, n, name, _, _, first, end, gain, said, _, _ = self.confirm(words, name=hit[2], start=start, stop=stop) or hit
            out.append((placed[first][1], placed[end - 1][2], name, gain, n, said))
        return out


FOUND = "doc_id long, start long, end long, license string, gain double, n_different long, differences string"


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least_gain: float = LEAST_GAIN, most_different: float = MOST_DIFFERENT) -> DataFrame:
    """One row per confirmed notice, with its place in the text by character."""
    scanner = Scanner(templates, least_gain, most_different)

    def rows(got: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in got:
            for hit in scanner.scan(text):
                yield doc_id, *hit

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, FOUND)


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("exact", F.col("n_different") == 0)
