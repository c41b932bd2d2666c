"""License scans by conditional compression.

A candidate block is a run of words dense in word pairs of some license
template. It is compressed with Zstandard on its own and once with each template
as raw dictionary; the bytes that each saves of a block rank them. The best
one whose words agree is found, with the exact differences in wording; what is
left around its words is searched again, until nothing more is found. Alignments
are taken in windows, so the work grows with a text's words and licenses.

Which blocks are candidates follows from WORDING. A match of m of a template's n
words within m / WORDING words of text leaves out n - m words and has at most
m / WORDING - m others in between, so it is cut into at most
(n - m) + (m / WORDING - m) + 1 runs, and m less that many pairs of neighbours
stand side by side in both. A stretch of n / WORDING words with fewer such pairs
can't agree and is passed over; no other is.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import hashes, lower, members, raw, slices, windows

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies."
)


def _gnu(program: str, version: str, mark: str, kind: str = "") -> str:
    """The notice of the GNU licenses, which differ in name, version and punctuation."""
    name = f"GNU {kind}General Public License"
    return (
        f"This {program} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published "
        f"by the Free Software Foundation{mark.replace(':', ',')} either version {version} of the License, or (at your option) any later version. This {program} "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        f"FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    )


# The wording of well-known licenses and their notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": _MIT + " " + _AS_IS,
    "MIT-grant": _MIT,
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": _gnu("program", "3", ":"),
    "GPL-2.0": _gnu("program", "2", ";"),
    "LGPL-3.0": _gnu("library", "3", ":", "Lesser "),
    "LGPL-2.1": _gnu("library", "2.1", ";", "Lesser "),
    "AGPL-3.0": _gnu("program", "3", ":", "Affero "),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BSD-3-Clause": " ".join((_BSD_START, _BSD_NAMES, _BSD_END)),
    "BSD-2-Clause": " ".join((_BSD_START, _BSD_END)),
    "BSD-conditions": _BSD_START,
    "ISC": _ISC
    + (
        ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
        "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "ISC-grant": _ISC,
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}

#: Least size reduction, and least share of a template's words, in order, and of the words they stretch over, of a license.
REDUCTION, WORDING = 0.2, 0.8
#: Words of text in one alignment, or four stretches of a long template.
WINDOW = 256
#: What a missing or an extra word counts in an alignment; a missing one 1 more.
_STEP = 1 << 12

_WORD = re.compile(r"[A-Za-z0-9\u0080-\U0010FFFF]+")
_WORDY = np.zeros(256, bool)
_WORDY[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True


def plain_words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def stretch(n: int) -> int:
    """Words of text that a match of a template of n words takes at most."""
    return int(n / WORDING + 1e-9)


def most_apart(n: int) -> int:
    """Missing and extra words of such a match at most."""
    return max(n - m + stretch(m) - m for m in range(-int(-n * WORDING // 1), n + 1))


def pairs_needed(n: int) -> int:
    """Pairs of neighbours that such a match has in common at least."""
    return max(1, min(m - (n - m) - (stretch(m) - m) - 1 for m in range(-int(-n * WORDING // 1), n + 1)))


def _merged(ranges) -> list[tuple[int, int]]:
    """Ranges in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Templates:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [plain_words(t) for t in templates.values()]
        if any(len(w) < 4 for w in self.words):
            raise ValueError("a template needs four words")
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for words in self.words for w in words))}
        self.models = [[self.number[w] for w in words] for words in self.words]
        self.alone = self._compressor(None)
        self.given = [self._compressor(zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in templates.values()]
        pairs = [self._pairs(*raw(pa.array([t]))) for t in templates.values()]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.uint64), *pairs]))
        self.own = np.array([np.isin(self.pairs, p) for p in pairs]).reshape(len(pairs), -1)  # (template, pair)
        self.stretch = [stretch(len(w)) for w in self.words]
        self.apart = [most_apart(len(w)) for w in self.words]
        self.need = [pairs_needed(len(w)) for w in self.words]

    @staticmethod
    def _pairs(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        low = lower(data)
        starts, ends, _ = members(_WORDY[low], at)
        return windows(hashes(low, starts, ends), 2)

    @staticmethod
    def _compressor(dictionary) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=19, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs that some template has, and which pairs these are."""
        if len(h) < 2 or not len(self.pairs):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w = windows(h, 2)
        which = np.minimum(np.searchsorted(self.pairs, w), len(self.pairs) - 1)
        at = np.flatnonzero(self.pairs[which] == w)
        return at, which[at]

    def dense(self, t: int, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        """First and last word of each stretch with pairs enough of a template, and how many it has: (k, 3)."""
        own = at[self.own[t][which]]
        need = self.need[t]
        if len(own) < need:
            return np.zeros((0, 3), np.int64)
        close = np.flatnonzero(own[need - 1 :] - own[: len(own) - need + 1] <= self.stretch[t] - 2)
        last = np.searchsorted(own, own[close] + self.stretch[t] - 2, "right") - 1
        return np.stack([own[close], own[last] + 1, last - close + 1], 1)

    def rooms(self, t: int, at: np.ndarray, which: np.ndarray, p: int, q: int) -> list[tuple[int, int]]:
        """Windows of words p to q in which a template may be found: those around its dense stretches, long ones cut so that each match lies whole in one."""
        i, j = np.searchsorted(at, p), np.searchsorted(at, q - 1)
        most, out = self.stretch[t], []
        wide = max(4 * most, WINDOW)
        for a, b in _merged((max(p, a - most), min(q, b + 1 + most)) for a, b, _ in self.dense(t, at[i:j], which[i:j]).tolist()):
            out += [(x, min(b, x + wide)) for x in range(a, max(a + 1, b - most), wide - most)]
        return out

    def matches(self, t: int, ids: np.ndarray, p: int, q: int) -> list[tuple[int, list[tuple[int, int]]]]:
        """Stretches of ids[p:q] that agree, closest first and apart from each other: words missing and extra, and the pairs of places that match.

        An edit distance with free ends: fewest missing and extra words, then
        fewest missing. An end whose last word the template lacks gives what the
        end before it gives.
        """
        model, text = self.models[t], ids[p:q]
        n, place = len(model), np.arange(len(text) + 1, dtype=np.int32) * np.int32(_STEP)
        rows, same, known = [np.zeros(len(text) + 1, np.int32)], [], np.zeros(len(text), bool)
        for w in model:
            same.append(text == w)
            known |= same[-1]
            e = rows[-1] + np.int32(_STEP + 1)
            np.minimum(e[1:], rows[-1][:-1], out=e[1:], where=same[-1])
            rows.append(np.minimum.accumulate(e - place) + place)
        cost = rows[-1]
        ends = 1 + np.flatnonzero((cost[1:] < (self.apart[t] + 1) * _STEP) & known)
        out, free = [], np.ones(len(text), bool)
        for end in ends[np.argsort(cost[ends], kind="stable")].tolist():
            if not free[end - 1]:
                continue
            i, j, pairs = n, end, []
            while i:
                here = rows[i][j]
                if j and same[i - 1][j - 1] and here == rows[i - 1][j - 1]:
                    i, j = i - 1, j - 1
                    pairs.append((i, p + j))
                elif here == rows[i - 1][j] + _STEP + 1:
                    i -= 1
                else:
                    j -= 1
            if not pairs:
                continue
            pairs.reverse()
            low, high = pairs[0][1] - p, pairs[-1][1] + 1 - p
            if len(pairs) >= WORDING * n and len(pairs) >= WORDING * (high - low) and free[low:high].all():
                free[low:high] = False
                out.append((n + high - low - 2 * len(pairs), pairs))
        return out

    def found(self, text: str, starts: array, ends: array, ids: np.ndarray, at: np.ndarray, which: np.ndarray) -> list[dict]:
        """All licenses of a text, in order. starts, ends, ids: its words; at, which: its pairs.

        Matches wait in a heap, those that save most bytes first. One that comes up
        and those that overlap it are ranked by what they save of the same block. A
        match whose words are taken meanwhile is sought anew in what is left around
        it, as is what one that is taken leaves free; nothing further away changes.
        """
        n = len(ids)
        text_of = lambda a, b: text[starts[a] : ends[b - 1]].encode()
        alone = lru_cache(1 << 10)(lambda a, b: len(self.alone.compress(text_of(a, b))))
        taken, held, waiting = np.zeros(n, bool), {}, []
        known: list[tuple | None] = [None]  # matches by number; None when they are settled

        def saved(t: int, a: int, b: int) -> int:
            return alone(a, b) - len(self.given[t].compress(text_of(a, b)))

        def seek(t: int, p: int, q: int) -> None:
            """Matches of a template within words p to q that nothing has taken and none of its own holds."""
            own = held.setdefault(t, np.zeros(n, np.int32)) if n and self.need[t] <= len(at) else None
            if own is None:
                return
            edge = np.flatnonzero(np.diff(np.concatenate([[True], taken[p:q] | (own[p:q] > 0), [True]]).astype(np.int8)))
            for a, b in [w for x, y in edge.reshape(-1, 2).tolist() for w in self.rooms(t, at, which, p + x, p + y)]:
                for apart, pairs in self.matches(t, ids, a, b):
                    low, high = pairs[0][1], pairs[-1][1] + 1
                    own[low:high] = len(known)
                    heapq.heappush(waiting, (-saved(t, low, high), apart, t, low, len(known)))
                    known.append((t, low, high, apart, pairs))

        def take(i: int) -> bool:
            t, low, high, _, pairs = known[i]
            known[i] = None
            reduction = 1 - len(self.given[t].compress(text_of(low, high))) / alone(low, high)
            if reduction < REDUCTION:
                return False
            taken[low:high] = True
            out.append({"license": self.names[t], "reduction": round(reduction, 4), "missing": len(self.words[t]) - len(pairs), "changes": self._changes(t, text, starts, ends, pairs), "words": (low, high)})
            return True

        for t in range(len(self.names)):
            seek(t, 0, n)
        out: list[dict] = []
        while waiting:
            number = heapq.heappop(waiting)[-1]
            if known[number] is None:
                continue
            t, low, high, _, _ = known[number]
            again = [(t, low, high)]
            if not taken[low:high].any():
                near = {number} | {int(i) for own in held.values() for i in np.unique(own[low:high])}
                rivals = [i for i in near if known[i] and not taken[known[i][1] : known[i][2]].any()]
                a, b = min(known[i][1] for i in rivals), max(known[i][2] for i in rivals)
                for i in sorted(rivals, key=lambda i: (-saved(known[i][0], a, b), known[i][3], known[i][0])):
                    again.append(known[i][:3])
                    if take(i):
                        break
            if known[number]:  # its words, or some of them, are another's
                held[t][low:high] = 0
                known[number] = None
            for t, low, high in again:
                seek(t, max(0, low - self.stretch[t]), min(n, high + self.stretch[t]))
        return sorted(out, key=lambda x: x["words"])

    def _changes(self, t: int, text: str, starts: array, ends: array, pairs: list[tuple[int, int]]) -> list[str]:
        model, out = self.words[t], []
        around = [(-1, pairs[0][1] - 1), *pairs, (len(model), pairs[-1][1] + 1)]
        for (i, x), (j, y) in zip(around[:-1], around[1:], strict=True):
            if j - i > 1 or y - x > 1:
                out.append(f"-{' '.join(model[i + 1 : j])}+{' '.join(text[starts[z] : ends[z]].lower() for z in range(x + 1, y))}")
        return out

    def blocks(self, at: np.ndarray, which: np.ndarray, n: int) -> list[tuple[int, int]]:
        """Runs of words, apart from each other, that hold every possible license of a text of n words."""
        room = [(int(a) - self.stretch[t], int(b) + 1 + self.stretch[t]) for t in range(len(self.names)) for a, b, _ in self.dense(t, at, which)]
        return _merged((max(0, a), min(n, b)) for a, b in room)

    def scan(self, text: str) -> list[dict]:
        """The licenses of a text, with `span` in code points."""
        data, at = raw(pa.array([text]))
        return [f for _, f in self.scan_all(data, at)]

    def scan_all(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, dict]]:
        """(number of the text, license) of every license in several texts."""
        low = lower(data)
        starts, ends, first = members(_WORDY[low], at)
        h = hashes(low, starts, ends)
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            place, which = self.hits(h[a:b])
            if not len(place):
                continue
            done, chars = int(at[i]), 0  # code points up to here are counted once
            for p, q in self.blocks(place, which, b - a):
                begin, end = int(starts[a + p]), int(ends[a + q - 1])
                chars += int(((data[done:begin] & 0xC0) != 0x80).sum())
                done = begin
                text = data[begin:end].tobytes().decode("utf-8", "replace")
                inside = (place >= p) & (place < q - 1)
                w_starts, w_ends, ids = array("q"), array("q"), array("q")
                for m in _WORD.finditer(text):
                    w_starts.append(m.start())
                    w_ends.append(m.end())
                    ids.append(self.number.get(m.group().lower(), -1))
                for got in self.found(text, w_starts, w_ends, np.frombuffer(ids, np.int64), place[inside] - p, which[inside]):
                    x, y = got["words"]
                    yield i, got | {"span": (chars + w_starts[x], chars + w_ends[y - 1])}


@lru_cache(2)
def _prepared(items: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(dict(items))


_FOUND = "doc_id long, block_start long, block_end long, license string, reduction double, missing_words int, changes array<string>"


def _scan(items: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = _prepared(items)
        for batch in batches:
            for rows in slices(batch, "text"):
                ids = rows.column("doc_id").to_pylist()
                out = [(ids[i], *x["span"], x["license"], x["reduction"], x["missing"], x["changes"]) for i, x in templates.scan_all(*raw(rows.column("text")))]
                if out:
                    columns = list(zip(*out, strict=True))
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.list_(pa.string())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return run


def license_blocks(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each license found: doc_id, block_start, block_end (code points), license, reduction, missing_words, changes.

    Every text is scanned whole. Null or empty texts and those without licenses
    give no rows, repeated rows give theirs again, licenses side by side or
    repeated one each. `changes` lists -template+text words. Other columns are
    left out. Row by row: no shuffle. A task holds some ten times a very long
    text's bytes.
    """
    items = tuple((TEMPLATES if templates is None else templates).items())
    return docs.select("doc_id", "text").mapInArrow(_scan(items), _FOUND)
