"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Templates are license notices.  Their word n-grams are winnowed: of every ``window`` consecutive
n-gram hashes the smallest is kept, so a document that shares ``window + gram - 1`` words in a row
with a template shares a fingerprint.  An inverted index from fingerprint to template and place
gives candidates with a diagonal; each is aligned with the document in a band around it, and
reported with the share of the template's words that match and the span in code points.

Words that tell a license from its siblings, as versions, "Lesser" or "ShareAlike", must be the same in
the place as in the template, so that no license is reported under the name of another.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .alignment import Alignment, align
from .shared import bounded_batches

_U = np.uint64

_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
)

def _gnu(kind: str, versions: str, of: str = "program") -> str:
    return (
        f"This {of} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {versions} of the License, or (at your option) any later version. "
        f"This {of} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."
    )


def _line(name: str, version: str) -> str:
    return f"This work is licensed under the GNU {name}, version {version}."


def _commons(name: str, version: str, kind: str = "International") -> str:
    return f"This work is licensed under a Creative Commons {name} {version} {kind} License."


#: Public license notices, by short name; BSD and MIT-text are openings, which stand alone in some texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause-conditions": _BSD_TERMS,
    "BSD-3-Clause-conditions": f"{_BSD_TERMS} {_BSD_THIRD}",
    "BSD-2-Clause-text": f"{_BSD_TERMS} {_BSD_WARRANTY}",
    "BSD-3-Clause-text": f"{_BSD_TERMS} {_BSD_THIRD} {_BSD_WARRANTY}",
    "CC-BY-4.0": _commons("Attribution", "4.0"),
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-line": _commons("Attribution-NonCommercial", "4.0"),
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-ND-4.0-line": _commons("Attribution-NonCommercial-NoDerivatives", "4.0"),
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-SA-4.0-line": _commons("Attribution-NonCommercial-ShareAlike", "4.0"),
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-ND-4.0-line": _commons("Attribution-NoDerivatives", "4.0"),
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-line": _commons("Attribution-ShareAlike", "4.0"),
    "CC-BY-3.0": _commons("Attribution", "3.0", "Unported"),
    "CC-BY-SA-3.0": _commons("Attribution-ShareAlike", "3.0", "Unported"),
    "GPL-3.0": _line("General Public License", "3"),
    "GPL-2.0": _line("General Public License", "2"),
    "LGPL-3.0": _line("Lesser General Public License", "3"),
    "LGPL-2.1": _line("Lesser General Public License", "2.1"),
    "AGPL-3.0": _line("Affero General Public License", "3"),
    "MPL-1.1-header": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ "
    "Software distributed under the License is distributed on an \"AS IS\" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License.",
    "AGPL-3.0-header": _gnu("Affero General Public License", "3"),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0-header": _gnu("General Public License", "2"),
    "GPL-3.0-header": _gnu("General Public License", "3"),
    "LGPL-2.1-header": _gnu("Lesser General Public License", "2.1", "library"),
    "LGPL-3.0-header": _gnu("Lesser General Public License", "3"),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-full-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Released under the MIT License.",
    "MIT-full-text": f"{_MIT_GRANT}: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-text": _MIT_GRANT,
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


#: Words that tell a license from its siblings, and words before a number that make it a version.
TELLING = {"lesser", "affero", "sharealike", "sa", "noncommercial", "nc", "noderivatives", "noderivs", "nd"}
VERSIONED = TELLING | {"version", "versions", "v", "license", "licence", "attribution", "by", "gpl", "lgpl", "agpl", "mpl", "epl"}


def telling(words: list[str]) -> list[str]:
    """The telling words and versions of a text in lower case, in order; a zero after a number says nothing, as in 2.0."""
    out, version = [], False
    for before, word in zip(["", *words], words):
        number = word.isdigit()
        version = number and (before in VERSIONED or version)
        if word in TELLING or (word == "library" and before == "gnu") or (version and not (word == "0" and before.isdigit())):
            out.append(word)
    return out


@dataclass(frozen=True)
class LicenseParams:
    """``min_coverage``: least share of a template's words that match, in order, within the band."""

    gram: int = 3
    window: int = 3
    min_coverage: float = 0.8
    band_share: float = 0.2
    min_band: int = 3


@dataclass
class TemplateIndex:
    names: list[str]
    words: list[np.ndarray]
    telling: list[list[str]]
    print_: np.ndarray
    template: np.ndarray
    place: np.ndarray


def _plain(block: W.Block) -> tuple[W.Words, np.ndarray]:
    w = W.words(block, W.NOT_PLAIN)
    return w, W.span_hashes(W.LOWER[block.data], w.start, w.end)


def _texts(text: str) -> list[str]:
    """The words of a short text, as ``_plain`` cuts them."""
    return [x.lower() for x in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text) if x]


def winnow(values: np.ndarray, window: int) -> np.ndarray:
    """Places of the rightmost smallest of every ``window`` consecutive values; of all if there are fewer."""
    if not len(values):
        return np.zeros(0, np.int64)
    width = min(window, len(values))
    view = np.lib.stride_tricks.sliding_window_view(values[::-1], width)
    return np.unique(len(values) - 1 - (view.argmin(axis=1) + np.arange(len(view))))


def index_templates(templates: dict[str, str], p: LicenseParams) -> TemplateIndex:
    """The inverted index; templates of fewer words than an n-gram are left out."""
    names, words, told, entries = sorted(templates), [], [], []
    for k, name in enumerate(names):
        w = np.zeros(0, np.uint64)
        for block in W.blocks(pa.array([templates[name]])):
            w = _plain(block)[1]
        words.append(w)
        told.append(telling(_texts(templates[name])))
        if len(w) >= p.gram:
            grams = W.gram_hashes(w, np.arange(len(w) - p.gram + 1), p.gram)
            entries += [(int(grams[i]), k, int(i)) for i in winnow(grams, p.window)]
    entries.sort()
    columns = list(zip(*entries)) if entries else [(), (), ()]
    return TemplateIndex(names, words, told, np.array(columns[0], np.uint64), np.array(columns[1], np.int64), np.array(columns[2], np.int64))


def _bands(d: np.ndarray, band: int) -> list[tuple[int, int]]:
    """Bands of diagonals around the seen ones, none wider than one copy may shift either way."""
    out, at = [], 0
    while at < len(d):
        end = int(np.searchsorted(d, d[at] + 2 * band, "right"))
        out.append((int(d[at]) - band, int(d[end - 1]) + band))
        at = end
    return out


def _exact(text: np.ndarray, target: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Where among the diagonals whole copies begin, those that overlap an earlier one left out."""
    d = d[(d >= 0) & (d + len(target) <= len(text))]
    for k in range(len(target)):
        if not len(d):
            break
        d = d[text[d + k] == target[k]]
    out: list[int] = []
    for x in d.tolist():
        if not out or x >= out[-1] + len(target):
            out.append(x)
    return np.array(out, np.int64)


def _between(a: int, b: int, copies: np.ndarray, size: int) -> list[tuple[int, int]]:
    """What copies of a size leave of a range."""
    out = []
    for x in copies[np.searchsorted(copies, a - size, "right") : np.searchsorted(copies, b)].tolist():
        out.append((a, x))
        a = max(a, x + size)
    return [(x, y) for x, y in [*out, (a, b)] if x < y]


def _apart(places: list[tuple]) -> list[tuple]:
    """Of places that overlap, those in no place of more words first, then the best covered, then longest, then first by name; in text order."""
    places = sorted(set(places), key=lambda x: (x[3], -x[4]))
    inner, open_ = {}, []
    for x in places:  # those that begin before it and have not ended
        open_ = [y for y in open_ if y[4] > x[3]]
        inner[x] = any(y[1] > x[1] and y[4] >= x[4] for y in open_)
        open_.append(x)
    for x, y in zip(places[1:], places):  # of those that begin and end together
        if y[3:5] == x[3:5]:
            inner[y] = inner[y] or x[1] > y[1]
    starts: list[int] = []
    ends: list[int] = []
    kept: list[tuple] = []
    for x in sorted(places, key=lambda x: (inner[x], -x[0], -x[1], x[2], x[3])):
        k = bisect_left(starts, x[4])  # kept places are apart, so only the last that begins before its end can overlap it
        if not k or ends[k - 1] <= x[3]:
            at = bisect_left(starts, x[3])
            starts.insert(at, x[3])
            ends.insert(at, x[4])
            kept.append(x)
    return sorted(kept, key=lambda x: (x[3], x[2]))


def _scan(index: TemplateIndex, p: LicenseParams):
    known, first, count = np.unique(index.print_, return_index=True, return_counts=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block in W.blocks(batch.column(1)):
                w, h = _plain(block)
                start, of = W.gram_starts(w.bounds, p.gram)
                grams = W.gram_hashes(h, start, p.gram)
                where = np.flatnonzero(np.isin(grams, known))
                if not len(where):
                    continue
                points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
                seen: dict[tuple[int, int], list[int]] = {}
                for i, g in zip(where.tolist(), np.searchsorted(known, grams[where]).tolist()):
                    for e in range(first[g], first[g] + count[g]):
                        seen.setdefault((int(of[i]), int(index.template[e])), []).append(int(start[i]) - int(w.bounds[of[i]]) - int(index.place[e]))
                found: dict[int, list[tuple]] = {}
                known_parts: dict[tuple, Alignment] = {}  # texts repeat themselves

                def aligned(t: int, part: np.ndarray, low: int, high: int) -> Alignment:
                    key = (t, low, high, part.tobytes())
                    if key not in known_parts:
                        known_parts[key] = align(index.words[t], part, low, high)
                    return known_parts[key]

                for (d, t), diagonals in sorted(seen.items()):
                    target = index.words[t]
                    lo, hi = int(w.bounds[d]), int(w.bounds[d + 1])
                    text, size = h[lo:hi], len(target)
                    band = max(p.min_band, int(p.band_share * size))

                    def place(b_start: int, b_end: int, before: int, after: int, matches: int) -> None:
                        """Notes a place if its telling words, those next to its ends too where the template goes on, are the template's."""
                        x, y = max(lo, lo + b_start - before), min(hi, lo + b_end + after)
                        told = [block.data[w.start[k] : w.end[k]].tobytes().decode().lower() for k in range(x, y)]
                        if telling(told) != index.telling[t]:
                            return
                        at = points[block.offsets[d]]
                        found.setdefault(d, []).append((matches / size, matches, index.names[t], int(points[w.start[lo + b_start]] - at), int(points[w.end[lo + b_end - 1]] - at)))

                    seen_at = np.unique(diagonals)
                    copies = _exact(text, target, seen_at)
                    for x in copies.tolist():
                        place(x, x + size, 0, 0, size)
                    for low, high in _bands(np.setdiff1d(seen_at, copies), band):
                        open_ = _between(max(0, low), min(len(text), high + size), copies, size)
                        while open_:  # several copies may lie in one band
                            a, b = open_.pop()
                            part = text[a:b]
                            if np.isin(target, part).sum() < p.min_coverage * size:
                                continue
                            got = aligned(t, part, low - a, high - a)
                            if not got.score:
                                continue
                            open_ += [(a, a + got.b_start), (a + got.b_end, b)]
                            if got.matches >= p.min_coverage * size:
                                place(a + got.b_start, a + got.b_end, got.a_start, size - got.a_end, got.matches)
                for d, places in sorted(found.items()):
                    rows += [(block.first + d, name, share, n, x, y) for share, n, name, x, y in _apart(places)]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64()), *(pa.array(c, pa.int64()) for c in columns[3:])],
                ["doc_id", "license", "coverage", "n_matches", "start", "end"],
            )

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, params: LicenseParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, license, coverage, n_matches, start, end)``: a row for each place in a document that covers a template.

    Places are code points, ends exclusive.  Null and empty texts cover nothing; a text that covers
    several templates, or one several times, gives a row for each.  Of overlapping places one that holds
    another with fewer words counts, then the best covered, then the one with more words, then the first by name.  Repeated rows and null ids give
    rows of their own.  The templates are a parameter of the scan and travel with its code.
    """
    p = params or LicenseParams()
    bounded_batches(docs.sparkSession)
    index = index_templates(TEMPLATES if templates is None else templates, p)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(index, p), "doc_id long, license string, coverage double, n_matches long, start long, end long")
