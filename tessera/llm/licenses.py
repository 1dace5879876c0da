"""Licence scans: Dice coefficient over word bigrams against templates.

Templates are short notices, short licences, and the full texts in `licence_texts` (public licences as published).
Units of a text are the whole text, each line, each block of lines between blank ones, and stretches: a line
is a template's if half of its bigrams at least (with that of the last word before it) are among the template's,
and a stretch is a longest run of such lines, once without and once with up to FOREIGN_LINES other lines in a
row between them (lines without words don't count).  So a licence of several paragraphs, before, behind or amid other
text, is a unit of its own, while there are no more stretches than lines and templates.  A stretch whose bigrams
of its template are fewer than the coefficient needs is left out, and a stretch gives way to a longer match of
another template around it (a full licence that ends in its own notice is the licence).  A unit is
normalised to its lower-case ASCII letter-and-digit words.  With a and b distinct bigrams of unit and template
and i in common, the coefficient is 2i/(a+b); for it to reach t, a must lie within [b t/(2-t), b (2-t)/t],
which prunes templates by size before any set is built.  Bigrams are also hashed over a whole batch at
once, and a unit without a bigram of any template is passed over.

A one-word unit has no bigrams and matches nothing.  Null and empty texts match nothing; every row gets
its result, so repeated rows get equal ones; ties between templates go to the first name.  Time is in proportion to a text's length.
Other columns aren't read; empty tables give no rows.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

THRESHOLD = 0.8
#: Lines in a row within a stretch that aren't its template's.
FOREIGN_LINES = 2

_FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licence_texts")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}"
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_WARRANTY = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
             "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
             "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")

# Notices by which texts state public licences, and licences of a paragraph or few.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause": "Licensed under the BSD 3-Clause License.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
                         "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                         "See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause-text": _BSD.format(""),
    "bsd-3-clause-text": _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
                                     "from this software without specific prior written permission. "),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                      "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, "
                      "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
                      "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
           "provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
                "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
                "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
                "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
                "substantial portions of the Software.",
    "mit-full": "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
                "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
                "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
                "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
                "substantial portions of the Software. " + _WARRANTY,
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


@functools.cache
def templates() -> dict[str, str]:
    """NOTICES and the files of `licence_texts`, by file name and "-text"."""
    full = {}
    for name in sorted(os.listdir(_FOLDER)):
        with open(os.path.join(_FOLDER, name), encoding="utf-8") as f:
            full[name.removesuffix(".txt") + "-text"] = f.read()
    return NOTICES | full


_WORD = re.compile(rb"[a-z0-9]+")
_OTHER = np.ones(256, bool)
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_OUT = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def bigrams(text: bytes) -> set[tuple[bytes, bytes]]:
    w = _WORD.findall(text.translate(_OUT))
    return set(zip(w, w[1:]))


def size_bounds(n: int, threshold: float) -> tuple[float, float]:
    """Of a unit's bigrams, for it to reach the threshold with a template of n."""
    return n * threshold / (2 - threshold), n * (2 - threshold) / threshold


def _hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each bigram of words, and where its second word starts."""
    buf = np.frombuffer(text + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(_OTHER[buf], prepend=True))
    start, end = edge[0::2], edge[1::2]
    h = C.Rolling(buf).of(start, end)
    return C.mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:]), start[1:]


class Templates:
    def __init__(self, notices: dict[str, str], threshold: float):
        self.threshold = threshold
        self.all = sorted(((k, bigrams(v.encode())) for k, v in notices.items()), key=lambda x: (len(x[1]), x[0]))
        self.all = [(k, b, *size_bounds(len(b), threshold)) for k, b in self.all if b]
        own = [np.unique(_hashes(notices[k].encode().translate(_OUT))[0]) for k, *_ in self.all]
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
        self.holds = [np.isin(self.known, x) for x in own]  # of each template

    def best(self, unit: bytes) -> tuple[str, float] | None:
        """The template with the largest coefficient of the threshold at least; ties to the first name."""
        own, found = bigrams(unit), None
        for name, theirs, low, high in self.all:
            if low <= len(own) <= high:
                dice = 2 * len(own & theirs) / (len(own) + len(theirs))
                if dice >= self.threshold and (found is None or (-dice, name) < (-found[1], found[0])):
                    found = (name, dice)
        return found

    def stretches(self, line: np.ndarray, place: np.ndarray, hit: np.ndarray) -> set[tuple[int, int]]:
        """(first line, lines) of the runs of a template's lines; of each bigram its line, its place in `known`, whether it is that one."""
        out = set()
        lines, index, size = np.unique(line, return_inverse=True, return_counts=True)
        index, place = index[hit], place[hit]
        for (_, _, low, _), holds in zip(self.all, self.holds):
            shared = holds[place]
            if np.count_nonzero(shared) < low:
                continue
            shared = np.bincount(index[shared], minlength=len(lines))
            mine = np.flatnonzero(2 * shared >= size)
            if not len(mine):
                continue
            for foreign in (0, FOREIGN_LINES):
                at = np.flatnonzero(np.r_[True, np.diff(mine) > foreign + 1])
                enough = np.add.reduceat(shared[mine], at) >= low
                first, last = lines[mine[at]], lines[mine[np.append(at[1:], len(mine)) - 1]]
                out |= set(zip(first[enough].tolist(), (last - first + 1)[enough].tolist()))
        return out

    def scan(self, text: bytes) -> dict[tuple[int, int], tuple[str, float]]:
        """Matches by (first line, lines), lines from 0."""
        out: dict[tuple[int, int], tuple[str, float]] = {}
        hashes, at = _hashes(text.translate(_OUT))
        if not len(hashes) or not len(self.known):
            return out
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hit = self.known[place] == hashes
        if not hit.any():
            return out
        lines = text.split(b"\n")
        starts = np.cumsum([0, *(len(x) + 1 for x in lines[:-1])])
        line = np.searchsorted(starts, at, "right") - 1
        touched = np.unique(line[hit]).tolist()
        blank = np.array([not x.strip() for x in lines])
        first = np.maximum.accumulate(np.where(blank, np.arange(len(lines)) + 1, 0))  # of a line's block
        last = np.minimum.accumulate(np.where(blank, np.arange(len(lines)), len(lines))[::-1])[::-1]
        units = {(i, 1) for i in touched} | {(0, len(lines))} | {(a, b - a) for a, b in zip(first[touched].tolist(), last[touched].tolist())}
        stretches = self.stretches(line, place, hit) - units
        for a, n in units | stretches:
            unit = b"\n".join(lines[a : a + n])
            if len(_WORD.findall(unit.translate(_OUT))) > 1 and (found := self.best(unit)):
                out[a, n] = found
        if stretches:
            inner, ends = [], {}  # how far the matches seen so far reach, by template
            for a, n in sorted(out, key=lambda x: (x[0], -x[1])):
                name = out[a, n][0]
                if (a, n) in stretches and any(end >= a + n for k, end in ends.items() if k != name):
                    inner.append((a, n))
                ends[name] = max(ends.get(name, 0), a + n)
            for x in inner:
                del out[x]
        return out


def _scan(notices: dict[str, str], threshold: float):
    def run(batches):
        templates = Templates(notices, threshold)
        for batch in batches:
            names, dice, lines, matches = [], [], [], []
            for text in C.texts(batch.column("_text")):
                found = templates.scan(text)
                best = min(found.values(), key=lambda x: (-x[1], x[0]), default=(None, None))
                names.append(best[0])
                dice.append(best[1])
                lines.append(sum(n == 1 for _, n in found))
                matches.append([{"first_line": a, "lines": n, "license": k, "dice": d} for (a, n), (k, d) in sorted(found.items())])
            kind = pa.list_(pa.struct([("first_line", pa.int64()), ("lines", pa.int64()), ("license", pa.string()), ("dice", pa.float64())]))
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(dice, pa.float64()), pa.array(lines, pa.int64()), pa.array(matches, kind)],
                                  names=["id", "license", "dice", "matched_lines", "matches"])

    return run


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, license, dice, matched_lines, matches) of every row; license is the best match's, null without any."""
    C.ship(df.sparkSession)
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("_text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_scan(templates() if notices is None else notices, threshold),
                             f"id {kind}, license string, dice double, matched_lines long, matches array<struct<first_line:long,lines:long,license:string,dice:double>>")
