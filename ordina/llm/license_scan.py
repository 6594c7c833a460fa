"""Operator 5: license scans.

Templates are cut into words (lower-cased runs of letters and digits); of their 3-word grams, winnowing
keeps the smallest hash in every window of two, and an inverted index tells which template has which
fingerprint where. Documents are winnowed the same way, so a shared stretch of four words or more shares
a fingerprint. Fingerprints found near one diagonal make a candidate, which is then aligned word by
word in a band around that diagonal (local alignment); the alignment gives the share of the template
that is matched and the span in the document.

Every stretch is aligned: from the first fingerprint on, what an alignment has matched is taken out and the words before
and behind it are aligned again, so copies that follow one another are found one by one.

The templates are a fixed table shipped with the function: whole texts of MIT, ISC, BSD-2/3-Clause, zlib, Unlicense and
BSL-1.0; the notices that works under Apache-2.0, GPL, LGPL, AGPL, MPL-2.0, EPL-2.0, CC and CC0 carry; short lines and
SPDX identifiers (by rule). Families that differ in a few words must show those words in the match (REQUIRED). Other licenses
are not found. Every document is scanned whole.

Defined results: null and empty texts, and texts without a match, have no rows; repeated documents
repeat their rows; an empty table gives no rows; texts of any length are read whole. Where spans of two templates overlap,
the one with more matched words stays (then higher coverage, then the first name). Spans are code points, end exclusive.
Columns named by `keep` that clash with a result's are passed on with `_in` at the end of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, takewhile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import Taken, by_texts, table, unused

GRAM, WINDOW = 3, 2
#: Least share of a template's words that must be matched: for short templates, and for those of LONG words or more.
COVERAGE_SHORT, COVERAGE, LONG = 0.8, 0.6, 25
#: Words by which an alignment may leave its diagonal: at least this, or a tenth of the template.
BAND = 8

# Texts and notices by license (fixed values: the licenses' own wording).
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "This {work} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
_GNU_NAMES = {"GPL": ("program", "General Public License"), "LGPL": ("library", "Lesser General Public License"), "AGPL": ("program", "Affero General Public License")}
_GNU_VERSIONS = (("GPL", "2.0", "2"), ("GPL", "3.0", "3"), ("LGPL", "2.1", "2.1"), ("LGPL", "3.0", "3"), ("AGPL", "3.0", "3"))
_CC = {"CC-BY": "Attribution", "CC-BY-SA": "Attribution-ShareAlike", "CC-BY-NC": "Attribution-NonCommercial", "CC-BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "CC-BY-ND": "Attribution-NoDerivatives", "CC-BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_SPDX = "Apache-2.0 MIT ISC BSD-2-Clause BSD-3-Clause Zlib Unlicense BSL-1.0 MPL-2.0 EPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0".split()

TEMPLATES = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT/line": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _AS_IS,
    "BSD-2-Clause": f"{_BSD} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD} {_BSD_THIRD} {_BSD_END}",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. This work is distributed without any warranty.",
    **{f"{k}-{v}": _GNU.format(work=_GNU_NAMES[k][0], name=_GNU_NAMES[k][1], version=n, colon=":", comma=",") for k, v, n in _GNU_VERSIONS},
    **{f"{k}-{v}/line": f"This work is licensed under the GNU {_GNU_NAMES[k][1]}, version {n}." for k, v, n in _GNU_VERSIONS},
    **{f"{k}-4.0": f"This work is licensed under a Creative Commons {name} 4.0 International License." for k, name in _CC.items()},
    **{f"{k}-4.0/line": f"Licensed under {k.replace('CC-', 'CC ')} 4.0." for k in _CC},
    **{f"{k}/spdx": f"SPDX-License-Identifier: {k}" for k in _SPDX},
    **{f"{k}-{v}/spdx": f"SPDX-License-Identifier: {k}-{v}-or-later" for k, v, _ in _GNU_VERSIONS},
}
#: Words that a match has to hold, in this order and together.
REQUIRED = {
    "Apache-2.0": "apache license", "Apache-2.0/line": "apache license", "MIT/line": "mit license", "BSD-3-Clause": "neither the name",
    **{f"{k}-{v}{end}": phrase for k, v, n in _GNU_VERSIONS for end in ("", "/line") for phrase in (f"{_GNU_NAMES[k][1].lower()}|version {n.replace('.', ' ')}|gnu {_GNU_NAMES[k][1].split()[0].lower()}",)},
    **{f"{k}-4.0": name.lower().replace("-", " ") + " 4 0" for k, name in _CC.items()},
    **{f"{k}-4.0/line": k.lower().replace("-", " ") + " 4 0" for k in _CC},
    **{f"{k}/spdx": k.lower().replace("-", " ").replace(".", " ") for k in (*_SPDX, *(f"{k}-{v}" for k, v, _ in _GNU_VERSIONS))},
}


def _winnow(hashes: np.ndarray) -> np.ndarray:
    """Positions of the fingerprints: the smallest hash (the last of equals) in each window."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.flatnonzero(np.ones(len(hashes), bool))
    best, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, WINDOW):
        other = hashes[j : j + n]
        less = other <= best
        best[less], at[less] = other[less], np.flatnonzero(less) + j
    return np.unique(at)


def align(template: np.ndarray, words: np.ndarray, first: int, diagonal: int, band: int) -> tuple[int, int, int]:
    """Best local alignment of a template with document words, `diagonal` = document minus template position,
    leaving it by `band` words at most: matched words, and the first and last matched document word
    (relative to `first`, the document position of words[0])."""
    m, width = len(template), 2 * band + 1
    # a cell's score, matches and start in one number (in this order), for the previous template row; column c is document word
    # i + diagonal - band + c. A row is a handful of array operations: a word that the template lacks is a running maximum.
    cells = np.zeros(width + 1, np.int64)
    steps = np.arange(width) * _SCORE
    best, end = 0, 0
    for i in range(m):
        low = i + diagonal - band - first
        a, b = max(0, -low), min(width, len(words) - low)
        new = np.zeros(width + 1, np.int64)
        if a < b:
            same = words[low + a : low + b] == template[i]
            along, above = cells[a:b], cells[a + 1 : b + 1]
            begun = np.where(same, 2 * _SCORE + _MATCH + np.arange(low + a, low + b), 0)
            row = np.where(along >= _SCORE, along + np.where(same, 2 * _SCORE + _MATCH, -_SCORE), begun)
            row = np.maximum(row, np.where(above >= 2 * _SCORE, above - _SCORE, 0))
            row = np.maximum.accumulate(row + steps[: b - a]) - steps[: b - a]
            row[row < _SCORE] = 0
            new[a:b] = row
            if same.any():
                scores = np.where(same, row >> 42, 0)
                c = int(scores.argmax())
                if scores[c] > best >> 42:
                    best, end = int(row[c]), low + a + c
        cells = new
    return best >> 21 & 0x1FFFFF, best & 0x1FFFFF, end


_SCORE, _MATCH = 1 << 42, 1 << 21


class Index:
    """Winnowed fingerprints of all templates: which template, and where."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, required: dict[str, str] = REQUIRED) -> None:
        self.names = list(templates)
        self.words = [_words(tb.of([t]))[1] for t in templates.values()]
        self.required = {k: [_words(tb.of([p]))[1] for p in phrases.split("|")] for k, phrases in required.items()}
        prints, place = [], []
        for k, own in enumerate(self.words):
            grams = tb.grams(own, np.array([0, len(own)]), GRAM)[0]
            at = _winnow(grams)
            prints.append(grams[at])
            place += [(k, int(p)) for p in at]
        every = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.prints, self.place = every[order], [place[i] for i in order]
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.prints & np.uint64(0xFFFF)).astype(np.int64)] = True

    def scan(self, texts: tb.Texts) -> dict[int, list[tuple[str, float, int, int, int]]]:
        """(license, coverage, matched words, start byte, end byte) by text."""
        spans, hashes = _words(texts)
        grams, _, firsts = tb.grams(hashes, spans.offsets, GRAM)
        maybe = np.flatnonzero(self.sieve[(grams & np.uint64(0xFFFF)).astype(np.int64)])
        found = maybe[np.isin(grams[maybe], self.prints)]
        owners = np.searchsorted(spans.offsets, firsts[found], "right") - 1
        out: dict[int, list] = {}
        for d in np.unique(owners).tolist():
            a, b = int(spans.offsets[d]), int(spans.offsets[d + 1])
            own = tb.grams(hashes[a:b], np.array([0, b - a]), GRAM)[0]
            fingerprints = set(_winnow(own).tolist())
            hits: dict[int, list[tuple[int, int]]] = {}
            for p in (firsts[found[owners == d]] - a).tolist():
                if p in fingerprints:
                    left = int(np.searchsorted(self.prints, own[p], "left"))
                    while left < len(self.prints) and self.prints[left] == own[p]:
                        k, q = self.place[left]
                        hits.setdefault(k, []).append((p - q, p))
                        left += 1
            matches = [m for k, at in hits.items() for m in self._aligned(k, hashes[a:b], at)]
            spans_taken, taken = Taken(), []
            for m in sorted(matches, key=lambda m: (-m[2], -m[1], m[0], m[3])):
                if spans_taken.add(m[3], m[4] + 1):
                    taken.append(m)
            if taken:
                out[d] = [(n, c, w, int(spans.starts[a + s] - texts.offsets[d]), int(spans.ends[a + e] - texts.offsets[d])) for n, c, w, s, e in sorted(taken, key=lambda m: m[3])]
        return out

    def _aligned(self, k: int, words: np.ndarray, hits: list[tuple[int, int]]) -> Iterator[tuple[str, float, int, int, int]]:
        """Matches of one template, from the first fingerprint on: what is matched is taken out, what stands before it
        is aligned again, and so is what stands behind."""
        template, name = self.words[k], self.names[k]
        m = len(template)
        band = max(BAND, m // 10)
        need = COVERAGE_SHORT if m < LONG else COVERAGE
        hits = sorted(hits, key=lambda h: (h[1], h[0]))
        known, counts = np.unique(template, return_counts=True)
        code = np.minimum(np.searchsorted(known, words), len(known) - 1)
        code = np.where(known[code] == words, code, len(known))  # which of the template's words each word is
        work = [(hits, 0, 0, len(words))]
        while work:
            own, begin, low, high = work.pop()
            failed: list[tuple[int, int]] = []  # diagonals that gave nothing, and up to where
            for i in range(begin, len(own)):
                diagonal, p = own[i]
                failed = [f for f in failed if f[1] > p]
                if p < low or p + GRAM > high or any(abs(diagonal - d) <= band // 2 for d, _ in failed):
                    continue
                first, last = max(low, diagonal - band), min(high, diagonal + m + band)
                # no alignment matches a word more often than both sides have it
                most = np.minimum(np.bincount(code[first:last], minlength=len(known) + 1)[:-1], counts).sum()
                matched, start, end = align(template, words[first:last], first, diagonal, band) if most >= need * m else (0, 0, 0)
                start, end = first + start, first + end
                if matched >= need * m and self._has_required(name, words[start : end + 1]):
                    yield name, round(matched / m, 6), matched, start, end
                    before = list(takewhile(lambda h, start=start: h[1] < start, islice(own, i, None))) if p < start else []
                    work.append((own, i + 1, end + 1, high))
                    if before:
                        work.append((before, 0, low, start))
                    break
                failed.append((diagonal, diagonal + m + band))

    def _has_required(self, name: str, words: np.ndarray) -> bool:
        """Whether the words hold each phrase that the template's matches need."""
        for phrase in self.required.get(name, ()):
            n = len(phrase)
            at = np.flatnonzero(words[: len(words) - n + 1] == phrase[0]) if len(words) >= n else []
            if not any((words[i : i + n] == phrase).all() for i in at):
                return False
        return True


def _words(texts: tb.Texts) -> tuple[tb.Words, np.ndarray]:
    data = tb.LOWER[texts.data]
    spans = tb.Texts(data, texts.offsets).words(tb.ALNUM)
    return spans, tb.word_hashes(data, spans)


def scan(docs: DataFrame, keep: list[str], text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row for each match: the `keep` columns, license, coverage, matched words, start and end."""
    index = Index(templates)

    def work():
        def of(texts: tb.Texts, n: int) -> dict:
            found = index.scan(texts)
            rows = []
            for d in range(n):
                raw = texts.raw(d) if d in found else b""
                rows.append([(*m[:3], len(raw[: m[3]].decode("utf-8", "replace")), len(raw[: m[4]].decode("utf-8", "replace"))) for m in found.get(d, ())])
            pick = lambda i: [[m[i] for m in r] for r in rows]
            return {"license": pick(0), "coverage": pick(1), "n_matched": pick(2), "start": pick(3), "end": pick(4)}

        return of

    fields = ("license", "coverage", "n_matched", "start", "end")
    out = by_texts(docs, keep, text, "license array<string>, coverage array<double>, n_matched array<bigint>, start array<bigint>, end array<bigint>", work)
    # no filter below the explode: it would run the scan twice
    own = [F.col(f"`{c}`") for c in out.columns if c not in fields]
    match = unused("match", out.columns)
    return out.select(*own, F.explode(F.arrays_zip(*fields)).alias(match)).select(*own, *[F.col(f"{match}.{f}") for f in fields])


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), ["doc_id"])
