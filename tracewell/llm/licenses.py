"""License texts in documents: winnowed fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import ship, slices, text_views
from .words import char_offset, number, plain_words, word_spans

#: Words of a fingerprint, fingerprints of a winnowing window: shared runs of GRAM + WINDOW - 1 words are never missed.
GRAM = 3
WINDOW = 3
MATCH, MISS, GAP = 2, -1, -1

# Public license notices, as their stewards ask to have them put.
TEMPLATES = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "MIT/line": "Released under the MIT License.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Apache-2.0/notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT/text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT/warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD/warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD/text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
}


def winnow(grams: np.ndarray) -> np.ndarray:
    """Positions of the chosen grams: the least, rightmost on ties, of each window."""
    if len(grams) <= WINDOW:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.empty(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(view)) + WINDOW - 1 - view.argmin(axis=1))


def _grams(ids: np.ndarray) -> np.ndarray:
    """A number for each run of GRAM words; 0 where one is outside the vocabulary."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    key, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for k in range(GRAM):
        part = ids[k : k + n]
        key = (key + part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
        known &= part > 0
    return np.where(known, key | np.uint64(1), np.uint64(0))


class Index:
    """Inverted index from winnowed fingerprints to templates and places."""

    def __init__(self, templates: dict[str, str]):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted(templates)
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in plain_words(templates[n].encode())], dtype=np.int32) for n in self.names]
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, w in enumerate(self.words):
            g = _grams(w)
            for at in winnow(g):
                places[int(g[at])].append((i, int(at)))
        self.places = dict(places)
        self.keys = np.array(sorted(places), dtype=np.uint64)

    def seeds(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """(word of the document, word of the template) pairs by template."""
        grams, out = _grams(ids), defaultdict(list)
        slot = np.searchsorted(self.keys, grams)
        slot[slot == len(self.keys)] = 0
        for at in np.flatnonzero((self.keys[slot] == grams) & (grams != 0)).tolist() if len(self.keys) else ():
            for template, place in self.places[int(grams[at])]:
                out[template].append((at, place))
        return out


#: A cell of the alignment in one number: score, then matched words, then how early it starts.
_SCORE, _HIT, _EARLY = 1 << 42, 1 << 22, (1 << 22) - 1


def banded(doc: np.ndarray, template: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int, int]:
    """Best local alignment with doc - template within ``band`` of ``diagonal``: (score, matched, start, end) in the document.

    A row of the programme holds the 2 * band + 1 places of the document that a word of the template may
    meet; steps along the document are a running maximum. Of equal scores the one with most matched words
    that starts first is taken, and the first place where it ends.
    """
    width = 2 * band + 1
    step = np.arange(width, dtype=np.int64)
    padded = np.full(len(doc) + 2 * width + len(template) + abs(diagonal), -1, dtype=np.int64)
    lead = width + max(0, band - diagonal)
    padded[lead : lead + len(doc)] = doc
    last, best, end = np.full(width + 1, -_SCORE, dtype=np.int64), 0, 0
    for j, word in enumerate(template.tolist()):
        at = j + diagonal - band + step
        hit = padded[lead + at[0] : lead + at[0] + width] == word
        fresh = np.where((at >= 0) & (at < len(doc)), _EARLY - at, -_SCORE)
        row = np.maximum(last[:width], fresh) + np.where(hit, MATCH * _SCORE + _HIT, MISS * _SCORE)
        row = np.maximum(row, last[1:] + GAP * _SCORE)
        row = np.maximum.accumulate(row - GAP * _SCORE * step) + GAP * _SCORE * step
        row[(row < _SCORE) | (at < 0) | (at >= len(doc))] = -_SCORE
        if (top := int(row.max())) > best and top >> 42 > best >> 42:
            best, end = top, int(at[int(np.argmax(row))]) + 1
        last = np.r_[row, -_SCORE]
    return (best >> 42, best >> 22 & (1 << 20) - 1, _EARLY - (best & _EARLY), end) if best else (0, 0, 0, 0)


def scan(index: Index, text: bytes, coverage: float) -> list[tuple[str, float, int, int]]:
    """(template, matched share, first word, end word) of each place that matches well enough."""
    ids = number(plain_words(text), index.vocabulary)
    out = []
    for template, seeds in index.seeds(ids).items():
        words = index.words[template]
        band = max(3, len(words) // 8)
        groups: list[list[tuple[int, int]]] = []
        near: list[list[tuple[int, int]]] = []  # groups that a further seed may still belong to
        for seed in sorted(seeds):
            near = [g for g in near if seed[0] - g[0][0] <= len(words) + band]
            home = next((g for g in reversed(near) if abs((seed[0] - seed[1]) - (g[-1][0] - g[-1][1])) <= band), None)
            if home is None:
                groups.append([seed])
                near.append(groups[-1])
            else:
                home.append(seed)
        for g in groups:
            diagonal = sorted(a - b for a, b in g)[len(g) // 2]
            if diagonal >= 0 and np.array_equal(ids[diagonal : diagonal + len(words)], words):  # nothing aligns better
                out.append((index.names[template], 1.0, diagonal, diagonal + len(words)))
                continue
            low = max(0, diagonal - band)
            part = ids[low : diagonal + len(words) + band + 1]
            if np.isin(words, part).sum() < coverage * len(words):  # so many words cannot match
                continue
            _, matched, a, b = banded(part, words, diagonal - low, band)
            if matched >= coverage * len(words):
                out.append((index.names[template], matched / len(words), low + a, low + b))
    out.sort(key=lambda m: (m[2], -m[1], -(m[3] - m[2]), m[0]))
    kept: list[tuple[str, float, int, int]] = []
    for m in sorted(out, key=lambda m: (-(m[3] - m[2]) * m[1], m[2], m[0])):
        if all(m[3] <= k[2] or k[3] <= m[2] for k in kept):  # the fullest of overlapping templates
            kept.append(m)
    return sorted(kept, key=lambda m: m[2])


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per place: doc_id, license, part, coverage, start, end (code points, end exclusive).

    A place counts where the alignment matches at least ``coverage`` of the template's words;
    of overlapping places the one with most matched text stays. Case and ASCII punctuation do not
    count. Cases: null and empty texts have no places; repeated rows report each for itself; ids
    may be null; templates without words match nothing; an empty table gives no rows; other
    columns are ignored.
    """
    ship(docs.sparkSession)
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen)
        for batch in slices(batches, 500):
            out, ids = [], batch.column(0).to_pylist()
            for doc_id, view in zip(ids, text_views(batch, "text")):
                text = bytes(view)
                found = scan(index, text, coverage)
                first, end = word_spans(text) if found else ((), ())
                for name, share, a, b in found:
                    out.append((doc_id, *name.partition("/")[::2], share, char_offset(text, first[a]), char_offset(text, end[b - 1])))
            if out:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "license", "part", "coverage", "start", "end"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, part string, coverage double, start long, end long")
