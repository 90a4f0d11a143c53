"""License scan: normalised text against license templates by Dice coefficient over word bigrams.

Units are whole texts, paragraphs, lines and windows of words.  A template can
only reach the threshold for units within a factor of its size, and a unit only
if enough of its bigrams occur in any template; what passes both bounds is
compared exactly (multisets of bigrams).  Windows are as long as the template or
longer, start anywhere and find what no line, paragraph or text holds alone.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import ALNUM, mix64, word_hashes

THRESHOLD = 0.8

# fixed values: public license texts and notices (wording must be theirs)
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution."],
}
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
        "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
          "derived from this software without specific prior written permission. ")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
            "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
            "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
            "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
            "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
            "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
            "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
TEMPLATES |= {
    "BSD-2-Clause": [_BSD + _BSD_END],
    "BSD-3-Clause": [_BSD + _BSD_3 + _BSD_END],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later "
        "version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for "
        "more details."],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for "
        "more details."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors "
        "of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication "
        "for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be "
        "an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "CC0-1.0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
        "software to the public domain worldwide. This software is distributed without any warranty. You should have received a "
        "copy of the CC0 Public Domain Dedication along with this software. If not, see "
        "<http://creativecommons.org/publicdomain/zero/1.0/>."],
}
MATCHES = "array<struct<license:string,unit:string,first_line:int,last_line:int,dice:double>>"


def _bigrams(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:])


@dataclass
class _Template:
    license: str
    size: int
    counts: Counter


class _Catalogue:
    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        self.low, self.high = threshold / (2 - threshold), (2 - threshold) / threshold
        self.templates = []
        for name, texts in sorted(templates.items()):
            for _, _, counts, words in word_hashes(pa.array(texts), ALNUM):
                for w in np.split(words, np.cumsum(counts)[:-1]):
                    if len(w) > 1:
                        grams = _bigrams(w).tolist()
                        self.templates.append(_Template(name, len(grams), Counter(grams)))
        self.known = np.unique(np.array([g for t in self.templates for g in t.counts], np.uint64))
        #: [template, known bigram]: how often the template has it
        self.table = np.array([[t.counts.get(g, 0) for g in self.known.tolist()] for t in self.templates], np.int32)
        sizes = [t.size for t in self.templates]
        self.smallest, self.largest = (min(sizes), max(sizes)) if sizes else (1, 0)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(grams), bool)
        at = np.searchsorted(self.known, grams)
        at[at == len(self.known)] = 0
        return self.known[at] == grams

    def best(self, grams: np.ndarray) -> tuple[str, float] | None:
        """License of greatest Dice coefficient, if it reaches the threshold; ties to the first in order."""
        n, counts, found = len(grams), None, None
        for t in self.templates:
            if not self.low * t.size <= n <= self.high * t.size:       # size bounds
                continue
            counts = counts or Counter(grams.tolist())
            dice = 2 * sum(min(c, counts[g]) for g, c in t.counts.items() if g in counts) / (n + t.size)
            if dice >= self.threshold and (found is None or dice > found[1]):
                found = (t.license, dice)
        return found

    def windows(self, grams: np.ndarray) -> list[tuple[float, float, int, int, int, str]]:
        """Windows of bigrams (surplus over the threshold, dice, overlap, start, end, license): the best of each start.

        With gains 2 - threshold for a template's bigram and -threshold for
        others, no window that reaches the threshold gains less than threshold
        times the template's size; the starts that can are compared exactly.
        """
        total, th, found = len(grams), self.threshold, []
        at = np.searchsorted(self.known, grams)
        at[at == len(self.known)] = 0
        hit = self.known[at] == grams
        held = self.table[:, at[hit]] > 0
        for k, t in enumerate(self.templates):
            if t.size > total or held[k].sum() * (2 - th) < th * t.size:
                continue
            need = np.where(hit, self.table[k, at], 0)
            score = np.append(0.0, np.cumsum(2.0 * (need > 0) - th))
            top = np.maximum.accumulate(score[::-1])[::-1]
            can = top[:-1] - score[:-1] >= th * t.size - 1e-9
            # windows of the least size that would pass the end start there
            starts = np.unique(np.minimum(np.flatnonzero(can & (need > 0)), total - t.size))
            if not len(starts):
                continue
            # a bigram counts in windows that start after its last occurrence too many
            after = np.where(need > 0, -1, total)
            seen: dict[int, list[int]] = {}
            for i in np.flatnonzero(need).tolist():
                places = seen.setdefault(int(at[i]), [])
                if len(places) >= need[i]:
                    after[i] = places[-int(need[i])]
                places.append(i)
            for a in starts.tolist():
                b = min(total, a + int(self.high * t.size))
                over = np.cumsum(after[a:b] < a)[t.size - 1:]
                dice = 2 * over / (np.arange(t.size, t.size + len(over)) + t.size)
                j = int(dice.argmax())
                if dice[j] >= th:
                    n, o = t.size + j, int(over[j])
                    found.append((2 * o - th * (n + t.size), float(dice[j]), o, a, a + n, t.license))
        return found


def _units(line_words: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, first line, last line + 1) of a text's lines, paragraphs and whole, without repeats."""
    out = {(i, i + 1): "line" for i in np.flatnonzero(line_words).tolist()}
    filled = np.concatenate([[False], line_words > 0, [False]]).astype(np.int8)
    for a, b in zip(np.flatnonzero(np.diff(filled) == 1).tolist(), np.flatnonzero(np.diff(filled) == -1).tolist()):
        out.setdefault((a, b), "paragraph")
    any_words = np.flatnonzero(line_words)
    if len(any_words):
        out.setdefault((int(any_words[0]), int(any_words[-1]) + 1), "text")
    return [(kind, a, b) for (a, b), kind in out.items()]


def _scan(catalogue, text_col: str):
    def one(cat: _Catalogue, line_words: np.ndarray, words: np.ndarray):
        if len(words) < 2:
            return []
        grams = _bigrams(words)
        hit = cat.hits(grams)
        if not hit.any():
            return []
        before = np.append(0, np.cumsum(hit))
        first_word = np.append(0, np.cumsum(line_words))
        found = []
        for kind, a, b in _units(line_words):
            lo, hi = int(first_word[a]), int(first_word[b]) - 1          # bigrams [lo, hi) of the unit
            n = hi - lo
            if n < 1 or n < cat.low * cat.smallest or n > cat.high * cat.largest:
                continue
            if 2 * int(before[hi] - before[lo]) < cat.threshold * (n + max(cat.smallest, cat.low * n)):
                continue
            got = cat.best(grams[lo:hi])
            if got:
                found.append((got[1], b - a, got[0], kind, a, b))
        # best first; what overlaps a better match goes
        found.sort(key=lambda x: (-x[0], -x[1], x[4]))
        kept: list = []                                                  # (first word, last word + 1, overlap, match)
        for dice, _, name, kind, a, b in found:
            lo, hi = int(first_word[a]), int(first_word[b])
            if all(hi <= k[0] or lo >= k[1] for k in kept):
                kept.append((lo, hi, dice * (hi - lo), {"license": name, "unit": kind, "first_line": a, "last_line": b - 1, "dice": dice}))
        # windows of words: where nothing matches yet, or only much shorter notices do
        for _, dice, o, a, b, name in sorted(cat.windows(grams), key=lambda x: (-x[0], -x[1], x[3], x[5])):
            lo, hi = a, b + 1
            over = [k for k in kept if lo < k[1] and hi > k[0]]
            if any(k[3]["unit"] == "words" or 2 * k[2] >= o for k in over):
                continue
            kept = [k for k in kept if k not in over]
            line = [int(np.searchsorted(first_word, w, "right")) - 1 for w in (lo, hi - 1)]
            kept.append((lo, hi, o, {"license": name, "unit": "words", "first_line": line[0], "last_line": line[1], "dice": dice}))
        return [k[3] for k in sorted(kept, key=lambda k: k[0])]

    def run(batches):
        cat: _Catalogue = catalogue.value
        for rb in batches:
            col = rb.column(rb.schema.get_field_index(text_col))
            out: list = []
            for a in range(0, rb.num_rows, 512):
                lines = pc.split_pattern(pc.fill_null(col.slice(a, 512).cast(pa.large_string()), ""), "\n")
                per_line, words = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for _, _, counts, h in word_hashes(lines.flatten(), ALNUM):
                    per_line.append(counts)
                    words.append(h)
                per_line, words = np.concatenate(per_line), np.concatenate(words)
                cut = lines.offsets.to_numpy() - lines.offsets[0].as_py()
                at = np.append(0, np.cumsum(per_line))
                for i, j in zip(cut[:-1], cut[1:]):
                    out.append(one(cat, per_line[i:j], words[at[i]:at[j]]))
            kind = pa.list_(pa.struct([("license", pa.string()), ("unit", pa.string()), ("first_line", pa.int32()),
                                       ("last_line", pa.int32()), ("dice", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(out, kind)], names=[*rb.schema.names, "licenses"])
    return run


def scan_licenses(spark: SparkSession, docs: DataFrame, *, templates: dict[str, list[str]] | None = None,
                  threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` with ``licenses``: the best-matching template of each matching unit, overlaps resolved for the better.

    Words are lowered ASCII letters and digits and all non-ASCII characters;
    everything else separates.  Units: each line, each paragraph (lines between
    lines without words), the whole text, and windows of words (unit ``words``)
    that overlap none of these or only much shorter ones; line numbers count from 0.  A unit
    of fewer than two words has no bigrams and matches nothing.  Null and empty
    texts give an empty list.  Equal coefficients go to the longer unit, then the
    earlier, and among licenses to the first by name.  A column named licenses is
    replaced.  The templates travel to all tasks and are a parameter of fixed size.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() != "licenses"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    cat = spark.sparkContext.broadcast(_Catalogue(TEMPLATES if templates is None else templates, threshold))
    return docs.mapInArrow(_scan(cat, text), f"{fields}, licenses {MATCHES}")


def license_digest(found: DataFrame) -> DataFrame:
    """Per document: matches, the best license and its coefficient, and all licenses found."""
    best = F.sort_array(F.transform("licenses", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("n"))))[0]
    names = F.array_join(F.sort_array(F.array_distinct(F.transform("licenses", lambda m: m["license"]))), ",")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"),
                        F.when(F.size("licenses") > 0, best["n"]).alias("license"),
                        F.when(F.size("licenses") > 0, F.round(-best["d"], 6)).alias("dice"), names.alias("licenses"))
