"""License scan by patience alignment.

A text and a template are aligned on words that are unique in both: the longest increasing
subsequence of their places is kept, and every gap between two neighbouring anchors is aligned again
in the same way (words repeated in the whole may be unique in a gap).  Runs of equal words next to an
anchor extend it.  Coverage is the share of the template's words that the alignment places, and it is
only counted inside the densest stretch of the text, so scattered common words add nothing: aligned
words more than ``STRAY`` words away from their neighbours are cut off.

A text may hold several licenses, or one several times, where no word is unique: it is cut where template words
thin out, and besides the whole each place is aligned where runs of the template's words agree that a copy stands;
what lies before and behind a license found is searched again.  Every license found is returned with its span.
Some templates hold others (a notice of the LGPL that of the GPL but for a word): of those that meet in the text the
one with the most aligned words is found, then the one covered best.

Defined results: null text is empty; a text that covers no template by ``MIN_COVERAGE`` has no license
(null) with coverage of its best template; ties go to the template first in ``TEMPLATES``; rows with an
equal ``doc_id`` are scanned each on their own; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts
from .license_texts import FULL

MIN_COVERAGE = 0.7
STRAY = 40
MOST_CHARS = 16 << 20
_SPAN = ("license", "coverage", "first_word", "last_word")

# Public license texts and notices as their authors publish them, whole.  ``-notice``: the notice that
# stands at the head of a file; ``-grant``: a text's first paragraph alone, as many files quote it; ``-short``: one line.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software.")
_BSD_2_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.")
_BSD_3_GRANT = (
    _BSD_2_GRANT + " Neither the name of the copyright holder nor the names of its "
    "contributors may be used to endorse or promote products derived from this software without specific prior "
    "written permission.")
_BSD_WARRANTY = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.")


def _gnu_notice(kind: str, version: str) -> str:
    kind, work = f"GNU {kind}General Public License", "library" if kind == "Lesser " and version == "2.1" else "program"
    return (f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {kind} as published "
            f"by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
            f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
            f"warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {kind} for more details. You should have "
            f"received a copy of the {kind} along with this {work}. If not, see <https://www.gnu.org/licenses/>.")


_GNU = {f"{name}-{v}": (kind, v) for name, kind, versions in (
    ("GPL", "", ("3.0", "2.0")), ("LGPL", "Lesser ", ("3.0", "2.1")), ("AGPL", "Affero ", ("3.0",))) for v in versions}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

TEMPLATES = {
    "MIT": _MIT_GRANT +
           " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
           "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
           "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
           "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-Clause": _BSD_3_GRANT + _BSD_WARRANTY,
    "BSD-2-Clause": _BSD_2_GRANT + _BSD_WARRANTY,
    "ISC": _ISC_GRANT +
           " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
           "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
           "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
           "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
           "PERFORMANCE OF THIS SOFTWARE.",
    **FULL,
    "Apache-2.0-notice":
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    "MPL-2.0-notice":
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    **{f"{name}-notice": _gnu_notice(kind, v.removesuffix(".0")) for name, (kind, v) in _GNU.items()},
    **{f"CC-{k}-{v}-notice": f"This work is licensed under the Creative Commons {title} {v} {port} License. To view a copy of this license, "
                             f"visit http://creativecommons.org/licenses/{k.lower()}/{v}/ or send a letter to Creative Commons, PO Box 1866, "
                             "Mountain View, CA 94042, USA."
       for v, port in (("4.0", "International"), ("3.0", "Unported")) for k, title in _CC.items()},
    "MIT-grant": _MIT_GRANT,
    "BSD-3-Clause-grant": _BSD_3_GRANT,
    "BSD-2-Clause-grant": _BSD_2_GRANT,
    "ISC-grant": _ISC_GRANT,
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "MIT-short": "Released under the MIT License.",
    **{f"{name}-short": f"Licensed under the GNU {kind}General Public License, version {v.removesuffix('.0')}." for name, (kind, v) in _GNU.items()},
    **{f"CC-{k}-{v}-short": f"Licensed under CC {k} {v}." for v in ("4.0", "3.0", "2.5", "2.0", "1.0") for k in _CC},
}

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by the first) that increases in the second."""
    tails, piles, back = [], [], []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        if at == len(tails):
            tails.append(b)
            piles.append(k)
        else:
            tails[at], piles[at] = b, k
        back.append(piles[at - 1] if at else -1)
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def places(template: list[int]) -> dict[int, list[int]]:
    """Where each word of a template stands."""
    out: dict[int, list[int]] = {}
    for k, w in enumerate(template):
        out.setdefault(w, []).append(k)
    return out


def align(doc: list[tuple[int, int]], template: list[int], at: dict[int, list[int]] | None = None) -> list[tuple[int, int]]:
    """Pairs (text place, template place) of aligned words.

    ``doc`` holds (place, word number) of the text's words that the template has, in order; ``at``: ``places``."""
    at = places(template) if at is None else at
    out: list[tuple[int, int]] = []
    todo = [(0, len(doc), 0, len(template))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and doc[a0][1] == template[b0] and (b0 and (not out or a0)):
            out.append((doc[a0][0], b0))         # equal words right behind an anchor
            a0, b0 = a0 + 1, b0 + 1
        if a0 >= a1 or b0 >= b1:
            continue
        there: dict[int, int] = {}
        for k in range(a0, a1):
            w = doc[k][1]
            there[w] = -1 if w in there else k
        pairs = []                               # words once in both, in the text's order
        for w, k in there.items():
            if k >= 0:
                own = at[w]
                i = bisect_left(own, b0) if b0 else 0
                if i < len(own) and own[i] < b1 and (i + 1 == len(own) or own[i + 1] >= b1):
                    pairs.append((k, own[i]))
        chain = _increasing(pairs)
        if not chain:
            continue
        la, lb = a0, b0
        for a, b in [*chain, (a1, b1)]:
            if a > la and b > lb:
                todo.append((la, a, lb, b))
            if a < a1:
                out.append((doc[a][0], b))
            la, lb = a + 1, b + 1
    return sorted(out)


def _dense(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The largest group of aligned words without a gap of over ``STRAY`` words."""
    best: list[tuple[int, int]] = []
    start = 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or pairs[k][0] - pairs[k - 1][0] > STRAY:
            if k - start > len(best):
                best = pairs[start:k]
            start = k
    return best


def _stretches(doc: list[tuple[int, int]], least: int) -> list[list[tuple[int, int]]]:
    """The text's template words cut where none stands within ``STRAY`` words; those of ``least`` words and more."""
    out, start = [], 0
    for k in range(1, len(doc) + 1):
        if k == len(doc) or doc[k][0] - doc[k - 1][0] > STRAY:
            if k - start >= least:
                out.append(doc[start:k])
            start = k
    return out


def _agreeing(size: int, run: int) -> int:
    """Runs that must agree on a copy's place.  Words put in move the starts behind them, so a few are enough."""
    return max(1, (size - run + 1) // 40)


class Template:
    def __init__(self, name: str, tokens: list[int]):
        self.name, self.tokens, self.counts, self.at = name, tokens, Counter(tokens), places(tokens)
        self.runs: dict[tuple[int, ...], list[int]] = {}
        self.run = min(3, len(tokens))           # words of a run by which a copy is located
        for k in range(len(tokens) - self.run + 1):
            self.runs.setdefault(tuple(tokens[k:k + self.run]), []).append(k)

    def bound(self, counts: Counter) -> int:
        """No alignment with a text of these words has more: each word as often as both have it."""
        return sum(min(n, self.counts[w]) for w, n in counts.items())

    def _windows(self, doc: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Places in the text from which to which copies of the template may stand, the likeliest first.

        A run of equal words says where its copy starts; the starts that most runs agree on (but for
        words put in or left out) are taken, each run for one copy."""
        size, run = len(self.tokens), self.run
        near = max(1, min(STRAY, size // 2))
        word, starts = [n for _, n in doc], []
        for k, x in enumerate(zip(*(word[i:] for i in range(run)), strict=False)):
            for b in self.runs.get(x, ()):
                starts.append(doc[k][0] - b)
        starts.sort()
        groups, lo = [], 0
        for hi in range(len(starts)):            # starts by peaks: as many within `near` as can be
            while starts[hi] - starts[lo] >= near:
                lo += 1
            groups.append((hi - lo + 1, lo, hi))
        out, taken = [], []
        for n, lo, hi in sorted(groups, key=lambda g: (-g[0], g[1])):
            first, last = starts[lo], starts[hi]
            if n < _agreeing(size, run):
                break
            if any(first <= y and x <= last for x, y in taken):
                continue
            taken.append((first, last))
            slack = min(size // 4 + 1, 8 * STRAY)
            out.append((first - slack, last + size + slack))
        return out

    def best(self, doc: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The alignment of most words: of the whole stretch, or of one place a copy may stand at."""
        found = _dense(align(doc, self.tokens, self.at))
        if 2 * len(doc) <= 3 * len(found):
            return found
        for low, high in self._windows(doc):
            if len(found) == len(self.tokens):
                break
            i, j = bisect_left(doc, (low, -1)), bisect_left(doc, (high, -1))
            if j - i > len(found):
                found = max(found, _dense(align(doc[i:j], self.tokens, self.at)), key=len)
        return found

    def find(self, doc: list[tuple[int, int]], least: float) -> list[list[tuple[int, int]]]:
        """Alignments of every copy covered by ``least``, and if there is none that of the whole."""
        need = max(1, ceil(least * len(self.tokens) - 1e-9))
        out, todo = [], _stretches(doc, need)
        while todo:
            part = todo.pop()
            if self.bound(Counter(n for _, n in part)) < need:
                continue
            pairs = self.best(part)
            if len(pairs) < need:
                continue
            out.append(pairs)
            todo += _stretches(part[:bisect_left(part, (pairs[0][0], -1))], need)
            todo += _stretches(part[bisect_left(part, (pairs[-1][0] + 1, -1)):], need)
        return out or [_dense(align(doc, self.tokens, self.at))]


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.number: dict[str, int] = {}
        self.templates = [Template(name, [self.number.setdefault(w, len(self.number)) for w in words(t)]) for name, t in templates.items()]
        self.templates = [t for t in self.templates if t.tokens]
        self.size = np.array([len(t.tokens) for t in self.templates])
        self.word = np.array([w for t in self.templates for w in t.counts], np.int64)
        self.times = np.array([n for t in self.templates for n in t.counts.values()], np.int64)
        self.start = np.cumsum([0, *(len(t.counts) for t in self.templates)])[:-1]
        self.known: dict[int, np.ndarray] = {}   # which words a template has, for those met so far

    def scan(self, text: str | None, least: float = MIN_COVERAGE) -> list[tuple[str, float, int, int]]:
        """Every license found (template, coverage, the aligned words' first and last place in the text), the
        one with the most aligned words first; spans do not meet.  If there is none: the best template alone."""
        get = self.number.get
        own = [(k, n) for k, n in enumerate(map(get, words(text))) if n is not None]
        if not own:
            return []
        number = np.array([n for _, n in own], np.int64)
        counts = np.bincount(number, minlength=len(self.number))
        bounds = np.add.reduceat(np.minimum(counts[self.word], self.times), self.start) / self.size      # as in Template.bound
        found, most = [], (0.0, 0, None)
        for k in np.argsort(-bounds, kind="stable").tolist():
            t, may = self.templates[k], bounds[k] >= least - 1e-9
            if bounds[k] <= 0 or not may and (found or bounds[k] < most[0]):
                break                            # nor can those behind it
            if k not in self.known:
                self.known[k] = np.zeros(len(self.number), bool)
                self.known[k][t.tokens] = True
            doc = [own[x] for x in np.flatnonzero(self.known[k][number]).tolist()]
            for pairs in t.find(doc, least) if may else [_dense(align(doc, t.tokens, t.at))]:
                cover = len(pairs) / len(t.tokens)
                if pairs and cover >= least:
                    found.append((-len(pairs), -cover, k, pairs[0][0], pairs[-1][0] + 1))
                elif (cover, -k) > most[:2]:
                    most = (cover, -k, pairs)
        out: list[tuple[str, float, int, int]] = []
        for _, c, k, s, e in sorted(found):
            if all(e <= x[2] or x[3] <= s for x in out):
                out.append((self.templates[k].name, -c, s, e))
        if not out and most[2]:
            out.append((self.templates[-most[1]].name, most[0], most[2][0][0], most[2][-1][0] + 1))
        return out


def _chosen(templates: dict[str, str] | DataFrame | None) -> dict[str, str]:
    """The templates by name; of a table ``license, text`` the rows in the order of their names."""
    if not isinstance(templates, DataFrame):
        return dict(TEMPLATES if templates is None else templates)
    rows = templates.where("license is not null and text is not null").select(F.col("license").cast("string"), F.col("text").cast("string"))
    size = rows.agg(F.coalesce(F.sum(F.char_length("license") + F.char_length("text")), F.lit(0)), F.count("*"), F.countDistinct("license")).first()
    if size[0] > MOST_CHARS:
        raise ValueError("templates of over 16 MB: scan them in parts")
    if size[1] != size[2]:
        raise ValueError("a license has two templates: give each its own name")
    return {r[0]: r[1] for r in rows.orderBy("license").collect()}


def license_scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``doc_id, license, coverage, first_word, last_word`` of every document, and ``licenses``: these four of
    every license found in it, in the order of the text (the first columns are the one with the most words).

    ``templates``: texts by license name, or a table ``license, text``; without it ``TEMPLATES``."""
    chosen = _chosen(templates)
    size = sum(len(k) + len(v) for k, v in chosen.items())
    if size > MOST_CHARS:                          # the templates go to every task
        raise ValueError("templates of over 16 MB: scan them in parts")

    def one(b):
        scanner, rows = Scanner(chosen), []
        for text in b.column(1).to_pylist():
            spans = scanner.scan(text, min_coverage)
            name, cover, s, e = spans[0] if spans else (None, 0.0, None, None)
            found = bool(spans) and cover >= min_coverage
            rows.append((name if found else None, cover, s if found else None, e if found else None,
                         [dict(zip(_SPAN, x, strict=True)) for x in sorted(spans, key=lambda x: x[2])] if found else []))
        c = list(zip(*rows, strict=True))
        spans = pa.list_(pa.struct(list(zip(_SPAN, (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True))))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(c[0], pa.string()), pa.array(c[1], pa.float64()),
                                           pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], spans)],
                                          ["doc_id", *_SPAN, "licenses"])

    span = "license string, coverage double, first_word bigint, last_word bigint"
    return map_batches(texts(docs), one, f"doc_id bigint, {span}, licenses array<struct<{span}>>")


def report(docs: DataFrame) -> DataFrame:
    rounded = F.transform("licenses", lambda x: x.withField("coverage", F.round(x["coverage"], 6)))
    return license_scan(docs).withColumn("coverage", F.round("coverage", 6)).withColumn("licenses", rounded)
