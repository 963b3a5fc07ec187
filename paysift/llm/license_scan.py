"""License scans by patience alignment.

A document's words are aligned with a license template's: words that occur once in both are
anchors; the longest increasing run of anchors (by patience sorting) is kept; and the gaps
before, between and after them are aligned in the same way, after common words at their ends
are taken.  The coverage of a template is the share of its words that are aligned.

In a long document hardly any word occurs once, and a notice may stand there twice.  So
passages are aligned: each word that occurs once in the template votes for the place where a
copy would begin, and votes of up to half a template apart make a passage, the most voted for
first.  Templates that can't reach the coverage, because the document has too few of their
words, are passed over; that bound is exact.

Coverage alone would take one license's notice for its sister's, which differs in a word.  So each template has telling words, computed from
the set: those of its name, version numbers, and the words in which it differs from a twin, a template
that otherwise aligns with it.  All telling words must be aligned, and a passage must not hold
the telling words of a twin beside them.  Of passages that overlap, the one with more aligned words stays (the whole notice, not the line in it); ties
go to the better covered, then the first name.

Defined cases: a null or wordless text matches nothing; a template without words matches
nothing; repeated rows get the same rows each; an empty table gives no rows; ids are whole numbers.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from paysift.llm.common import bounded_batches

#: The least share of a template that counts, and of its once-occurring words that must vote for one place.
MIN_COVERAGE, MIN_VOTES = 0.8, 0.3
#: The most words of its own that a template may have beside a twin.
TWIN_WORDS = 8
WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")

# Notices and texts of public licenses.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject
to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "BSD-line": "Released under the BSD License.",
    "MPL-2.0-line": "Licensed under the Mozilla Public License, version 2.0.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-SA-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0-line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-ND-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0-line": "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication.",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "LGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
any means.""",
    "GPL-3.0-text": """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007. Everyone is permitted to copy and distribute verbatim copies of this license
document, but changing it is not allowed. Preamble. The GNU General Public License is a free, copyleft license for software and other kinds of
works.""",
    "GPL-2.0-text": """GNU GENERAL PUBLIC LICENSE Version 2, June 1991. Everyone is permitted to copy and distribute verbatim copies of this license
document, but changing it is not allowed. Preamble. The licenses for most software are designed to take away your freedom to share and change
it.""",
    "Apache-2.0-text": """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND
DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1
through 9 of this document.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of ``a`` and ``b``, rising in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            found.append((i_end, j_end))
        if i >= i_end or j >= j_end:
            continue
        anchors = _rising(_unique_in_both(a[i:i_end], b[j:j_end]))
        if not anchors:
            continue
        anchors = [(i + x, j + y) for x, y in anchors]
        found += anchors
        ends = [(i - 1, j - 1), *anchors, (i_end, j_end)]
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:])]
    return sorted(found)


def _unique_in_both(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    in_a, in_b = Counter(a), Counter(b)
    place = {w: j for j, w in enumerate(b) if in_b[w] == 1}
    return [(i, place[w]) for i, w in enumerate(a) if in_a[w] == 1 and w in place]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run that rises in both, by patience sorting."""
    tops: list[int] = []
    top_at: list[int] = []
    back: list[int | None] = []
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back.append(top_at[pile - 1] if pile else None)
        if pile == len(tops):
            tops.append(y)
            top_at.append(k)
        else:
            tops[pile], top_at[pile] = y, k
    run, k = [], top_at[-1] if top_at else None
    while k is not None:
        run.append(pairs[k])
        k = back[k]
    return run[::-1]


def passages(starts: list[int], length: int, min_votes: float) -> Iterator[tuple[int, int]]:
    """(first, last) start of each group of ``starts`` (rising) within half a length of each
    other, the largest groups first, of at least ``min_votes``."""
    reach, groups, hi = max(4, length // 2), [], 0
    for lo, first in enumerate(starts):
        while hi < len(starts) and starts[hi] <= first + reach:
            hi += 1
        if hi - lo >= min_votes:
            groups.append((lo - hi, first, starts[hi - 1]))
    taken: list[int] = []  # first starts of the groups chosen
    for _, first, last in sorted(groups):
        k = bisect_left(taken, first)
        if all(abs(x - first) > reach for x in taken[max(0, k - 1):k + 1]):
            taken.insert(k, first)
            yield first, last


def twins(a: list[str], b: list[str]) -> tuple[list[int], set[str]] | None:
    """For two templates that differ in few words: the places of ``a``'s own words, and ``b``'s; None if they differ in more."""
    same = patience(a, b)
    own = sorted(set(range(len(a))) - {i for i, _ in same})
    other = {b[j] for j in set(range(len(b))) - {j for _, j in same}}
    if len(same) < max(3, 0.5 * min(len(a), len(b))) or len(own) > TWIN_WORDS or len(other) > TWIN_WORDS:
        return None
    return own, other - set(a)


def name_words(name: str, template: list[str]) -> list[int]:
    """Places of words that the name spells: one of its parts, or several in a row."""
    parts = name.lower().split("-")
    spelt = {"-".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)} - {"line", "short", "text", "or", "later"}
    return [i for i, w in enumerate(template) if w in spelt and not w.isdigit()]


def versions(template: list[str]) -> list[int]:
    """Places of version numbers: with a dot in them, or after "version" or "v"."""
    return [i for i, w in enumerate(template) if w[0].isdigit() and ("." in w or i and template[i - 1] in ("version", "v"))]


class Scanner:
    """Finds the passages of a document that cover ``min_coverage`` of a template, its telling words among them."""

    def __init__(self, templates: dict[str, str], min_coverage: float = MIN_COVERAGE):
        self.templates = {name: w for name, text in templates.items() if (w := words(text))}
        self.counts = {name: Counter(w) for name, w in self.templates.items()}
        self.once = {name: {x: i for i, x in enumerate(w) if self.counts[name][x] == 1} for name, w in self.templates.items()}
        self.min_coverage = min_coverage
        self.telling: dict[str, set[int]] = {}
        self.foreign: dict[str, set[str]] = {}
        for name, template in self.templates.items():
            tell, foreign = {*name_words(name, template), *versions(template)}, set()
            for other, text in self.templates.items():
                if other != name and (found := twins(template, text)):
                    tell |= set(found[0])
                    foreign |= found[1]
            self.telling[name], self.foreign[name] = tell, foreign

    def __call__(self, text: str | None) -> Iterator[tuple[str, int, int, int, float]]:
        """(template, first word, words, words aligned, coverage) of each passage, none overlapping another."""
        doc = words(text)
        kept: list[tuple[int, int]] = []
        for hit in sorted(self.covered(doc), key=lambda h: (-h[3], -h[4], h[0], h[1])):
            _, start, size, _, _ = hit
            k = bisect_left(kept, (start, 0))
            before, after = k == 0 or kept[k - 1][1] <= start, k == len(kept) or kept[k][0] >= start + size
            if before and after:
                kept.insert(k, (start, start + size))
                yield hit

    def covered(self, doc: list[str]) -> Iterator[tuple[str, int, int, int, float]]:
        """Every passage that covers a template by its own words, whatever it overlaps."""
        vocabulary = set(doc)
        for name, template in self.templates.items():
            n = len(template)
            # words of the template that the document lacks can't be aligned
            if any(template[i] not in vocabulary for i in self.telling[name]) or sum(c for w, c in self.counts[name].items() if w in vocabulary) < self.min_coverage * n:
                continue
            once = self.once[name]
            starts = sorted(i - once[w] for i, w in enumerate(doc) if w in once)
            used: list[tuple[int, int]] = []
            for first, last in passages(starts, n, max(1.0, MIN_VOTES * len(once))):
                # with room for words that were put in; else just from where a copy would begin to where it would end
                for room in (n // 4, 0):
                    lo, hi = max(0, first - room), min(len(doc), last + n + room)
                    for a, b in used:  # a copy beside another keeps to its own words
                        lo, hi = (max(lo, b) if a <= lo < b else lo), (min(hi, a) if a < hi <= b else hi)
                    aligned = patience(doc[lo:hi], template) if hi > lo else []
                    if len(aligned) >= self.min_coverage * n and self.tells(name, doc[lo:hi], aligned):
                        start, end = lo + aligned[0][0], lo + aligned[-1][0] + 1
                        used.append((start, end))
                        yield name, start, end - start, len(aligned), len(aligned) / n
                        break

    def tells(self, name: str, doc: list[str], aligned: list[tuple[int, int]]) -> bool:
        """Whether the telling words are aligned and no twin's stand between the aligned words."""
        if not self.telling[name] <= {j for _, j in aligned}:
            return False
        own = {i for i, _ in aligned}
        return not any(doc[i] in self.foreign[name] for i in range(aligned[0][0], aligned[-1][0] + 1) if i not in own)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text",
         min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """A row for each passage found: doc_id, license, start_word, n_words, n_aligned, coverage."""
    bounded_batches(docs.sparkSession)
    columns = ["doc_id", "license", "start_word", "n_words", "n_aligned", "coverage"]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Scanner(templates, min_coverage)
        for batch in batches:
            rows = [(i, *hit) for i, text in zip(batch["doc_id"].astype("Int64"), batch["text"]) for hit in find(text)]
            out = pd.DataFrame(rows, columns=columns)
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInPandas(task, "doc_id long, license string, start_word long, n_words long, n_aligned long, coverage double")
