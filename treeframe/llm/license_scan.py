"""License scans by patience alignment.

Words of a text are aligned with those of a license template: words that are unique in both are
anchors; of these, the longest sequence that ascends in both is kept; the gaps between are aligned in
the same way. Coverage is the share of the template's words that are aligned.

A template can stand anywhere in a text, and more than once, with words changed, left out or put in: up
to twice as many put in as it has itself; into a statement, of fewer than LONG words, up to as many, and
INSERTED at least, as a few common words spread over a page are no license. That is what counts as a
place. Every word of the text that is in the template, other than common ones, may be the first of one;
where the words from it to that reach hold enough of the template's, wherever they stand, windows that
begin there are aligned.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treeframe.llm import text as tx

#: least share of a template's words
COVERAGE = 0.8
#: words that may be put into any template, however short
INSERTED = 4
#: words of a template from which on twice its words may be put in
LONG = 20
_CHUNK = 1 << 20
_COMMON = frozenset("a an the of and or to in is are be by for with this that it as on at any all not you your from under may".split())
_WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")

TEMPLATES: dict[str, str] = {
    "gpl-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-4.0-statement": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-sa-4.0-statement": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4.0-statement": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-4.0-statement": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-statement": "Licensed under CC BY 4.0.",
    "cc0-1.0-statement": "Licensed under CC0 1.0.",
    "gpl-2.0-statement": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-2.1-statement": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0-statement": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-statement": "This work is licensed under the GNU Affero General Public License, version 3.",
    "bsd-statement": "Released under the BSD License.",
    "isc-statement": "Released under the ISC License.",
    "mit-statement": "Released under the MIT License.",
    "apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-2.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

#: words that tell one license from another: those of them that a template has must be aligned
NAMING = frozenset("gnu lesser affero apache mozilla mpl mit bsd isc cc cc0 by nc nd sa 0 1 2 3 4".split())
#: words that name another license when they stand beside an aligned naming word
OTHERS = frozenset("lesser library affero nc nd sa noncommercial noderivatives sharealike".split())
#: license -> one that has all of its words and more, and counts alone where both stand
PART_OF = {"bsd-2-clause": "bsd-3-clause"}


def normalised(text: str) -> list[str]:
    """Lower-case words of ASCII letters and digits and of everything beyond ASCII."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return _WORD.findall(tx.folded(raw).tobytes().decode())


def ascending(values: list[int]) -> list[int]:
    """Places of a longest ascending subsequence, by patience piles."""
    tops: list[int] = []
    pile: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            pile.append(i)
        else:
            tops[k] = v
            pile[k] = i
        back.append(pile[k - 1] if k else -1)
    out = []
    i = pile[-1] if pile else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places at which the two agree, ascending in both."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        # equal ends need no anchors
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1}
        both = [(place[w], j) for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and w in place]
        kept = [both[i] for i in ascending([i for i, _ in both])]
        if not kept:
            continue
        out += kept
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        stack += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:]) if i + 1 < k and j + 1 < m]
    return sorted(out)


class Scanner:
    """The templates, prepared."""

    def __init__(self, templates: Mapping[str, str], coverage: float):
        self.coverage = coverage
        self.templates = [(name, w) for name, t in sorted(templates.items()) if (w := normalised(t))]
        #: the naming words that must be aligned; "by" and numbers name only in short statements of TEMPLATES
        self.naming = [self._naming(name, w) if templates is TEMPLATES else set() for name, w in self.templates]
        #: word -> (template, places in it), for words that tell something
        self.places: dict[str, list[tuple[int, list[int]]]] = {}
        self.telling = []
        #: of each template, how often each telling word is in it
        self.often: list[dict[str, int]] = []
        #: of each template and word, the most common words that go right before it
        self.before: list[dict[str, int]] = []
        for t, (_, words) in enumerate(self.templates):
            own: dict[str, list[int]] = {}
            for i, w in enumerate(words):
                if w not in _COMMON:
                    own.setdefault(w, []).append(i)
            if not own:
                own = {w: [i for i, x in enumerate(words) if x == w] for w in set(words)}
            for w, at in own.items():
                self.places.setdefault(w, []).append((t, at))
            self.telling.append(sum(map(len, own.values())))
            self.often.append({w: len(at) for w, at in own.items()})
            run = [0]
            for w in words[:-1]:
                run.append(0 if w in own else run[-1] + 1)
            self.before.append({w: max(run[i] for i in at) for w, at in own.items()})
        words = [w.encode() for w in self.places]
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words]).astype(np.int64)
        self.hashes = np.sort(tx.Rolling(data)(np.r_[0, ends[:-1]].astype(np.int64), ends)) if words else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    @staticmethod
    def _naming(name: str, words: list[str]) -> set[str]:
        if name.endswith("-statement"):
            return NAMING & set(words)
        # versions stand after the word
        numbers = {b for a, b in zip(words, words[1:]) if a == "version"}
        return {w for w in NAMING & set(words) if w in numbers or w in ("gnu", "lesser", "affero")}

    def named(self, t: int, pairs: list[tuple[int, int]], words: list[str]) -> bool:
        """Whether the words that name the license are aligned, and none between, beside them, names another."""
        naming, template = self.naming[t], self.templates[t][1]
        if not naming:
            return True
        if not naming <= {template[j] for _, j in pairs}:
            return False
        aligned = {i for i, _ in pairs}
        beside = {k for i in aligned if words[i] in naming or words[i] == "general" for k in (i - 1, i + 1) if pairs[0][0] < k < pairs[-1][0]}
        return not any(words[k] in OTHERS and k not in aligned for k in beside)

    def windows(self, t: int, places: list[int], words: list[str]) -> set[tuple[int, int]]:
        """Parts of the text to be aligned with a template, given the places of its telling words."""
        m, often = len(self.templates[t][1]), self.often[t]
        # aligned words of a window may miss what isn't covered
        least = max(1, self.telling[t] - int((1 - self.coverage) * m + 1e-9))
        out: set[tuple[int, int]] = set()
        if len(places) < least:
            return out
        reach = 3 * m if m >= LONG else m + max(INSERTED, m)
        sizes = sorted({m, m + max(2, m // 4), m + max(2, m // 2), m + max(INSERTED, m), reach})
        count = dict.fromkeys(often, 0)
        there, hi = 0, 0
        for p in places:
            while hi < len(places) and places[hi] < p + reach:
                w = words[places[hi]]
                there += count[w] < often[w]
                count[w] += 1
                hi += 1
            w = words[p]
            if there >= least:
                before = self.before[t][w]
                for a0 in {p - before, p - before - max(INSERTED, before)} if before else {p}:
                    out.update((max(0, a0), min(len(words), p + size)) for size in sizes)
            count[w] -= 1
            there -= count[w] < often[w]
        return out

    def scan(self, words: list[str], at: list[int]) -> list[tuple[str, int, int, float]]:
        """(license, first word, words, coverage) of a text, given the places of telling words."""
        hits: dict[int, list[int]] = {}
        for p in at:
            for t, _ in self.places.get(words[p], ()):
                hits.setdefault(t, []).append(p)
        out: list[tuple[str, int, int, float]] = []
        #: of each place, (aligned words, words of text and template that aren't)
        worth: list[tuple[int, int]] = []
        for t, places in hits.items():
            name, template = self.templates[t]
            m = len(template)
            found = []
            for a0, a1 in sorted(self.windows(t, places, words)):
                pairs = align(words[a0:a1], template)
                if len(pairs) >= self.coverage * m - 1e-9 and self.named(t, [(i + a0, j) for i, j in pairs], words):
                    first, last = pairs[0][0] + a0, pairs[-1][0] + a0
                    found.append((-len(pairs), last - first, first, last))
            taken: list[tuple[int, int]] = []
            for n, _, first, last in sorted(found):
                if all(last < a or first > b for a, b in taken):
                    taken.append((first, last))
                    out.append((name, first, last - first + 1, -n / m))
                    worth.append((-n, last - first + 1 + m + 2 * n))
        return _unexplained(out, worth)


def _unexplained(out: list[tuple[str, int, int, float]], worth: list[tuple[int, int]]) -> list[tuple[str, int, int, float]]:
    """The places, in order, of which no place that overlaps aligns as many words and leaves fewer over."""
    order = sorted(range(len(out)), key=lambda i: (out[i][1], out[i][0]))
    longest = max((x[2] for x in out), default=0)
    begins = [out[i][1] for i in order]
    kept = []
    for i in order:
        _, a, n, _ = out[i]
        near = order[bisect.bisect_right(begins, a - longest) : bisect.bisect_left(begins, a + n)]
        if any(out[j][0] == PART_OF.get(out[i][0]) and out[j][1] <= a and out[j][1] + out[j][2] >= a + n for j in near):
            continue
        if not any(out[j][1] + out[j][2] > a and worth[j][0] >= worth[i][0] and worth[j][1] < worth[i][1] for j in near):
            kept.append(out[i])
    return kept


def _scanned(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner: Scanner = sent.value
        for batch in batches:
            data, offsets, _ = tx.string_bytes(batch.column("text"))
            row, out = [], []
            for i, j in tx.pieces(offsets, _CHUNK):
                sub, bound = tx.folded(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
                starts, ends, first = tx.words(sub, bound, tx.MARK)
                if not len(starts):
                    continue
                h = tx.Rolling(sub)(starts, ends)
                maybe = np.flatnonzero(scanner.seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
                maybe = maybe[np.isin(h[maybe], scanner.hashes)]
                own = np.searchsorted(first, maybe, "right") - 1
                cuts = np.flatnonzero(np.r_[True, np.diff(own) != 0, True]) if len(own) else np.zeros(1, np.int64)
                for a, b in zip(cuts[:-1], cuts[1:]):
                    d = int(own[a])
                    words = _WORD.findall(sub[bound[d] : bound[d + 1]].tobytes().decode())
                    for hit in scanner.scan(words, (maybe[a:b] - first[d]).tolist()):
                        row.append(i + d)
                        out.append(hit)
            names = ["license", "first_word", "n_words", "coverage"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64()]
            cols = [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *cols], ["doc_id", *names])

    return run


def license_scan(docs: DataFrame, templates: Mapping[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, first_word, n_words, coverage of each place where a template is covered enough.

    Words are counted from 0, in lower case and without marks. Of places of one template that overlap,
    the one with most aligned words counts, then the shortest, then the first. A place may count for
    several templates, unless another aligns as many words and leaves fewer over: a license isn't taken
    for one that differs from it in a word. Of the templates here, the words that name the license must
    be there, and no other license's beside them. Null and empty texts, and an empty table, give nothing; rows that are repeated
    are scanned each. Long texts are scanned to their end. Only doc_id and text are read, so that other
    columns may have any names.
    """
    if not 0 < coverage <= 1:
        raise ValueError("coverage is above 0, up to 1")
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, coverage))
    have = docs.select("doc_id", "text")
    kind = have.schema["doc_id"].dataType.simpleString()
    return have.mapInArrow(_scanned(sent), f"doc_id {kind}, license string, first_word long, n_words long, coverage double")
