"""License scans by patience alignment of texts with license templates.

Words are runs of letters and digits, A-Z lowered.  Inside a stretch of text,
words that occur exactly once there and once in the template are anchors; the
longest run of anchors in the same order on both sides is kept, and the gaps
between them are aligned in the same way, until a gap has no anchors.  Equal
words at the ends of a stretch are matched at once.  The coverage of a template
is the share of its words that were matched.

A text is looked at in windows with somewhat more words than the template that start at each of
its template words, in order; after a find the search goes on behind it, so that a license given twice is found
twice.  What lies between the finds is looked at again in windows twice as wide, and so on up to its
whole length; these start at every half of their width, so that the work of a round is that of one
pass over the text.  So the closest reading of a license wins, and one that is spread by
other text is found however wide.  Texts, stretches and windows that cannot reach the wanted
coverage are passed over: by counts of words, and by the longest common subsequence
with the template, which no alignment exceeds.  A window that lacks k words of it is followed
only by one with at least k more template words behind its end.

Matched words that stand scattered are no license: they count only in pieces, in
which neighbours are at most ``GAP`` words apart, with at least ``PIECE`` words or an eighth
of the template, whichever is more, and a share of matched words of at least ``DENSITY``.
The density of a find is the share of matched words between its first and last word.

Defined results: null, empty and wordless texts have no finds; templates without
words are left out; rows that repeat a doc_id are scanned one by one; extra
columns take no part.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow
from .textbytes import ALNUM, LOWER, text_bytes, text_slices, words

COVERAGE = 0.9
#: Largest distance of neighbours in a piece, least matched words and share of them in a piece.
GAP, PIECE, DENSITY = 32, 4, 0.25

#: Public license notices, by their short names.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "MIT-line": "Released under the MIT License",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def _rising(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence of different numbers."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        back[i] = ends[at - 1] if at else -1
        tops[at : at + 1] = [v]
        ends[at : at + 1] = [i]
    out = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched places (text, template), rising on both sides."""
    found = []
    open_ = [(0, len(text), 0, len(template))]
    while open_:
        a, b, c, d = open_.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: j for j, w in enumerate(template[c:d], c) if there[w] == 1}
        pairs = [(i, place[w]) for i, w in enumerate(text[a:b], a) if here[w] == 1 and w in place]
        anchors = [pairs[k] for k in _rising([j for _, j in pairs])]
        if not anchors:
            continue
        found += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        open_ += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if i + 1 < k and j + 1 < m]
    return sorted(found)


def bits(template: list[int]) -> dict[int, int]:
    """The places of each word of a template as bits of a number."""
    places: dict[int, int] = {}
    for j, w in enumerate(template):
        places[w] = places.get(w, 0) | 1 << j
    return places


def common(text: list[int], template: list[int], places: dict[int, int] | None = None) -> int:
    """Length of a longest common subsequence, with one bit per template word."""
    places = bits(template) if places is None else places
    all_ = free = (1 << len(template)) - 1
    for w in text:
        if w in places:
            hit = free & places[w]
            free = ((free + hit) | (free - hit)) & all_
    return len(template) - free.bit_count()


def piece_words(template: int) -> int:
    """Least words of a piece of a template with so many words."""
    return min(template, max(PIECE, template // 8))


def in_pieces(pairs: list[tuple[int, int]], template: int) -> list[tuple[int, int]]:
    """The matched places that lie in pieces."""
    out: list[tuple[int, int]] = []
    at = 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or pairs[k][0] - pairs[k - 1][0] > GAP:
            span = pairs[k - 1][0] - pairs[at][0] + 1
            if k - at >= piece_words(template) and k - at >= DENSITY * span:
                out += pairs[at:k]
            at = k
    return out


def finds(text: list[int], template: list[int], need: int) -> list[tuple[int, int, int]]:
    """(first word, end word, matched words) of each find in one text."""
    n, places = len(template), bits(template)
    different = len(places) - (n - need)
    member = np.fromiter((w in places for w in text), bool, len(text))
    total = np.concatenate([[0], np.cumsum(member)])
    hits = [w for w in text if w in places]
    width, found = n + n // 4 + 8, []
    # Where two pieces cannot make up the need, no find is wider than one.
    widest = len(text) if need >= 2 * piece_words(n) else n * GAP

    def shared(i: int, k: int) -> int:
        return common(hits[total[i] : total[k]], template, places)

    open_ = [(0, len(text))]
    while open_:
        left = []
        again, narrow = False, width == n + n // 4 + 8
        for a, b in open_:
            if total[b] - total[a] < need or shared(a, b) < need:
                continue
            if narrow:
                start = a + np.flatnonzero(member[a:b])
            else:
                start = np.arange(a, max(a + 1, b - width // 2), width // 2)
            end = np.minimum(start + width, b)
            able = total[end] - total[start] >= need
            free, wanted = a, 0
            for i, k in zip(start[able].tolist(), end[able].tolist(), strict=True):
                if narrow and i < free or total[k] < wanted:
                    continue
                i = max(i, free)
                if len(set(hits[total[i] : total[k]])) < different:
                    continue
                lacks = need - shared(i, k)
                if lacks > 0:
                    wanted = total[k] + lacks if narrow else 0
                    continue
                pairs = align(text[i:k], template)
                if len(pairs) >= need:
                    stop, at = i + pairs[-1][0] + 1, pairs[-1][1] + 1
                    while stop < b and at < n and text[stop] == template[at]:  # the window ended inside the license
                        pairs.append((stop - i, at))
                        stop, at = stop + 1, at + 1
                    pairs = in_pieces(pairs, n)
                if len(pairs) >= need:
                    first, stop = i + pairs[0][0], i + pairs[-1][0] + 1
                    found.append((first, stop, len(pairs)))
                    left.append((free, first))
                    free, again = stop, True
            left.append((free, b))
            again |= b - a > width
        open_ = left if again and width < widest else []
        width *= 2
    return found


@dataclass
class Scanner:
    names: list[str]
    hashes: np.ndarray  # sorted, of all template words
    templates: list[list[int]]  # places in ``hashes``
    coverage: float

    @classmethod
    def build(cls, templates: dict[str, str], coverage: float) -> Scanner:
        data, offsets = text_bytes(pa.array(list(templates.values()), pa.string()))
        hashes, _, _, first = words(data, offsets, LOWER, ALNUM)
        known, code = np.unique(hashes, return_inverse=True)
        parts = [(name, code[a:b].tolist()) for name, a, b in zip(templates, first[:-1], first[1:], strict=True) if b > a]
        return cls([n for n, _ in parts], known, [c for _, c in parts], coverage)

    def find(self, code: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, float, float]]:
        """(text, template, first word, end word, coverage, density) of each find; ``code`` is -1 for words of no template."""
        n_text = len(first) - 1
        text = np.repeat(np.arange(n_text), np.diff(first))
        seen, times = np.unique((text * len(self.hashes) + code)[code >= 0], return_counts=True)
        for k, template in enumerate(self.templates):
            need = int(np.ceil(self.coverage * len(template) - 1e-9))
            wanted = np.bincount(template, minlength=len(self.hashes))
            shared = np.bincount(seen // len(self.hashes), weights=np.minimum(times, wanted[seen % len(self.hashes)]), minlength=n_text) if len(seen) else np.zeros(n_text)
            for t in np.flatnonzero(shared >= need).tolist():
                for begin, end, matched in finds(code[first[t] : first[t + 1]].tolist(), template, need):
                    yield t, k, begin, end, matched / len(template), matched / (end - begin)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id and finds: array of license, first word, end word, coverage and density, in order of place and license."""
    scanner = Scanner.build(templates, coverage)
    kind = docs.schema["doc_id"].dataType.simpleString()
    find = pa.struct([("license", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64()), ("density", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for a, b in text_slices(offsets):
                hashes, _, _, first = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], LOWER, ALNUM)
                at = np.minimum(np.searchsorted(scanner.hashes, hashes), max(0, len(scanner.hashes) - 1))
                code = np.where(scanner.hashes[at] == hashes, at, -1) if len(scanner.hashes) else np.full(len(hashes), -1)
                for t, k, begin, end, share, dense in scanner.find(code, first):
                    out[a + t].append({"license": scanner.names[k], "first": begin, "end": end, "coverage": share, "density": dense})
            for finds in out:
                finds.sort(key=lambda x: (x["first"], x["license"]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "finds": pa.array(out, pa.list_(find))})

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, finds array<struct<license:string,first:bigint,end:bigint,coverage:double,density:double>>")
