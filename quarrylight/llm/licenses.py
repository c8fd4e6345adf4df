"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Words are those of the decontamination operator. Of a template's ``GRAM``-word grams the winnowed ones (the least hash
of every ``WINNOW`` consecutive ones) go to an inverted index. A text looks up all its grams, so any run of
GRAM + WINNOW - 1 template words is found. Hits of a template on near diagonals are one candidate, which is aligned with
the words around by local alignment within a band: a match counts 2, a substitution, an extra or a missing word -1.
The text left and right of a match is aligned again until nothing reaches the threshold, so adjacent notices all count.
The result has the share of the template's words that matched and the span of text words they cover.

The templates are a parameter of fixed size, so the broadcast index doesn't grow with the corpus. The default ones are
excerpts and notices, not whole licenses: MIT, BSD and ISC end before their disclaimers, Apache, GPL and MPL are the
standard headers or part of them. Coverage and span are those of the excerpt; bodies and disclaimers alone aren't found,
LGPL, AGPL and GPL-2.0 have no template, and a GPL-2.0 header aligns with that of GPL-3.0.

Defined results: null and empty texts match nothing; several occurrences are several matches; of overlapping matches
the one with more matched words stays, then the better covered, then the first by name; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import prepare, slices, texts
from quarrylight.llm.decontaminate import words_of

GRAM, WINNOW, BAND, LEAST = 3, 4, 8, 0.6
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
#: Excerpts of public licenses and the usual one-line notices.
TEMPLATES = [
    ("Apache-2.0", APACHE),
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", BSD),
    ("BSD-3-Clause", f"{BSD} 3. {BSD_NAMES}"),
    ("CC-BY-4.0 notice", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0 notice", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", GPL),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", ISC),
    ("MIT", MIT),
    ("MIT notice", "Released under the MIT License."),
    ("MPL-2.0", MPL),
    ("Proprietary notice", "All rights reserved."),
]


class Index:
    def __init__(self, templates: list[tuple[str, str]]):
        self.number: dict[bytes, int] = {}
        self.names = [k for k, _ in templates]
        self.words = [[self.number.setdefault(w, len(self.number) + 1) for w in words_of(t)] for _, t in templates]
        self.postings: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.words):
            grams = [tuple(words[i : i + GRAM]) for i in range(max(1, len(words) - GRAM + 1))] if words else []
            hashes = [hash((0x5BD1E995, *g)) for g in grams]
            for a in range(max(1, len(grams) - WINNOW + 1) if grams else 0):
                i = min(range(a, min(a + WINNOW, len(grams))), key=lambda x: (hashes[x], -x))
                if (k, i) not in self.postings[grams[i]]:
                    self.postings[grams[i]].append((k, i))
        self.sizes = sorted({len(g) for g in self.postings})

    def hits(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, its position, text position) of each gram of the text that is in the index."""
        known = np.concatenate(([0], np.cumsum(numbers > 0)))
        for size in self.sizes:
            if len(numbers) >= size:
                for p in np.flatnonzero(known[size:] - known[:-size] == size).tolist():
                    for k, i in self.postings.get(tuple(numbers[p : p + size].tolist()), ()):
                        yield k, i, p

    def matches(self, numbers: np.ndarray, least: float) -> list[tuple[int, int, int, int, float]]:
        """(begin, end, template, matched words, coverage), disjoint and in order."""
        near: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, i, p in self.hits(numbers):
            near[k].append((p - i, p))
        found = []
        for k, places in near.items():
            places.sort()
            group: list[tuple[int, int]] = []
            for d, p in [*places, (1 << 62, 0)]:
                if group and d - group[-1][0] > BAND:
                    low, high = group[0][0], group[-1][0]
                    found += [(*x[:2], k, x[2], x[2] / len(self.words[k])) for x in occurrences(self.words[k], numbers, low - BAND, high + BAND, least)]
                    group = []
                group.append((d, p))
        out: list[tuple[int, int, int, int, float]] = []
        for x in sorted(found, key=lambda x: (-x[3], -x[4], self.names[x[2]], x[0])):
            if all(x[1] <= y[0] or y[1] <= x[0] for y in out):
                out.append(x)
        return sorted(out)


def cells(template: list[int], numbers: np.ndarray, low: int, high: int, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(score, matched words, begin, end) of the best alignment that ends in each cell of the diagonals low to high.

    Only the text words from start to stop are seen.
    """
    first = max(start, low)
    text = numbers[first : max(0, high + len(template)) if stop is None else max(0, min(stop, high + len(template)))].tolist()
    none = (0, 0, -1)
    before: dict[int, tuple[int, int, int]] = {}
    for i, word in enumerate(template):
        now = {}
        for j in range(max(0, low + i - first), min(len(text), high + i - first + 1)):
            s, n, b = before.get(j - 1, none)
            if text[j] == word:
                cell = (s + 2, n + 1, b if s else j)
            else:
                cell = max((s - 1, n, b), *((x[0] - 1, x[1], x[2]) for x in (before.get(j, none), now.get(j - 1, none))))
            if cell[0] <= 0:
                continue
            now[j] = cell
            yield cell[0], cell[1], first + cell[2], first + j + 1
        before = now


def align(template: list[int], numbers: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """(begin, end, matched words) of the best local alignment on the diagonals low to high; ties: the earliest."""
    best = max(cells(template, numbers, low, high), key=lambda x: x[0], default=None)
    return (best[2], best[3], best[1]) if best else None


def occurrences(template: list[int], numbers: np.ndarray, low: int, high: int, least: float) -> list[tuple[int, int, int]]:
    """(begin, end, matched words) of disjoint alignments that match at least that share of the template.

    The best ones are taken, then the best in what is left of the text between them, until none reaches the share.
    """
    out, parts = [], [(0, len(numbers))]
    while parts:
        start, stop = parts.pop()
        if stop - start < least * len(template):
            continue
        top, ends = 0, []
        for x in cells(template, numbers, low, high, start, stop):
            if x[0] >= top and x[1] / len(template) >= least:
                if x[0] > top:
                    top, ends = x[0], []
                ends.append(x)
        at = start
        for _, n, begin, end in sorted(ends, key=lambda x: (x[3], x[2])):
            if begin >= at:
                out.append((begin, end, n))
                parts.append((at, begin))
                at = end
        if ends:
            parts.append((at, stop))
    return out


def scan(docs: DataFrame, *, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """A row per document: doc_id, n_matches, coverage (the best), license (the one with most matched words), matches."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(templates)
    item = pa.struct([("license", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("matched", pa.int32()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for b in slices(batches, 8 << 20):
            found = []
            for text in texts(b.column(1)):
                words = words_of(text)
                numbers = np.fromiter(map(index.number.get, words, repeat(0)), np.int64, len(words))
                found.append(index.matches(numbers, least) if numbers.any() else [])
            best = [max(x, key=lambda m: (m[3], m[4], -m[0]), default=None) for x in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in found], pa.int32()), pa.array([x[4] if x else 0.0 for x in best]), pa.array([index.names[x[2]] if x else None for x in best], pa.string()), pa.array([[{"license": index.names[m[2]], "begin": m[0], "end": m[1], "matched": m[3], "coverage": m[4]} for m in x] for x in found], pa.list_(item))],
                ["doc_id", "n_matches", "coverage", "license", "matches"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_matches int, coverage double, license string, matches array<struct<license:string,begin:bigint,end:bigint,matched:int,coverage:double>>")
