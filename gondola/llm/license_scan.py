"""Licence texts in documents, by patience alignment of words.

Words that occur once in a template and once in the stretch looked at are anchors; the
longest increasing run of them (patience sorting) is kept, and the gaps between two
anchors are aligned in the same way, where words that were repeated before may now be
unique. Equal words at the ends of a gap are taken first. Coverage is the share of the
template's words that are aligned.

A template is looked for only in texts that hold one of its telling words: enough of its
rarest words that a text without any of them cannot reach the least coverage. Around
each such word lies a stretch of the template's length on either side; stretches that
touch are one. Stretches are aligned whole, so a text may hold a licence several times.

Templates are a small set given as an argument (their words are broadcast with the task);
they do not grow with the data. Null or empty texts, and texts without a licence, give no
row. Of templates found in one place the one with the largest coverage is kept, then the
longest, then the first by name. Repeated rows and repeated or null keys give their rows
each. An empty table gives an empty result. Extra columns are ignored. Whole texts are
scanned; places are code points.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gondola.llm.texts import id_and_text, slices

LEAST_COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+(?:[.'’-][^\W_]+)*")

#: Short notices of common licences, as they are written in files.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use '
        "this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without "
        "modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce "
        "the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-short": "Use of this source code is governed by a BSD-style license that can be "
        "found in the LICENSE file.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International "
        "License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    "GPL-2.0-short": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
    "MIT-short": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. "
        "2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone "
        "is free to copy, modify, publish, use, compile, sell, or distribute this software, either "
        "in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
}


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def increasing(places: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    heads: list[int] = []
    before = [-1] * len(places)
    for k, place in enumerate(places):
        pile = bisect_left(tops, place)
        before[k] = heads[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(place)
            heads.append(k)
        else:
            tops[pile], heads[pile] = place, k
    out, k = [], heads[-1] if heads else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, both ascending: the patience alignment."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        count_a, count_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place_b = {b[k]: k for k in range(b0, b1)}
        unique = [(k, place_b[a[k]]) for k in range(a0, a1)
                  if count_a[a[k]] == 1 and count_b.get(a[k]) == 1]
        anchors = [unique[k] for k in increasing([j for _, j in unique])]
        out += anchors
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            gaps += [(i + 1, k, j + 1, n) for (i, j), (k, n) in zip(edges, edges[1:])]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, least: float, spread: Counter):
        self.name, self.words = name, words_of(text)
        self.least = least
        counts = Counter(self.words)
        # Long words met in few templates; together they are more words than may be missing.
        ranked = sorted(counts, key=lambda w: (len(w) < 5, spread[w], -len(w), w))
        spare, self.telling = math.floor((1 - least) * len(self.words) + 1e-9), set()
        for word in ranked:
            if spare < 0:
                break
            self.telling.add(word)
            spare -= counts[word]
        self.places = {w: [k for k, x in enumerate(self.words) if x == w] for w in self.telling}

    def stretches(self, words: list[str], places: dict[str, list[int]]) -> list[tuple[int, int]]:
        """Where the template may lie: around telling words, touching ones together."""
        hits = sorted(k for w in self.telling for k in places.get(w, ()))
        reach, out = len(self.words) + 2, []
        for k in hits:
            low, high = max(0, k - reach), min(len(words), k + reach + 1)
            if out and low <= out[-1][1]:
                out[-1] = (out[-1][0], high)
            else:
                out.append((low, high))
        return out

    def find(self, words: list[str], low: int, high: int) -> list[tuple[int, int, float]]:
        """Alignments in a stretch with enough coverage: first word, end word, coverage.

        Where the template occurs more than once, no word of it may be unique in the whole
        stretch, so it is taken in windows of about the template's length, laid by each
        telling word in turn.
        """
        size, out, at = len(self.words), [], low
        while at < high:
            first = next((k for k in range(at, high) if words[k] in self.telling), None)
            if first is None:
                break
            best = None
            for place in self.places[words[first]]:
                begin = max(at, first - place - 2)
                for slack in (4, 4 + size // 4):
                    pairs = align(self.words, words[begin:min(high, begin + size + slack)])
                    if not pairs:
                        continue
                    a, b = begin + pairs[0][1], begin + pairs[-1][1] + 1
                    coverage = len(pairs) / size
                    if b - a <= 1.5 * size and (best is None or (coverage, a - b) > (
                            best[2], best[0] - best[1])):
                        best = (a, b, coverage)
            if best and best[2] >= self.least:
                out.append(best)
                at = max(best[1], first + 1)
            else:
                at = first + 1
        return out


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        spread = Counter(w for t in templates.values() for w in set(words_of(t)))
        self.templates = [Template(n, t, least, spread) for n, t in sorted(templates.items())]
        self.telling = {w for t in self.templates for w in t.telling}

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        low = text.lower()
        if not any(w in low for w in self.telling):
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        places: dict[str, list[int]] = {}
        for k, word in enumerate(words):
            if word in self.telling:
                places.setdefault(word, []).append(k)
        found = []
        for template in self.templates:
            for low, high in template.stretches(words, places) if places else ():
                found += [(coverage, len(template.words), template.name, a, b)
                          for a, b, coverage in template.find(words, low, high)]
        kept: list[tuple[str, int, int, float]] = []
        for coverage, _, name, a, b in sorted(found, key=lambda x: (-x[0], -x[1], x[2:])):
            start, end = spans[a][0], spans[b - 1][1]
            if all(end <= s or e <= start for _, s, e, _ in kept):
                kept.append((name, start, end, coverage))
        return sorted(kept, key=lambda x: (x[1], x[0]))


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None,
                  least_coverage: float = LEAST_COVERAGE, **columns: str) -> DataFrame:
    """One row for each licence in a text: ``doc_id``, ``license``, ``start``, ``end``,
    ``coverage``."""
    given = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given, least_coverage)
        kind = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int32()),
                          ("end", pa.int32()), ("coverage", pa.float64())])
        for batch in slices(batches):
            rows = [(key, *found) for key, text in zip(batch.column("doc_id").to_pylist(),
                                                       batch.column("text").to_pylist())
                    for found in scanner.scan(text)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kind)], schema=kind)

    return id_and_text(docs, **columns).mapInArrow(
        run, "doc_id long, license string, start int, end int, coverage double")
