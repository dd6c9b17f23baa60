"""License scan: patience alignment of license wordings with the passages of a text that share their words."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COVERAGE = 0.8
_WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")

# Public license notices as they are commonly written.
TEMPLATES: dict[str, str] = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "bsd-2-clause-terms": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution."),
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "mit-line": "Released under the MIT License.",
    "mit-terms": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software."),
}


def words_with_places(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(_WORD.finditer(text))
    return [m.group().lower() for m in found], [m.span() for m in found]


def _longest_rise(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest part of pairs, ascending in the first number, that also rises in the second (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    below: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        below.append(piles[at - 1] if at else -1)
        tops[at:at + 1] = [b]
        piles[at:at + 1] = [k]
    chain, k = [], piles[-1] if piles else -1
    while k >= 0:
        chain.append(pairs[k])
        k = below[k]
    return chain[::-1]


def patience_align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of two word lists, ascending in both.

    Equal words at both ends are matched first. Words that occur once in each
    of the two are anchors; the longest rising chain of anchors is matched and
    the gaps between are aligned in the same way. A gap without anchors
    matches nothing.
    """
    matched: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, p, j, q = work.pop()
        while i < p and j < q and a[i] == b[j]:
            matched.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
            matched.append((p, q))
        if i == p or j == q:
            continue
        in_a, in_b = Counter(a[i:p]), Counter(b[j:q])
        once = {w: k for k, w in enumerate(b[j:q], j) if in_b[w] == 1}
        anchors = _longest_rise([(k, once[w]) for k, w in enumerate(a[i:p], i) if in_a[w] == 1 and w in once])
        matched += anchors
        if anchors:
            fences = [(i - 1, j - 1), *anchors, (p, q)]
            work += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(fences, fences[1:])]
    return sorted(matched)


class Scanner:
    """Templates cut into words, and what a passage has to share with each of them to cover it well enough."""

    def __init__(self, templates: Mapping[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = {name: words_with_places(text)[0] for name, text in sorted(templates.items())}
        self.counts = {name: Counter(words) for name, words in self.templates.items()}
        self.least = {name: max(1, math.ceil(coverage * len(words))) for name, words in self.templates.items()}

    def passages(self, name: str, words: list[str]) -> list[tuple[int, int]]:
        """Longest and shortest passage up to each word that share enough words with a template, counted as often as it has them.

        No finding is missed: it lies within twice the template's length and
        has at least so many of its words.
        """
        wanted, least, reach = self.counts[name], self.least[name], 2 * len(self.templates[name])
        hits = [k for k, w in enumerate(words) if w in wanted]
        spans: dict[tuple[int, int], None] = {}
        wide, tight = Counter(), Counter()
        shared = first = close = 0
        for k in hits:
            word = words[k]
            wide[word] += 1
            tight[word] += 1
            shared += wide[word] <= wanted[word]
            while k - hits[first] >= reach:
                gone = words[hits[first]]
                shared -= wide[gone] <= wanted[gone]
                wide[gone] -= 1
                if close == first:
                    tight[gone] -= 1
                    close += 1
                first += 1
            if shared < least:
                continue
            kept = sum(min(n, wanted[w]) for w, n in tight.items())
            while kept - (tight[words[hits[close]]] <= wanted[words[hits[close]]]) >= least:
                gone = words[hits[close]]
                kept -= tight[gone] <= wanted[gone]
                tight[gone] -= 1
                close += 1
            spans[hits[first], k + 1] = spans[hits[close], k + 1] = None
        return list(spans)

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, template, coverage) of each finding in code points; findings do not overlap, the best covered and longest win.

        Every passage that shares enough words with a template is aligned with
        it, and once more with what the template has before and after the
        matched part; a finding covers the template's words well enough and is
        not longer than twice what it covers.
        """
        words, places = words_with_places(text or "")
        present = set(words)
        found = set()
        for name, template in self.templates.items():
            size, wanted = len(template), self.counts[name]
            # A word that is not there costs at least one match.
            if len(wanted.keys() & present) < max(1, len(wanted) - (size - self.least[name])):
                continue
            known: dict[tuple[str, ...], list[tuple[int, int]]] = {}
            seen: set[tuple[int, int]] = set()
            work = [(span, True) for span in self.passages(name, words)]
            while work:
                (low, high), extend = work.pop()
                if (low, high) in seen:
                    continue
                seen.add((low, high))
                passage = tuple(words[low:high])
                if passage not in known:
                    known[passage] = patience_align(list(passage), template)
                matched = known[passage]
                if not matched:
                    continue
                first, last = low + matched[0][0], low + matched[-1][0]
                if extend:
                    before, after = matched[0][1], size - 1 - matched[-1][1]
                    work += [((max(0, first - before - slack), min(len(words), last + 1 + after + slack)), False) for slack in (0, size // 4 + 2)]
                if len(matched) >= self.coverage * size and last - first + 1 <= 2 * len(matched):
                    found.add((-len(matched) / size, -len(matched), last - first, places[first][0], places[last][1], name))
        chosen: list[tuple[int, int, str, float]] = []
        for covered, _, _, start, end, name in sorted(found):
            if all(end <= s or start >= e for s, e, _, _ in chosen):
                chosen.append((start, end, name, -covered))
        return sorted(chosen)


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text: str = "text", templates: Mapping[str, str] = TEMPLATES,
                  coverage: float = COVERAGE) -> DataFrame:
    """One row per input row: id and ``licenses``, an array of (start, end, template, coverage) by start.

    Null and empty texts have none. Repeated rows are scanned one by one.
    Templates are a parameter of fixed size and travel with the function.
    """
    scanner = Scanner(templates, coverage)
    item = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("template", T.StringType()),
                         T.StructField("coverage", T.DoubleType())])
    arrow = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("template", pa.string()), ("coverage", pa.float64())])
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("start", "end", "template", "coverage"), x)) for x in scanner.scan(t.as_py())] for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(arrow))], names=["id", "licenses"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("licenses", T.ArrayType(item))])).withColumnRenamed("id", id_column)
