"""License scans by patience alignment of whole texts with license templates.

Words that occur once in the text's window and once in the template are anchors;
the longest increasing subsequence of anchors is matched, and the gaps between are
aligned the same way until no anchor is left. Equal words at both ends of a gap
match before. Coverage is the share of template words matched.

A window is the stretch a template would fill around one occurrence of the template
word that is rarest in the text, widened by a quarter; each occurrence gets one, so
repeated notices are all found and words far away add nothing. A text that lacks so
many different template words that coverage cannot be reached is not aligned (this
loses nothing). Windows of one template that overlap give the best one.

Words are runs of letters, digits, dots, plus and hyphens between others, in lower
case, without dots or hyphens at their end. Rows are independent: null, blank and
empty texts have no licenses, repeated rows repeat, an empty table gives no rows, and
among windows of equal coverage the first counts. Nothing is shuffled or collected.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tripmine.llm.shingles import rows_of

#: Public license statements and notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "mit": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met."
    ),
}
_WORD = re.compile(r"\w(?:[\w.+-]*[\w+])?")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of ``a`` and ``b``, increasing in both."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, j, k, m = gaps.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append((j, m))
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: x for x, w in enumerate(a[i:j], i) if in_a[w] == 1 and in_b[w] == 1}
        anchors = _increasing([(place[w], y) for y, w in enumerate(b[k:m], k) if w in place])
        for x, y in anchors:
            gaps.append((i, x, k, y))
            found.append((x, y))
            i, k = x + 1, y + 1
        if anchors:
            gaps.append((i, j, k, m))
    return sorted(found)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence with increasing first parts, by patience piles."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for n, (x, _) in enumerate(pairs):
        pile = bisect_left(tops, x)
        before[n] = last[pile - 1] if pile else -1
        tops[pile : pile + 1], last[pile : pile + 1] = [x], [n]
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


class Template:
    def __init__(self, name: str, text: str, least: float):
        self.name, self.words, self.least = name, words(text), least
        self.count = Counter(self.words)

    def windows(self, found: list[str], places: dict[str, list[int]]) -> Iterator[tuple[int, int]]:
        n = len(self.words)
        here = [w for w in self.count if w in places]
        if sum(self.count[w] for w in here) < self.least * n - 1e-9:
            return
        # coverage may miss the rarest word: as many words as could be missing get windows
        spare = n - int(self.least * n - 1e-9) if self.least < 1 else 1
        seeds, held = sorted(here, key=lambda w: (len(places[w]), self.words.index(w))), 0
        done: set = set()
        step = n // 8 + 1
        for w in seeds:
            for at in places[w]:
                for of in (x for x, v in enumerate(self.words) if v == w):
                    if at - of not in done:
                        # as long as the template, for copies that stand side by side
                        done.add(at - of)
                        yield max(0, at - of), min(len(found), at - of + n)
                    if (wide := ("wide", (at - of) // step)) not in done:
                        done.add(wide)
                        yield max(0, at - of - n // 4 - step), min(len(found), at + n - of + n // 4 + step)
            held += self.count[w]
            if held >= spare:
                break

    def scan(self, found: list[str], places: dict[str, list[int]]) -> list[tuple[str, float, int, int, int]]:
        """(name, coverage, matched words, first and end word) of separate matches."""
        hits = []
        for start, end in self.windows(found, places):
            window = found[start:end]
            if sum((self.count & Counter(window)).values()) < self.least * len(self.words) - 1e-9:
                continue
            matched = patience(window, self.words)
            if matched and len(matched) >= self.least * len(self.words) - 1e-9:
                hits.append((len(matched), start + matched[0][0], start + matched[-1][0] + 1))
        out: list[tuple[str, float, int, int, int]] = []
        taken: list[tuple[int, int]] = []
        for n, first, end in sorted(hits, key=lambda h: (-h[0], h[2] - h[1], h[1])):
            at = bisect_left(taken, (first, end))
            if (at == 0 or taken[at - 1][1] <= first) and (at == len(taken) or taken[at][0] >= end):
                taken.insert(at, (first, end))
                out.append((self.name, n / len(self.words), n, first, end))
        return sorted(out, key=lambda h: h[3])


SCHEMA = "doc_id bigint, license string, coverage double, n_matched bigint, first_word bigint, end_word bigint"
_KINDS = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
_NAMES = ("doc_id", "license", "coverage", "n_matched", "first_word", "end_word")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """A row per license notice found in ``docs`` (``doc_id, text``), at word positions of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Template(name, text, least) for name, text in templates.items()]
        vocabulary = frozenset(w for t in ready for w in t.words)
        for batch in rows_of(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words(text.as_py() or "")
                places: dict[str, list[int]] = {}
                for at, w in enumerate(found):
                    if w in vocabulary:
                        places.setdefault(w, []).append(at)
                for t in ready:
                    rows += [(doc_id, *hit) for hit in t.scan(found, places)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
