"""Operator 10: license scans by patience alignment.

A template and a stretch of text are aligned on words that are unique in both: of these anchors the longest sequence
that ascends in both is kept, and the gaps between its members are aligned in the same way, until a gap has no anchor.
Coverage is the share of the template's words that are aligned. A match has at least MIN_COVERAGE.

Where to align is exact too: a stretch that covers a share t of a template of L words misses at most (1 - t) L of
them, so it holds one of any floor((1 - t) L) + 1 of its words. The longest words are taken as these keys, and only
stretches around a key are aligned, with the key as the first anchor.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping
from heapq import heappop, heappush
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import prepare

MIN_COVERAGE = 0.75
#: A match may spread over so many times the template's words, and SLACK_WORDS more.
STRETCH = 1.25
SLACK_WORDS = 4

TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy "
        "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
        "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def ascending(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, v in enumerate(values):
        pile = bisect_left(tops, v)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(k)
        else:
            tops[pile], at[pile] = v, k
    out = []
    k = at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places in a and b, ascending in both, that patience alignment matches."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where]
        if not anchors:
            # equal words at the ends are aligned even if they are not unique
            if a[a0] == b[b0]:
                out.append((a0, b0))
                work.append((a0 + 1, a1, b0 + 1, b1))
            elif a[a1 - 1] == b[b1 - 1]:
                out.append((a1 - 1, b1 - 1))
                work.append((a0, a1 - 1, b0, b1 - 1))
            continue
        kept = [anchors[k] for k in ascending([j for _, j in anchors])]
        out += kept
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        work += [(i0 + 1, i1, j0 + 1, j1) for (i0, j0), (i1, j1) in zip(edges[:-1], edges[1:])]
    return sorted(out)


class Side:
    """The words on one side of an anchor, nearest first: a of the template, b of the text."""

    def __init__(self, a: list[int], b: list[int]):
        self.a, self.b = a, b
        at: dict[int, int] = {}
        for i, w in enumerate(a):
            at[w] = at.get(w, 0) | 1 << i
        #: (most pairs, words of b) of the beginnings of b; no alignment is longer than the longest common subsequence
        self.bounds: list[tuple[int, int]] = []
        self.pairs: dict[int, tuple[int, int]] = {0: (0, 0)}
        every = rest = (1 << len(a)) - 1
        for j, w in enumerate(b):
            if w in at:
                hit = rest & at[w]
                rest = (rest + hit | rest - hit) & every
            elif not j or b[j - 1] not in at:
                continue  # further words that a has not make no difference
            self.bounds.append((len(a) - rest.bit_count(), j + 1))
        self.most = len(a) - rest.bit_count()

    def growing(self, least: int) -> list[tuple[int, int]]:
        """(pairs, words of b that they take) of the beginnings of b with least pairs or more, each with more than any shorter one."""
        out = [(0, 0)] if least <= 0 else []
        for bound, j in self.bounds:
            if bound >= least and bound > (out[-1][0] if out else 0):
                if j not in self.pairs:
                    pairs = align(self.a, self.b[:j])
                    self.pairs[j] = len(pairs), pairs[-1][1] + 1 if pairs else 0
                if self.pairs[j][0] >= max(least, out[-1][0] + 1 if out else 1):
                    out.append(self.pairs[j])
        return out


class Templates:
    def __init__(self, texts: Mapping[str, str], coverage: float):
        self.names, self.coverage = list(texts), coverage
        self.words, self.counts, self.least, self.keys = [], [], [], []
        owners: dict[int, list[tuple[int, int]]] = {}
        for t, text in enumerate(texts.values()):
            raw = np.frombuffer(text.encode(), np.uint8)
            low, off = K.lowered(raw, np.array([0, len(raw)]))
            _, s, e = K.word_spans(low, off)
            words = K.span_hash(K.prefix_hashes(low), s, e).tolist()
            self.words.append(words)
            self.counts.append(Counter(words))
            self.least.append(ceil(coverage * len(words)))
            length = dict(zip(words, (e - s).tolist()))
            # with multiplicity: words that may be missing, plus one
            count, need = Counter(words), int((1 - coverage) * len(words)) + 1
            for w in sorted(count, key=lambda w: (-length[w], w)):
                if need <= 0:
                    break
                need -= count[w]
                for place in (k for k, x in enumerate(words) if x == w):
                    owners.setdefault(w, []).append((t, place))
        self.owners = owners
        self.keys = np.array(sorted(owners), np.uint64)
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.keys >> np.uint64(46)).astype(np.int64)] = True

    def fullest(self, t: int, words: list[int], k: int, place: int, lo: int, hi: int) -> tuple[int, int, int] | None:
        """(words aligned, first word, end word) of the fullest match of template t in words[lo:hi], then the tightest.

        It aligns word k with the template's word at place. With that pair as an anchor, what is left and right of it is
        aligned apart, in stretches of every length: longer ones may hold words of other copies, which cost a word its
        uniqueness.
        """
        own, need = self.words[t], self.least[t]
        begin, end = k - place, k - place + len(own)
        if lo <= begin and end <= hi and words[begin:end] == own:
            return len(own), begin, end
        width = int(len(own) * STRETCH) + SLACK_WORDS
        lo, hi = max(lo, k - width + 1), min(hi, k + width)
        count = self.counts[t]
        if sum(min(n, count.get(w, 0)) for w, n in Counter(words[lo:hi]).items()) < need:
            return None
        # the left side is aligned back to front, so that both sides begin at the anchor
        left, right = Side(own[:place][::-1], words[lo:k][::-1]), Side(own[place + 1 :], words[k + 1 : hi])
        for goal in range(left.most + right.most + 1, need - 1, -1):
            ends = right.growing(goal - 1 - left.most)
            fits = [(m + n + 1, -x - y - 1, x) for m, x in left.growing(goal - 1 - right.most) for n, y in ends if m + n + 1 >= goal and x + y + 1 <= width]
            if fits:
                n, wide, x = max(fits)
                return n, k - x, k - x - wide
        return None

    def matches(self, words: list[int], hits: list[int]) -> list[tuple[int, int, int, int]]:
        """(template, first word, end word, words aligned) in one document, given the places of its key words."""
        anchors: dict[int, list[tuple[int, int]]] = {}
        for k in hits:
            for t, place in self.owners[words[k]]:
                anchors.setdefault(t, []).append((k, place))
        out = []
        for t, pairs in anchors.items():
            starts: list[int] = []  # of the matches taken, which do not overlap
            ends: list[int] = []
            found: list[tuple[int, int, int, int, int]] = []

            def gap(k: int) -> tuple[int, int] | None:
                """The words around k that no match has taken."""
                at = bisect_right(starts, k)
                if at and ends[at - 1] > k:
                    return None
                return ends[at - 1] if at else 0, starts[at] if at < len(starts) else len(words)

            def look(k: int, place: int) -> None:
                if (free := gap(k)) is not None and (best := self.fullest(t, words, k, place, *free)) is not None:
                    n, a, b = best
                    heappush(found, (-n, b - a, a, k, place))

            def take() -> None:
                while found:
                    n, wide, a, k, place = heappop(found)
                    free = gap(a)
                    if free is not None and a + wide <= free[1]:
                        at = bisect_right(starts, a)
                        starts.insert(at, a)
                        ends.insert(at, a + wide)
                        out.append((t, a, a + wide, -n))
                    else:  # a fuller one has taken some of its words
                        look(k, place)

            # nothing is fuller or tighter than a verbatim copy: most other anchors are inside of one and need no look
            own = self.words[t]
            whole = {begin: (k, place) for k, place in pairs if (begin := k - place) >= 0 and words[begin : begin + len(own)] == own}
            for k, place in whole.values():
                look(k, place)
            take()
            for k, place in pairs:
                look(k, place)
            take()
        return sorted(out)


def license_scan(docs: DataFrame, templates: Mapping[str, str] | None = None, coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, first_word, end_word, matched): every match of a template in every row of docs.

    Places count words from 0. Matches of one template do not overlap: the fuller one stands, then the tighter, then the
    earlier, and what it leaves is searched again; so copies side by side are all found.
    Uses doc_id and text alone. Defined cases: a null, empty or wordless text has no match; null doc_ids and repeated
    rows are scanned as they come; an empty table gives no rows; texts are scanned whole, at any length.
    """
    prepare(docs.sparkSession)
    known = Templates(templates or TEMPLATES, coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = K.text_buffer(batch.column("text"))
            rows = []
            for i, j in K.slices(off):
                d, h = K.word_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                at = np.flatnonzero(known.maybe[(h >> np.uint64(46)).astype(np.int64)])
                at = at[np.isin(h[at], known.keys)]
                begin = np.searchsorted(d, np.arange(j - i + 1))
                docs_, first = K.runs(d[at])
                for k, (doc, f) in enumerate(zip(docs_, first)):
                    end = first[k + 1] if k + 1 < len(first) else len(at)
                    a, b = begin[doc], begin[doc + 1]
                    for t, s, e, n in known.matches(h[a:b].tolist(), (at[f:end] - a).tolist()):
                        rows.append((i + doc, known.names[t], n / len(known.words[t]), s, e, n))
            if rows:
                row, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), pa.array(rest[0]), pa.array(rest[1], pa.float64()), *(pa.array(x, pa.int32()) for x in rest[2:])],
                    ["doc_id", "license", "coverage", "first_word", "end_word", "matched"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, license string, coverage double, first_word int, end_word int, matched int")
