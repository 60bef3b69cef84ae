"""License scans with a generalised suffix automaton.

The automaton holds all substrings, as words, of all phrases and templates.
Streaming a text through it gives at each word the longest run of words
that ends there and occurs in some template (matching statistics).  Long
runs are chained, in the order of both text and template, into the spans of
the template that the text covers.

Only words that follow each other in some template can take the automaton
past its first states, so runs of such pairs are found in whole Arrow
slices first, and only they are streamed.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import LOWER_ALNUM, slices, text_rows, translated, words_of

#: The phrases of the base and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Openings of well-known public licences.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}


def template_words(text: str) -> list[str]:
    """The words of a text, as the scan takes them."""
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").translate(LOWER_ALNUM).split()]


class Automaton:
    """A suffix automaton of several word sequences; phrases are sequences whose every occurrence is reported."""

    def __init__(self, phrases: list[list[str]], templates: list[list[str]]):
        self.words = {w: k for k, w in enumerate(dict.fromkeys(w for s in [*phrases, *templates] for w in s))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (template, the place after an occurrence), of all occurrences
        self.templates = [[self.words[w] for w in s] for s in templates]
        for k, s in enumerate(self.templates):
            self._add(s, k)
        ended = [self._add([self.words[w] for w in s], None) for s in phrases]
        # a state's places in the templates hold for all shorter suffixes, too
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[v]:
                self.ends[self.link[v]] |= self.ends[v]
        # phrases that end where a state's strings end: (phrase, words it needs)
        own: dict[int, list[int]] = {}
        for p, v in enumerate(ended):
            if phrases[p]:
                own.setdefault(v, []).append(p)
        self.reports: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.reports[v] = [*self.reports[self.link[v]], *((p, len(phrases[p])) for p in own.get(v, ()))]
        n = len(self.words)
        self.pairs = np.zeros((n, n), bool)
        for s in [*phrases, *templates]:
            for a, b in zip(s, s[1:]):
                self.pairs[self.words[a], self.words[b]] = True
        self.single = np.zeros(n, bool)  # phrases of one word
        for s in phrases:
            if len(s) == 1:
                self.single[self.words[s[0]]] = True

    def _add(self, seq: list[int], template: int | None) -> int:
        last = 0
        for place, c in enumerate(seq, 1):
            last = self._extend(last, c)
            if template is not None:
                self.ends[last].add((template, place))
        return last

    def _clone(self, p: int, c: int, q: int) -> int:
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.ends.append(set())
        new = len(self.link) - 1
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        self.ends.append(set())
        cur, p = len(self.link) - 1, last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return cur

    def stream(self, codes):
        """For each word of a run, (state, length) of the longest match that ends there."""
        v = n = 0
        step, link, length = self.next, self.link, self.length
        for c in codes:
            while v and c not in step[v]:
                v = link[v]
                n = length[v]
            if c in step[v]:
                v, n = step[v][c], n + 1
            else:
                v = n = 0
            yield v, n

    def ended(self, v: int, n: int, follows: int, least: int):
        """(template, place after it, words) of the matches that end here and that the next word does not go on from.

        Those of the state are the longest; along its links follow shorter
        ones, at other places of the templates.
        """
        seen: set[tuple[int, int]] = set()
        while v and n >= least:
            for t, end in self.ends[v] - seen:
                if end == len(self.templates[t]) or self.templates[t][end] != follows:
                    yield t, end, n
            seen |= self.ends[v]
            v = self.link[v]
            n = self.length[v]


def chained(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The most template words that runs (place in the text, place in the template, words) cover in order in both; and the chain's span in the text.

    Runs come in the order of the text, and of those that ended the best chain
    is kept for each (begin, end) in the template, of which there are few.
    """
    best: dict[tuple[int, int], tuple[int, int]] = {}
    waiting: list[tuple[int, int, int, int, int]] = []  # by the end in the text: chains that a later run may go on from
    top = (0, 0, 0)
    for d, t, n in sorted(runs):
        while waiting and waiting[0][0] <= d:
            _, tj, ej, had, begin = heapq.heappop(waiting)
            best[tj, ej] = max(best.get((tj, ej), (0, 0)), (had, begin))
        value = (n, d)
        for (tj, ej), (had, begin) in best.items():
            gain = n - max(0, ej - t)
            if tj < t and gain > 0 and had + gain > value[0]:
                value = (had + gain, begin)
        heapq.heappush(waiting, (d + n, t, t + n, *value))
        top = max(top, (*value, d + n))
    return top


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, least: int = 4, share: float = 0.5) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each document.

    Words are runs of ASCII letters and digits and of all other non-ASCII
    characters, A-Z in lower case.  n_base counts the places where a phrase
    stands.  A template counts if matches of ``least`` words or more, chained,
    cover ``share`` of it; spans are (label, first, end, covered) of these, in
    words from 0 with the end excluded.  score is the greatest share covered
    of a template, or 1 with a phrase.  A null or empty text has no words,
    null places, empty labels and the score 0.  Rows may repeat.
    """
    names, titles = list(phrases), list(templates)
    kinds = [phrases[n] for n in names]
    made: list[Automaton] = []

    def run(batches):
        if not made:
            made.append(Automaton([template_words(n) for n in names], [template_words(templates[t]) for t in titles]))
        auto = made[0]
        sizes = [len(template_words(templates[t])) for t in titles]
        for rows, text in slices(batches):
            counts, words = words_of(translated(text, LOWER_ALNUM))
            known = np.fromiter((auto.words.get(w, -1) for w in words.dictionary.to_pylist()), np.int64, len(words.dictionary))
            codes = known[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
            ends = np.cumsum(counts)
            row = np.repeat(np.arange(len(counts)), counts)
            good = (codes[:-1] >= 0) & (codes[1:] >= 0) & (row[:-1] == row[1:])
            good[good] = auto.pairs[codes[:-1][good], codes[1:][good]]
            live = np.zeros(len(codes), bool)
            live[:-1] |= good
            live[1:] |= good
            single = codes >= 0
            single[single] = auto.single[codes[single]]
            live |= single
            # runs of words each of which goes on from the one before
            at = np.flatnonzero(live)
            begins = at[~np.concatenate([[False], (np.diff(at) == 1) & good[at[:-1]]])] if len(at) else at
            found: dict[int, list] = {}
            for b in begins.tolist():
                e = b + 1
                while e < len(codes) and live[e] and good[e - 1]:
                    e += 1
                r = int(row[b])
                base0 = int(ends[r] - counts[r])
                places, runs = found.setdefault(r, [[], {}])
                some = codes[b:e].tolist()
                for k, (v, n) in enumerate(auto.stream(some)):
                    if n >= least:
                        for t, end, size in auto.ended(v, n, some[k + 1] if k + 1 < len(some) else -1, least):
                            runs.setdefault(t, []).append((b + k + 1 - size - base0, end - size, size))
                    for p, need in auto.reports[v]:
                        if need <= n:
                            places.append((b + k - need + 1 - base0, p))
            out = [[], [], [], [], [], [], []]
            for r in range(len(counts)):
                places, runs = found.get(r, ((), {}))
                spans = []
                for t, some in runs.items():
                    covered, first, end = chained(some)
                    spans.append((titles[t], first, end, covered / sizes[t]))
                took = sorted(x for x in spans if x[3] >= share)
                base = sorted({kinds[p] for _, p in places})
                starts = [s for s, _ in places]
                score = 1.0 if places else max([0.0, *(min(1.0, x[3]) for x in spans)])
                for column, value in zip(out, (len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *(x[0] for x in took)})), score, [dict(zip(("label", "first", "end", "covered"), x)) for x in took])):
                    column.append(value)
            span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))
            kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span)
            yield pa.RecordBatch.from_arrays(
                [pc.cast(rows.column("doc_id"), pa.int64()), pa.array(counts.astype(np.int64)), *(pa.array(c, k) for c, k in zip(out, kinds_))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return text_rows(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, end: long, covered: double>>")
