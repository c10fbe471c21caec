"""Licence text by matching statistics on a generalised suffix automaton of licence tokens.

The automaton holds every run of words of every template. Streaming a text's words through it gives, at each word, how many
of the last words stand together in some template. Long matches are then chained, in the template's own order, into
covered spans, scored by the words covered among the template's and those of the span that it lacks; where spans overlap
the best one stays, so that a relative which shares most of the wording does not win over the licence itself. Short name
phrases are templates too: a phrase stands where the match at its last word is long enough and passes through the phrase's
state.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridindex.llm import wordbytes

#: Name phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The wording of public licence notices, and their labels.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("apache", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
]

#: Families whose members differ by a few words of the same notices.
GNU = {"gpl": "GNU General Public License", "lgpl": "GNU Lesser General Public License", "agpl": "GNU Affero General Public License"}
GNU_NOTICES = [
    "{subject} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
    "{subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.",
    "Licensed under the {name}.",
]
CREATIVE_COMMONS = {
    "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}

TEMPLATES += [(label, notice.format(subject=subject, name=name, version=version)) for label, name in GNU.items() for notice in GNU_NOTICES for subject, version in (("This program", "3"), ("This library", "2.1")) if "{subject}" in notice or version == "3"]
TEMPLATES += [(f"cc-{code}", text) for code, name in CREATIVE_COMMONS.items() for text in (f"Licensed under CC {code.upper()} 4.0.", f"This work is licensed under a Creative Commons {name} 4.0 International License.")]

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


class SuffixAutomaton:
    """Of several token sequences. Each state keeps where its strings end: (sequence, position)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for p, token in enumerate(sequence):
                last = self._extend(last, token, ends)
                ends[last].add((k, p))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                ends[self.link[state]] |= ends[state]
        self.ends = [sorted(e) for e in ends]

    def _add(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: int, ends: list) -> int:
        clone = self._add(self.length[p] + 1, ends)
        self.next[clone] = dict(self.next[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int, ends: list) -> int:
        q = self.next[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token, ends)
        new, p = self._add(self.length[last] + 1, ends), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token, ends)
        return new

    def walk(self, state: int, length: int, token: int) -> tuple[int, int]:
        """The longest suffix of the text so far that the sequences contain."""
        while state and token not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(token)
        return (0, 0) if to is None else (to, length + 1)


def _tokens(text: str) -> list[int]:
    return next(wordbytes.words(pa.array([text]), wordbytes.ALNUM)).hash.tolist()


class Scanner:
    def __init__(self, min_match: int = 3, min_cover: float = 0.6, max_gap: int = 12):
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap
        phrases, templates = [_tokens(p) for p in PHRASES], [_tokens(t) for _, t in TEMPLATES]
        self.labels = [*PHRASES.values(), *(label for label, _ in TEMPLATES)]
        self.n_phrases, self.sizes = len(phrases), [len(x) for x in phrases + templates]
        self.automaton = SuffixAutomaton(phrases + templates)
        self.vocabulary = np.unique(np.array([t for s in phrases + templates for t in s], np.uint64))
        self.least = min(map(len, phrases))
        # the phrases that end a state's strings; one of m words stands where the match is at least m long
        own: list[list[int]] = [[] for _ in self.automaton.ends]
        for k, phrase in enumerate(phrases):
            state = 0
            for token in phrase:
                state = self.automaton.next[state][token]
            own[state].append(k)
        self.phrase_ends: list[list[int]] = []
        for state in range(len(own)):
            found: set[int] = set()
            while state > 0:
                found |= set(own[state])
                state = self.automaton.link[state]
            self.phrase_ends.append(sorted(found))

    def scan(self, tokens: list[int], places: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """tokens that the templates use and their places in the text -> (phrase, first word) and maximal matches (end, length, state)."""
        walk, phrase_ends = self.automaton.walk, self.phrase_ends
        base, matches = [], []
        state = length = 0
        before = -2
        for token, place in zip(tokens, places, strict=True):
            if place != before + 1:
                if length >= self.min_match:
                    matches.append((before, length, state))
                state = length = 0
            was, had = state, length
            state, length = walk(state, length, token)
            if length <= had and had >= self.min_match:
                matches.append((before, had, was))
            for k in phrase_ends[state]:
                if self.sizes[k] <= length:
                    base.append((k, place - self.sizes[k] + 1))
            before = place
        if length >= self.min_match:
            matches.append((before, length, state))
        return base, matches

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[float, int, int, int]]:
        """Covered template spans: (score, template, first word, last word), none overlapping another.

        The score is the words covered over the template's words and those of the span that are not covered.
        """
        open_: dict[int, list[int]] = {}
        out = []

        def close(k: int) -> None:
            _, _, covered, first, last = open_.pop(k)
            score = covered / (self.sizes[k] + max(last - first + 1 - covered, 0))
            if score >= self.min_cover:
                out.append((score, covered, k, first, last))

        for end, length, state in matches:
            start = end - length + 1
            for k in [k for k, (text_end, *_) in open_.items() if start > text_end + self.max_gap]:
                close(k)
            for k, at in self.automaton.ends[state]:
                if k < self.n_phrases or at + 1 < length:
                    continue
                if k not in open_:
                    open_[k] = [end, at, length, start, end]
                elif at > open_[k][1] and end > open_[k][0]:
                    text_end, template_end, covered, first, _ = open_[k]
                    open_[k] = [end, at, covered + min(length, end - text_end, at - template_end), first, end]
                elif length > open_[k][2] or (start > open_[k][0] and open_[k][2] >= self.min_cover * self.sizes[k]):  # a better copy of the template, or the next one
                    close(k)
                    open_[k] = [end, at, length, start, end]
        for k in list(open_):
            close(k)
        return self._apart(out)

    def _apart(self, found: list[tuple[float, int, int, int, int]]) -> list[tuple[float, int, int, int]]:
        """The best of spans (score, covered, template, first, last) that overlap: by score, words covered, then the first template."""
        kept: list[tuple[int, int, float, int]] = []
        for score, _, k, first, last in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
            at = bisect_left(kept, (first, -1, 0.0, -1))
            if (at == 0 or kept[at - 1][1] < first) and (at == len(kept) or kept[at][0] > last):
                kept.insert(at, (first, last, score, k))
        return [(score, k, first, last) for first, last, score, k in kept]

    def batch(self, column: pa.Array) -> list[tuple]:
        rows: list[tuple] = []
        for w in wordbytes.words(column, wordbytes.ALNUM):
            at = np.searchsorted(self.vocabulary, w.hash)
            known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == w.hash
            place = np.flatnonzero(known)
            if self.least > 1 and len(place):  # a lone known word is no match of two words or more
                near = np.zeros(len(place) + 1, bool)
                near[1:-1] = np.diff(place) == 1
                place = place[near[1:] | near[:-1]]
            cuts = np.searchsorted(place, w.first).tolist()
            tokens, place, first = w.hash[place].tolist(), place.tolist(), w.first.tolist()
            for k in range(w.hi - w.lo):
                n = first[k + 1] - first[k]
                if cuts[k] == cuts[k + 1]:
                    rows.append((n, 0, None, None, "", "", 0.0, ""))
                    continue
                base, matches = self.scan(tokens[cuts[k] : cuts[k + 1]], [p - first[k] for p in place[cuts[k] : cuts[k + 1]]])
                spans = self.chain(matches)
                named = {self.labels[p] for p, _ in base}
                starts = [s for _, s in base]
                score = max([1.0 if base else 0.0, *(s[0] for s in spans)])
                best = sorted({(s, e, self.labels[t]) for _, t, s, e in spans})
                rows.append((n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(named)), ",".join(sorted(named | {self.labels[s[1]] for s in spans})), score, ",".join(f"{label}:{s}:{e + 1}" for s, e, label in best)))
        return rows


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: its words, the places of name phrases, labels and covered template spans (label:first:end in words).

    A null or empty text has no words, labels "" and score 0; repeated rows stay repeated; a null doc_id stays null; other
    columns are ignored. Whole texts are streamed; templates are fixed, so memory does not follow the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        names, types = zip(*((n, kinds[t]) for n, t in (x.split() for x in SCHEMA.split(", "))), strict=True)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = scanner.batch(part.column(1))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types[1:], strict=True))], list(names))

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
