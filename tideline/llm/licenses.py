"""License scans: a generalised suffix automaton of license tokens, matching statistics, chained spans.

The automaton holds every run of words of every template and phrase. A text's words stream through it; after each word
the state and length say how many of the last words stand consecutively in some template (the matching statistics).
A phrase that ends at the state within that length has a place there. Matches that cannot be extended and have at
least ``MIN_MATCH`` words become anchors (template place, text place); anchors of one template in the same order, at
most ``MAX_GAP`` words apart, are chained, and a chain that covers enough of its template is a span. Licences come in
families whose notices differ in a word or a number. The words that tell a template from one of another label that it
resembles must be among the covered ones, so a notice of a version that is not listed gets no label of its sister.

Only words that occur in a template can move the automaton, so all others are passed over by array operations.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Words, lowered, map_slices

MIN_MATCH = 4
MAX_GAP = 16
MIN_COVERAGE = 0.6

# Phrases whose places are always reported, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Public license notices, with their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("gpl", "This work is licensed under the GNU General Public License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-1", "This work is licensed under the GNU General Public License, version 1."),
    ("gpl-1", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version."),
    ("lgpl-3", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Released under the BSD License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
]
#: Templates of other labels that share so much of their words are told apart word by word.
ALIKE = 0.5

_IS_WORD = np.zeros(256, bool)
_IS_WORD[ord("0") : ord("9") + 1] = _IS_WORD[ord("a") : ord("z") + 1] = _IS_WORD[128:] = True

SCAN = (
    "doc_id bigint, n_words bigint, phrase_label array<string>, phrase_start array<bigint>, "
    "span_label array<string>, span_start array<bigint>, span_end array<bigint>, span_coverage array<double>"
)


def words_of(text: str | None) -> list[str]:
    """Words of a text: A-Z lower-cased; runs of digits, letters a-z and non-ASCII characters."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


class Automaton:
    """Generalised suffix automaton of several word sequences.

    ``step`` holds the transitions, ``link`` and ``longest`` the suffix links and longest lengths, and ``ends`` for each
    state the (sequence, place after the last word) pairs where its strings end.
    """

    def __init__(self, sequences: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.longest, self.ends = [-1], [0], [set()]
        for number, words in enumerate(sequences):
            last = 0
            for place, word in enumerate(words, 1):
                last = self._extend(last, word)
                self.ends[last].add((number, place))
        for state in sorted(range(1, len(self.step)), key=lambda s: -self.longest[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, longest: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.longest.append(longest)
        self.link.append(link)
        self.ends.append(set())
        return len(self.step) - 1

    def _split(self, state: int, below: int, word: int) -> int:
        """The state of exactly the strings one word longer than ``state``'s, parted from ``below`` if need be."""
        if self.longest[below] == self.longest[state] + 1:
            return below
        copy = self._state(self.longest[state] + 1, dict(self.step[below]), self.link[below])
        self.link[below] = copy
        while state >= 0 and self.step[state].get(word) == below:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, self.step[last][word], word)
        new = self._state(self.longest[last] + 1, {}, 0)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, self.step[last][word], word)
        return new

    def advance(self, state: int, length: int, word: int) -> tuple[int, int]:
        """State and matched length after one more word."""
        while state and word not in self.step[state]:
            state = self.link[state]
            length = self.longest[state]
        if word in self.step[state]:
            return self.step[state][word], length + 1
        return 0, 0


def telling_words(texts: list[list[str]], labels: list[str]) -> list[tuple[set[int], list[tuple[int, int]]]]:
    """For each template the places of the words that tell it from alike templates of other labels, and the pairs of
    neighbours between which such a template has more words: nothing may stand between those."""
    out: list[tuple[set[int], list[tuple[int, int]]]] = [(set(), []) for _ in texts]
    for i, own in enumerate(texts):
        for j, other in enumerate(texts):
            if labels[i] == labels[j] or not own or not other:
                continue
            match = SequenceMatcher(None, own, other, autojunk=False)
            if 2 * sum(b.size for b in match.get_matching_blocks()) < ALIKE * (len(own) + len(other)):
                continue
            for kind, a, b, _, _ in match.get_opcodes():
                if kind in ("replace", "delete") and b - a <= MIN_MATCH:  # a word or two, not a paragraph
                    out[i][0].update(range(a, b))
                elif kind == "insert" and 0 < a < len(own):
                    out[i][1].append((a - 1, a))
    return out


def chain(anchors: list[tuple[int, int, int]], gap: int = MAX_GAP) -> list[tuple[int, int, int]]:
    """Chains of (text start, template start, words) anchors of one template: (text start, text end, words covered)."""
    return [(begin, end, covered) for begin, end, covered, _ in chains(anchors, gap)]


def chains(anchors: list[tuple[int, int, int]], gap: int = MAX_GAP) -> list[tuple[int, int, int, list[tuple[int, int, int]]]]:
    """:func:`chain` with the anchors of each chain, last first.

    An anchor may follow another that starts earlier in both and ends at most ``gap`` words before; words that both
    cover count once. Each anchor takes its best predecessor; chains are read off from the best ends, each anchor in
    one chain only.
    """
    anchors = sorted(set(anchors))
    longest = max((n for _, _, n in anchors), default=0)
    best, previous = [], []
    for i, (d, t, n) in enumerate(anchors):
        gain, source = n, -1
        j = i - 1
        while j >= 0:
            d0, t0, n0 = anchors[j]
            if d - d0 > gap + longest:  # this anchor and all before it end too far off
                break
            if d0 < d and t0 < t and d - (d0 + n0) <= gap and d + n > d0 + n0 and t + n > t0 + n0:
                fresh = n - max(0, d0 + n0 - d, t0 + n0 - t)
                if fresh > 0 and best[j] + fresh > gain:
                    gain, source = best[j] + fresh, j
            j -= 1
        best.append(gain)
        previous.append(source)
    out, used = [], set()
    for i in sorted(range(len(anchors)), key=lambda k: (-best[k], anchors[k])):
        if i in used:
            continue
        k, whole = i, True
        trail = []
        while k >= 0:
            if k in used:
                whole = False
                break
            trail.append(k)
            k = previous[k]
        used.update(trail)
        covered = best[i] if whole else best[i] - best[k]
        out.append((anchors[trail[-1]][0], anchors[i][0] + anchors[i][2], covered, [anchors[t] for t in trail]))
    return out


class Scanner:
    """Templates and phrases, ready to scan sequences of word numbers."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], min_match: int, min_coverage: float, gap: int):
        texts = [words_of(text) for _, text in templates] + [p.split(" ") for p in phrases]
        self.labels = [label for label, _ in templates] + list(phrases.values())
        self.n_templates = len(templates)
        self.lengths = [len(t) for t in texts]
        vocabulary = sorted({w for t in texts for w in t})
        raw = [w.encode() for w in vocabulary]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        hashes = Words(np.frombuffer(b"".join(raw), np.uint8), offsets, _IS_WORD).hash
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        number = {w: i for i, w in enumerate(vocabulary)}
        self.automaton = Automaton([[number[w] for w in t] for t in texts])
        self.min_match, self.min_coverage, self.gap = min_match, min_coverage, gap
        self.telling = telling_words(texts[: self.n_templates], self.labels[: self.n_templates])
        self.least = min([min_match, *(n for n in self.lengths)])
        # the phrases that end wherever a state's strings do: those of the state itself and of its suffix links
        self.phrase_ends: list[list[int]] = [[] for _ in self.automaton.step]
        for state in sorted(range(1, len(self.automaton.step)), key=lambda x: self.automaton.longest[x]):
            link = self.automaton.link[state]
            own = {s for s, end in self.automaton.ends[state] if s >= self.n_templates and end == self.lengths[s] and self.automaton.longest[link] < end <= self.automaton.longest[state]}
            self.phrase_ends[state] = sorted({*self.phrase_ends[link], *own})

    def word_numbers(self, hashes: np.ndarray) -> np.ndarray:
        """For each word its number, or -1 for a word in no template."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1)

    def scan(self, runs: list[tuple[int, list[int]]]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """Phrase places and spans of one text, given its runs of known words as (place of the first, numbers)."""
        auto, places, anchors = self.automaton, [], {}
        for begin, words in runs:
            state = length = 0
            for i, word in enumerate(words):
                before, was = state, length
                state, length = auto.advance(state, length, word)
                if was >= self.min_match and length != was + 1:
                    self._anchor(anchors, before, was, begin + i)
                for s in self.phrase_ends[state]:
                    if self.lengths[s] <= length:
                        places.append((begin + i + 1 - self.lengths[s], self.labels[s]))
            if length >= self.min_match:
                self._anchor(anchors, state, length, begin + len(words))
        found = []
        for template, own in anchors.items():
            for start, end, covered, trail in chains(own, self.gap):
                if covered >= self.min_coverage * self.lengths[template] and self._told(template, trail):
                    found.append((covered, covered / self.lengths[template], start, end, self.labels[template]))
        spans: list[tuple[int, int, str, float]] = []
        taken: list[tuple[int, int]] = []  # in order, none overlapping another
        for _, share, start, end, label in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[4])):
            at = bisect_left(taken, (end, 0))  # the spans before this place begin before the end
            if not at or taken[at - 1][1] <= start:
                taken.insert(at, (start, end))
                spans.append((start, end, label, share))
        return sorted(places), sorted(spans)

    def _told(self, template: int, trail: list[tuple[int, int, int]]) -> bool:
        """Whether a chain covers the words that tell its template from others."""
        words, together = self.telling[template]
        if not all(any(t <= w < t + n for _, t, n in trail) for w in words):
            return False
        # where another template has more words, this text has none: both neighbours are in one anchor, or not at all
        return all(any(t <= a and b < t + n for _, t, n in trail) for a, b in together)

    def _anchor(self, anchors: dict, state: int, length: int, end: int) -> None:
        for sequence, place in self.automaton.ends[state]:
            if sequence < self.n_templates:
                anchors.setdefault(sequence, []).append((end - length, place - length, length))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, gap: int = MAX_GAP) -> DataFrame:
    """One row per row of ``docs``: word count, phrase places and chained template spans, places in words from 0.

    A null or empty text has no words, places or spans. Where spans overlap, the one that covers more words stays, at
    a tie the one with the greater share of its template. Time is proportional to a text's length, but for the sorting
    of its anchors and spans. No shuffle; other columns of ``docs`` are not read.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases

    def make():
        scanner = Scanner(templates, phrases, min_match, min_coverage, gap)

        def work(batch, data, offsets):
            words = Words(lowered(data), offsets, _IS_WORD)
            number = scanner.word_numbers(words.hash)
            known = number >= 0
            # runs of known words inside one text
            edge = np.zeros(len(known) + 1, bool)
            edge[words.first] = True
            begin = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
            end = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
            long = end - begin >= scanner.least
            begin, end = begin[long], end[long]
            text_of = np.searchsorted(words.first, begin, "right") - 1
            n = len(offsets) - 1
            runs: dict[int, list] = {}
            for t, a, b in zip(text_of.tolist(), begin.tolist(), end.tolist(), strict=True):
                runs.setdefault(t, []).append((a - int(words.first[t]), number[a:b].tolist()))
            columns: dict = {"doc_id": batch.column(0), "n_words": np.diff(words.first)}
            empty: list = []
            made = {t: scanner.scan(r) for t, r in runs.items()}
            rows = [made.get(t, (empty, empty)) for t in range(n)]
            for k, name in enumerate(("phrase_start", "phrase_label")):
                columns[name] = [[p[k] for p in places] for places, _ in rows]
            for k, name in enumerate(("span_start", "span_end", "span_label", "span_coverage")):
                columns[name] = [[s[k] for s in spans] for _, spans in rows]
            return columns

        return work

    return map_slices(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), "text", SCAN, make)


def license_digest(scan: DataFrame) -> DataFrame:
    """The columns of the registered query from the rows of :func:`license_scan`."""
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.when(F.size("phrase_start") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("span_coverage"), F.lit(0.0)))
    return scan.select(
        "doc_id",
        "n_words",
        F.size("phrase_start").cast("bigint").alias("n_base"),
        F.array_min("phrase_start").alias("first_word"),
        F.array_max("phrase_start").alias("last_word"),
        joined(F.col("phrase_label")).alias("base_labels"),
        joined(F.concat("phrase_label", "span_label")).alias("labels"),
        F.least(best, F.lit(1.0)).alias("score"),
        F.size("span_label").cast("bigint").alias("n_spans"),
    )
