"""Licence scans with a generalised suffix automaton over words.

Words are runs of ASCII letters and digits and of all characters beyond ASCII;
A-Z count as a-z. One automaton holds all templates and base phrases. A text is
streamed through it once: at every word the automaton knows the longest string
of words ending there that stands in some template (the matching statistics),
and where in the templates it stands. Maximal matches of at least ``LEAST_MATCH`` words are
chained in order, over gaps of at most ``GAP`` words, into spans of a template; a
template whose span covers ``COVERED`` of its words labels the text. Templates of fewer than
``SHORT`` words are full of everyday phrases: the words that only their label has must be
among those covered, or all words if there are none.

Only stretches in which all pairs of neighbouring words occur in some template
are streamed, as no match of two words can stand elsewhere; the rest of the words
is passed over in numpy.

Defined cases: a null text is empty; texts without matches have empty labels,
null places and score 0; an empty table gives an empty result; input columns
named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termwell.llm.common import hash_sums, read_table, span_hashes, word_spans
from termwell.llm.registry import query

LEAST_MATCH = 3
GAP = 8
COVERED = 0.6
SHORT = 20
MOST_TEMPLATE_WORDS = 2_000_000
HALF_SCORE_WORDS = 4.0

# Base phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Public licence notices by label.
TEMPLATES = {
    "mit-notice": ["Released under the MIT License", "Licensed under the MIT License",
                   "This project is licensed under the MIT License"],
    "mit": ["""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
            """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
        OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0",
                   """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""],
    "bsd": ["""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
            """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
        OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""],
    "bsd-3-clause": ["""Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission."""],
    "zlib": ["""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated
        but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being
        the original software. This notice may not be removed or altered from any source distribution."""],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0",
                """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
        and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
        Software is furnished to do so, all subject to the following:"""],
    "isc": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""],
    "gpl-notice": ["This work is licensed under the GNU General Public License, version 3",
                   """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version.""",
                   """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details."""],
    "lgpl-notice": ["""This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
        option) any later version.""", "Licensed under the GNU Lesser General Public License"],
    "agpl-notice": ["""This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.""", "Licensed under the GNU Affero General Public License"],
    "epl-2.0": ["""This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
        which is available at https://www.eclipse.org/legal/epl-2.0""", "Licensed under the Eclipse Public License"],
    "eupl-1.2": ["Licensed under the European Union Public Licence"],
    "artistic-2.0": ["""This library is free software; you may redistribute it and/or modify it under the terms of the Artistic
        License 2.0""", "Licensed under the Artistic License 2.0"],
    "ofl-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1"],
    "wtfpl": ["Do What The Fuck You Want To Public License"],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
                "Licensed under CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"],
    "mpl-2.0": ["""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0",
                 "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0",
                 "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0",
                 "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words of a text."""
    data = _FOLD[np.frombuffer((text or "").encode(), np.uint8)]
    return span_hashes(hash_sums(data), *word_spans(data, _WORD))


class Automaton:
    """Generalised suffix automaton: every path from the root spells a run of words of some sequence.

    State ``s`` stands for strings of ``len(link(s)) < n <= len(s)`` words that end at the same
    places; ``ends[s]`` holds those places as (sequence, words up to there).
    """

    def __init__(self, sequences: list[list[int]]):
        self.length, self.link, self.step = [0], [-1], [{}]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            state = 0
            for place, word in enumerate(sequence, 1):
                state = self._extended(state, word)
                self.ends[state].append((number, place))
        # A string ends wherever a longer string with it as suffix ends.
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]].extend(self.ends[state])
        self.ends = [sorted(set(places)) for places in self.ends]

    def _state(self, length: int, link: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, state: int, word: int, old: int) -> int:
        """Part the strings that ``state`` and its suffixes reach from the longer ones of ``old``."""
        new = self._state(self.length[state] + 1, self.link[old], dict(self.step[old]))
        self.link[old] = new
        while state >= 0 and self.step[state].get(word) == old:
            self.step[state][word] = new
            state = self.link[state]
        return new

    def _extended(self, state: int, word: int) -> int:
        old = self.step[state].get(word)
        if old is not None:
            return old if self.length[old] == self.length[state] + 1 else self._split(state, word, old)
        new = self._state(self.length[state] + 1, 0, {})
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state >= 0:
            old = self.step[state][word]
            self.link[new] = old if self.length[old] == self.length[state] + 1 else self._split(state, word, old)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """For each word the state and length of the longest match that ends with it."""
        state, size = 0, 0
        for word in words:
            while state and word not in self.step[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.step[state]:
                state, size = self.step[state][word], size + 1
            yield state, size


class Scanner:
    """Templates and phrases ready to be looked for."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]):
        self.labels = [*phrases.values()] + [label for label, texts in templates.items() for _ in texts]
        self.phrases = len(phrases)
        sequences = [words_of(text) for text in [*phrases, *(text for texts in templates.values() for text in texts)]]
        self.sizes = [len(s) for s in sequences]
        self.words = np.unique(np.concatenate(sequences))
        numbered = [np.searchsorted(self.words, s).tolist() for s in sequences]
        holders: dict[int, set[str]] = {}
        for label, sequence in zip(self.labels, numbered, strict=True):
            for word in sequence:
                holders.setdefault(word, set()).add(label)
        # Per short template the places that must be covered.
        self.telling = [{k for k, word in enumerate(s) if len(holders[word]) == 1} or set(range(len(s)))
                        if len(s) < SHORT else set() for s in numbered]
        pairs = [(a * len(self.words) + b) for s in numbered for a, b in zip(s, s[1:], strict=False)]
        self.pairs = np.unique(np.array(pairs, np.int64))
        self.automaton = Automaton(numbered)

    def stretches(self, words: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(first word, word numbers) of the maximal stretches whose neighbouring words are pairs of some template."""
        if len(words) < 2:
            return
        number = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        known = self.words[number] == words
        both = np.flatnonzero(known[:-1] & known[1:])
        code = number[both] * len(self.words) + number[both + 1]
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        both = both[self.pairs[at] == code]
        if not len(both):
            return
        cuts = np.flatnonzero(np.diff(both) != 1)
        for low, high in zip(both[np.r_[0, cuts + 1]].tolist(), both[np.r_[cuts, len(both) - 1]].tolist(), strict=True):
            yield low, number[low:high + 2].tolist()

    def scan(self, text: str | None) -> dict:
        """Places of base phrases, spans of templates, labels and score of a text."""
        words = words_of(text)
        base: list[tuple[int, int]] = []  # (first word, phrase)
        matches: list[tuple[int, int, int]] = []  # (first word, size, state), maximal to both sides
        for first, numbers in self.stretches(words):
            found = list(self.automaton.statistics(numbers))
            for k, (state, size) in enumerate(found):
                up, longest = state, size
                while longest > 1:  # all suffixes of the match, from state to state
                    shorter = self.automaton.length[self.automaton.link[up]]
                    for number, place in self.automaton.ends[up]:
                        if number >= self.phrases:
                            break
                        if place == self.sizes[number] and shorter < place <= longest:
                            base.append((first + k + 1 - place, number))
                    up, longest = self.automaton.link[up], shorter
                if size >= LEAST_MATCH and (k + 1 == len(found) or found[k + 1][1] <= size):
                    matches.append((first + k + 1 - size, size, state))
        base = sorted(set(base))
        spans = self._spans(matches)
        base_labels = {self.labels[number] for _, number in base}
        covered = {w for start, number in base for w in range(start, start + self.sizes[number])}
        for start, end, _, _ in spans:
            covered.update(range(start, end))
        return {"n_words": len(words), "n_base": len(base), "first_word": base[0][0] if base else None,
                "last_word": base[-1][0] if base else None, "base_labels": ",".join(sorted(base_labels)),
                "labels": ",".join(sorted(base_labels | {label for _, _, label, _ in spans})),
                "score": 1.0 - 2.0 ** (-len(covered) / HALF_SCORE_WORDS),
                "spans": [{"label": label, "first_word": start, "last_word": end - 1, "covered": share}
                          for start, end, label, share in spans]}

    def _spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """Chain matches per template, in the order of the text; keep chains that cover enough of it."""
        open_: dict[int, list] = {}  # template: first word, end, end in the template, words covered, places covered
        spans = []

        def close(number: int) -> None:
            start, end, _, covered, met = open_.pop(number)
            if covered >= COVERED * self.sizes[number] and self.telling[number] <= met:
                spans.append((start, end, self.labels[number], covered / self.sizes[number]))

        for first, size, state in matches:
            places: dict[int, list[int]] = {}
            for number, place in self.automaton.ends[state]:
                if number >= self.phrases:
                    places.setdefault(number, []).append(place - size)
            for number, starts in places.items():
                if number in open_:
                    start, end, upto, covered, met = open_[number]
                    skip = max(0, end - first)  # maximal matches may overlap in the text
                    onward = [s for s in starts if 0 <= s + skip - upto <= GAP]
                    if first - end <= GAP and onward and size > skip:
                        best = min(onward)
                        open_[number] = [start, first + size, best + size, covered + size - skip,
                                         met.union(range(best, best + size))]
                        continue
                    if size <= covered and first + size <= end:
                        continue
                    close(number)
                open_[number] = [first, first + size, min(starts) + size, size, set(range(min(starts), min(starts) + size))]
        for number in list(open_):
            close(number)
        return sorted(spans)


@cache
def scanner() -> Scanner:
    """The production scanner, built once per process from the constants above."""
    return Scanner(PHRASES, TEMPLATES)


SCAN_TYPE = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()), T.StructField("covered", T.DoubleType())])))])
_ARROW_SCAN = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                                  ("covered", pa.float64())])))])


def _scanned(texts: pa.Array) -> pa.Array:
    return pa.array([scanner().scan(text) for text in texts.to_pylist()], _ARROW_SCAN)


def scanner_of(templates: DataFrame) -> Scanner:
    """A scanner of the base phrases and a table ``(label, template)`` of at most ``MOST_TEMPLATE_WORDS`` words."""
    rows = templates.select("label", "template").filter("label IS NOT NULL AND template IS NOT NULL").distinct()
    words = rows.agg(F.sum(F.size(F.split("template", r"\s+")))).first()[0] or 0
    if words > MOST_TEMPLATE_WORDS:
        raise ValueError(f"{words} words of templates are more than an executor should hold")
    by_label: dict[str, list[str]] = {}
    for label, template in sorted(map(tuple, rows.collect())):
        if len(words_of(template)):
            by_label.setdefault(label, []).append(template)
    return Scanner(PHRASES, by_label)


def with_licences(docs: DataFrame, text: str = "text", templates: DataFrame | None = None) -> DataFrame:
    """The rows with the fields of ``SCAN_TYPE``, ``spans`` with their words included.

    ``templates(label, template)`` replaces the public notices above.
    """
    scan = _scanned
    if templates is not None:
        shared = docs.sparkSession.sparkContext.broadcast(scanner_of(templates))

        def scan(texts: pa.Array) -> pa.Array:
            return pa.array([shared.value.scan(value) for value in texts.to_pylist()], _ARROW_SCAN)

    found = docs.drop(*SCAN_TYPE.fieldNames()).withColumn("_licences", F.arrow_udf(scan, SCAN_TYPE)(F.col(text)))
    return found.select("*", "_licences.*").drop("_licences")


def plain_places(text: str | None, phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """Base places by direct comparison of words; the measure in tests."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return sorted((k, label) for phrase, label in phrases.items() for k in range(len(words))
                  if words[k:k + len(phrase.split())] == phrase.split())


@query("op2_licences")
def op2_licences(spark, sf_dir):
    """Licence phrases, labels and score of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_licences(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
