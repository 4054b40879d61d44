"""License texts in files: matching statistics against a generalised suffix automaton, chained into spans.

The automaton holds the tokens of all templates. A file is streamed through it once; at every token
the state tells the longest run of tokens, ending there, that stands in some template, and its links the shorter
runs that stand in others. Long runs that do not extend in their template are matches, and matches that follow one
another in a template and in the file are chained. The tokens of a template that its best chain covers give its score.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from veritab.llm.common import LOWER_ASCII, per_row

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases of the base rule and their labels: fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public license notices by label.
TEMPLATES = {
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ],
    "gpl-2.0": [
        "the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "gpl-3.0": [
        "the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "lgpl": [
        "the GNU Lesser General Public License",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
        "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "cc-by": ["Licensed under CC BY 4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0"],
    "cc0": ["Licensed under CC0 1.0"],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial "
        "or non-commercial, and by any means.",
    ],
}

#: Shortest match in tokens, longest distance between chained matches, least share of a template to name it.
LEAST, GAP, COVERED = 4, 12, 0.8


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER_ASCII))


@dataclass
class Automaton:
    """Suffix automaton of several token sequences; a state knows where in the templates its strings end."""

    vocabulary: dict[str, int]
    labels: list[str]
    sizes: list[int]
    tokens: list[list[int]] = field(default_factory=list)  # of each template
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    @classmethod
    def of(cls, templates: dict[str, list[str]]) -> Automaton:
        named = [(label, words_of(text)) for label, texts in templates.items() for text in texts]
        vocabulary: dict[str, int] = {}
        for _, words in named:
            for w in words:
                vocabulary.setdefault(w, len(vocabulary))
        out = cls(vocabulary, [label for label, _ in named], [len(words) for _, words in named],
                  [[vocabulary[w] for w in words] for _, words in named])
        own: list[list[tuple[int, int]]] = [[]]
        for t, (_, words) in enumerate(named):
            last = 0
            for at, w in enumerate(words):
                last = out._extend(last, vocabulary[w])
                while len(own) < len(out.step):
                    own.append([])
                own[last].append((t, at))
        # Ends of a state are those of all states that link to it.
        out.ends = own
        for s in sorted(range(1, len(out.step)), key=lambda s: -out.length[s]):
            out.ends[out.link[s]].extend(out.ends[s])
        out.ends = [sorted(set(e)) for e in out.ends]
        return out

    def _extend(self, last: int, token: int) -> int:
        """The state of the string of ``last`` followed by the token; made if there is none."""
        known = self.step[last].get(token)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, token, known)
        new = self._state({}, self.length[last] + 1)
        at = last
        while at >= 0 and token not in self.step[at]:
            self.step[at][token] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            known = self.step[at][token]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._split(at, token, known)
        return new

    def _split(self, at: int, token: int, known: int) -> int:
        """A copy of ``known`` for its strings that are no longer than ``at`` allows."""
        copy = self._state(dict(self.step[known]), self.length[at] + 1)
        self.link[copy], self.link[known] = self.link[known], copy
        while at >= 0 and self.step[at].get(token) == known:
            self.step[at][token] = copy
            at = self.link[at]
        return copy

    def _state(self, step: dict[int, int], length: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(0)
        return len(self.step) - 1

    def statistics(self, words: list[str]):
        """(position, length, state) of the longest match that ends at each token of some match."""
        find = self.vocabulary.get
        step, link, length = self.step, self.link, self.length
        state = size = 0
        previous = -1
        for at, token in [(i, t) for i, t in enumerate(map(find, words)) if t is not None]:
            if at != previous + 1:
                state = size = 0
            previous = at
            while state and token not in step[state]:
                state = link[state]
                size = length[state]
            to = step[state].get(token)
            if to is not None:
                state = to
                size += 1
                yield at, size, state

    def matches(self, words: list[str], least: int = LEAST) -> list[tuple[int, int, int, int]]:
        """(start, length, template, first token there) of the matches with each template that extend neither way,
        ``least`` tokens or longer, or the whole of a shorter template."""
        out: list[tuple[int, int, int, int]] = []
        least_of = [min(least, n) for n in self.sizes]
        floor = min((n for n in least_of if n), default=least)
        for at, size, state in self.statistics(words):
            if size < floor:
                continue
            follows = self.vocabulary.get(words[at + 1]) if at + 1 < len(words) else None
            longer: set[tuple[int, int]] = set()  # ends of longer runs
            while state and size >= floor:
                for t, end in self.ends[state]:
                    if (t, end) not in longer and size >= least_of[t] and (
                            follows is None or end + 1 == self.sizes[t] or self.tokens[t][end + 1] != follows):
                        out.append((at - size + 1, size, t, end - size + 1))
                longer.update(self.ends[state])
                state = self.link[state]
                size = self.length[state]
        return out


@dataclass
class Span:
    label: str
    start: int  # first word in the file
    end: int  # word after the last
    covered: float  # share of the template
    words: int  # of the template that are covered


def chains(automaton: Automaton, words: list[str], least: int = LEAST, gap: int = GAP) -> list[Span]:
    """For each template its chains of matches in the file, each ended by a long gap or a step back in the template.

    Templates shorter than ``least`` count as matches when they stand whole.
    """
    by_template: dict[int, list[tuple[int, int, int]]] = {}
    for start, size, t, at in automaton.matches(words, least):
        by_template.setdefault(t, []).append((start, at, size))
    out: list[Span] = []
    for t, found in sorted(by_template.items()):
        # Best chain to each match: tokens covered, then where it starts.
        best: list[tuple[int, int, int]] = []  # covered, first word, end in file
        found.sort()
        starts = [s for s, _, _ in found]
        used = set()
        for i, (s, at, size) in enumerate(found):
            top, link = (size, s, s + size), -1
            lo = bisect_right(starts, s - gap - automaton.sizes[t])
            for j in range(lo, i):
                s2, at2, size2 = found[j]
                shared = max(0, s2 + size2 - s, at2 + size2 - at)
                if s2 < s and at2 < at and shared < size and s - (s2 + size2) <= gap and best[j][0] + size - shared > top[0]:
                    top, link = (best[j][0] + size - shared, best[j][1], s + size), j
            best.append(top)
            used.add(link)
        out += [Span(automaton.labels[t], first, end, min(1.0, covered / automaton.sizes[t]), covered)
                for i, (covered, first, end) in enumerate(best) if i not in used]
    return out


def told(found: list[Span], covered: float) -> list[Span]:
    """Chains that cover ``covered`` of their template. One with words missing does not count inside one of more words:
    the notice of version 3 is not that of version 2 with an error."""
    enough = [s for s in found if s.covered >= covered]
    return [s for s in enough if s.covered == 1 or not any(
        o.words > s.words and o.start <= s.start and s.end <= o.end for o in enough)]


def base_places(words: list[str], phrases: dict[tuple[str, ...], str]) -> list[tuple[int, str]]:
    """(start, label) of every place of every phrase."""
    lasts: dict[str, list[tuple[tuple[str, ...], str]]] = {}
    for p, label in phrases.items():
        lasts.setdefault(p[-1], []).append((p, label))
    out = []
    for last, ending in lasts.items():
        at = -1
        for _ in range(words.count(last)):
            at = words.index(last, at + 1)
            for p, label in ending:
                start = at - len(p) + 1
                if start >= 0 and tuple(words[start:at + 1]) == p:
                    out.append((start, label))
    return sorted(out)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None,
         covered: float = COVERED) -> DataFrame:
    """Base places, labels, score and spans for each row of ``docs``.

    ``spans`` lists label:first word:word after the last of every chain that covers ``covered`` of its template, but
    for incomplete ones inside a chain of more words; their labels join those of the base. ``score`` is the best share of a template, over all chains.
    Null and empty texts have no words, no labels and score 0. Rows are scanned one by one, so repeated rows get equal
    results; an empty table gives no rows. Columns other than doc_id and text are not read.
    """
    automaton = Automaton.of(TEMPLATES if templates is None else templates)
    known = {tuple(words_of(p)): label for p, label in (PHRASES if phrases is None else phrases).items()}
    sent = docs.sparkSession.sparkContext.broadcast((automaton, known))

    def one(doc_id, text):
        machine, phrases_ = sent.value
        words = words_of(text)
        places = base_places(words, phrases_)
        found = chains(machine, words)
        named = told(found, covered)
        base = {label for _, label in places}
        return (doc_id, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
                ",".join(sorted(base)), ",".join(sorted(base | {s.label for s in named})),
                max((s.covered for s in found), default=0.0),
                ",".join(f"{s.label}:{s.start}:{s.end}" for s in sorted(named, key=lambda s: (s.start, s.end, s.label))))

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, " \
             "score double, spans string"
    return per_row(docs.selectExpr("cast(doc_id as long) doc_id", "text"), one, schema, "doc_id", "text")
