"""Licence scan: matching statistics against a generalised suffix automaton, then chaining.

The automaton holds the words of all licence templates.  A text is streamed
through it; at each word the automaton knows the longest run of words that ends
there and stands in some template.  Runs that cannot grow are cut out as matches,
matches of one template that follow each other within ``GAP`` words are chained in
order to spans, and the share of the template's words that the best span covers is
its score: scraps strewn over a long text make no span.  Words that no template has reset the
automaton, so stretches of them are skipped at once.

Words are runs of a-z, 0-9 and characters beyond ASCII after A-Z are lower-cased.
A base phrase is counted at every place where its words stand consecutively; a
template's label is given when its chain covers at least ``COVER`` of it.

Defined results: null and empty texts have no words, no labels and score 0;
first_word and last_word are null where no base phrase stands; repeated rows and
null ids are scanned like others, texts of any length are streamed whole; an empty
table gives no rows.  Only doc_id and
text are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfwise.llm.tables import Batches, as_bytes

# Phrases that must be found wherever they stand, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Public licence notices, in lower case and without punctuation.
TEMPLATES = {
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and
        associated documentation files the software to deal in the software without restriction including without
        limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the
        software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the software""",
    "apache-2": """licensed under the apache license version 2 0 the license you may not use this file except in
        compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
        unless required by applicable law or agreed to in writing software distributed under the license is
        distributed on an as is basis without warranties or conditions of any kind either express or implied see the
        license for the specific language governing permissions and limitations under the license""",
    "bsd": """redistribution and use in source and binary forms with or without modification are permitted provided
        that the following conditions are met redistributions of source code must retain the above copyright notice
        this list of conditions and the following disclaimer redistributions in binary form must reproduce the above
        copyright notice this list of conditions and the following disclaimer in the documentation and or other
        materials provided with the distribution""",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee is
        hereby granted provided that the above copyright notice and this permission notice appear in all copies""",
    "gpl": """this program is free software you can redistribute it and or modify it under the terms of the gnu
        general public license as published by the free software foundation either version 2 of the license or at
        your option any later version""",
    "mpl-2": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the
        mpl was not distributed with this file you can obtain one at""",
    "cc-by-nc": """this work is licensed under the creative commons attribution noncommercial 4 0 international
        license to view a copy of this license visit""",
}
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COVER = 0.5
LONG = 4  # words of the shortest match that a chain uses
GAP = 64  # words of the text between two matches of one chain, at most


class Automaton:
    """Generalised suffix automaton of word sequences.

    ``next`` holds the moves of each state, ``link`` its longest shorter suffix
    that other continuations share, ``length`` its longest run of words, and
    ``where`` a (sequence, end) at which that run stands.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.where = [(-1, -1)]

    def _state(self, moves: dict, link: int, length: int, where: tuple) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.where.append(where)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word) -> int:
        """A copy of ``q`` whose longest run is one word more than that of ``p``."""
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.where[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list, sequence: int = 0) -> None:
        last = 0
        for end, word in enumerate(words):
            p, q = last, self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
                continue
            last = self._state({}, 0, self.length[p] + 1, (sequence, end))
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)

    def step(self, state: int, matched: int, word) -> tuple[int, int]:
        """State and length of the longest known run after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        found = self.next[state].get(word)
        return (0, 0) if found is None else (found, matched + 1)


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str], cover: float = COVER, long: int = LONG, gap: int = GAP):
        self.names = list(templates)
        self.texts = [templates[n].encode().split() for n in self.names]
        self.phrases = [(tuple(p.encode().split()), label) for p, label in phrases.items()]
        self.cover, self.long, self.gap = cover, long, gap
        self.automaton = Automaton()
        for i, words in enumerate([*self.texts, *[list(p) for p, _ in self.phrases]]):
            self.automaton.add(words, i)
        self.vocabulary = {w for words in self.texts for w in words} | {w for p, _ in self.phrases for w in p}
        self.shortest = min(len(p) for p, _ in self.phrases)

    def _runs(self, words: list[bytes]):
        """Stretches of template words, long enough to hold a phrase."""
        known = np.fromiter(map(self.vocabulary.__contains__, words), bool, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= self.shortest:
                yield a, b

    def matches(self, words: list[bytes]):
        """(start, end, template, end in template) of every run that cannot grow; phrase places."""
        found, places = [], []
        for a, b in self._runs(words):
            state = matched = 0
            for i in range(a, b):
                before = (matched, state, i)
                state, matched = self.automaton.step(state, matched, words[i])
                if matched <= before[0] and before[0] >= self.long:
                    found.append(before)
                if matched >= self.shortest:
                    for phrase, label in self.phrases:
                        start = i + 1 - len(phrase)
                        if matched >= len(phrase) and tuple(words[start : i + 1]) == phrase:
                            places.append((start, label))
            if matched >= self.long:
                found.append((matched, state, b))
        return found, places

    def chains(self, words: list[bytes], found: list) -> list[float]:
        """For each template, the share of its words that the best span covers: matches in order, near each other."""
        shares = []
        for template in self.texts:
            spots = {}
            for n, _, end in found:
                # A state knows one place of its run; the run itself is looked up in this template.
                run = words[end - n : end]
                for k in range(len(template) - n + 1):
                    if template[k : k + n] == run:
                        spots[end - n, k] = n
            # (end, end in the template, words covered) of the chains that may go on.
            near: list[tuple[int, int, int]] = []
            most = 0
            for (at, k), n in sorted(spots.items()):
                near = [c for c in near if c[0] >= at - self.gap]
                score = n + max((c[2] for c in near if c[0] <= at and c[1] <= k), default=0)
                near.append((at + n, k + n, score))
                most = max(most, score)
            shares.append(most / max(len(template), 1))
        return shares

    def scan(self, text: bytes) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a whole text."""
        words = WORD.findall(text.lower())
        found, places = self.matches(words)
        base = sorted({label for _, label in places})
        labels, score = set(base), 1.0 if base else 0.0
        if found:
            shares = self.chains(words, found)
            labels |= {n for n, s in zip(self.names, shares, strict=True) if s >= self.cover}
            score = max(score, *shares)
        starts = [s for s, _ in places]
        first, last = (min(starts), max(starts)) if starts else (None, None)
        return len(words), len(places), first, last, ",".join(base), ",".join(sorted(labels)), score


def scan(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    cover: float = COVER,
    long: int = LONG,
    gap: int = GAP,
) -> DataFrame:
    """One row per document: words, base phrases, labels, score.  Nothing is shuffled.

    The templates are configuration: their automaton is built once and sent to the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates, phrases, cover, long, gap))
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def kernel(batches: Batches) -> Batches:
        scanner = shared.value
        for batch in batches:
            rows = [scanner.scan(t) for t in as_bytes(batch.column(1))]
            columns = [batch.column(0).cast(pa.int64())]
            columns += [pa.array([r[i] for r in rows], t) for i, t in enumerate(types[1:])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", "text").mapInArrow(kernel, schema)
