"""License scan with a generalised suffix automaton over the words of license templates.

A text is streamed through the automaton, which gives its matching statistics: for every word the longest run ending there
that stands in some template.  Long runs are chained, in the order of both text and template, into covered template
spans; a template is found where its best chain covers enough of it.  Base phrases are templates too: all places
where they stand are read off the automaton.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresmith.llm.bytesweep import LOWER, WORD_BYTES, chunks, word_hashes
from loresmith.llm.common import bounded_batches, text_of

#: Phrases and labels of the base scan.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Usual wordings of license notices, with the label that a covered span gives.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("gpl", "licensed under the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
LONG = 3  # words of a match that is chained
GAP = 8  # words of text, or of template, between two matches of a chain, at most
COVER = 0.75  # share of a template that its chain covers where it is found


def words_of(text: str) -> list[bytes]:
    data = LOWER[np.frombuffer(text.encode("utf-8"), np.uint8)]
    return np.where(WORD_BYTES[data], data, np.uint8(32)).tobytes().split()


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, sequences: Iterable[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (sequence, words up to the end) of a state's runs
        self.sequences = [list(s) for s in sequences]
        for number, sequence in enumerate(self.sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].append((number, at + 1))
        for state in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            self.ends[self.link[state]].extend(self.ends[state])
        self.ends[0] = []
        # The sequences that end wherever a state's run ends, by the run itself (if long enough) or by its suffixes.
        self.whole: list[list[int]] = [[] for _ in self.length]
        for state in sorted(range(1, len(self.length)), key=lambda v: self.length[v]):
            own = [n for n, at in self.ends[state] if at == len(self.sequences[n]) <= self.length[state]]
            self.whole[state] = own + self.whole[self.link[state]]

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            target = self.next[last][word]
            if self.length[target] == self.length[last] + 1:
                return target
            return self._split(last, word, target)
        state = self._add(self.length[last] + 1, {}, -1)
        while last != -1 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last == -1:
            self.link[state] = 0
        else:
            target = self.next[last][word]
            near = self.length[target] == self.length[last] + 1
            self.link[state] = target if near else self._split(last, word, target)
        return state

    def _add(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(dict(following))
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, last: int, word: int, target: int) -> int:
        copy = self._add(self.length[last] + 1, self.next[target], self.link[target])
        self.link[target] = copy
        while last != -1 and self.next[last].get(word) == target:
            self.next[last][word] = copy
            last = self.link[last]
        return copy

    def stream(self, words: Iterable[int]):
        """Matching statistics: (state, length of the longest run of a sequence that ends with each word)."""
        state, length = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            else:
                state, length = 0, 0
            yield state, length


class Scanner:
    """Templates compiled once per task."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]) -> None:
        whole = [words_of(t) for _, t in templates] + [words_of(p) for p in phrases]
        self.labels = [label for label, _ in templates] + list(phrases.values())
        self.first_phrase = len(templates)
        known = sorted({w for s in whole for w in s})
        hashes, _ = word_hashes(np.frombuffer(b" ".join(known), np.uint8), np.array([0, len(b" ".join(known))]))
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order + 1
        number = {w: i + 1 for i, w in enumerate(known)}
        self.sequences = [[number[w] for w in s] for s in whole]
        self.automaton = Automaton(self.sequences)
        self.pairs = np.zeros((len(known) + 1, len(known) + 1), bool)
        for s in self.sequences:
            self.pairs[s[:-1], s[1:]] = True
        self.single = np.zeros(len(known) + 1, bool)
        self.single[[s[0] for s in self.sequences if len(s) == 1]] = True

    def known_numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the templates; 0 for all other words."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], 0)

    def runs(self, numbers: np.ndarray) -> Iterable[tuple[int, int]]:
        """Stretches in which all neighbours are neighbours in a template too, and words that are a sequence alone.

        No match of two words, and none of a whole sequence, lies outside.
        """
        good = np.zeros(len(numbers) + 1, bool)
        if len(numbers) > 1:
            good[1:-1] = self.pairs[numbers[:-1], numbers[1:]]
        turns = np.flatnonzero(good[1:] != good[:-1])
        found = [(int(a), int(b) + 1) for a, b in zip(turns[::2], turns[1::2])]
        # A word by itself is a run of its own where no longer run holds it.
        alone = np.flatnonzero(self.single[numbers] & ~good[1:] & ~good[:-1])
        return sorted([*found, *((int(i), int(i) + 1) for i in alone)])

    def scan(self, numbers: np.ndarray) -> tuple[list[tuple[int, int]], list[float]]:
        """Places (start, template) of the base phrases, and for each template the largest covered share."""
        places: list[tuple[int, int]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        auto = self.automaton
        for a, b in self.runs(numbers):
            before = (0, 0)
            for i, (state, length) in enumerate(auto.stream(numbers[a:b].tolist()), a):
                for n in auto.whole[state]:
                    if n >= self.first_phrase and len(self.sequences[n]) <= length:
                        places.append((i + 1 - len(self.sequences[n]), n))
                if before[1] >= LONG and length != before[1] + 1:
                    self._record(matches, i, *before)
                before = (state, length)
            if before[1] >= LONG:
                self._record(matches, b, *before)
        covered = [0.0] * len(self.sequences)
        for n, found in matches.items():
            covered[n] = self._chain(found) / len(self.sequences[n])
        for _, n in places:
            covered[n] = 1.0
        return places, covered

    def _record(self, matches: dict, end: int, state: int, length: int) -> None:
        for n, at in self.automaton.ends[state]:
            matches.setdefault(n, []).append((end, at, length))

    @staticmethod
    def _chain(found: list[tuple[int, int, int]]) -> int:
        """Most words of the template covered by matches (text end, template end, length) in order and with small gaps."""
        found.sort()
        ends = [e for e, _, _ in found]
        best: list[int] = []
        for i, (end, at, length) in enumerate(found):
            value = length
            # Only matches that end shortly before, or inside, this one can precede it.
            for j in range(bisect_left(ends, end - length - GAP), i):
                e, t, _ = found[j]
                if e < end and t < at and at - length - t <= GAP:
                    value = max(value, best[j] + min(length, end - e, at - t))
            best.append(value)
        return max(best, default=0)


def scan_licenses(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None,
    cover: float = COVER, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """License findings of every row of ``docs``: doc id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A-Z are lower-cased; words are runs of digits, letters and anything beyond ASCII.  ``n_base`` counts all places of all base
    phrases; ``first_word`` and ``last_word`` are the smallest and largest start of one, from 0, else null.  ``labels``
    adds those of templates covered by ``cover`` or more; labels are distinct, sorted and joined by commas, '' if
    none.  ``score`` is the largest covered share of any template or phrase.  A null text is empty: no words, score 0.
    Repeated rows give repeated results; other columns are not read; empty input gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    given = list(TEMPLATES if templates is None else templates), dict(BASE_PHRASES if phrases is None else phrases)
    kinds = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long",
             "base_labels": "string", "labels": "string", "score": "double"}
    schema = T.StructType([
        T.StructField(k, {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType()}[v]) for k, v in kinds.items()])
    compiled: list[Scanner] = []

    @F.arrow_udf(schema)
    def find(texts: pa.Array) -> pa.Array:
        if not compiled:
            compiled.append(Scanner(*given))
        scanner, out = compiled[0], {k: [] for k in kinds}
        for _, data, bounds in chunks(texts):
            hashes, firsts = word_hashes(LOWER[data], bounds)
            numbers = scanner.known_numbers(hashes)
            for a, b in zip(firsts[:-1], firsts[1:]):
                places, covered = scanner.scan(numbers[a:b])
                base = {scanner.labels[n] for _, n in places}
                more = {scanner.labels[n] for n, c in enumerate(covered) if c >= cover}
                starts = [s for s, _ in places]
                for key, value in zip(kinds, (
                    int(b - a), len(places), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(base)), ",".join(sorted(base | more)), max(covered, default=0.0))):
                    out[key].append(value)
        types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        return pa.StructArray.from_arrays([pa.array(out[k], types[v]) for k, v in kinds.items()], names=list(kinds))

    rows = docs.select(F.col(doc_id).alias("id"), find(text_of(docs, text)).alias("found"))
    return rows.select(F.col("id").alias(doc_id), "found.*")
