"""Licence scans: matching statistics against a generalised suffix automaton of licence texts, chained into spans.

The automaton holds every run of words of every template. A document streams through it: at each word the automaton knows
the longest run ending there that some template contains. Runs that cannot be extended are matches; those of one template
that follow each other in both texts, with small gaps, are chained, and a chain that covers enough of its template is a
span with that template's label. The base phrases are templates as well: a state knows which phrases end in it.

The automaton is made of fixed texts, so its size does not depend on the input. The scan is narrow: no shuffle.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from docledger.llm.decontaminate import words_of
from docledger.llm.shared import prepare

# Phrases that always count, with their labels.
PHRASES = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]

# Wording of well-known public licences and of the notices that refer to them.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
]

# Shortest run of words that is a match, largest gap within a chain, and share of a template that a span covers.
LEAST_MATCH = 3
MOST_GAP = 8
LEAST_COVER = 0.75

_FOUND = (
    "struct<n_words: long, n_base: long, first_word: long, last_word: long, base_labels: array<string>, "
    "spans: array<struct<start: long, stop: long, label: string, cover: double>>>"
)


@dataclass
class Span:
    """Words [start, stop) of a document that follow a template, and the share of the template that they cover."""

    start: int
    stop: int
    label: str
    cover: float


class Automaton:
    """Generalised suffix automaton of templates, with the places where each state's runs end."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]]) -> None:
        self.labels = [label for label, _ in [*templates, *phrases]]
        texts = [words_of(text) for _, text in [*templates, *phrases]]
        self.sizes = [len(t) for t in texts]
        self.number = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for which, words in enumerate(texts):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, self.number[word])
                self.ends[last].append((which, at + 1))
        # A run ends wherever the longer runs that it ends do: hand the places down the suffix links, longest first.
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] = sorted({*self.ends[self.link[state]], *self.ends[state]})
        # Phrases (number, words) that end in a state, its own and those of shorter runs.
        own: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for i in range(len(templates), len(texts)):
            state = 0
            for word in texts[i]:
                state = self.step[state][self.number[word]]
            own[state].append((i, self.sizes[i]))
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for state in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            self.phrases[state] = own[state] + self.phrases[self.link[state]]

    def _extend(self, last: int, word: int) -> int:
        """The state of the text read so far, with ``word`` added to that of ``last``."""
        if word in self.step[last]:
            following = self.step[last][word]
            return following if self.length[following] == self.length[last] + 1 else self._split(last, word, following)
        new = self._state({}, self.length[last] + 1, 0)
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            following = self.step[at][word]
            self.link[new] = following if self.length[following] == self.length[at] + 1 else self._split(at, word, following)
        return new

    def _state(self, step: dict[int, int], length: int, link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, at: int, word: int, whole: int) -> int:
        """A state of its own for the shorter runs of ``whole``."""
        part = self._state(dict(self.step[whole]), self.length[at] + 1, self.link[whole])
        self.link[whole] = part
        while at >= 0 and self.step[at].get(word) == whole:
            self.step[at][word] = part
            at = self.link[at]
        return part

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[Span]]:
        """(places of base phrases as (start, phrase), spans in order of their start)."""
        number = self.number.get
        numbers = np.fromiter((number(w, 0) for w in words), np.int32, len(words))
        known = np.flatnonzero(numbers)
        base: list[tuple[int, int]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        # Words of no template end every run, so only neighbours among the known words are read.
        cut = np.flatnonzero(np.diff(known) > 1) + 1
        starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(known)]))
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            if b - a > 1:
                self._read(int(known[a]), numbers[known[a] : known[b - 1] + 1].tolist(), base, matches)
        spans = [span for which, found in matches.items() for span in self._chains(which, found)]
        return base, sorted(spans, key=lambda s: (s.start, s.stop, s.label))

    def _read(self, first: int, numbers: list[int], base: list[tuple[int, int]], matches: dict[int, list[tuple[int, int, int]]]) -> None:
        """Run the automaton over one stretch of known words that begins at ``first``."""
        step, link, length, phrases = self.step, self.link, self.length, self.phrases
        state = run = 0
        for i, word in enumerate(numbers):
            if run >= LEAST_MATCH and word not in step[state]:
                self._match(first + i, state, run, matches)
            while state and word not in step[state]:
                state = link[state]
                run = length[state]
            if word in step[state]:
                state = step[state][word]
                run += 1
            else:
                run = 0
            for which, size in phrases[state]:
                if size <= run:
                    base.append((first + i + 1 - size, which))
        if run >= LEAST_MATCH:
            self._match(first + len(numbers), state, run, matches)

    def _match(self, stop: int, state: int, run: int, matches: dict[int, list[tuple[int, int, int]]]) -> None:
        """Note a longest run: (stop in the document, stop in the template, words) for each place in the templates."""
        for which, end in self.ends[state]:
            matches.setdefault(which, []).append((stop, end, min(run, end)))

    def _chains(self, which: int, found: list[tuple[int, int, int]]) -> Iterator[Span]:
        """Matches of one template chained greedily in document order; chains that cover enough of it are spans."""
        size = self.sizes[which]
        open_chains: list[list[int]] = []  # start and stop in the document, stop in the template, words covered
        done: list[list[int]] = []
        for stop, end, run in sorted(found):
            best = None
            for chain in open_chains:
                fresh = min(run, stop - chain[1], end - chain[2])
                gap = max(stop - fresh - chain[1], end - fresh - chain[2])
                if fresh > 0 and gap <= MOST_GAP and (best is None or chain[3] + fresh > best[0][3] + best[1]):
                    best = chain, fresh
            if best:
                chain, fresh = best
                open_chains.append([chain[0], stop, end, chain[3] + fresh])
            open_chains.append([stop - run, stop, end, run])
            # A chain too far behind cannot grow any more.
            done += [c for c in open_chains if c[1] + size + MOST_GAP < stop]
            open_chains = [c for c in open_chains if c[1] + size + MOST_GAP >= stop]
        whole = sorted((c for c in done + open_chains if c[3] >= LEAST_COVER * size), key=lambda c: (-c[3], c[1] - c[0], c[0]))
        taken: list[tuple[int, int]] = []
        for start, stop, _, words in whole:
            at = bisect.bisect_left(taken, (start, stop))
            if (at == len(taken) or stop <= taken[at][0]) and (not at or start >= taken[at - 1][1]):
                taken.insert(at, (start, stop))
                yield Span(start, stop, self.labels[which], words / size)


_AUTOMATA: list[Automaton] = []


def automaton() -> Automaton:
    """The automaton of the fixed templates and phrases, built once by each worker."""
    if not _AUTOMATA:
        _AUTOMATA.append(Automaton(TEMPLATES, PHRASES))
    return _AUTOMATA[0]


def _scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    known = automaton()
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("cover", pa.float64())])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(span)]
    for batch in batches:
        columns: list[list] = [[] for _ in types]
        for text in batch.to_pylist():
            words = words_of(text)
            base, spans = known.scan(words)
            starts = [at for at, _ in base]
            row = (len(words), len(base), min(starts, default=None), max(starts, default=None), sorted({known.labels[i] for _, i in base}), [vars(s) for s in spans])
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["n_words", "n_base", "first_word", "last_word", "base_labels", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels (array) and spans; columns of these names are replaced.

    All places of the base phrases count, overlapping ones too. A null or empty text has no words, places or spans.
    """
    prepare(docs.sparkSession)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "spans"]
    return docs.withColumn("__found", arrow_udf(_scan, _FOUND)("text")).withColumns({k: F.col(f"__found.{k}") for k in names}).drop("__found")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document; the score is the best cover of a template, 1 for a base phrase."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("spans", lambda s: s["label"]))))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
