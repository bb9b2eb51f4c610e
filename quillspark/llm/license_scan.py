"""Licence notices by an exact set-similarity join of text blocks and templates.

Words are ordered by how many times they stand in the whole corpus, rarest
first. A template is contained in a block when the block holds at least
``threshold`` of the template's distinct words. By the prefix filter such a block holds one
of the template's rarest words; the length and positional filters drop blocks
that cannot reach the count any more; what is left is counted exactly.

A block is a window of twice the longest template's words, one every half
window, so that any span no longer than a template lies in one block as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import kernel

# Phrases whose words must stand consecutively.
PHRASES = {
    "mit": "mit license",
    "apache": "apache license",
    "gpl": "general public license",
}

# Notices in common use; a word set of at least the threshold makes a match.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-2.0": "this program is free software redistribute it under the terms of the gnu general public license version 2",
    "lgpl": "licensed under the gnu lesser general public license",
    "cc-by-nc-4.0": "licensed under cc by nc 4.0",
    "cc-by-4.0": "licensed under the creative commons attribution 4.0 international license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "proprietary": "all rights reserved",
}


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = kernel.words(data, np.array([0, len(data)]), kernel.ALNUM)
    return kernel.range_hash(kernel.prefix_sums(data, kernel.LOWERED), starts, ends)


@dataclass(frozen=True)
class Template:
    label: str
    words: np.ndarray
    threshold: float
    phrase: bool

    @property
    def need(self) -> int:
        return math.ceil(self.threshold * len(np.unique(self.words)) - 1e-9)


def templates(phrases: dict[str, str], notices: dict[str, str], threshold: float) -> list[Template]:
    return [Template(k, _words(v), 1.0, True) for k, v in phrases.items()] + [Template(k, _words(v), threshold, False) for k, v in notices.items()]


def _hits(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray):
    starts, ends, first = kernel.words(data, offsets, kernel.ALNUM)
    hashes = kernel.range_hash(kernel.prefix_sums(data, kernel.LOWERED), starts, ends)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    where = np.flatnonzero(vocabulary[at] == hashes)
    return first, where, at[where]


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each word of the templates stands in the corpus; at most the templates' words come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, _, data, offsets in kernel.blocks(batch.column(0)):
                total += np.bincount(_hits(data, offsets, vocabulary)[2], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary))), pa.array(total)], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word: r.n for r in rows}


class Index:
    """Templates with their words in global order, and the rare words that lead to them."""

    def __init__(self, found: list[Template], vocabulary: np.ndarray, counts: dict[int, int]) -> None:
        self.templates = found
        order = sorted(range(len(vocabulary)), key=lambda w: (counts.get(w, 0), int(vocabulary[w])))
        self.rank = np.empty(len(vocabulary), np.int64)
        self.rank[order] = np.arange(len(order))
        self.sequence = [np.searchsorted(vocabulary, t.words) for t in found]
        self.sorted = [np.sort(np.unique(self.rank[s])) for s in self.sequence]
        self.leads: dict[int, list[tuple[int, int]]] = {}
        for k, (t, own) in enumerate(zip(found, self.sorted, strict=True)):
            for i, rank in enumerate(own[: len(own) - t.need + 1]):
                self.leads.setdefault(int(rank), []).append((k, i))
        self.lead = np.zeros(len(vocabulary), bool)
        self.lead[list(self.leads)] = True
        self.half = max(len(t.words) for t in found)

    def scan(self, at: np.ndarray, ranks: np.ndarray, n_words: int) -> dict[int, float]:
        """Best containment of every template that reaches its threshold in a block of one text."""
        best: dict[int, float] = {}
        half = self.half
        leads = np.flatnonzero(self.lead[ranks])
        blocks = np.unique(np.concatenate([at[leads] // half, np.maximum(at[leads] // half - 1, 0)]))
        for b in blocks.tolist():
            lo, hi = np.searchsorted(at, (b * half, b * half + 2 * half))
            own = np.unique(ranks[lo:hi])
            length = min(n_words - b * half, 2 * half)
            tried = set()
            for j in np.flatnonzero(self.lead[own]).tolist():
                for k, i in self.leads[int(own[j])]:
                    t, words = self.templates[k], self.sorted[k]
                    if k in tried or length < t.need or 1 + min(len(words) - i - 1, len(own) - j - 1) < t.need:
                        continue
                    tried.add(k)
                    both = len(np.intersect1d(own, words, assume_unique=True))
                    if both >= t.need:
                        best[k] = max(best.get(k, 0.0), both / len(words))
        return best


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, threshold: float = 0.9) -> DataFrame:
    """Licence labels and places per row of ``docs`` (``doc_id``, ``text``; other columns are left out).

    ``n_base`` counts the places where a phrase's words stand consecutively,
    ``first_word`` and ``last_word`` are the smallest and largest start, null
    without one. ``labels`` also has the notices' labels, ``score`` is the best
    containment of what was found, 0 without. Null and empty texts have no words.
    Equal rows give equal results; a null doc_id stays null.
    """
    found = templates(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices, threshold)
    kernel.small_batches(docs.sparkSession)
    vocabulary = np.unique(np.concatenate([t.words for t in found]))
    index = Index(found, vocabulary, frequencies(docs, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            firsts: list[int | None] = [None] * n
            lasts: list[int | None] = [None] * n
            base, labels = [""] * n, [""] * n
            for row, _, data, offsets in kernel.blocks(batch.column(1)):
                first, where, ids = _hits(data, offsets, vocabulary)
                n_words[row : row + len(first) - 1] = np.diff(first)
                ranks = index.rank[ids]
                for i in np.unique(np.searchsorted(first, where[index.lead[ranks]], "right") - 1).tolist():
                    lo, hi = np.searchsorted(where, (first[i], first[i + 1]))
                    at, own = where[lo:hi] - first[i], ids[lo:hi]
                    best = index.scan(at, ranks[lo:hi], int(first[i + 1] - first[i]))
                    places: list[np.ndarray] = []
                    names, more, top = set(), set(), 0.0
                    for k, share in best.items():
                        t = found[k]
                        if not t.phrase:
                            more.add(t.label)
                            top = max(top, share)
                            continue
                        words = index.sequence[k]
                        held = {int(p): int(w) for p, w in zip(at, own, strict=True)}
                        start = [p for p, w in held.items() if w == words[0] and all(held.get(p + d) == words[d] for d in range(1, len(words)))]
                        if start:
                            places.append(np.array(start))
                            names.add(t.label)
                            top = 1.0
                    if places:
                        every = np.concatenate(places)
                        n_base[row + i], firsts[row + i], lasts[row + i] = len(every), int(every.min()), int(every.max())
                    base[row + i], labels[row + i], score[row + i] = ",".join(sorted(names)), ",".join(sorted(names | more)), top
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64()), pa.array(base), pa.array(labels), pa.array(score)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
