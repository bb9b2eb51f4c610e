"""Benchmark decontamination by spaced seeds.

A seed looks at some of the words of a window and ignores the others, always the
same ones. Hashes of the benchmark's windows are joined with those of the
training texts; around every hit the two word sequences are laid on one
diagonal and the stretch of most equal words with few substitutions is measured.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import kernel
from quillspark.llm.kernel import U
from quillspark.session import stored

# The seeds; # is looked at, - is ignored. Every stretch of 13 words or more with 80 % of them equal
# holds one of them whole: a test goes through all patterns of 13 to 25 words, and of a longer stretch's halves one is as equal.
MASKS = ("####-##", "##-#---#--##", "##-#-#-##", "###-###")
#: Equal words of a match at least; an item of fewer words would be met by chance.
FEWEST = 5
#: Benchmark window hashes that may be sent to every task; a larger benchmark is worked off part by part.
SENT = 4_000_000
#: Pairs of a hit and an item's place that are looked at together.
PAIRS = 1 << 20
RESULT = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long, n_item long"


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = kernel.words(data, offsets, kernel.ALNUM)
    return kernel.range_hash(kernel.prefix_sums(data, kernel.LOWERED), starts, ends), first


def seeds(hashes: np.ndarray, first: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of one mask and the place of their first word."""
    n, width = len(hashes), len(mask)
    if n < width:
        return np.zeros(0, U), np.zeros(0, np.int64)
    rolled = np.full(n - width + 1, U((number + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    for k, c in enumerate(mask):
        if c == "#":
            rolled = rolled + hashes[k : n - width + 1 + k] * kernel._WEIGHTS[k]
    whole = np.ones(n - width + 1, bool)
    for e in first[1:-1]:
        whole[max(0, e - width + 1) : e] = False
    at = np.flatnonzero(whole)
    return kernel.mix(rolled[at]), at


def overlap(a: np.ndarray, b: np.ndarray, i: int, j: int, least: int = 13, share: float = 0.8) -> tuple[int, int, int, int]:
    """The stretch of most equal words on the diagonal of ``a[i]`` and item word ``b[j]``: start in a, start in b, words, equal words.

    It has ``least`` words (or the whole item, where that is shorter), ``share`` of them equal;
    unequal words at its ends are taken in only to reach that length. No words if there is none.
    """
    back, need = min(i, j), min(least, len(b))
    length = back + min(len(a) - i, len(b) - j)
    same = a[i - back : i - back + length] == b[j - back : j - back + length]
    sums = np.concatenate([[0], np.cumsum(same)])
    part = Fraction(str(share))
    # a stretch has the share if this is no smaller at its end than at its start; the first such start is the longest stretch
    over = part.denominator * sums - part.numerator * np.arange(length + 1)
    starts = np.searchsorted(-np.minimum.accumulate(over), -over, "left")
    equal = np.where(np.arange(length + 1) - starts >= need, sums - sums[starts], -1)
    end = int(np.argmax(equal))
    if equal[end] < 1:
        return i, j, 0, 0
    start = int(starts[end])
    while end - start > need and not same[end - 1]:
        end -= 1
    while end - start > need and not same[start]:
        start += 1
    return i - back + start, j - back + start, end - start, int(equal.max())


def seeds_for(least: int, share: float) -> tuple[str, ...]:
    """Masks that miss no stretch of ``least`` words or more of which ``share`` are equal.

    ``MASKS`` up to their own bounds; below these one mask as wide as the longest run that
    every stretch of ``least`` to twice as many words must hold.
    """
    part = Fraction(str(share))
    if least >= 13 and part >= Fraction(4, 5):
        return MASKS
    other = ((n, n - ceil(part * n)) for n in range(least, 2 * least))
    return ("#" * max(1, min(-(-(n - k) // (k + 1)) for n, k in other)),)


def _pieces(words: int, least: int, share: float) -> tuple[int, int]:
    """Width and number of the pieces of an item below ``least`` words: one more than it may have unequal words, so that one piece is whole; none for others."""
    if not 0 < words < least:
        return 0, 0
    number = words - ceil(Fraction(str(share)) * words) + 1
    return min(max(1, words // number), 8), number


class Benchmark:
    """Items as word hashes, and their seeds in sorted arrays; items below ``least`` words have pieces besides, which miss nothing."""

    def __init__(self, items: list[tuple[int, str]], least: int = 13, share: float = 0.8) -> None:
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        self.ids = [i for i, _ in items]
        self.words: list[np.ndarray] = []
        keys, owners, places, widths = [], [], [], set()
        masks = seeds_for(least, share)
        for row, _, data, offsets in kernel.blocks(texts):
            hashes, first = hashed(data, offsets)
            self.words += [hashes[first[k] : first[k + 1]] for k in range(len(first) - 1)]
            for m, mask in enumerate(masks):
                h, at = seeds(hashes, first, mask, m)
                own = np.searchsorted(first, at, "right") - 1
                keys.append(h)
                owners.append(row + own)
                places.append(at - first[own])
            cut = np.array([_pieces(n, least, share) for n in np.diff(first).tolist()], np.int64).reshape(-1, 2)
            for width in set(cut[:, 0].tolist()) - {0}:
                widths.add(width)
                h, at = seeds(hashes, first, "#" * width, len(masks) + width)
                own = np.searchsorted(first, at, "right") - 1
                place = at - first[own]
                piece = (cut[own, 0] == width) & (place % width == 0) & (place // width < cut[own, 1])
                keys.append(h[piece])
                owners.append(row + own[piece])
                places.append(place[piece])
        self.masks = [*zip(masks, range(len(masks))), *(("#" * w, len(masks) + w) for w in sorted(widths))]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, U)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.owners = np.concatenate(owners)[order] if keys else np.zeros(0, np.int64)
        self.places = np.concatenate(places)[order] if keys else np.zeros(0, np.int64)
        # one bit for every value of a hash's top 20 bits spares most searches
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.keys >> U(44)).astype(np.int64)] = True


def _diagonals(own: Benchmark, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Text, item, place in the text less place in the item, and one place in the text, for every diagonal that a seed hits."""
    found = [np.zeros((0, 4), np.int64)]
    for mask, m in own.masks:
        h, at = seeds(hashes, first, mask, m)
        maybe = np.flatnonzero(own.near[(h >> U(44)).astype(np.int64)])
        lo = np.searchsorted(own.keys, h[maybe], "left")
        hi = np.searchsorted(own.keys, h[maybe], "right")
        hit = np.flatnonzero(hi > lo)
        at, lo, counts = at[maybe[hit]], lo[hit], (hi - lo)[hit]
        ends = np.cumsum(counts)
        k = 0
        while k < len(at):  # some hits at a time, since one seed may stand in many items
            last = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
            n = counts[k:last]
            at_, which = np.repeat(at[k:last], n), np.repeat(lo[k:last] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            doc = np.searchsorted(first, at_, "right") - 1
            place = at_ - first[doc]
            rows = np.stack([doc, own.owners[which], place - own.places[which], place], axis=1)
            found.append(rows[np.unique(rows[:, :3], axis=0, return_index=True)[1]])
            k = last
    rows = np.concatenate(found)
    return rows[np.unique(rows[:, :3], axis=0, return_index=True)[1]] if len(rows) else rows


def _matches(own: Benchmark, data: np.ndarray, offsets: np.ndarray, least: int, share: float):
    hashes, first = hashed(data, offsets)
    best: dict[tuple[int, int], tuple[int, ...]] = {}
    for doc, item, diagonal, i in _diagonals(own, hashes, first).tolist():
        words = hashes[first[doc] : first[doc + 1]]
        start, start_b, n, equal = overlap(words, own.words[item], i, i - diagonal, least, share)
        if equal >= FEWEST and (equal, -start) > best.get((doc, item), (0, 0))[:2]:
            best[doc, item] = (equal, -start, start_b, n)
    return [(doc, item, -s, sb, n, e) for (doc, item), (e, s, sb, n) in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.8, sent: int = SENT) -> DataFrame:
    """One row per text and benchmark item that share a stretch: where it starts in both, its words, how many are equal.

    A stretch counts when it has ``least`` words (or the whole item, where that
    is shorter) of which ``share`` are equal, five at least. The seeds miss none. Words are runs of letters and digits
    with A-Z lower-cased; null and empty texts share nothing. Every distinct
    item is compared; equal rows give equal results, of equally long stretches the first. The benchmark goes to every
    task only if its words are at most ``sent`` divided by the masks; a larger one is split by
    item over several passes of that size, each against all texts, one part in the driver at a time.
    """
    items, passes = _measured(benchmark, sent)
    found = None
    for k in range(passes):
        shared = _part(items, passes, k, least, share)
        one = _pass(docs, shared, least, share)
        if passes > 1:
            one = stored(one, "leaks")
            shared.unpersist()
        found = one if found is None else found.unionByName(one)
    return found


def _measured(benchmark: DataFrame, sent: int) -> tuple[DataFrame, int]:
    """The distinct items, and how many parts of at most about ``sent`` seeds they make."""
    kernel.small_batches(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    measured = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return items, max(1, -(-int(measured) * len(MASKS) // (2 * sent)))


def _part(items: DataFrame, passes: int, k: int, least: int, share: float):
    """The ``k``-th part of the benchmark as a broadcast."""
    part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else items
    return items.sparkSession.sparkContext.broadcast(Benchmark([(r.item_id, r.text) for r in part.collect()], least, share))


def _pass(docs: DataFrame, shared, least: int, share: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Benchmark = shared.value
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [], [], [])
            for row, _, data, offsets in kernel.blocks(batch.column(1)):
                for doc, item, start, start_b, n, equal in _matches(own, data, offsets, least, share):
                    values = (batch.column(0)[row + doc].as_py(), own.ids[item], start, start_b, n, equal, len(own.words[item]))
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=[x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.8, sent: int = SENT) -> DataFrame:
    """The rows of ``docs`` that share no stretch with the benchmark, all columns as they were; no shuffle.

    Null and empty texts stay. A benchmark over ``sent`` takes a pass for each part, the texts left being written between them.
    """
    items, passes = _measured(benchmark, sent)
    for k in range(passes):
        shared = _part(items, passes, k, least, share)
        docs = _without(docs, shared, least, share)
        if k < passes - 1:
            docs = stored(docs, "clean")
            shared.unpersist()
    return docs


def _without(docs: DataFrame, shared, least: int, share: float) -> DataFrame:
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel.release()
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, _, data, offsets in kernel.blocks(batch.column(at)):
                for doc in {m[0] for m in _matches(shared.value, data, offsets, least, share)}:
                    keep[row + doc] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
