"""Blocks of neighbouring doc_ids, in order, of about equal row counts."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges whose bounds come to the driver at most; beyond that each range is cut evenly into blocks.
RANGES = 10_000


@dataclass(frozen=True)
class Blocks:
    """``edges``: the lowest key, the bounds between ranges, the highest key; ``parts`` blocks in each range; ``nulls`` blocks before them for null keys."""

    edges: tuple[int, ...]
    parts: int
    nulls: int = 1

    @property
    def count(self) -> int:
        return self.nulls + (len(self.edges) - 1) * self.parts

    def of(self, key: Column, spread: Column) -> Column:
        """The number of the key's block; null keys are dealt by ``spread``. Two searches of about the root of the number of ranges."""
        cuts = list(self.edges[1:-1])
        lost = F.pmod(F.xxhash64(spread), F.lit(self.nulls)).cast("int") if self.nulls > 1 else F.lit(0)
        array = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
        below = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
        found = F.lit(0)
        if cuts:
            step = math.isqrt(len(cuts) - 1) + 1
            groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
            coarse = below(array([g[0] for g in groups]))
            fine = F.element_at(F.array(*[array(g) for g in groups]), coarse)
            found = F.when(key < cuts[0], 0).otherwise((coarse - 1) * step + below(fine))
        if self.parts > 1:
            low, high = F.get(array(self.edges[:-1]), found.cast("int")), F.get(array(self.edges[1:]), found.cast("int"))
            share = (key - low).cast("double") / F.greatest(high - low, F.lit(1)).cast("double")
            found = found * self.parts + F.least(F.lit(self.parts - 1), F.floor(share * self.parts).cast("int"))
        return F.when(key.isNull(), lost).otherwise(found + self.nulls).cast("int")


def blocks(docs: DataFrame, n: int, key: str = "doc_id", ranges: int = RANGES) -> Blocks:
    """About ``n`` blocks from at most ``ranges`` approximate quantiles of ``key``, and more for null keys by their share of the rows.

    Ids within a range, one ten-thousandth of all at the most, are taken to be spread evenly.
    """
    cut = max(1, min(n, ranges))
    wanted = [k / cut for k in range(1, cut)]
    quantiles = [F.percentile_approx(key, wanted, 20 * cut).alias("b")] if wanted else []
    row = docs.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("rows"), F.count(key).alias("keys"), *quantiles).first()
    nulls = max(1, -(-n * (row.rows - row.keys) // max(1, row.rows)))
    if row.lo is None:
        return Blocks((0, 0), 1, nulls)
    inner = sorted({b for b in (row.b if wanted else []) if row.lo < b <= row.hi})
    return Blocks((row.lo, *inner, row.hi), -(-n // cut), nulls)


def number(docs: DataFrame, each: int, least: int = 8) -> int:
    """How many blocks of about ``each`` bytes of text hold ``docs``, whatever their files' compression."""
    return max(least, -(-int(docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0) // each))
