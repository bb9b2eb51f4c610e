"""Imputation by nearest rows where many rows are equal in what queries have."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import neighbours


def _plainly(rows, k):
    x = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], float)
    out = x.copy()
    for i, j in zip(*np.nonzero(np.isnan(x)), strict=True):
        both = ~np.isnan(x) & ~np.isnan(x[i])
        n = both.sum(axis=1)
        d = np.sqrt(np.where(both, (np.nan_to_num(x) - np.nan_to_num(x[i])) ** 2, 0).sum(axis=1) * x.shape[1] / np.maximum(n, 1))
        near = sorted((d[r], rows[r][0], x[r, j]) for r in range(len(rows)) if n[r] and not np.isnan(x[r, j]) and r != i)[:k]
        out[i, j] = np.mean([v for *_, v in near]) if near else np.nanmean(x[:, j])
    return {r[0]: tuple(v) for r, v in zip(rows, out.tolist(), strict=True)}


@pytest.mark.parametrize("most", [2_000_000, 12])
def test_impute_is_that_of_all_pairs(spark, most):
    rng = random.Random(4)
    rows = [(k, *(None if rng.random() < 0.25 else float(rng.randint(0, 4)) for _ in range(3))) for k in rng.sample(range(1000), 120)]
    got = neighbours.impute(spark.createDataFrame(rows, "id long, a double, b double, c double"), "id", ["a", "b", "c"], 3, most)
    want = _plainly(rows, 3)
    found = {r.id: (r.a, r.b, r.c) for r in got.collect()}
    assert len(found) == len(want) and all(found[k] == pytest.approx(v) for k, v in want.items())


def test_equal_rows_are_one_query(spark, monkeypatch):
    asked, donors = [], neighbours._donors
    monkeypatch.setattr(neighbours, "_donors", lambda shared, *rest: asked.append(len(shared.value)) or donors(shared, *rest))
    rows = spark.range(20_000).select("id", (F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 5 != 0, (F.col("id") % 11).cast("double")).alias("b"))
    assert neighbours.impute(rows, "id", ["a", "b"]).where("b IS NOT NULL").count() == 20_000
    assert asked == [7]  # not 4,000
