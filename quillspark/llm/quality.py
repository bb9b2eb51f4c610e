"""Document quality by regularised quadratic discriminant analysis.

Every text becomes a vector of transformed statistics. Each class has a mean
and a covariance that is shrunk towards its diagonal; the score is the
difference of the two log densities, from Mahalanobis distances by Cholesky
factors that are computed once, mapped to 0..1 by a fitted logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import kernel
from quillspark.session import stored

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_spread", "distinct", "commonest", "repeated", "lines", "equal_lines",
    "upper", "digits", "stops", "commas", "marks", "bars", "symbols", "beyond_ascii", "entropy",
)


def _class(found: str) -> np.ndarray:
    return kernel.byte_class(keep=found.encode())


_CLASSES = {
    "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digits": _class("0123456789"),
    "stops": _class("."),
    "commas": _class(",;:"),
    "marks": _class("!?"),
    "bars": _class("|"),
    "symbols": _class("*&$#%@^~<>[]{}\\/=+_`"),
    "beyond_ascii": np.arange(256) >= 128,
}
_LINE = kernel.byte_class(drop=b"\n")
_KINDS = np.zeros(256, np.int64)
for _k, _c in enumerate(_CLASSES.values()):
    _KINDS[_c] = _k + 1
_KINDS[list(b" \t\r\n")] = len(_CLASSES) + 1


def _distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct values every text has, and how often its commonest stands."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    keys, at, counts = np.unique(kernel.mix(hashes + owner.astype(kernel.U) * kernel.U(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner[at], counts)
    return np.bincount(owner[at], minlength=n), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` for every text; an empty text has a row like any other."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kinds = len(_CLASSES) + 2
    by_kind = np.bincount(owner * kinds + _KINDS[data], minlength=n * kinds).reshape(n, kinds) if len(data) else np.zeros((n, kinds))
    share = by_kind / np.maximum(size, 1)[:, None]
    sums = kernel.prefix_sums(data)
    starts, ends, first = kernel.words(data, offsets, kernel.SPACED)
    hashes = kernel.range_hash(sums, starts, ends)
    count = np.diff(first).astype(float)
    own_word = np.repeat(np.arange(n), np.diff(first))
    length = (ends - starts).astype(float)
    total = np.bincount(own_word, length, n)
    square = np.bincount(own_word, length**2, n)
    mean = total / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(square / np.maximum(count, 1) - mean**2, 0))
    distinct, most = _distinct(hashes, first)
    again = np.zeros(n)
    if len(hashes) > 1:
        same = (hashes[1:] == hashes[:-1]) & (own_word[1:] == own_word[:-1])
        again = np.bincount(own_word[1:][same], minlength=n)
    line_starts, line_ends, line_first = kernel.words(data, offsets, _LINE)
    lines = np.diff(line_first).astype(float)
    unequal, _ = _distinct(kernel.range_hash(sums, line_starts, line_ends), line_first)
    p = np.where(share > 0, share, 1)
    out = {
        "log_bytes": np.log1p(size),
        "log_words": np.log1p(count),
        "word_length": np.log1p(mean),
        "word_spread": np.log1p(spread),
        "distinct": np.sqrt(distinct / np.maximum(count, 1)),
        "commonest": np.sqrt(most / np.maximum(count, 1)),
        "repeated": np.sqrt(again / np.maximum(count, 1)),
        "lines": np.log1p(lines),
        "equal_lines": np.sqrt(1 - unequal / np.maximum(lines, 1)) * (lines > 0),
        "entropy": -(p * np.log(p)).sum(axis=1),
    }
    for k, name in enumerate(_CLASSES):
        out[name] = np.sqrt(share[:, k + 1])
    return np.stack([out[name] for name in STATISTICS], axis=1)


def vectors(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, its statistics; a null text counts as empty."""

    kernel.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel.release()
        for batch in batches:
            parts = [statistics(data, offsets) for _, _, data, offsets in kernel.blocks(batch.column(1))]
            flat = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    means: np.ndarray
    factors: np.ndarray  # inverses of the Cholesky factors of both covariances
    logdets: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        logs = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.factors[c].T
            logs.append(-0.5 * (z**2).sum(axis=1) - 0.5 * self.logdets[c])
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self._squash(self.margin(x)) + self.shift, -30, 30)))

    @staticmethod
    def _squash(margin: np.ndarray) -> np.ndarray:
        return np.sign(margin) * np.log1p(np.abs(margin))


def _moments(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of products by class, each summed in the partitions first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + width + width * width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[label == c]
                total[c, 0] += len(own)
                total[c, 1 : 1 + width] += own.sum(axis=0)
                total[c, 1 + width :] += (own.T @ own).ravel()
        cells = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "v"])

    got = rows.select("x", "label").mapInArrow(add, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 * (1 + width + width * width))
    for r in got:
        flat[r.cell] = r.v
    flat = flat.reshape(2, -1)
    return flat[:, 0], flat[:, 1 : 1 + width], flat[:, 1 + width :].reshape(2, width, width)


def fit(rows: DataFrame, shrink: float = 0.1, least: float = 1e-4, most: int = 20_000) -> Discriminant:
    """A model of ``x`` by ``label`` (0 or 1; other rows teach nothing).

    Moments cover all rows; the logistic curve is fitted on at most about
    ``most`` of them, those with the smallest hash. Without one class every score is 0.5.
    """
    rows = rows.where(F.col("label").isin(0, 1))
    width = len(STATISTICS)
    n, sums, products = _moments(rows, width)
    if not n.all():
        return Discriminant(np.zeros((2, width)), np.zeros((2, width, width)), np.zeros(2), 0.0, 0.0)
    means = sums / n[:, None]
    factors, logdets = [], []
    for c in (0, 1):
        cov = products[c] / n[c] - np.outer(means[c], means[c])
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + least * np.eye(width)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        logdets.append(2 * np.log(np.diag(low)).sum())
    model = Discriminant(means, np.array(factors), np.array(logdets))
    unit = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    picked = rows.where(unit < most / n.sum()).select("x", "label").collect() if n.sum() > most else rows.select("x", "label").collect()
    x, y = np.array([r.x for r in picked]), np.array([r.label for r in picked], float)
    if len(set(y)) == 2:
        a = np.stack([model._squash(model.margin(x)), np.ones(len(y))], axis=1)
        w = np.zeros(2)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        model.slope, model.shift = float(max(w[0], 1e-6)), float(w[1])
    return model


def scored(rows: DataFrame, model: Discriminant) -> DataFrame:
    """The rows' ``doc_id`` and ``score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, learn=None, name: str = "quality") -> DataFrame:
    """``doc_id, score`` for every row of ``docs``, null and empty texts too.

    ``labels`` has ``doc_id, quality``; null labels teach nothing, ``learn`` is
    a condition on ``doc_id`` for rows that may. The vectors are written once.
    """
    rows = stored(vectors(docs), f"{name}-vectors")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    if learn is not None:
        known = known.where(learn)
    return scored(rows, fit(rows.join(known, "doc_id")))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, name: str = "quality") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, all columns as they were.

    All labels teach. Texts are read once for the labelled vectors and once for the decision, and never shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    model = fit(stored(vectors(docs).join(known, "doc_id").select("doc_id", "x", "label"), f"{name}-vectors"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel.release()
        for batch in batches:
            parts = [model.score(statistics(data, offsets)) for _, _, data, offsets in kernel.blocks(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(parts) >= least)) if parts else batch

    return docs.mapInArrow(run, docs.schema)
