"""Languages by interpolated Kneser-Ney models over characters.

One model per language is counted on a bounded sample of labelled texts. All
n-grams of all languages lie in one sorted array of 64-bit hashes with a column
of costs for each language, so scoring looks every position up once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.kernel import U, mix, small_batches

UNKNOWN = "und"
#: Between words and between texts.
_GAP = 32
_STEP = U(0x9E3779B97F4A7C15)


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lower-cased texts with all that are no letters as one blank, each text after a blank.

    The second array has each text's first position and the end, the third whether it has a letter.
    """
    joined = "\0".join(["", *texts]).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.flatnonzero(codes == 0)
    if len(edges) != len(texts):  # texts hold the separator themselves
        return characters([t.replace("\0", " ") for t in texts])
    kinds = _letters(codes)
    clean = np.where(kinds, codes, _GAP).astype(np.int64)
    keep = kinds.copy()
    keep[1:] |= kinds[:-1]
    keep[edges] = True
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    bounds = np.append(kept_before[edges], kept_before[-1])
    letters = np.concatenate([[0], np.cumsum(kinds)])
    ends = np.append(edges[1:], len(codes))
    return clean[keep], bounds, letters[ends] > letters[edges]


_LETTER = np.zeros(0x110000, np.int8)


def _letters(codes: np.ndarray) -> np.ndarray:
    unknown = np.flatnonzero(np.bincount(codes[_LETTER[codes] == 0])) if (_LETTER[codes] == 0).any() else ()
    for c in unknown:
        _LETTER[c] = 2 if chr(c).isalpha() else 1
    return _LETTER[codes] == 2


def ngrams(codes: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1- to ``order``-grams that end at every position; those over a text's start are cut short to its start."""
    inside = np.arange(len(codes)) - np.repeat(bounds[:-1], np.diff(bounds))
    cells = codes.astype(U) + U(1)
    rolled = cells * _STEP
    out = [mix(rolled)]
    for k in range(1, order):
        longer = rolled.copy()
        longer[k:] = mix(longer[k:]) + cells[:-k] * _STEP
        rolled = np.where(inside >= k, longer, rolled)
        out.append(mix(rolled + U(k)))
    return out


class Model:
    """``keys``: sorted hashes of all n-grams; ``cost`` and ``backoff``: a column of negative logs for each language."""

    def __init__(self, languages: list[str], samples: dict[str, list[str]], order: int = 4, discount: float = 0.75) -> None:
        self.languages, self.order = languages, order
        counted = [self._count(samples[x] or [""], order) for x in languages]
        n, sizes = len(languages), []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        gammas: list[tuple[np.ndarray, np.ndarray]] = []
        below_keys, below = np.zeros(0, U), np.zeros((0, n))
        for k in range(order):
            own = [c[k] for c in counted]
            keys, at = np.unique(np.concatenate([x[0] for x in own]), return_index=True)
            context, suffix = (np.concatenate([x[c] for x in own])[at] for c in (2, 3))
            names, which = np.unique(context, return_inverse=True)
            counts = np.zeros((len(keys), n))
            for j, x in enumerate(own):
                counts[np.searchsorted(keys, x[0]), j] = x[1]
            total, kinds = np.zeros((len(names), n)), np.zeros((len(names), n))
            np.add.at(total, which, counts)
            np.add.at(kinds, which, counts > 0)
            gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            lower = below[np.searchsorted(below_keys, suffix)] if k else np.full((len(keys), n), 1 / max(len(keys), 1))
            p = np.maximum(counts - discount, 0) / np.maximum(total[which], 1) + gamma[which] * lower
            if k:
                gammas.append((names, gamma))
            else:
                self.floor = (-np.log(gamma[0] / len(keys))).astype(np.float32) if len(keys) else np.zeros(n, np.float32)
            parts.append((keys, p, keys))
            below_keys, below = keys, p
            sizes.append(len(keys))
        every = np.concatenate([x[0] for x in parts])
        order_of = np.argsort(every)
        self.keys = every[order_of]
        self.cost = (-np.log(np.concatenate([x[1] for x in parts])))[order_of].astype(np.float32)
        self.backoff = np.zeros((len(self.keys), n), np.float32)
        for names, gamma in gammas:
            self.backoff[np.searchsorted(self.keys, names)] = -np.log(gamma)
        self.shift = U(64 - max(8, int(np.ceil(np.log2(len(self.keys) + 1)))))
        starts = np.searchsorted(self.keys, np.arange(1 << (64 - int(self.shift)), dtype=U) << self.shift)
        self.slot = np.append(starts, len(self.keys)).astype(np.int32)
        self.deep = int(np.diff(self.slot).max())

    @staticmethod
    def _count(texts: list[str], order: int) -> list[tuple[np.ndarray, ...]]:
        """By order: n-grams, counts (below the longest: of contexts they stand in), and hashes of context and suffix."""
        codes, bounds, _ = characters(texts)
        grams = ngrams(codes, bounds, order)
        inside = np.arange(len(codes)) - np.repeat(bounds[:-1], np.diff(bounds))
        out = []
        for k in range(order):
            use = np.flatnonzero(inside >= k)
            if k < order - 1:
                use = np.flatnonzero(inside >= k + 1)
                use = use[np.unique(grams[k + 1][use], return_index=True)[1]]
            keys, first, counts = np.unique(grams[k][use], return_index=True, return_counts=True)
            at = use[first]
            out.append((keys, counts, grams[k - 1][at - 1] if k else np.zeros(len(at), U), grams[k - 1][at] if k else np.zeros(len(at), U)))
        # every context and suffix must have a cost of its own
        for k in range(order - 1, 0, -1):
            need = np.setdiff1d(np.concatenate([out[k][2], out[k][3]]), out[k - 1][0])
            if len(need):
                use = np.flatnonzero((inside >= k - 1) & np.isin(grams[k - 1], need))
                keys, first = np.unique(grams[k - 1][use], return_index=True)
                at = use[first]
                before = np.maximum(at - 1, 0)
                out[k - 1] = (
                    np.concatenate([out[k - 1][0], keys]),
                    np.concatenate([out[k - 1][1], np.ones(len(keys), np.int64)]),
                    np.concatenate([out[k - 1][2], grams[k - 2][before] if k > 1 else np.zeros(len(at), U)]),
                    np.concatenate([out[k - 1][3], grams[k - 2][at] if k > 1 else np.zeros(len(at), U)]),
                )
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places in ``keys``, -1 where a hash is absent."""
        lo = self.slot[(hashes >> self.shift).astype(np.int64)]
        out = np.full(len(hashes), -1, np.int32)
        for d in range(self.deep):
            at = np.minimum(lo + d, len(self.keys) - 1)
            out = np.where(self.keys[at] == hashes, at, out)
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cost per character of every text and language, and whether the text has a letter."""
        codes, bounds, letters = characters(texts)
        grams = ngrams(codes, bounds, self.order)
        total = np.zeros((len(codes), len(self.languages)), np.float32)
        open_ = np.arange(len(codes))
        inside = np.arange(len(codes)) - np.repeat(bounds[:-1], np.diff(bounds))
        for k in range(self.order - 1, -1, -1):
            can = inside[open_] >= k
            at = np.full(len(open_), -1, np.int32)
            at[can] = self.find(grams[k][open_[can]])
            hit = at >= 0
            total[open_[hit]] += self.cost[at[hit]]
            rest = open_[~hit]
            if k:  # an unseen n-gram costs its context's back-off besides the shorter one
                left = rest[can[~hit]]
                place = self.find(grams[k - 1][left - 1])
                known = place >= 0
                total[left[known]] += self.backoff[place[known]]
            open_ = rest
            if not len(open_):
                break
        total[open_] += self.floor
        sums = np.add.reduceat(total, bounds[:-1], axis=0) if len(codes) else np.zeros((len(texts), len(self.languages)), np.float32)
        return sums / np.maximum(np.diff(bounds), 1)[:, None], letters


def dealt(texts: list[str]) -> tuple[list[str], list[str]]:
    """A language's texts that are counted, and those that set its limit: every third, but none of a language's first two."""
    return [t for k, t in enumerate(texts) if k % 3 != 2], texts[2::3]


def fit(labelled: DataFrame, most: int = 1500, order: int = 4, quantile: float = 0.999, letters: int = 6_000_000) -> tuple[Model, np.ndarray]:
    """A model of ``text`` by ``lang``, and the cost per character over which each language rejects.

    Of a language about ``most`` whole texts or ``letters`` characters come to the driver, whichever is less, those
    with the smallest hash; a third of them set the threshold and are not
    counted. Every language is counted on a text at least; one of fewer than three texts rejects nothing. Rows without text or language teach nothing.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: max(r.n / most, r.size / letters) for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).collect()}
    if not counts:
        return Model([UNKNOWN], {UNKNOWN: [""]}, order), np.array([np.inf])
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, 1 / max(n, 1e-9)).otherwise(share)
    unit = (F.xxhash64("doc_id", "text") / F.lit(2.0**64)) + 0.5
    picked = known.select("lang", "text", unit.alias("at")).where(F.col("at") < share).collect()
    picked.sort(key=lambda r: (r["lang"], r["at"]))
    languages = sorted({r["lang"] for r in picked})
    own: dict[str, list[str]] = {x: [] for x in languages}
    for r in picked:
        own[r["lang"]].append(r["text"])
    samples, kept_out = ({x: dealt(own[x])[k] for x in languages} for k in (0, 1))
    model = Model(languages, samples, order)
    limits = []
    for j, x in enumerate(languages):
        texts = [t for t in kept_out[x] if len(t) >= 40]
        limits.append(float(np.quantile(model.cross_entropy(texts)[0][:, j], quantile)) * 1.25 if texts else np.inf)
    return model, np.array(limits)


def predict(docs: DataFrame, model: Model, limits: np.ndarray, reject: bool = True, block: int = 400_000) -> DataFrame:
    """``doc_id, lang_pred, score, cost, rejected`` for every row.

    The language with the lowest cost per character wins; ``score`` is its share
    of the likelihoods, tempered by length. A null text and one without a letter
    get ``und`` and score 0. A text that costs more than its language's limit is
    ``rejected``, and ``und`` too where ``reject``.
    """
    small_batches(docs.sparkSession)
    names = np.array(model.languages, object)
    shared = docs.sparkSession.sparkContext.broadcast((model, limits))  # bounded by the sample of fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, most = shared.value
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            lo = 0
            outs: tuple[list, ...] = ([], [], [], [])
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= block):
                    size += len(texts[hi])
                    hi += 1
                cost, letters = own.cross_entropy(texts[lo:hi])
                best = cost.argmin(axis=1)
                least = cost[np.arange(len(best)), best]
                length = np.array([min(len(t), 400) for t in texts[lo:hi]])
                share = 1 / np.exp(-(cost - least[:, None]) * np.sqrt(np.maximum(length, 1))[:, None]).sum(axis=1)
                bad = letters & (least > most[best])
                outs[0].append(np.where(letters & ~(bad & reject), names[best], UNKNOWN))
                outs[1].append(np.where(letters, share, 0.0))
                outs[2].append(np.where(letters, least, 0.0))
                outs[3].append(bad)
                lo = hi
            flat = [np.concatenate(x) if x else np.zeros(0) for x in outs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(flat[0].tolist(), pa.string()), pa.array(flat[1].astype(float)), pa.array(flat[2].astype(float)), pa.array(flat[3].astype(bool))],
                names=["doc_id", "lang_pred", "score", "cost", "rejected"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, cost double, rejected boolean")
