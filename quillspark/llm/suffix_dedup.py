"""Repeated passages by suffix arrays and their trees of common-prefix intervals.

Suffixes of the whole corpus can't be sorted at once, and needn't be: every
window of ``length`` bytes has one anchor, its smallest ``SEED``-byte hash, and equal
windows have equal anchors at equal places. Texts are read in blocks of
neighbouring doc_ids, so that the order of blocks is the order of texts.

1. Every block counts its anchors and the contexts (all windows of an anchor) they stand in.
2. Equal contexts are one leaf of the tree with several occurrences: one that an earlier block has is a
   repeat as a whole. An anchor that stands in one
   context only is settled by that. What is left are anchors in unequal contexts: the edges of repeats.
3. The first copy of each such context goes to a suffix array with the others of its
   anchor. A scan over its neighbours' common prefixes yields the interval tree; every interval
   of at least ``length`` whose occurrences differ in the byte before is a maximal repeat, and all its
   occurrences but the earliest are removed.
4. An anchor in more than ``HOT`` unequal contexts (a line that many texts have) would bring them all into one array.
   Its windows of ``length`` bytes are told apart one by one instead, by hash, after every block has united its own.
5. Every block unites its spans and cuts them out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import idblocks, kernel
from quillspark.llm.kernel import U, mix
from quillspark.session import dealt, even

SEED = 36
#: Groups of contexts for each block: a suffix array takes some eighty bytes for each of its own.
FINER = 4
#: About how many suffixes one array holds; those that share ``length`` bytes always stay together.
SUFFIXES = 30_000
#: Unequal contexts of an anchor, counted block by block, beyond which its windows are dealt one by one.
HOT = 4_096
#: Windows of a long text that are looked at together.
SLICE = 2 << 20
#: Bytes of text for one block.
EACH = 14 << 20
_PLACE = U((1 << 24) - 1)
_ODD = U(0x9E3779B97F4A7C15)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Text, place, hash, context hash, context start and end of every anchor (places count in ``data``).

    A text of more than ``SLICE`` bytes, which stands alone, is worked off in slices that share what contexts reach over.
    """
    if len(data) <= SLICE:
        return _anchors(data, offsets, length, 0, len(data))
    outs, last = [], -1
    for first in range(0, len(data) - length + 1, SLICE):
        lo, hi = max(0, first - length), min(len(data), first + SLICE + 2 * length)
        text, place, grams, context, start, end = _anchors(data[lo:hi], np.array([0, hi - lo]), length, first - lo, first - lo + SLICE)
        kept = place + lo > last
        outs.append(tuple(x[kept] for x in (text, place + lo, grams, context, start + lo, end + lo)))
        last = int(place[-1]) + lo if len(place) else last
    return tuple(np.concatenate(x) for x in zip(*outs, strict=True))


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, first: int, last: int) -> tuple[np.ndarray, ...]:
    """The anchors of the windows that start at ``first`` to ``last``."""
    none = np.zeros(0, np.int64)
    reach = length - SEED
    if len(data) < length:
        return none, none, none.astype(U), none.astype(U), none, none
    sums = kernel.prefix_sums(data)
    at = np.arange(len(data) - SEED + 1)
    grams = kernel.range_hash(sums, at, at + SEED)
    least = (grams & ~_PLACE) | at.astype(U)
    span = 1
    while span * 2 <= reach + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = reach + 1 - span
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    sizes = np.diff(offsets)
    starts = np.zeros(len(data) + 1, np.int8)
    long = sizes >= length
    starts[offsets[:-1][long]] += 1
    starts[(offsets[1:] - length + 1)[long]] -= 1
    valid = np.flatnonzero(np.cumsum(starts[: len(least)], dtype=np.int8))
    if first or last < len(least):
        valid = valid[(valid >= first) & (valid < last)]
    place = (least[valid] & _PLACE).astype(np.int64)
    place = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
    text = np.searchsorted(offsets, place, "right") - 1
    lo = np.maximum(offsets[text], place - reach)
    hi = np.minimum(offsets[text + 1], place + length)
    context = mix(kernel.range_hash(sums, lo, hi) + (place - lo).astype(U) * _ODD)
    # anchors are small hashes; mixed again they spread evenly
    return text, place, mix(grams[place]), context, lo, hi


class Block:
    """A block's texts in order of doc_id and then of text, and all its anchors."""

    def __init__(self, table: pa.Table, length: int) -> None:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        # a null doc_id stands before all others
        lost = table.filter(pc.is_null(table.column("doc_id")))
        if lost.num_rows:
            table = pa.concat_tables([lost, table.filter(pc.is_valid(table.column("doc_id")))])
        self.ids = table.column("doc_id").to_pylist()
        self.parts = list(kernel.blocks(table.column("text")))
        self.length = length

    def anchors(self) -> tuple[np.ndarray, ...]:
        """As ``anchors``, texts by their number in the block and places within the text; and the part of each."""
        out = [[] for _ in range(7)]
        for k, (row, _, data, offsets) in enumerate(self.parts):
            text, place, a, c, lo, hi = anchors(data, offsets, self.length)
            for column, value in zip(out, (text + row, lo - offsets[text], hi - offsets[text], a, c, np.full(len(text), k), lo), strict=True):
                column.append(value)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _key(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(a.astype(U) ^ mix(c.astype(U)))


def _buckets(sorted_keys: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """Number, start and end of the buckets that sorted keys fall into, of ``n`` equal ranges."""
    names, first = np.unique(((sorted_keys >> U(32)) * U(n)) >> U(32), return_index=True)
    if len(names):
        yield from zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_keys)], strict=True)


def _table(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])


_COUNTED = [("bucket", pa.int32()), ("block", pa.int32()), ("u", pa.binary()), ("v", pa.binary()), ("w", pa.binary())]
#: Kinds of notes for a block: contexts that an earlier block has, spans to remove, anchors in unequal contexts, and windows of hot ones that an earlier block has.
KEYS, SPANS, ANCHORS, WINDOWS = range(4)
_NOTES = [("block", pa.int32()), ("kind", pa.int32()), ("u", pa.binary()), ("v", pa.binary()), ("w", pa.binary())]
_RAW = [("bucket", pa.int32()), ("block", pa.int32()), ("u", pa.binary()), ("start", pa.binary()), ("size", pa.binary()), ("bytes", pa.binary())]
_SQL = {pa.int32(): "int", pa.binary(): "binary"}


def _schema(types: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{n} {_SQL[t]}" for n, t in types)


_MORE = np.dtype([("at", "<u4"), ("top", "<u8"), ("n", "<u4")])


def _count(length: int, buckets: int):
    """A block's contexts, in buckets by context; and its anchors with the least and largest of their contexts, in more buckets by anchor."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        _, _, _, a, c, _, _ = Block(table, length).anchors()
        keys, at = np.unique(_key(a, c), return_index=True)
        rows = [(b, block, keys[lo:hi].tobytes(), b"", b"") for b, lo, hi in _buckets(keys, buckets)]
        a, c = a[at], c[at]
        order = np.lexsort((c, a))
        a, c = a[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(a)))
        a, least, top = a[first], c[first], c[first + n - 1]
        for b, lo, hi in _buckets(a, buckets):
            several = np.flatnonzero(n[lo:hi] > 1)
            more = np.zeros(len(several), _MORE)
            more["at"], more["top"], more["n"] = several, top[lo:hi][several], n[lo:hi][several]
            rows.append((buckets + b, block, a[lo:hi].tobytes(), least[lo:hi].tobytes(), more.tobytes()))
        return _table(rows, _COUNTED)

    return run


def _joined(table: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, U) for x in table.column(column).to_pylist()])


def _owners(table: pa.Table) -> np.ndarray:
    return np.repeat(table.column("block").to_numpy(), [len(x) // 8 for x in table.column("u").to_pylist()])


def _by_block(block: np.ndarray, kind: int, u: np.ndarray, v: np.ndarray | None = None) -> list[tuple]:
    if not len(block):
        return []
    order = np.argsort(block, kind="stable")
    names, first = np.unique(block[order], return_index=True)
    ends = np.append(first[1:], len(block))
    return [(int(b), kind, u[order[lo:hi]].tobytes(), b"" if v is None else v[order[lo:hi]].tobytes(), b"") for b, lo, hi in zip(names, first.tolist(), ends.tolist(), strict=True)]


def _later(table: pa.Table, kind: int) -> pa.Table:
    """For every block those of its keys that an earlier one has."""
    key, block = _joined(table, "u"), _owners(table)
    order = np.lexsort((block, key))
    key, block = key[order], block[order]
    again = np.flatnonzero(key[1:] == key[:-1]) + 1
    return _table(_by_block(block[again], kind, key[again]), _NOTES)


def _settle(buckets: int, hot: int):
    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < buckets:
            return _later(table, KEYS)
        a, least, block = _joined(table, "u"), _joined(table, "v"), _owners(table)
        top, n, at = least.copy(), np.ones(len(a), np.int64), 0
        for u, w in zip(table.column("u").to_pylist(), table.column("w").to_pylist(), strict=True):
            more = np.frombuffer(w, _MORE)
            top[at + more["at"]], n[at + more["at"]] = more["top"], more["n"]
            at += len(u) // 8
        order = np.argsort(a, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], a[order][1:] != a[order][:-1]]))
        size = np.diff(np.append(first, len(a)))
        several = np.minimum.reduceat(least[order], first) != np.maximum.reduceat(top[order], first)
        kind = np.where(np.add.reduceat(n[order], first) > hot, 2, 1).astype(np.uint8)
        kept = order[np.repeat(several, size)]
        return _table(_by_block(block[kept], ANCHORS, a[kept], np.repeat(kind[several], size[several])), _NOTES)

    return run


def _told(notes: pa.Table, kind: int, column: str = "u", dtype=U) -> np.ndarray:
    rows = [x for k, x in zip(notes.column("kind").to_pylist(), notes.column(column).to_pylist(), strict=True) if k == kind]
    return np.concatenate([np.frombuffer(x, dtype) for x in rows] or [np.zeros(0, dtype)])


def _among(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are known, and their places among the sorted known ones."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


def _decided(own: tuple[np.ndarray, ...], notes: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of a block's anchors stand in a repeated context, which go to a suffix array, and whose windows are told apart."""
    key = _key(own[3], own[4])
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    again |= _among(key, np.sort(_told(notes, KEYS)))[0]
    known, kinds = _told(notes, ANCHORS), _told(notes, ANCHORS, "v", np.uint8)
    order = np.argsort(known, kind="stable")
    there, at = _among(own[3], known[order])
    kind = np.where(there, kinds[order][at], 0) if len(known) else np.zeros(len(key), np.uint8)
    return again, ~again & (kind == 1), ~again & (kind == 2)


def _windows(whole: Block, own: tuple[np.ndarray, ...], hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and hash of all windows of the hot anchors' contexts, in order, each place once."""
    text, lo, hi, _, _, part, place = (x[hot] for x in own)
    outs = []
    for p in np.unique(part).tolist():
        mine = np.flatnonzero(part == p)
        n = np.maximum(hi[mine] - lo[mine] - whole.length + 1, 0)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(place[mine], n) + step
        at, first = np.unique(at, return_index=True)
        sums = kernel.prefix_sums(whole.parts[p][2])
        outs.append((np.repeat(text[mine], n)[first], (np.repeat(lo[mine], n) + step)[first], kernel.range_hash(sums, at, at + whole.length)))
    if not outs:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U)
    return tuple(np.concatenate(x) for x in zip(*outs, strict=True))


def _contexts(length: int, buckets: int, more: int):
    """The bytes of unequal contexts, in buckets by anchor; and the first windows of hot anchors, in ``more`` buckets by window."""

    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not docs.num_rows or not notes.num_rows:
            return _table([], _RAW)
        block = docs.column("block")[0].as_py()
        whole = Block(docs, length)
        own = whole.anchors()
        _, raw, hot = _decided(own, notes)
        windows = np.unique(_windows(whole, own, hot)[2])
        rows = [(buckets + b, block, windows[lo:hi].tobytes(), b"", b"", b"") for b, lo, hi in _buckets(windows, more)]
        text, lo, hi, a, _, part, place = (x[raw] for x in own)
        order = np.argsort(a, kind="stable")
        text, lo, hi, a, part, place = (x[order] for x in (text, lo, hi, a, part, place))
        for b, first, last in _buckets(a, buckets):
            s = slice(first, last)
            size = hi[s] - lo[s]
            held = b"".join(whole.parts[p][2][q : q + n].tobytes() for p, q, n in zip(part[s].tolist(), place[s].tolist(), size.tolist(), strict=True))
            rows.append((b, block, text[s].astype("<u4").tobytes(), lo[s].astype("<u4").tobytes(), size.astype("<u2" if length < 30_000 else "<u4").tobytes(), held))
        return _table(rows, _RAW)

    return run


def intervals(common: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """First, last and depth of every interval of at least ``least`` of the tree over ``common``.

    ``common[i]`` is the length that suffix i shares with suffix i + 1; an interval
    closes when a shorter one follows.
    """
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate(common.tolist()):
        lo = i
        while stack and stack[-1][1] > depth:
            lo, top = stack.pop()
            yield lo, i, top
        if depth >= least and (not stack or stack[-1][1] < depth):
            stack.append((lo, depth))
    while stack:
        lo, top = stack.pop()
        yield lo, len(common), top


def maximal_repeats(data: np.ndarray, bounds: np.ndarray, where: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, int]]:
    """Occurrences (places in ``data``) and length of every maximal repeat of ``length`` bytes or more.

    ``bounds`` has the ends of the strings in ``data``; ``where`` a number for each place, equal for one
    place of a text that stands in several strings. Only windows whose hash stands at
    two places enter the suffix array.
    """
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    room = bounds[owner + 1] - np.arange(len(data))
    start = np.flatnonzero(room >= length)
    if len(start) < 2:
        return
    sums = kernel.prefix_sums(data)
    hashes = kernel.range_hash(sums, start, start + length)
    order = np.lexsort((where[start], hashes))
    h, w = hashes[order], where[start][order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    group = np.cumsum(new) - 1
    places = np.bincount(group, new | np.concatenate([[True], w[1:] != w[:-1]]))
    kept = places[group] > 1
    start, group = start[order[kept]], group[kept]
    # suffixes that share ``length`` bytes have one hash; each array holds all suffixes of some hashes
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    lo = 0
    while lo < len(start):
        k = int(np.searchsorted(cuts, lo + SUFFIXES, "right"))
        hi = len(start) if k == len(cuts) else max(int(cuts[k - 1]), int(cuts[np.searchsorted(cuts, lo, "right")]))
        yield from _tree(data, bounds, owner, room, np.sort(start[lo:hi]), length)
        lo = hi


def _tree(data: np.ndarray, bounds: np.ndarray, owner: np.ndarray, room: np.ndarray, start: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, int]]:
    width = int(room[start].max())
    matrix = data[np.minimum(start[:, None] + np.arange(width), len(data) - 1)]
    matrix[np.arange(width) >= room[start][:, None]] = 0
    suffix = np.argsort(matrix.view(f"S{width}").ravel(), kind="stable")
    start, matrix = start[suffix], matrix[suffix]
    same = matrix[1:] == matrix[:-1]
    common = np.where(same.all(axis=1), width, same.argmin(axis=1))
    common = np.minimum(common, np.minimum(room[start[1:]], room[start[:-1]]))
    inner = start > bounds[owner[start]]
    before = np.where(inner, data[np.maximum(start - 1, 0)].astype(np.int64), -1)
    # runs of one byte before: an interval within a run has no other
    run = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])]).tolist()
    known = inner.tolist()
    for lo, hi, depth in intervals(common, length):
        if known[lo] and run[lo] == run[hi]:
            continue  # the repeat goes on to the left
        yield start[lo : hi + 1], depth


def _repeats(length: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= buckets:
            return _later(table, WINDOWS)
        u4 = lambda name, kind="<u4": np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()]).astype(np.int64)
        text, start, size = u4("u"), u4("start"), u4("size", "<u2" if length < 30_000 else "<u4")
        block = np.repeat(table.column("block").to_numpy(), [len(x) // 4 for x in table.column("u").to_pylist()]).astype(np.int64)
        data = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("bytes").to_pylist()])
        bounds = np.concatenate([[0], np.cumsum(size)])
        # one number for each text and place, in the order of the corpus
        order = np.lexsort((start, text, block))
        changed = np.concatenate([[True], (block[order][1:] != block[order][:-1]) | (text[order][1:] != text[order][:-1])])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(changed) - 1
        owner = np.repeat(np.arange(len(size)), size)
        inside = start[owner] + np.arange(len(data)) - bounds[owner]
        where = (rank[owner] << 32) | inside
        out_owner, out_lo, out_n = [], [], []
        for places, depth in maximal_repeats(data, bounds, where, length):
            at = where[places]
            later = places[at > at.min()]
            out_owner.append(owner[later])
            out_lo.append(inside[later])
            out_n.append(np.full(len(later), depth))
        if not out_owner:
            return _table([], _NOTES)
        own, lo, n = np.concatenate(out_owner), np.concatenate(out_lo), np.concatenate(out_n)
        begin = (rank[own] << 32) | lo
        order = np.argsort(begin, kind="stable")
        own, begin, end = own[order], begin[order], (begin + n)[order]
        reach = np.maximum.accumulate(end)
        first = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
        own, lo, hi = own[first], begin[first] & 0xFFFFFFFF, reach[np.append(first[1:], len(own)) - 1] & 0xFFFFFFFF
        names, first = np.unique(block[own], return_index=True)  # ranks follow the blocks
        ends = np.append(first[1:], len(own))
        return _table([(int(b), SPANS, text[own[i:j]].astype("<u4").tobytes(), lo[i:j].astype("<u4").tobytes(), hi[i:j].astype("<u4").tobytes()) for b, i, j in zip(names, first.tolist(), ends.tolist(), strict=True)], _NOTES)

    return run


_RESULT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]


def _cut_out(length: int, keep_text: bool):
    types = [*_RESULT, *([("kept_text", pa.string())] if keep_text else [])]

    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], types)
        whole = Block(docs, length)
        own = whole.anchors()
        repeat, _, hot = _decided(own, notes)
        text, lo, hi = ([x[repeat]] for x in own[:3])
        for column, name in zip((text, lo, hi), "uvw", strict=True):
            column.append(_told(notes, SPANS, name, "<u4").astype(np.int64))
        owner, start, window = _windows(whole, own, hot)
        again = np.ones(len(window), bool)
        again[np.unique(window, return_index=True)[1]] = False
        again |= _among(window, np.sort(_told(notes, WINDOWS)))[0]
        for column, values in zip((text, lo, hi), (owner, start, start + length), strict=True):
            column.append(values[again])
        text, lo, hi = (np.concatenate(x) for x in (text, lo, hi))
        order = np.argsort(text, kind="stable")
        text, lo, hi = text[order], lo[order], hi[order]
        rows = []
        for row, last, data, offsets in whole.parts:
            i, j = np.searchsorted(text, (row, last))
            base = offsets[text[i:j] - row]
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, base + lo[i:j], 1)
            np.add.at(change, base + hi[i:j], -1)
            gone = np.cumsum(change[:-1]) > 0
            touched = set((text[i:j] - row).tolist())
            for k in range(last - row):
                raw = data[offsets[k] : offsets[k + 1]]
                removed = spans = 0
                if k in touched:
                    mask = gone[offsets[k] : offsets[k + 1]]
                    removed = int(mask.sum())
                    spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = raw[~mask].tobytes()
                else:
                    kept = raw.tobytes()
                more = (kept.decode("utf-8", "ignore"),) if keep_text else ()
                rows.append((whole.ids[row + k], len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), *more))
        return _table(rows, types)

    return run


def remove_repeats(docs: DataFrame, length: int = 100, keep_text: bool = False, each: int = EACH, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept_text``) for every row of ``docs``.

    Every byte that lies in a string of ``length`` bytes which also starts
    earlier (in a smaller doc_id, or earlier in the same text) is removed; matches stay within a
    text and are judged on the input. Null texts count as empty; texts may have any length. Rows of one doc_id
    are ordered by text; of equal rows one counts as the earlier. Null
    doc_ids come before all others, in an order of their texts. ``kept_text`` drops bytes of characters that a cut tears apart.
    Blocks hold about ``each`` bytes of text; ``hot`` is the number of unequal contexts beyond which an anchor's windows are dealt one by one.
    """
    if length <= SEED:
        raise ValueError(f"length must be over {SEED}")
    spark = docs.sparkSession
    kernel.small_batches(spark)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = idblocks.blocks(named, idblocks.number(named, each))
    n = found.count
    laid = dealt(named.withColumn("block", even(found.of(F.col("doc_id"), F.col("text")), n, spark)), n, "block")
    counted = laid.groupBy("block").applyInArrow(kernel.lean(_count(length, n)), _schema(_COUNTED))
    notes = counted.groupBy("bucket").applyInArrow(kernel.lean(_settle(n, hot)), _schema(_NOTES))
    raw = laid.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(kernel.lean(_contexts(length, FINER * n, n)), _schema(_RAW))
    spans = raw.groupBy("bucket").applyInArrow(kernel.lean(_repeats(length, FINER * n)), _schema(_NOTES))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text
    return laid.groupBy("block").cogroup(notes.unionByName(spans).groupBy("block")).applyInArrow(kernel.lean(_cut_out(length, keep_text)), schema)
