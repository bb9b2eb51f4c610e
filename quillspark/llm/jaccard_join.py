"""Documents whose n-gram sets overlap, as a blocked product of the incidence matrix.

The matrix has a row per document and a column per word n-gram. Columns that one
row alone has match nothing: a row with so many of them that the bound is out of
reach leaves at once, and equal rows become one. The other columns are put in
one order, rarest first. Two rows that reach the bound share a column among the first
few of both, so rows meet in bundles: all rows that have a column among their first few
go to the bundle named after one of them. A bundle is cut into blocks of rows, and each pair of
blocks is a tile of the product: overlaps of its rows are summed over the columns, rare
ones first and common ones as dense matrices, and a pair is discarded as soon as the columns left
can't lift it over the bound that its sizes give. Pairs never leave their tile: a tile gives each of
its rows the number of its links and one row that links lead to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import idblocks, kernel
from quillspark.llm.kernel import U
from quillspark.operators.graph import connected_components
from quillspark.session import PARTITIONS, cut, dealt, even, shares, stored

#: Columns below this hash are counted over all documents; a row that has too many of them
#: for itself alone is out. All columns of the rows that are left, equal ones as one, are counted then.
FIRST_HALF = U(1 << 63)
_ROWS = "doc_id long, n long, sig binary, first boolean, body binary"
#: Rows of one side of a tile; small bundles are multiplied together up to half as many rows.
SIDE = 1024
#: Cells of a tile for which a column's products are cheaper as dense matrices than one by one.
DENSE = 512
#: Columns of one dense product, and products of rare columns that are held at once.
CHUNK, PRODUCTS = 512, 1 << 20
#: Text and tile bytes for one block and one task.
EACH, TILE_BYTES = 14 << 20, 16 << 20


def _least(n: np.ndarray | int, num: int, den: int):
    """The smallest overlap of a set of ``n`` with any set that links to it."""
    return -(-num * n // den)


def _sets(table: pa.Table, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each text's distinct n-grams, sorted, by blocks of rows."""
    for row, _, data, offsets in kernel.blocks(table.column("text")):
        starts, ends, first = kernel.words(data, offsets, kernel.SPACED)
        hashes = kernel.range_hash(kernel.prefix_sums(data, kernel.LOWERED), starts, ends)
        grams, bounds = kernel.shingles(hashes, first, width)
        yield row, [np.unique(grams[bounds[i] : bounds[i + 1]]) for i in range(len(bounds) - 1)]


def _counted(own: list[np.ndarray], block: int, n_buckets: int, bits: int) -> pa.Table:
    """The columns of one block with how many of its rows have them, by ``n_buckets`` equal ranges of ``bits``-bit numbers."""
    keys, counts = np.unique(np.concatenate(own) if own else np.zeros(0, U), return_counts=True)
    bucket = ((keys >> U(bits - 32)) * U(n_buckets)) >> U(32)
    names, first = np.unique(bucket, return_index=True)
    bounds = np.append(first, len(keys)).tolist()
    rows = []
    for b, lo, hi in zip(names.tolist(), bounds[:-1], bounds[1:], strict=True):
        many = np.flatnonzero(counts[lo:hi] > 1).astype("<u4")
        rows.append((b, block, keys[lo:hi].tobytes(), many.tobytes() + counts[lo:hi][many].astype("<u4").tobytes()))
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "keys", "many"])


def _count(n_buckets: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        own = [s[: np.searchsorted(s, FIRST_HALF)] for _, sets in _sets(table, width) for s in sets]
        return _counted(own, table.column("block")[0].as_py(), n_buckets, 63)

    return run


def _count_rows(n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        return _counted([np.frombuffer(x, U) for x in table.column("body").to_pylist()], table.column("block")[0].as_py(), n_buckets, 64)

    return run


def _totals(table: pa.Table) -> pa.Table:
    """For every block its columns that more than one document has, with how many."""
    keys, counts, owners = [], [], []
    blocks = table.column("block").to_numpy()
    for k, (raw, many) in enumerate(zip(table.column("keys").to_pylist(), table.column("many").to_pylist(), strict=True)):
        own = np.frombuffer(raw, U)
        n = np.ones(len(own), np.int64)
        at = np.frombuffer(many, "<u4")
        n[at[: len(at) // 2]] = at[len(at) // 2 :]
        keys.append(own)
        counts.append(n)
        owners.append(np.full(len(own), k, np.int32))
    key, count, owner = np.concatenate(keys), np.concatenate(counts), np.concatenate(owners)
    order = np.argsort(key, kind="stable")
    key, count, owner = key[order], count[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    total = np.repeat(np.add.reduceat(count, first), np.diff(np.append(first, len(key))))
    kept = total > 1
    key, total, owner = key[kept], total[kept], owner[kept]
    order = np.argsort(owner, kind="stable")
    key, total, bounds = key[order], total[order], np.searchsorted(owner[order], np.arange(len(blocks) + 1))
    rows = [(int(blocks[k]), key[bounds[k] : bounds[k + 1]].tobytes(), np.minimum(total[bounds[k] : bounds[k + 1]], 0xFFFFFFFF).astype("<u4").tobytes()) for k in range(len(blocks)) if bounds[k] < bounds[k + 1]]
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "keys", "totals"])


class _Totals:
    """Columns that more than one row has, with how many."""

    def __init__(self, freq: pa.Table) -> None:
        keys = np.concatenate([np.frombuffer(x, U) for x in freq.column("keys").to_pylist()] or [np.zeros(0, U)])
        totals = np.concatenate([np.frombuffer(x, "<u4") for x in freq.column("totals").to_pylist()] or [np.zeros(0, "<u4")])
        order = np.argsort(keys, kind="stable")
        self.keys, self.totals = keys[order], totals[order].astype(np.int64)

    def of(self, columns: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(len(columns), np.int64)
        at = np.minimum(np.searchsorted(self.keys, columns), len(self.keys) - 1)
        return np.where(self.keys[at] == columns, self.totals[at], 1)


def _reduce(num: int, den: int, width: int):
    def run(docs: pa.Table, freq: pa.Table) -> pa.Table:
        types = (pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.binary())
        out: tuple[list, ...] = ([], [], [], [], [])
        if docs.num_rows:
            docs = docs.sort_by("doc_id")
            totals = _Totals(freq)
            ids, sizes, sigs, bodies = docs.column("doc_id").to_pylist(), [], [], []
            for _, sets in _sets(docs, width):
                for own in sets:
                    sizes.append(len(own))
                    sigs.append(None)
                    bodies.append(None)
                    cutoff = int(np.searchsorted(own, FIRST_HALF))
                    shared = totals.of(own[:cutoff]) > 1
                    if len(own) and len(own) - int((~shared).sum()) >= _least(len(own), num, den):
                        sigs[-1] = np.array([len(own), kernel.mix(own + U(1)).sum(dtype=U), kernel.mix(own ^ U(0x5DEECE66D)).sum(dtype=U)], U).tobytes()
                        bodies[-1] = np.concatenate([own[:cutoff][shared], own[cutoff:]]).tobytes()
            # rows of one doc_id stand side by side; the smallest of their sets is the document's
            lo, known = 0, set()
            while lo < len(ids):
                hi = lo + 1
                while hi < len(ids) and ids[hi] == ids[lo]:
                    hi += 1
                sig = min((x for x in sigs[lo:hi] if x is not None), default=None)
                for k in range(lo, hi):
                    fresh = k == lo and sig is not None and sig not in known
                    for column, value in zip(out, (ids[k], sizes[k], sig, k == lo, bodies[sigs.index(sig, lo, hi)] if fresh else None), strict=True):
                        column.append(value)
                known.add(sig)
                lo = hi
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "n", "sig", "first", "body"])

    return run


_LEADS = "id long, n long, copies long, m long, lead array<long>, body binary"


def _lead(num: int, den: int):
    """Rows without the columns they have alone: size, shared columns, and the first few of those in the common order."""

    def run(rows: pa.Table, freq: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        if rows.num_rows:
            totals = _Totals(freq)
            for i, n, copies, body in zip(*(rows.column(c).to_pylist() for c in ("id", "n", "copies", "body")), strict=True):
                own = np.frombuffer(body, U)
                df = totals.of(own)
                own, df = own[df > 1], df[df > 1]
                need = _least(n, num, den)
                if len(own) >= need:
                    first = own[np.argsort(df, kind="stable")][: len(own) - need + 1]
                    for column, value in zip(out, (i, n, copies, len(own), first.view(np.int64), own.tobytes()), strict=True):
                        column.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["id", "n", "copies", "m", "lead", "body"])

    return run


class _Incidence:
    """Entries of a tile's two sides by column, for the columns that both have (or two rows, where the sides are one)."""

    def __init__(self, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None, shape: tuple[int, int]) -> None:
        self.shape = shape
        (a, ra), (b, rb) = left, right or left
        keys, at = np.unique(np.concatenate([a, b]) if right else a, return_inverse=True)
        at_a, at_b = at[: len(a)], at[len(a) :] if right else at
        self.ca, self.cb = np.bincount(at_a, minlength=len(keys)), np.bincount(at_b, minlength=len(keys))
        self.ra, self.pa = ra[np.argsort(at_a, kind="stable")], np.concatenate([[0], np.cumsum(self.ca)])
        self.rb, self.pb = rb[np.argsort(at_b, kind="stable")], np.concatenate([[0], np.cumsum(self.cb)])
        cost = self.ca * self.cb
        common = (cost > 0) if right else (cost > 1)
        dense = cost > max(16, shape[0] * shape[1] // DENSE)
        self.rare = np.flatnonzero(common & ~dense)
        dense = np.flatnonzero(common & dense)
        self.dense = dense[np.argsort(cost[dense], kind="stable")]

    def entries(self, columns: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of some columns, and for each the column's number among them."""
        rows, bounds, counts = ((self.ra, self.pa, self.ca), (self.rb, self.pb, self.cb))[side]
        n = counts[columns]
        which = np.repeat(np.arange(len(columns)), n)
        at = np.arange(len(which)) + np.repeat(bounds[columns] - (np.cumsum(n) - n), n)
        return rows[at], which

    def rare_product(self) -> np.ndarray:
        """Overlaps over the rare columns, product by product."""
        total = np.zeros(self.shape[0] * self.shape[1], np.float32)
        ends = np.cumsum(self.ca[self.rare] * self.cb[self.rare])
        k = 0
        while k < len(self.rare):
            last = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PRODUCTS, "right")))
            columns = self.rare[k:last]
            rows, which = self.entries(columns, 0)
            n = self.cb[columns][which]
            first = np.repeat(rows * self.shape[1], n)
            at = np.arange(len(first)) + np.repeat(self.pb[columns][which] - (np.cumsum(n) - n), n)
            total += np.bincount(first + self.rb[at], minlength=len(total))
            k = last
        return total.reshape(self.shape)

    def dense_product(self, columns: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
        """Overlaps of the rows ``ra`` and ``rb`` over some columns, as a product of matrices."""
        sides = []
        for side, rows in enumerate((ra, rb)):
            place = np.full(self.shape[side], -1)
            place[rows] = np.arange(len(rows))
            own, which = self.entries(columns, side)
            matrix = np.zeros((len(rows), len(columns)), np.float32)
            kept = place[own] >= 0
            matrix[place[own][kept], which[kept]] = 1
            sides.append(matrix)
        return sides[0] @ sides[1].T


def product(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None, need: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Which pairs of ``alive`` share ``need`` columns; each side has its columns and the row of each, ``right`` is None if both are one.

    Overlaps are summed column by column, rarest first; pairs that the columns left can't lift to
    ``need`` are discarded, and rows without a pair leave the product.
    """
    own = _Incidence(left, right, need.shape)
    total = own.rare_product()
    rest = [np.bincount(own.entries(own.dense, side)[0], minlength=n) for side, n in enumerate(need.shape)]
    alive = alive & (total + np.minimum(rest[0][:, None], rest[1][None, :]) >= need)
    for k in range(0, len(own.dense), CHUNK):
        ra, rb = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(ra):
            break
        columns = own.dense[k : k + CHUNK]
        total[np.ix_(ra, rb)] += own.dense_product(columns, ra, rb)
        rest = [x - np.bincount(own.entries(columns, side)[0], minlength=n) for side, (x, n) in enumerate(zip(rest, need.shape, strict=True))]
        alive &= total + np.minimum(rest[0][:, None], rest[1][None, :]) >= need
    return alive


def _flat(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary or list column, and the row of each."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if pa.types.is_binary(column.type):
        data = column.buffers()[2]
        values = np.frombuffer(data, kind, (offsets[-1] - offsets[0]) // 8, int(offsets[0])) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, kind)
        sizes = np.diff(offsets) // 8
    else:
        values, sizes = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(kind), np.diff(offsets)
    return values, np.repeat(np.arange(len(sizes)), sizes)


def _roots(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For both sides' rows the smallest row that links lead to; rows of the right side come after those of the left."""
    a, b = links.shape
    top, left, right = a + b, np.arange(a), a + np.arange(b)
    while True:
        new = np.minimum(right, np.where(links, left[:, None], top).min(axis=0, initial=top))
        left = np.minimum(left, np.where(links, new[None, :], top).min(axis=1, initial=top))
        if (new == right).all():
            return left, right
        right = new


def _tile(table: pa.Table, num: int, den: int) -> list[np.ndarray]:
    """Of the rows of one tile, or of some bundles of one tile each, those that link: id, a row that links lead to, links."""
    ids, n, m, copies = (table.column(c).to_numpy() for c in ("id", "n", "m", "copies"))
    bundle, i, j, sub = (table.column(c).to_numpy() for c in ("bundle", "i", "j", "sub"))
    columns, row = _flat(table.column("body"), U)
    smaller, owner = _flat(table.column("smaller"), np.int64)
    one = i[0] == j[0]
    tile = np.concatenate([[0], np.cumsum((bundle[1:] != bundle[:-1]) | (i[1:] != i[:-1]))])
    if tile[-1]:  # tiles side by side have no column in common
        columns = columns ^ kernel.mix(tile.astype(U))[row]
    if one:
        sides = [np.arange(len(ids))] * 2
    else:
        sides = [np.flatnonzero(sub == i[0]), np.flatnonzero(sub == j[0])]
    if not all(map(len, sides)):
        return []

    def entries(values: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        if one:
            return [(values, rows), None]
        out = []
        for side in sides:
            place = np.full(len(ids), -1)
            place[side] = np.arange(len(side))
            kept = place[rows] >= 0
            out.append((values[kept], place[rows][kept]))
        return out

    a, b = sides
    need = -(-num * (n[a][:, None] + n[b][None, :]) // (num + den))
    alive = np.minimum(m[a][:, None], m[b][None, :]) >= need
    if one:
        alive &= np.tri(len(a), k=-1, dtype=bool).T
    if len(smaller):  # rows that meet in a smaller bundle too count there
        alive &= ~product(*entries(smaller, owner), np.ones(need.shape), np.ones(need.shape, bool))
    if not alive.any():
        return []
    links = product(*entries(columns, row), need, alive)
    if not links.any():
        return []
    if one:
        links = links | links.T
    left, right = _roots(links | np.eye(len(a), dtype=bool) if one else links)
    weight = [links @ copies[b].astype(float), copies[a].astype(float) @ links]
    place = np.concatenate([a, b])
    some = [np.flatnonzero(w) for w in weight]
    parts = [(ids[a][some[0]], ids[place[left[some[0]]]], weight[0][some[0]])]
    if not one:
        parts.append((ids[b][some[1]], ids[place[right[some[1]]]], weight[1][some[1]]))
    return [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one tile after the other; small tiles of whole bundles come together."""
    ready, now, last = [], [], None
    count = lambda parts: sum(hi - lo for _, lo, hi in parts)
    table = lambda parts: pa.Table.from_batches([x.slice(lo, hi - lo) for x, lo, hi in parts])

    def joined(parts: list, more: list) -> list:
        for part in more:
            if parts and parts[-1][0] is part[0] and parts[-1][2] == part[1]:
                parts[-1] = (part[0], parts[-1][1], part[2])
            else:
                parts.append(part)
        return parts

    def closed() -> Iterator[pa.Table]:
        nonlocal ready, now
        alone = bool(now) and last[1] != last[2]
        if ready and (alone or count(ready) + count(now) > SIDE // 2):
            yield table(ready)
            ready = []
        if alone:
            yield table(now)
        else:
            ready = joined(ready, now)
        now = []

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("bundle", "i", "j")], axis=1).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
            key = tuple(keys[lo].tolist())
            if key != last:
                if now:
                    yield from closed()
                last = key
            now.append((batch, lo, hi))
    if now:
        yield from closed()
    if ready:
        yield table(ready)


def _links(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel.release()
        for table in _tiles(batches):
            if found := _tile(table, num, den):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["id", "root", "links"])
        kernel.release()

    return run


def _bundled(leads: DataFrame) -> DataFrame:
    """``leads`` once for every tile they take part in, dealt by tile: bundle, the tile's blocks ``i`` and ``j``, the row's own (``sub``)."""
    spark = leads.sparkSession
    postings = leads.select("id", F.explode("lead").alias("h"))
    heads = postings.groupBy("h").agg(F.min(F.struct(F.xxhash64("id").alias("r"), "id"))["id"].alias("bundle"), F.count("*").alias("c")).where("c > 1").select("h", "bundle")
    member = stored(postings.join(heads, "h").select("id", "bundle").distinct(), "jaccard-bundles")
    sizes = member.groupBy("bundle").agg(F.count("*").alias("c")).where("c > 1").select("bundle", "c", F.ceil(F.col("c") / SIDE).cast("long").alias("blocks"))
    rows = sizes.agg(F.sum(F.col("c") * F.col("blocks")).alias("n")).first().n or 0
    wide = leads.agg(F.avg("m").alias("m")).first().m or 0
    parts = int(min(PARTITIONS, max(2 * spark.sparkContext.defaultParallelism, -(-rows * (8 * wide + 100) // TILE_BYTES))))
    own = member.join(sizes.select("bundle", "blocks"), "bundle").groupBy("id").agg(F.collect_list(F.struct("bundle", "blocks")).alias("own"))
    one = leads.select("id", "n", "copies", "m", "body").join(own, "id")
    each = one.select("id", "n", "copies", "m", "body", F.explode("own").alias("o"), "own")
    each = each.select("id", "n", "copies", "m", "body", F.col("o.bundle").alias("bundle"), F.expr("transform(filter(own, x -> x.bundle < o.bundle), x -> x.bundle)").alias("smaller"), F.col("o.blocks").alias("blocks"))
    each = each.withColumn("sub", F.pmod(F.xxhash64("id", "bundle"), F.col("blocks")))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    each = each.withColumn("i", F.least("sub", "other")).withColumn("j", F.greatest("sub", "other")).drop("other", "blocks")
    # tiles of one bundle go to partitions one after the other
    part = F.pmod(F.pmod(F.xxhash64("bundle"), F.lit(parts)) + F.expr("j * (j + 1) div 2") + F.col("i"), F.lit(parts)).cast("int")
    return each.withColumn("part", part).repartitionById(parts, "part").drop("part").sortWithinPartitions("bundle", "i", "j")


def classes(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100, each: int = EACH) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row of ``docs`` (``doc_id``, ``text``).

    Two documents link when ``den * intersection >= num * union`` of their sets
    of ``width``-word shingles (words: runs without ASCII white space, A-Z
    lower-cased). ``component_id`` is the smallest doc_id that links reach, ``n_links`` how many other
    documents a document links with, copies counted one by one. A
    text of fewer words is one shingle; null, empty and blank texts have none
    and link with nothing. Rows with a null doc_id link with nothing and keep a
    null component. Repeated rows are kept; rows of one doc_id count as one document, with
    the set that sorts first by size where their texts differ.

    Copies are one row of the product. Links between different sets are counted, not listed, tile by tile;
    ``k`` near copies of each other, all different, take ``(k / SIDE) ** 2 / 2`` tiles.
    """
    spark = docs.sparkSession
    kernel.small_batches(spark)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_blocks = idblocks.number(named, each)
    block = even(F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int"), n_blocks, spark)
    laid = dealt(named.where("doc_id is not null").select("doc_id", "text", block.alias("block")), n_blocks, "block")
    counted = laid.groupBy("block").applyInArrow(kernel.lean(_count(n_blocks, width)), "bucket int, block int, keys binary, many binary")
    totals = counted.groupBy("bucket").applyInArrow(kernel.lean(_totals), "block int, keys binary, totals binary")
    reduced = stored(laid.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(kernel.lean(_reduce(num, den, width)), _ROWS), "jaccard-rows")

    alike = reduced.where("first AND sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    rows = reduced.where("body IS NOT NULL").withColumnRenamed("doc_id", "id").join(alike.select("id", "copies"), "id").select("id", "n", "copies", "body")
    n_rows = shares(reduced, each)
    rows = dealt(rows.withColumn("block", even(F.pmod(F.xxhash64("id"), F.lit(n_rows)).cast("int"), n_rows, spark)), n_rows, "block")
    totals = rows.groupBy("block").applyInArrow(kernel.lean(_count_rows(n_rows)), "bucket int, block int, keys binary, many binary").groupBy("bucket").applyInArrow(kernel.lean(_totals), "block int, keys binary, totals binary")
    leads = stored(rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(kernel.lean(_lead(num, den)), _LEADS), "jaccard-leads")

    found = stored(_bundled(leads).mapInArrow(_links(num, den), "id long, root long, links long"), "jaccard-links")
    joined = connected_components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    alike = alike.join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(joined, "id", "left")
    alike = alike.select("sig", F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = reduced.where("sig IS NOT NULL").join(alike, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = reduced.where("sig IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    nameless = named.where("doc_id IS NULL").select("text").mapInArrow(_sizes(width), "n_shingles long")
    nameless = nameless.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone).unionByName(nameless)


def _sizes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [len(s) for _, sets in _sets(pa.Table.from_batches([batch]), width) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["n_shingles"])

    return run


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` but those with a smaller doc_id in their class, all columns as they were.

    Null doc_ids, null and empty texts stay; rows of one doc_id stay or go together.
    """
    later = classes(docs, **options).where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(stored(later, "later-copies"), "doc_id", "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
