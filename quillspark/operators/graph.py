"""Graph operators over edge frames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import LABELLED, added, cut, dealt, dropped, even_labels, freed, fresh, leaf_bytes, moved

#: Pairs of users that one block counts, about, and that it sorts at once; rows whose lists are packed together.
BLOCK_PAIRS, SORTED_PAIRS, PACKED_ROWS = 8_000_000, 4_000_000, 250_000
#: Bytes of tables that are joined at once; places in lists that are dealt at once, or so many times the rows where that is more.
JOINED_BYTES, DEALT_PLACES, DEALT_TIMES = 300 << 20, 64_000_000, 4
#: Vertices and edges, times sources, that are searched at once (their arrays fit a core's cache); vertices of small components in one task, about.
CELLS, SMALL_VERTICES = 100_000, 1_000
#: Vertices on cycles whose paths a task holds at most (10 bytes a pair); pairs that are weighed at once; numbers of paths beyond which sums are not exact; cuts that tasks look ahead at first.
CORE, WEIGHED, EXACT, AHEAD = 8_000, 1 << 20, 2.0**50, 250
#: The distance of vertices without a path.
FAR = np.int16(30_000)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``id, component`` (the smallest id that links reach) for every vertex of an edge.

    Alternates two contractions: every vertex hands its larger neighbours, then its
    smaller ones, to the smallest it knows. The number of rounds follows the
    logarithm of the longest path. Loops are dropped; an empty frame gives an
    empty result. One row at most a round comes to the driver; a round's table goes when the next one is there.
    """
    with freed(edges.sparkSession):
        now = _settled(edges, most)
    heads = now.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(heads)


def _settled(edges: DataFrame, most: int) -> DataFrame:
    """``src, dst``: every vertex but the smallest of its component, and that one."""
    now = moved(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct(), "graph-links")
    for _ in range(most):
        ways = both_ways(now)
        least = ways.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("least"))
        large = ways.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct()
        down = large.groupBy("src").agg(F.min("dst").alias("least"))
        pulled = large.join(down, "src").where("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        before, now = now, moved(pulled.unionByName(down.select("src", F.col("least").alias("dst"))).where("src <> dst").distinct(), "graph-links")
        dropped(before)
        # stars: every vertex has one edge down, and none of those ends has one
        rows = now.select("src", F.lit(1).alias("out"), F.lit(0).alias("in_")).unionByName(now.select(F.col("dst").alias("src"), F.lit(0).alias("out"), F.lit(1).alias("in_")))
        if rows.groupBy("src").agg(F.sum("out").alias("o"), F.max("in_").alias("i")).where("o > 1 OR (o > 0 AND i > 0)").isEmpty():
            return now
    raise RuntimeError("components did not settle")


def shared_edges(pairs: DataFrame, user: str, item: str) -> DataFrame:
    """``src < dst, n``: users with common items, by an equality join on the item, never a product of users."""
    rows = pairs.select(F.col(user).alias("u"), F.col(item).alias("i")).distinct()
    left, right = rows.select(F.col("u").alias("src"), "i"), rows.select(F.col("u").alias("dst"), "i")
    return left.join(right, "i").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _squeezed(x: np.ndarray) -> bytes:
    """Differences of int64 numbers, with the sign in the lowest bit, byte by byte of their places, compressed."""
    steps = np.diff(x, prepend=np.int64(0))
    steps = (steps << 1) ^ (steps >> 63)
    return len(x).to_bytes(8, "little") + pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _loosened(x: bytes) -> np.ndarray:
    size = int.from_bytes(x[:8], "little")
    planes = np.frombuffer(pa.decompress(x[8:], 8 * size, "zstd", asbytes=True), np.uint8).reshape(8, size)
    steps = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum((steps >> np.uint64(1)).view(np.int64) ^ -(steps & np.uint64(1)).view(np.int64))


def _hashes(users: np.ndarray) -> np.ndarray:
    """Other numbers for users, a different one for each."""
    h = users.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _blocks(users: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each user, rising with its hash; pairs belong to the lower of two blocks, so lower ones have fewer users and all about as many pairs."""
    left = 1 - (_hashes(users) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.minimum((blocks * (1 - left * left)).astype(np.int64), blocks - 1)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of the item: lists of whole items with two users at least, users in order of their hashes, each once."""

    def fold(users: np.ndarray, items: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((_hashes(users), items))
        users, items = users[order], items[order]
        new = np.append(True, (items[1:] != items[:-1]) | (users[1:] != users[:-1]))
        users, items = users[new], items[new]
        sizes = np.diff(np.flatnonzero(np.append(True, items[1:] != items[:-1])), append=len(items))
        users, sizes = users[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
        if len(sizes):
            pairs = float((sizes * (sizes - 1.0)).sum() / 2)
            yield pa.RecordBatch.from_arrays([pa.array([_squeezed(users)], pa.binary()), pa.array([_squeezed(sizes)], pa.binary()), pa.array([len(users)], pa.int64()), pa.array([pairs])], names=["users", "sizes", "places", "pairs"])

    held, rows = [], 0
    for batch in batches:
        held.append([batch.column(k).to_numpy() for k in (0, 1)])
        rows += batch.num_rows
        if rows >= PACKED_ROWS:
            users, items = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = int(np.searchsorted(items, items[-1]))  # the last item may go on
            if whole:
                yield from fold(users[:whole], items[:whole])
            held = [[users[whole:], items[whole:]]]
            rows = len(users) - whole
    if rows:
        yield from fold(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _packed(blocks: int, rounds: int, now: int, labels: np.ndarray):
    """From folded lists: for every block of the round ``now`` the items of its users, each with those users and all of later blocks."""

    def pack(users: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(sizes)
        block = _blocks(users, blocks)
        new = np.append(True, block[1:] != block[:-1])
        new[ends[:-1]] = True
        starts = np.flatnonzero(new)
        own, at = np.diff(starts, append=len(users)), block[starts]
        size = ends[np.searchsorted(ends, starts, "right")] - starts
        starts, own, size, at = (x[(size > 1) & (at % rounds == now)] for x in (starts, own, size, at))
        if not len(at):
            return
        order = np.argsort(at, kind="stable")
        starts, own, size, at = (x[order] for x in (starts, own, size, at))
        bounds = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        rows = [[_squeezed(x) for x in (own[lo:hi], size[lo:hi], users[_ranges(starts[lo:hi], size[lo:hi])])] for lo, hi in zip(bounds, [*bounds[1:], len(at)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(labels[at[bounds] // rounds], pa.int32()), *[pa.array(c, pa.binary()) for c in zip(*rows, strict=True)]], names=["block", "own", "size", "users"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for users, sizes in zip(batch.column(0), batch.column(1), strict=True):
                yield from pack(_loosened(users.as_py()), _loosened(sizes.as_py()))

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Users, pairs of their places in that (of 32 bits each) and ``n`` of all pairs of the blocks in a partition, each pair once; some users' pairs at a time."""
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    blocks = table.column("block").to_numpy() if table is not None else np.empty(0, int)
    for block in np.unique(blocks).tolist():
        part = table.filter(pa.array(blocks == block))
        own, size, users = (np.concatenate([_loosened(x.as_py()) for x in part.column(c)]) for c in ("own", "size", "users"))
        names, users = np.unique(users, return_inverse=True)
        users = users.astype(np.uint32)
        starts = np.cumsum(size) - size
        at = _ranges(starts, own)  # where a user of the block stands
        later = np.repeat(starts + size, own) - at - 1
        order = np.argsort(users[at], kind="stable")
        at, later = at[order], later[order]
        firsts = np.flatnonzero(np.append(True, users[at[1:]] != users[at[:-1]]))  # where a user's rows begin
        done = np.append(0, np.cumsum(later))
        lo = 0
        while lo < len(at):
            hi = firsts[np.searchsorted(done[firsts], done[lo] + SORTED_PAIRS, "right") - 1] if done[-1] - done[lo] > SORTED_PAIRS else len(at)
            if hi <= lo:  # one user has more
                hi = np.append(firsts, len(at))[np.searchsorted(firsts, lo, "right")]
            pairs = (np.repeat(users[at[lo:hi]].astype(np.uint64), later[lo:hi]) << np.uint64(32)) | users[_ranges(at[lo:hi] + 1, later[lo:hi])]
            pairs.sort()
            new = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.empty(0, int)
            yield names, pairs[new], np.diff(new, append=len(pairs))
            lo = hi


def _weighed(least: float):
    """Rows of ``n, pairs``, how many pairs have that ``n``, and rows of ``n, src, dst``, the pairs whose ``n`` is not under ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, pairs, n in _common(batches):
            tally, top = np.bincount(n), np.flatnonzero(n >= least)
            values = np.flatnonzero(tally)
            a, b = names[pairs[top] >> np.uint64(32)], names[pairs[top] & np.uint64(0xFFFFFFFF)]
            for columns in ((pa.array(values, pa.int64()), pa.array(tally[values], pa.int64()), *[pa.nulls(len(values), pa.int64())] * 2), (pa.array(n[top], pa.int64()), pa.nulls(len(top), pa.int64()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)))):
                yield pa.RecordBatch.from_arrays(list(columns), names=["n", "pairs", "src", "dst"])

    return run


def top_shared_edges(pairs: DataFrame, user: str, item: str, share: float) -> DataFrame:
    """``src < dst`` of the pairs of ``shared_edges`` whose ``n`` is not under its quantile ``share``, for integer users and items.

    No pair is written but those of the result. Users are listed by item, a part of the items at a time, since what a join deals is many
    times as large as its lists. Every block of users then gets, item by item, its own users and those of later blocks, counts its pairs
    some users at a time and gives how many have each ``n``. Blocks are dealt in rounds, whose shuffle files go before the next one. The first
    round's quantile tells what the others keep besides, so only the first is counted again for its edges, or all if the quantile of all is
    lower. One number comes to the driver for a quantile.
    """
    spark, kind = pairs.sparkSession, pairs.schema[user].dataType
    rows = pairs.select(F.col(user).cast("long").alias("u"), F.col(item).cast("long").alias("i")).where("u IS NOT NULL AND i IS NOT NULL")
    parts, path = max(1, math.ceil(leaf_bytes(rows) / JOINED_BYTES)), fresh(spark, "graph-lists")
    for part in range(parts):
        some = rows.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part) if parts > 1 else rows
        folded = added(some.repartition("i").sortWithinPartitions("i").mapInArrow(_folded, "users binary, sizes binary, places long, pairs double"), path)
    places, most = (x or 0 for x in folded.agg(F.sum("places"), F.sum("pairs")).first())
    cores = spark.sparkContext.defaultParallelism
    blocks = max(cores, math.ceil(most / BLOCK_PAIRS))
    rounds = max(1, math.ceil(min(most + places, places * blocks * 2 / 3) / max(DEALT_PLACES, DEALT_TIMES * places)))
    each = math.ceil(blocks / rounds / cores) * cores
    labels = np.array(even_labels(each, each) if 1 < each <= LABELLED else range(each))

    def counted(now: int, least: float) -> DataFrame:
        lists = folded.mapInArrow(_packed(each * rounds, rounds, now, labels), "block int, own binary, size binary, users binary")
        return dealt(lists, each, "block", each=1).mapInArrow(_weighed(least), "n long, pairs long, src long, dst long")

    def quantile(weighed: DataFrame) -> float:
        least = weighed.agg(F.percentile("n", F.lit(share), F.coalesce("pairs", F.lit(0))).alias("t")).first().t
        return float("inf") if least is None else least

    def kept(weighed: DataFrame) -> DataFrame:
        return added(weighed.where(F.col("src").isNotNull() & (F.col("n") >= least)).select(*[F.col(c).cast(kind) for c in ("src", "dst")]), edges)

    counts, edges, guess = fresh(spark, "graph-counts"), fresh(spark, "graph-edges"), float("inf")
    for now in range(rounds):
        weighed = added(counted(now, guess), counts)
        if rounds > 1 and not now:
            guess = quantile(weighed)
    least = quantile(weighed)
    if enough := guess <= least < float("inf"):
        found = kept(weighed)
    for now in range(1 if enough else rounds):
        found = kept(counted(now, least))
    dropped(folded)
    dropped(weighed)
    return found


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def _voted(rounds: int):
    """Labels of all vertices from both directions of all edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        names, at = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("src", "dst")]), return_inverse=True)
        src, dst = at.reshape(2, -1)
        n, label = len(names), np.arange(len(names))
        for _ in range(rounds):
            votes = np.sort(src * n + label[dst])
            new = np.flatnonzero(np.append(True, votes[1:] != votes[:-1]))
            who, what = np.divmod(votes[new], n)
            order = np.lexsort((what, -np.diff(new, append=len(votes)), who))
            first = order[np.append(True, who[order][1:] != who[order][:-1])]
            label[who[first]] = what[first]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], names=["id", "label"])

    return run


def label_propagation(edges: DataFrame, rounds: int = 5, held: int = 2_000_000) -> DataFrame:
    """``id, label`` after synchronous rounds: each vertex takes its neighbours' most frequent label, ties the smallest.

    Up to ``held`` directions of edges vote in one task. Of more, votes are counted by vertex and label first, so a vertex of high degree costs
    as many rows as its neighbours have labels. A round's labels go when the next ones are there.
    """
    ways = moved(both_ways(edges), "graph-ways")
    if ways.count() <= held:
        kind = ways.schema["src"].dataType.simpleString()
        labels = moved(ways.coalesce(1).mapInArrow(_voted(rounds), f"id {kind}, label {kind}"), "graph-labels")
        dropped(ways)
        return labels
    labels = moved(ways.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")), "graph-labels")
    for _ in range(rounds):
        votes = ways.join(labels, ways["dst"] == labels["id"]).groupBy(F.col("src"), "label").agg(F.count("*").alias("n"))
        before, labels = labels, moved(votes.groupBy(F.col("src").alias("id")).agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label")), "graph-labels")
        dropped(before)
    dropped(ways)
    return labels


def communities(labels: DataFrame, label: str = "label") -> DataFrame:
    """``size, first, members`` by size and first member."""
    grouped = labels.groupBy(label).agg(F.array_sort(F.collect_list("id")).alias("m"))
    return grouped.select(F.size("m").alias("size"), F.col("m")[0].alias("first"), F.array_join(F.transform("m", lambda x: x.cast("string")), ", ").alias("members")).orderBy("size", "first")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``q``: sum over communities of twice the inner edges less K^2 / 2m, over 2m; both orders and i = j count.

    ``edges`` are those of the original graph; vertices without a label don't count.
    """
    lab = labels.select("id", "label")
    inner = edges.join(lab.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(lab.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").where("a = b").groupBy("a").agg(F.count("*").alias("e"))
    k = degrees(edges).join(lab, "id").groupBy("label").agg(F.sum("degree").alias("k"))
    m = F.broadcast(edges.agg((F.count("*") * 2.0).alias("m2")))
    return k.join(inner, k["label"] == inner["a"], "left").join(m).agg((F.sum(2 * F.coalesce("e", F.lit(0)) - F.col("k") * F.col("k") / F.col("m2")) / F.first("m2")).alias("q"))


def _flow(src: np.ndarray, dst: np.ndarray, n: int, sources: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Of every edge between numbered vertices, the shortest paths over it from ``sources``; as many search together as ``CELLS`` hold.

    A vertex of ``weight`` w stands for w sources and w ends.
    """
    ends = np.concatenate([src, dst])
    order = np.argsort(ends, kind="stable")
    near, edge = np.concatenate([dst, src])[order], order % len(src)
    first = np.searchsorted(ends[order], np.arange(n + 1))
    score, weight = np.zeros(len(src)), np.ones(n) if weight is None else weight
    step = max(1, CELLS // (n + len(ends)))
    for lo in range(0, len(sources), step):
        own = sources[lo : lo + step]
        front = np.arange(len(own)) * n + own
        seen, paths, mark = np.zeros(len(own) * n, bool), np.zeros(len(own) * n), np.empty(len(own) * n, np.int64)
        seen[front], paths[front], levels = True, 1, []
        while len(front):
            v = front % n
            ways = first[v + 1] - first[v]
            at, back = _ranges(first[v], ways), np.repeat(front, ways)
            to = back - np.repeat(v, ways) + near[at]
            fresh = ~seen[to]
            at, back, to = at[fresh], back[fresh], to[fresh]
            np.add.at(paths, to, paths[back])
            mark[to] = np.arange(len(to))
            front = to[mark[to] == np.arange(len(to))]
            seen[front] = True
            levels.append((back, to, edge[at]))
        credit = np.tile(weight, len(own))
        for back, to, e in reversed(levels):
            share = credit[to] * paths[back] / paths[to]
            np.add.at(credit, back, share)
            np.add.at(score, e, share * weight[own[back // n]])
    return score


def _peeled(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges that lie on or between cycles; how many vertices each vertex stands for when the trees on it are folded into it; the paths over the trees' edges,
    both ways; the next vertex of each one towards its tree's root, -1 for roots; the lower end of the trees' edges.

    An edge of a tree parts its component in two, so as many paths use it as there are pairs across.
    """
    label = _joined(src, dst, n)
    total = np.bincount(label, minlength=n)[label].astype(float)
    degree, own = np.bincount(np.concatenate([src, dst]), minlength=n), np.zeros(n, np.int64)
    for ends in (src, dst):
        np.bitwise_xor.at(own, ends, np.arange(len(src)))  # what is left of a vertex with one edge is that edge
    weight, score, live = np.ones(n), np.zeros(len(src)), np.ones(len(src), bool)
    above, below = np.full(n, -1), np.full(len(src), -1)
    leaf = np.flatnonzero(degree == 1)
    while len(leaf):
        edge = own[leaf]
        root = src[edge] + dst[edge] - leaf
        kept = (degree[root] > 1) | (leaf < root)  # an edge of two leaves goes once
        leaf, edge, root = leaf[kept], edge[kept], root[kept]
        above[leaf], below[edge] = root, leaf
        live[edge], score[edge] = False, 2 * weight[leaf] * (total[leaf] - weight[leaf])
        np.add.at(weight, root, weight[leaf])
        np.bitwise_xor.at(own, root, edge)
        np.subtract.at(degree, root, 1)
        degree[leaf] = 0
        leaf = np.unique(root[degree[root] == 1])
    return np.flatnonzero(live), weight, score, above, below


def _passed(src: np.ndarray, dst: np.ndarray, n: int, part: int = 0, of: int = 1) -> np.ndarray:
    """Of every edge, the shortest paths over it from a part of the sources; trees are folded first and counted in part 0."""
    live, weight, score, _, _ = _peeled(src, dst, n)
    names, at = np.unique(np.concatenate([src[live], dst[live]]), return_inverse=True)
    found = score if part == 0 else np.zeros(len(src))
    if len(live):
        found[live] = _flow(*at.reshape(2, -1), len(names), np.arange(part, len(names), of), weight[names])
    return found


def _searched(table: pa.Table) -> pa.Table:
    """Shares of the edges of one group from its block of sources."""
    names, at = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("src", "dst")]), return_inverse=True)
    src, dst = at.reshape(2, -1)
    share = _passed(src, dst, len(names), table.column("_block")[0].as_py(), table.column("_blocks")[0].as_py())
    return pa.table({"src": table.column("src"), "dst": table.column("dst"), "share": share})


def _parted(each: int, few: int, tasks: int, labels: np.ndarray):
    """From all edges: those of every component once for each block of its sources, small components together, with the task that has the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        src, dst = (table.column(c).to_numpy() for c in ("src", "dst"))
        names, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        a, b = at.reshape(2, -1)
        live = _peeled(a, b, len(names))[0]
        label = _joined(a, b, len(names))
        inner = np.zeros(len(names), bool)
        inner[a[live]] = inner[b[live]] = True
        vertices = np.bincount(label[inner], minlength=len(names))
        steps = vertices * (vertices + 2.0 * np.bincount(label[a[live]], minlength=len(names)))
        heads = np.flatnonzero(label == np.arange(len(names)))
        group = np.zeros(len(names), np.int64)
        small = heads[steps[heads] <= few]
        group[small] = -1 - np.cumsum(np.bincount(label, minlength=len(names))[small]) // SMALL_VERTICES
        large = heads[steps[heads] > few]
        group[large] = large
        size = min(each, max(few, 1, math.ceil(steps.sum() / tasks)))
        own = group[label[a]]
        order = np.argsort(own, kind="stable")
        bounds = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1]))
        task = 0
        for lo, hi in zip(bounds, [*bounds[1:], len(order)], strict=True):
            rows = order[lo:hi]
            which = int(own[rows[0]])
            blocks = 1 if which < 0 else int(min(vertices[which], math.ceil(steps[which] / size)))
            for block in range(blocks):
                numbers = [pa.array(np.full(len(rows), x, kind)) for x, kind in ((labels[task % tasks], np.int32), (which, np.int64), (block, np.int64), (blocks, np.int64))]
                yield pa.RecordBatch.from_arrays([*numbers, pa.array(src[rows]), pa.array(dst[rows])], names=["_task", "_group", "_block", "_blocks", "src", "dst"])
                task += 1

    return run


def betweenness(edges: DataFrame, each: int = 1 << 25, few: int = 1 << 20, held: int = 2_000_000) -> DataFrame:
    """``src, dst, score`` of every edge: shortest paths over it, from all sources, halved. Loops have no paths.

    A task has the edges of one component and a block of its vertices as sources, about ``each`` steps over vertices and edges;
    components of up to ``few`` steps share tasks. What a source reaches stays in the task, only sums of edges leave it, and trees are
    folded before the search. Components of integers are found in one task where there are up to ``held`` edges, else by joins.
    """
    spark = edges.sparkSession
    lines = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst")
    kind = lines.schema["src"].dataType.simpleString()
    lines = moved(lines, "graph-lines")
    if lines.count() <= held:
        tasks = 4 * spark.sparkContext.defaultParallelism
        named = lines.coalesce(1).mapInArrow(_parted(each, few, tasks, np.array(even_labels(tasks, tasks))), f"_task int, _group long, _block long, _blocks long, src {kind}, dst {kind}")
        found = dealt(named, tasks, "_task", each=1).groupBy("_task", "_group", "_block", "_blocks").applyInArrow(_searched, f"src {kind}, dst {kind}, share double")
        return found.groupBy("src", "dst").agg((F.sum("share") / 2).alias("score"))
    own = connected_components(lines)
    placed = cut(lines.join(own, F.col("src") == F.col("id")).select("component", "src", "dst"))
    steps = F.col("n") * (F.col("n") + 2 * F.col("e"))
    sizes = own.groupBy("component").agg(F.count("*").cast("double").alias("n")).join(placed.groupBy("component").agg(F.count("*").cast("double").alias("e")), "component")
    sizes = cut(sizes.select("component", "n", F.when(steps > few, F.least("n", F.ceil(steps / each))).cast("long").alias("_blocks")))
    total = sizes.agg(F.sum("_blocks").alias("large"), F.sum(F.when(F.col("_blocks").isNull(), F.col("n"))).alias("n")).first()
    shared = max(1, math.ceil((total.n or 0) / SMALL_VERTICES))
    keys = ["_component", "_bin", "_block"]
    sizes = sizes.select("component", F.when(F.col("_blocks").isNotNull(), F.col("component")).alias("_component"), F.when(F.col("_blocks").isNull(), F.pmod(F.xxhash64("component"), F.lit(shared))).alias("_bin"), F.coalesce("_blocks", F.lit(1)).alias("_blocks"))
    sizes = sizes.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    tasks = dealt(placed.join(sizes, "component").select(*keys, "_blocks", "src", "dst"), shared + (total.large or 0), *keys, each=1).groupBy(*keys)
    return tasks.applyInArrow(_searched, f"src {kind}, dst {kind}, share double").groupBy("src", "dst").agg((F.sum("share") / 2).alias("score"))


def _scores(near: np.ndarray) -> np.ndarray:
    """Betweenness of every edge of an adjacency matrix; a level of the search from all sources is one product."""
    n = len(near)
    depth, paths, front, level = np.where(np.eye(n) > 0, 0, -1), np.eye(n), np.eye(n), 0
    while front.any():
        level += 1
        front = np.where(depth < 0, front @ near, 0)
        depth[front > 0] = level
        paths += front
    credit, score = np.ones((n, n)), np.zeros((n, n))
    for d in range(level, 0, -1):
        share = np.where(depth == d, credit / np.maximum(paths, 1), 0)
        up = np.where(depth == d - 1, paths, 0)
        credit += up * (share @ near)
        score += near * (up.T @ share)
    return (score + score.T) / 2


def _labels(near: np.ndarray) -> np.ndarray:
    """The smallest vertex that each one reaches."""
    n, label = len(near), np.arange(len(near))
    while True:
        lower = np.minimum(label, np.where(near > 0, label[None, :], n).min(axis=1, initial=n))
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _cuts(edges: np.ndarray, most: int, stale: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Vertices, their labels in the best division, its modularity and the number of cuts. Only components that lost an edge are searched anew."""
    names, at = np.unique(edges, return_inverse=True)
    src, dst = at.reshape(edges.shape).T
    n = len(names)
    now = np.zeros((n, n))
    now[src, dst] = now[dst, src] = 1
    degree, twice = now.sum(axis=1), now.sum()
    label, score = _labels(now), np.zeros((n, n))
    touched = np.unique(label)
    best, value, idle, cuts = None, float("-inf"), 0, 0
    while True:
        inner, total = (label[src] == label[dst]), np.bincount(label, degree, n)
        q = float(2 * inner.sum() / twice - (total**2).sum() / twice**2)
        if best is None or q >= value - 1e-12:
            best, value, idle = label.copy(), max(q, value), 0
        else:
            idle += 1
        if idle >= stale or cuts >= most or not now.any():
            return names, names[best], value, cuts
        for x in touched.tolist():
            own = np.flatnonzero(label == x)
            score[np.ix_(own, own)] = _scores(now[np.ix_(own, own)])
        gone = (now > 0) & (score >= _least(score.max()))
        before = np.unique(label[gone.any(axis=1)])
        now[gone] = score[gone] = 0
        cuts += 1
        changed = np.flatnonzero(np.isin(label, before))
        label[changed] = changed[_labels(now[np.ix_(changed, changed)])]
        touched = np.unique(label[changed])


def _least(score: float) -> float:
    """What counts as equal to the greatest score, whose sums differ in the last digits with their order."""
    return score - 1e-9 * max(1.0, score)


def _joined(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The smallest of ``n`` numbered vertices that each one reaches over the edges."""
    label = np.arange(n)
    while True:
        lower = label.copy()
        np.minimum.at(lower, src, label[dst])
        np.minimum.at(lower, dst, label[src])
        np.minimum.at(lower, label, lower)  # also where the old label stands
        while not (lower[lower] == lower).all():
            lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _rescored(spark: SparkSession, src: np.ndarray, dst: np.ndarray, label: np.ndarray, alone: int = 1 << 23) -> np.ndarray:
    """Betweenness of edges of whole components, ``label`` being that of each edge; up to ``alone`` steps in the driver, else blocks of sources in tasks."""
    order = np.argsort(label, kind="stable")
    bounds = np.flatnonzero(np.append(True, label[order][1:] != label[order][:-1]))
    parts, steps = [], 0
    for lo, hi in zip(bounds, [*bounds[1:], len(order)], strict=True):
        names, at = np.unique(np.concatenate([src[order[lo:hi]], dst[order[lo:hi]]]), return_inverse=True)
        parts.append((*at.reshape(2, -1), len(names)))
        steps += len(names) * (len(names) + 2 * (hi - lo))

    def search(part: int, of: int, graphs: list) -> np.ndarray:
        return np.concatenate([_passed(a, b, n, part, of) for a, b, n in graphs])

    if steps <= alone:
        found = search(0, 1, parts)
    else:
        tasks = 2 * spark.sparkContext.defaultParallelism
        shared = spark.sparkContext.broadcast(parts)
        found = spark.sparkContext.parallelize(range(tasks), tasks).map(lambda t: search(t, tasks, shared.value)).treeReduce(np.add)
        shared.destroy()
    score = np.empty(len(src))
    score[order] = found / 2
    return score


def _guided(spark: SparkSession, edges: np.ndarray, most: int, stale: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """As ``_cuts``, with lists of edges in the driver and the searches in tasks."""
    names, at = np.unique(edges, return_inverse=True)
    src, dst = at.reshape(edges.shape).T
    n, twice = len(names), 2.0 * len(edges)
    degree = np.bincount(np.concatenate([src, dst]), minlength=n)
    alive, score, label = np.ones(len(src), bool), np.zeros(len(src)), _joined(src, dst, n)
    touched = alive.copy()
    best, value, idle, cuts = None, float("-inf"), 0, 0
    while True:
        inner, total = (label[src] == label[dst]).sum(), np.bincount(label, degree, n)
        q = float(2 * inner / twice - (total**2).sum() / twice**2)
        if best is None or q >= value - 1e-12:
            best, value, idle = label.copy(), max(q, value), 0
        else:
            idle += 1
        if idle >= stale or cuts >= most or not alive.any():
            return names, names[best], value, cuts
        again = np.flatnonzero(touched & alive)
        if len(again):
            score[again] = _rescored(spark, src[again], dst[again], label[src[again]])
        gone = alive & (score >= _least(score[alive].max()))
        hit = np.zeros(n, bool)
        hit[label[src[gone]]] = True
        alive &= ~gone
        score[gone] = 0
        cuts += 1
        changed = np.flatnonzero(hit[label])
        touched = hit[label[src]]
        inside = np.flatnonzero(touched & alive)
        label[changed] = changed[_joined(*(np.searchsorted(changed, x[inside]) for x in (src, dst)), len(changed))]


class _Paths:
    """Distances and numbers of shortest paths between all vertices of a graph, and the betweenness of its edges, kept up while edges go.

    When an edge goes, only pairs with a shortest path over it change; their shares are taken off, and added anew over the paths that are left.
    A cell is the place of a pair in the square of all vertices.
    """

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int, weight: np.ndarray):
        self.src, self.dst, self.n, self.weight = src, dst, n, weight
        ends = np.concatenate([src, dst])
        order = np.argsort(ends, kind="stable")
        self.near, self.edge = np.concatenate([dst, src])[order], order % max(1, len(src))
        self.first = np.searchsorted(ends[order], np.arange(n + 1))
        self.alive, self.rows = np.ones(len(src), bool), max(1, WEIGHED // max(1, n))
        self.far, self.paths = np.full((n, n), FAR), np.zeros((n, n))
        far, paths, step = self.far.ravel(), self.paths.ravel(), max(1, CELLS // max(1, n + len(ends)))
        mark = np.empty(step * n, np.int64)
        for lo in range(0, n, step):
            own = np.arange(lo, min(n, lo + step))
            front, level = own * n + own, 0
            far[front], paths[front] = 0, 1
            while len(front):
                level += 1
                rows, to, _ = self._around(front)
                back = front[rows]
                fresh = far[to] == FAR
                back, to = back[fresh], to[fresh]
                np.add.at(paths, to, paths[back])
                at = to - lo * n
                mark[at] = np.arange(len(to))
                front = to[mark[at] == np.arange(len(to))]
                far[front] = level
        self.most = paths.max(initial=0)
        self.rescore()

    def rescore(self) -> None:
        """Scores from the beginning, without what rounding has left."""
        live = np.flatnonzero(self.alive)
        self.score = np.zeros(len(self.src))
        if len(live):
            self.score[live] = _flow(self.src[live], self.dst[live], self.n, np.arange(self.n), self.weight) / 2

    def _around(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every edge at the end of each cell's pair: which cell, the cell of its other end, and the edge."""
        v = cells % self.n
        ways = self.first[v + 1] - self.first[v]
        at, rows = _ranges(self.first[v], ways), np.repeat(np.arange(len(cells)), ways)
        live = self.alive[self.edge[at]]
        at, rows = at[live], rows[live]
        return rows, (cells - v)[rows] + self.near[at], self.edge[at]

    def _weigh(self, cells: np.ndarray, values: np.ndarray) -> None:
        """Add values of pairs, in order of their sources, to the edges on their shortest paths."""
        far, paths = self.far.ravel(), self.paths.ravel()
        sources, at = np.unique(cells // self.n, return_inverse=True)
        for lo in range(0, len(sources), self.rows):
            own = sources[lo : lo + self.rows]
            part = slice(*np.searchsorted(at, [lo, lo + self.rows]))
            now = cells[part]
            off = (own - np.arange(len(own)))[at[part] - lo] * self.n  # a cell's place is less by that
            held, mark = np.zeros(len(own) * self.n), np.empty(len(own) * self.n, np.int64)
            held[now - off] = values[part]
            order = np.argsort(far[now], kind="stable")
            now, off = now[order], off[order]
            bounds = np.searchsorted(far[now], np.arange(int(far[now[-1]]) + 2))
            more = np.empty(0, np.int64), np.empty(0, np.int64)
            for level in range(len(bounds) - 2, 0, -1):
                top, less = (np.concatenate([x[bounds[level] : bounds[level + 1]], y]) for x, y in zip((now, off), more, strict=True))
                v = top % self.n
                ways = self.first[v + 1] - self.first[v]
                at_end, rows = _ranges(self.first[v], ways), np.repeat(np.arange(len(top)), ways)
                to, edge = (top - v)[rows] + self.near[at_end], self.edge[at_end]
                up = np.flatnonzero((far[to] == level - 1) & self.alive[edge])
                rows, to, edge = rows[up], to[up], edge[up]
                share = (held[top - less] / paths[top])[rows] * paths[to]
                self.score += np.bincount(edge, share, minlength=len(self.score))
                less = less[rows]
                place = to - less
                new = held[place] == 0
                np.add.at(held, place, share)
                place, to, less = place[new], to[new], less[new]
                mark[place] = np.arange(len(place))
                once = mark[place] == np.arange(len(place))
                more = to[once], less[once]

    def _bridge(self, u: int, v: int) -> bool:
        seen, front = np.zeros(self.n, bool), np.array([u])
        seen[u] = True
        while len(front) and not seen[v]:
            _, to, _ = self._around(front)  # of the first row, where cells are vertices
            front = np.unique(to[~seen[to]])
            seen[front] = True
        return not seen[v]

    def cut(self, e: int) -> bool:
        """Take an edge away; whether its component falls apart."""
        n, u, v = self.n, int(self.src[e]), int(self.dst[e])
        far, paths, weight = self.far.ravel(), self.paths.ravel(), self.weight
        a, b = (np.flatnonzero(self.far[:, y] == self.far[:, x] + 1) for x, y in ((u, v), (v, u)))  # sources whose paths may use it one way, and the ends of those
        self.alive[e] = False
        if self._bridge(u, v):
            self.score[e] = 0
            for x, own, other in ((u, a, b), (v, b, a)):
                own = own[own != x]
                self._weigh(x * n + own, -weight[own] * weight[other].sum())
            for own, other in ((a, b), (b, a)):
                self.far[np.ix_(own, other)], self.paths[np.ix_(own, other)] = FAR, 0
            return True
        self.alive[e] = True
        s, t = np.nonzero(self.far[np.ix_(a, b)] == self.far[a, u][:, None] + (self.far[b, v] + 1)[None, :])
        if np.count_nonzero(np.bincount(t)) < np.count_nonzero(np.bincount(s)):  # fewer sources share more of their paths
            order = np.argsort(t, kind="stable")
            s, t, a, b, u, v = t[order], s[order], b, a, v, u
        s, t = a[s], b[t]
        cells, values = s * n + t, weight[s] * weight[t]
        self._weigh(cells, -values)
        self.alive[e], self.score[e] = False, 0
        left = paths[cells] - paths[s * n + u] * paths[v * n + t]
        paths[cells] = paths[t * n + s] = left
        lost = cells[left < 0.5]  # numbers are whole
        if len(lost):
            far[lost], paths[lost] = FAR, 0
            rows, to, _ = self._around(lost)
            bounds = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            while True:
                nearest = np.minimum(np.minimum.reduceat(far[to], bounds) + 1, FAR)
                if (nearest == far[lost]).all():
                    break
                far[lost] = nearest
            up = far[to] == far[lost[rows]] - 1
            back, to = lost[rows[up]], to[up]
            order = np.argsort(far[back], kind="stable")
            back, to = back[order], to[order]
            level = far[back]
            bounds = np.flatnonzero(np.append(True, level[1:] != level[:-1]))
            for lo, hi in zip(bounds, [*bounds[1:], len(back)], strict=True):
                np.add.at(paths, back[lo:hi], paths[to[lo:hi]])
            turned = lost % n * n + lost // n
            far[turned], paths[turned] = far[lost], paths[lost]
            self.most = max(self.most, paths[lost].max())
        self._weigh(cells, values)
        return False

    def lighten(self, v: int, less: float) -> None:
        """A tree of that weight has left the vertex."""
        ends = np.flatnonzero((self.far[v] < FAR) & (self.far[v] > 0))
        self._weigh(v * self.n + ends, -less * self.weight[ends])
        self.weight[v] -= less


def _course(src: np.ndarray, dst: np.ndarray, n: int, most: int) -> Iterator[tuple[float, np.ndarray, bool]]:
    """The greatest score, the edges that have it and go, and whether something falls apart, cut by cut.

    Vertices on cycles have their paths held; trees on them count by their weight.
    """
    live, weight, _, above, below = _peeled(src, dst, n)
    names, at = np.unique(np.concatenate([src[live], dst[live]]), return_inverse=True)
    held = _Paths(*at.reshape(2, -1), len(names), weight[names])
    built, alive, score, label = None, np.ones(len(src), bool), np.zeros(len(src)), _joined(src, dst, n)
    place, core = np.full(len(src), -1), np.full(n, -1)
    place[live], core[names] = np.arange(len(live)), np.arange(len(names))
    trees, split = np.flatnonzero(place < 0), True
    for _ in range(most):
        if not alive.any():
            return
        exact = held.most <= EXACT
        if exact:
            if split:
                own = below[trees]
                score[trees] = weight[own] * (np.bincount(label, minlength=n)[label[own]] - weight[own])
            score[live] = held.score
        else:
            rest = np.flatnonzero(alive)
            score[rest] = _passed(src[rest], dst[rest], n) / 2
        score[~alive] = 0
        built = built or score.max()
        if exact and score.max() < built / 100:  # what rounding left is small again beside the scores
            held.rescore()
            score[live] = held.score
            built = score.max()
        gone, split = np.flatnonzero(alive & (score >= _least(score.max()))), not exact
        alive[gone] = False
        for e in gone.tolist() if exact else ():
            if place[e] >= 0:
                split |= held.cut(place[e])
                continue
            split, v = True, below[e]
            up, less, above[v] = above[v], weight[v], -1
            while True:
                weight[up] -= less
                if above[up] < 0:
                    break
                up = above[up]
            if core[up] >= 0:
                held.lighten(core[up], less)
        if split:
            label = _joined(src[alive], dst[alive], n)
        yield float(score.max()), gone, split


def _followed(spark: SparkSession, edges: np.ndarray, most: int, stale: int) -> tuple[np.ndarray, np.ndarray, float, int] | None:
    """As ``_guided``; a task follows a component's own cuts some way ahead, since others don't change them, and here the greatest scores go first.

    None if a component has more than ``CORE`` vertices on cycles.
    """
    names, at = np.unique(edges, return_inverse=True)
    src, dst = at.reshape(edges.shape).T
    n, twice = len(names), 2.0 * len(edges)
    degree, label = np.bincount(np.concatenate([src, dst]), minlength=n), _joined(src, dst, n)
    inner = np.zeros(n, bool)
    live = _peeled(src, dst, n)[0]
    inner[src[live]] = inner[dst[live]] = True
    if np.bincount(label[inner], minlength=1).max() > CORE:
        return None
    size = np.bincount(label, minlength=n)
    group = np.where(size > SMALL_VERTICES, np.arange(n), -1 - np.cumsum(np.where(size > SMALL_VERTICES, 0, size)) // SMALL_VERTICES)[label[src]]
    own = [np.flatnonzero(group == g) for g in np.unique(group)]
    alive = np.ones(len(src), bool)  # after all that tasks have found
    courses, done, ahead = [[] for _ in own], [0] * len(own), [AHEAD] * len(own)
    here, best, value, q, idle, cuts = np.ones(len(src), bool), None, float("-inf"), None, 0, 0

    def follow(x: tuple[int, np.ndarray, np.ndarray, int]) -> tuple[int, list]:
        which, a, b, far = x
        own, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        return which, list(_course(*at.reshape(2, -1), len(own), far))

    while True:
        if q is None:
            q = float(2 * (label[src] == label[dst]).sum() / twice - (np.bincount(label, degree, n) ** 2).sum() / twice**2)
            if q >= value - 1e-12:
                best = label.copy()
        value, idle = (max(q, value), 0) if q >= value - 1e-12 else (value, idle + 1)
        if idle >= stale or cuts >= most or not here.any():
            return names, names[best], value, cuts
        left = [len(c) - k for c, k in zip(courses, done, strict=True)]
        if any(not k and alive[x].any() for k, x in zip(left, own, strict=True)):
            asked = []
            for g, x in enumerate(own):
                if left[g] <= len(courses[g]) // 2 and left[g] < most - cuts and len(rest := x[alive[x]]):
                    asked.append((g, src[rest], dst[rest], min(ahead[g], most - cuts - left[g])))
                    ahead[g] *= 2
            for g, found in spark.sparkContext.parallelize(asked, len(asked)).map(follow).collect():
                rest = own[g][alive[own[g]]]
                for top, gone, split in found:
                    courses[g].append((top, rest[gone], split))
                    alive[rest[gone]] = False
        heads = [c[k] if k < len(c) else None for c, k in zip(courses, done, strict=True)]
        least = _least(max(h[0] for h in heads if h))
        taken = [g for g, h in enumerate(heads) if h and h[0] >= least]
        gone = np.concatenate([heads[g][1] for g in taken])
        here[gone] = False
        for g in taken:
            done[g] += 1
        cuts += 1
        if any(heads[g][2] for g in taken):
            hit = np.zeros(n, bool)
            hit[label[src[gone]]] = True
            changed, inside = np.flatnonzero(hit[label]), np.flatnonzero(hit[label[src]] & here)
            label[changed] = changed[_joined(*(np.searchsorted(changed, x[inside]) for x in (src, dst)), len(changed))]
            q = None


def girvan_newman(edges: DataFrame, most: int = 1000, stale: int = 30, small: int = 2000, held: int = 2_000_000) -> tuple[DataFrame, float, int]:
    """The labels of best modularity, that modularity, and the number of cuts: all edges of greatest betweenness go in each.

    Modularity counts the original edges; a later cut of equal value replaces an
    earlier one. Ends without edges, after ``most`` cuts, or after ``stale`` without gain. The graph is counted first: up to
    ``small`` vertices and edges are cut in one task, whose matrices have at most ``small ** 2`` cells. Of up to ``held`` edges the
    list is held in the driver and nothing is written: a task follows the cuts of one component, or, where one has over ``CORE`` vertices on
    cycles, tasks search the components that lost an edge; larger ones go by joins, where one number a cut comes to the driver.
    """
    whole = cut(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct())
    vertices = cut(both_ways(whole).select(F.col("src").alias("id")).distinct())
    size, kind = whole.count(), whole.schema["src"].dataType.simpleString()
    if 0 < size <= small and vertices.count() <= small:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = [f for f in frames if len(f)]
            if rows:
                names, labels, q, cuts = _cuts(pd.concat(rows)[["src", "dst"]].to_numpy(), most, stale)
                yield pd.DataFrame({"id": names, "label": labels, "q": q, "cuts": cuts})

        found = cut(whole.coalesce(1).mapInPandas(run, f"id {kind}, label {kind}, q double, cuts long"))
        first = found.first()
        return found.select("id", "label"), first.q, first.cuts
    if 0 < size <= held:
        rows = whole.toPandas().to_numpy()
        names, labels, q, cuts = _followed(whole.sparkSession, rows, most, stale) or _guided(whole.sparkSession, rows, most, stale)
        return whole.sparkSession.createDataFrame(pd.DataFrame({"id": names, "label": labels}), f"id {kind}, label {kind}"), q, cuts
    now, best, value, idle, cuts = whole, None, float("-inf"), 0, 0
    while True:
        joined = connected_components(now)
        labels = cut(vertices.join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("label")))
        q = modularity(whole, labels).first().q
        if best is None or (q is not None and q >= value - 1e-12):
            best, value, idle = labels, value if q is None else max(q, value), 0
        else:
            idle += 1
        if idle >= stale or cuts >= most or now.isEmpty():
            return best, value, cuts
        scores = cut(betweenness(now))
        top = scores.agg(F.max("score").alias("t")).first().t
        now = cut(scores.where(F.col("score") < _least(top)).select("src", "dst"))
        cuts += 1
