"""Document fingerprints by one-permutation MinHash, in built-in functions alone.

Every word shingle is hashed once. The hash's high bits name one of ``BINS`` bins,
and a bin keeps its smallest hash. An empty bin takes over that of another one, probed in
an order that only depends on the bin (optimal densification). The low
``BITS`` bits of every bin's value, hashed with the bin's number so that copies of one
value stay independent, make up the fingerprint; since unequal hashes agree on
those by chance once in 2**BITS, the likeness of two fingerprints is corrected for that.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import idblocks
from quillspark.session import dealt as spread
from quillspark.session import even

BINS = 128
BITS = 8
WIDTH = 5
#: Bytes of text in a range of doc_ids, and ranges at most; beyond that they grow, and each is streamed through a sort.
EACH, RANGES = 28 << 20, 100_000
#: Probes of an empty bin before all filled bins are ranked for it.
PROBES = 12


def _probe(j: int, t: int) -> int:
    """The ``t``-th bin that bin ``j`` looks at, by a fixed multiplicative hash."""
    x = (j * 1_000_003 + t * 7_368_787 + 12_345) * 0x9E3779B97F4A7C15 % (1 << 64)
    x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    return (x >> 40) % BINS


def _literal(values: list[int]) -> str:
    return f"array({', '.join(map(str, values))})"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once a row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _spaced(text: str) -> str:
    for c in ("\\n", "\\t", "\\r", "\\f", "\\u000b"):
        text = f"replace({text}, '{c}', ' ')"
    return text


def bins(text: str) -> Column:
    """The low bits of all bins of the column ``text``: ``BINS`` numbers, none for a blank text.

    Shingles are runs of ``WIDTH`` words between ASCII blanks, or the whole text where it has fewer words.
    """
    shift = 64 - int(math.log2(BINS))
    run = ", ".join(f"w[i + {k}]" for k in range(WIDTH))
    hashes = f"CASE WHEN size(w) < {WIDTH} THEN array(xxhash64(array_join(w, ' '))) ELSE transform(sequence(0, size(w) - {WIDTH}), i -> xxhash64({run})) END"
    # the first hash of every bin in sorted order, and the bin of each
    least = f"filter(h, (x, i) -> i = 0 OR shiftrightunsigned(x, {shift}) <> shiftrightunsigned(h[i - 1], {shift}))"
    names = f"transform(f, x -> cast(shiftrightunsigned(x, {shift}) AS INT))"
    held = f"transform(sequence(0, {BINS - 1}), j -> nullif(array_position(g, j), 0))"
    probes = ", ".join(f"b[element_at({_literal([_probe(j, t) for j in range(BINS)])}, j + 1)]" for t in range(PROBES))
    ranked = "array_position(g, array_min(transform(g, x -> struct(xxhash64(j, x) AS r, x AS x))).x)"
    low = f"transform(sequence(0, {BINS - 1}), j -> cast(xxhash64(f[cast(coalesce(b[j], {probes}, {ranked}) AS INT) - 1], j) & {(1 << BITS) - 1} AS SMALLINT))"
    filled = _let(f"sort_array({hashes})", "h", _let(least, "f", _let(names, "g", _let(held, "b", low))))
    return F.expr(_let(f"array_remove(split({_spaced(text)}, ' '), '')", "w", f"CASE WHEN size(w) = 0 THEN cast(array() AS array<smallint>) ELSE {filled} END"))


def with_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    return df.withColumn(out, bins(text))


def packed(bins: Column) -> Column:
    """The bins as a hexadecimal string; a blank text has an empty one."""
    return F.lower(F.array_join(F.transform(bins, lambda x: F.lpad(F.hex(x.cast("long")), BITS // 4, "0")), ""))


def likeness(a: str, b: str) -> Column:
    """The share of equal bins, corrected for chance; two blank texts are alike, one blank and one other are not."""
    equal = F.expr(f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), e -> e))") / F.lit(float(BINS))
    chance = 2.0**-BITS
    value = F.greatest(F.lit(0.0), (equal - F.lit(chance)) / F.lit(1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(value)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` for every row of ``docs``; a null text counts as empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_bins(rows, "text", "bins").select("doc_id", F.length("text").cast("long").alias("n_chars"), packed(F.col("bins")).alias("fingerprint"))


def compared(docs: DataFrame, each: int = EACH) -> DataFrame:
    """Every row's fingerprint beside that of its edited text and of the next row.

    The edited text has its last third of characters replaced by as many first ones of the
    next row's text, by descending doc_id; after the last comes the first. Rows of
    one doc_id are ordered by text; null doc_ids come last, in an order of their texts. Texts cross the
    network once: they are dealt into ranges of doc_ids, and each range also gets the
    first row of the one below.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = idblocks.blocks(rows, min(idblocks.number(rows, each), RANGES))
    block = even(found.of(F.col("doc_id"), F.col("text")), found.count, docs.sparkSession, each=1)
    placed = rows.withColumn("block", block)
    marked = with_bins(placed, "text", "bins")
    # a row for each range, RANGES and those of null doc_ids at most: its first row's key and the range above, after the last the first
    order = Window.orderBy("block")
    key = lambda lost: F.struct(F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.when(F.col("doc_id").isNull(), lost).alias("text"))
    ends = placed.groupBy("block").agg(F.max(key(F.xxhash64("text"))).alias("top"))
    above = F.coalesce(F.lead("block").over(order), F.first("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tops = F.broadcast(ends.select("block", "top", above.alias("above")))
    own, guest = F.struct(F.col("block").alias("to"), F.lit(0).alias("guest")), F.struct(F.col("above").alias("to"), F.lit(1).alias("guest"))
    copies = F.when(key(F.xxhash64("text")).eqNullSafe(F.col("top")), F.array(own, guest)).otherwise(F.array(own))
    dealt = marked.join(tops, "block").withColumn("copy", F.explode(copies))
    dealt = dealt.select("doc_id", "text", "bins", F.col("copy.to").alias("to"), F.col("copy.guest").alias("guest"))
    line = Window.partitionBy("to").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc(F.when(F.col("doc_id").isNull(), F.xxhash64("text"))), F.desc("text"))
    paired = spread(dealt, found.count, "to", each=1).withColumn("next", F.lead(F.struct("text", "bins")).over(line)).where("guest = 0")
    edited = F.concat(F.expr("substring(text, 1, length(text) - floor(length(text) / 3))"), F.expr("substring(next.text, 1, cast(floor(length(text) / 3) AS int))"))
    ready = paired.select("doc_id", F.length("text").cast("long").alias("n_chars"), "bins", F.col("next.bins").alias("next_bins"), edited.alias("edited"))
    both = with_bins(ready, "edited", "edited_bins")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness("bins", "edited_bins").alias("near_edited"),
        likeness("bins", "next_bins").alias("near_next"),
    )
