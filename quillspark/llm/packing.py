"""Best-fit packing of tokenised texts by hierarchical residual packing.

Texts are tokenised where they are read; from then on only lengths move. Each
partition packs its pieces best-fit by decreasing length and emits the bins that
are nearly full or that nothing left can complete. Best-fit leaves one bin up to half full at the
most; it and the roomiest others become items of the next round on an eighth of
the partitions, until one partition repacks the last few.
"""

from __future__ import annotations

import bisect
import codecs
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.kernel import holders, small_batches
from quillspark.session import compact, cut

#: Chunks in each half of a worker's memory, some 60 MB.
REMEMBERED = 350_000
#: Characters of texts that are learnt together.
TOGETHER = 10_000
#: A mark that separates chunks.
_MARK = "\x01"
#: How the vocabulary's special tokens begin.
_SPECIAL = "<|"
#: Lower-case and caseless letters, and marks, that composing and lower-casing leave as they are.
_LETTERS, _MARKS = "a-zß-öø-ÿā-įı-žά-ώа-џא-תء-يぁ-ゖァ-ヺー一-龥가-힣", r"!-/:-@\[-`{-~¡-©«-±´¶-¸»¿×÷‐-‧‰-⁞€、。〈-】"
#: Signs that neither compose with a neighbour nor are lower-cased by one: no combining marks, no capital sigma, no dotted capital I.
_SIMPLE = re.compile(rf"[\0-\xffΆΈ-ΡΤ-ΫЀ-Я{_LETTERS}Ā-įı-ž{_MARKS}]*")
#: How the vocabulary parts a text, and the same for these letters and marks.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[{_MARKS}]+")
#: A mark after a letter, where the vocabulary always parts.
_TAIL = re.compile(rf"[.,!?%*&$#|;:)](?<=[{_LETTERS}].)")
#: The character that stands for each byte in the vocabulary.
_SIGNS, _OTHERS = "".join(chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else "\0" for b in range(256)), iter(range(256, 512))
_SIGNS = "".join(chr(next(_OTHERS)) if c == "\0" else c for c in _SIGNS)
#: Characters of the longest chunk that is remembered.
_LONGEST = 200
_PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
_ITEM = T.StructType([*_PIECE.fields, T.StructField("offset", T.LongType())])
_BIN = T.StructType([T.StructField("bin", T.LongType()), T.StructField("used", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("items", T.ArrayType(_ITEM))])


class _Known(dict):
    """Ids by chunk; a chunk that is missing is learnt when it is asked for."""

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        self.learn = learn

    def __missing__(self, chunk: str) -> bytes:
        return self.learn(chunk)


class ChunkTokenizer:
    """Ids of whole texts from remembered ids of their white-space separated chunks.

    The vocabulary drops white space and never joins across it, so a text's ids
    are those of its chunks in order. Chunks are split at ASCII blanks only. A chunk of letters, digits and marks of the common scripts is
    parted here as the vocabulary parts it, and its parts go to the merges alone; other chunks go through the whole tokenizer.
    Texts are lower-cased, and punctuation after their letters split off, where that can't change ids: the vocabulary looks for its special tokens first,
    so a text that may hold one stays as it is, and it composes letters and marks before it lower-cases, so a text that may hold such marks stays as it is too.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        (self.mark,) = self.inner.encode(_MARK, add_special_tokens=False).ids
        split, level = json.loads(self.inner.pre_tokenizer.__getstate__())["pretokenizers"]
        steps = [x["type"] for x in json.loads(self.inner.normalizer.__getstate__())["normalizers"]]
        if (split["pattern"], split["behavior"], split["invert"], level["type"], level["add_prefix_space"], level["use_regex"], steps) != ({"Regex": _SPLIT}, "Removed", True, "ByteLevel", False, False, ["NFC", "Replace", "Lowercase"]):
            raise ValueError(f"{path} parts texts in another way")
        self.merges = self.inner.model.tokenize
        self.bytes_of = [k.to_bytes(4, "little") for k in range(max(self.inner.get_vocab().values()) + 1)]
        self.forget()

    def _part(self, part: str) -> bytes:
        """Ids of what the vocabulary doesn't part any further."""
        signs = part if part.isascii() else codecs.charmap_decode(part.encode(), "strict", _SIGNS)[0]
        bytes_of = self.bytes_of
        return b"".join([bytes_of[t.id] for t in self.merges(signs)])

    def _one(self, chunk: str) -> bytes:
        """Learn a chunk from its parts, which are remembered too."""
        known = self.known
        found = self.before.get(chunk)
        if found is None:
            low = chunk.lower()
            if low.isascii() and low.isalpha():
                parts = [low]
            else:
                parts = _PARTS.findall(low)
                if _SPECIAL in chunk or len("".join(parts)) != len(low):
                    parts = []
            if len(parts) > 1:
                found = b"".join(map(known.__getitem__, parts))
            elif parts:
                found = self._part(low) if low == chunk else known[low]
            else:
                found = np.asarray(self.inner.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= _LONGEST:
            known[chunk] = found
        return found

    def _learn(self, chunks: list[str]) -> None:
        """Learn chunks of other signs in one string, between marks that have an id of their own."""
        known, before = self.known, self.before
        known.update((c, before[c]) for c in chunks if c in before)
        lows = {c: low if (low := c.lower()) != c and _SPECIAL not in c and "Σ" not in c and is_normalized("NFC", c) and is_normalized("NFC", low) else c for c in chunks if c not in known}
        plain = [c for c in {*lows.values()} if _MARK not in c and c not in known]
        for lo in range(0, len(plain), 2048):
            part = plain[lo : lo + 2048]
            ids = np.asarray(self.inner.encode_batch_fast([f" {_MARK} ".join([*part, ""])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.mark)
            flat, at = ids.tobytes(), 0
            for chunk, end in zip(part, ends.tolist(), strict=True):
                known[chunk] = flat[4 * at : 4 * end]
                at = end + 1
        known.update((c, known[low]) for c, low in lows.items())

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of some texts, learnt together."""
        if len(self.known) > REMEMBERED:  # what was used lately stays in the older half
            self.known, self.before = _Known(self._one), self.known
        simple = [_SPECIAL not in t and _simple(t) for t in texts]
        split = [_TAIL.sub(r" \g<0>", t.lower()) if plain else t for t, plain in zip(texts, simple, strict=True)]
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in split]
        if not all(simple):
            others = {c for chunks, plain in zip(split, simple, strict=True) if not plain for c in chunks if not c.isascii()}
            self._learn([c for c in others if c not in self.known and not _simple(c)])
        get = self.known.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def forget(self) -> None:
        self.known, self.before = _Known(self._one), {}


def _simple(text: str) -> bool:
    return text.isascii() or _SIMPLE.fullmatch(text) is not None


@lru_cache(maxsize=1)
def tokenizer(path: str) -> ChunkTokenizer:
    found = ChunkTokenizer(path)
    holders.append(found.forget)  # other operators' tasks in this worker drop what it remembers
    return found


def pieces(docs: DataFrame, vocabulary: str, limit: int = 4096, end_id: int = 1) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each text's ids and ``end_id``, cut at ``limit``.

    A null text counts as empty and gives one piece of ``end_id`` alone; so does a
    text of white space. Null doc_ids and repeated rows are kept as they are.
    """

    small_batches(docs.sparkSession)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        end, size = int(end_id).to_bytes(4, "little"), 4 * limit
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            lo = 0
            while lo < len(ids_of):
                own, hi, length = [], lo, 0
                while hi < len(ids_of) and length < TOGETHER:
                    own.append(texts[hi].as_py() or "")
                    length += len(own[-1])
                    hi += 1
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc, ids in zip(ids_of[lo:hi], tok.encode_all(own), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), size)):
                        piece = ids[at : at + size]
                        for column, value in zip(out, (doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=_PIECE.names)
                lo = hi

    return docs.select("doc_id", "text").mapInArrow(cut_up, _PIECE)


def best_fit(sizes: list[int], limit: int) -> list[int]:
    """The bin of each item, items placed by decreasing size into the fullest bin that has room."""
    rooms: list[int] = []  # sorted distinct rooms
    by_room: dict[int, list[int]] = {}
    found = [0] * len(sizes)
    bins = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(rooms, sizes[i])
        if at == len(rooms):
            b, room = bins, limit
            bins += 1
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        left = room - sizes[i]
        found[i] = b
        if left:
            if left not in by_room:
                bisect.insort(rooms, left)
                by_room[left] = []
            by_room[left].append(b)
    return found


def _open(total: np.ndarray, limit: int, slack: int, spare: int) -> np.ndarray:
    """Which bins go to the next round: those up to half full, of which best-fit leaves one at most, and the ``spare`` roomiest others.

    No two bins over half full fit together, so more of them than there are small ones can't be completed.
    """
    under = np.flatnonzero(total < limit - slack)
    under = under[np.argsort(total[under], kind="stable")]
    small = int(np.searchsorted(total[under], limit // 2, "right"))
    found = np.zeros(len(total), bool)
    found[under[: small + spare]] = True
    return found


def _round(level: int, limit: int, slack: int, spare: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        used = table.column("used").to_numpy()
        items = table.column("items").combine_chunks()
        if isinstance(items, pa.ChunkedArray):
            items = items.chunk(0)
        bins = np.asarray(best_fit(used.tolist(), limit))
        order = np.argsort(bins, kind="stable")
        bounds = np.flatnonzero(np.diff(bins[order], prepend=-1))
        total = np.add.reduceat(used[order], bounds)
        counts = items.value_lengths().to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(counts[order], bounds))]).astype(np.int32)
        before = np.cumsum(used[order]) - used[order]
        before -= np.repeat(before[bounds], np.diff(bounds, append=len(order)))
        flat = items.take(pa.array(order)).flatten()
        fields = [flat.field(name) for name in _PIECE.names]
        fields.append(pa.array(flat.field("offset").to_numpy(zero_copy_only=False) + np.repeat(before, counts[order])))
        merged = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=_ITEM.names))
        again = _open(total, limit, slack, spare)
        # one number for each bin of all rounds: 6 bits of the round, 26 of the partition, 31 of the bin
        name = (level << 57) + (part << 31) + np.arange(len(total), dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(name), pa.array(total.astype(np.int64)), pa.array(np.where(again, level, -1).astype(np.int32)), merged],
            schema=pa.schema([("bin", pa.int64()), ("used", pa.int64()), ("level", pa.int32()), ("items", merged.type)]),
        )

    return pack


def packed(cut_pieces: DataFrame, limit: int = 4096, slack: int = 8, fan_in: int = 8, each: int = 50_000, spare: int = 64) -> DataFrame:
    """``cut_pieces`` with ``sequence_id`` and ``offset``; every piece is in one sequence, gapless from 0.

    ``slack`` is how far from full an emitted bin may be before the last round,
    ``each`` how many pieces a partition of the first round takes, ``spare`` how many bins over half full
    a partition hands on to be completed elsewhere; later partitions hold ``fan_in * (spare + 1)``
    items, whatever the lengths. Rows with the same doc_id and piece, and rows with a null doc_id, are
    items of their own; no pieces give no rows. Sequences are numbered by round, partition and bin, so no number is used twice.
    """
    rows = cut(compact(cut_pieces))
    parts = max(1, rows.count() // each)
    one = rows.select(F.lit(0).cast("long").alias("bin"), F.col("length").alias("used"), F.lit(0).alias("level"), F.array(F.struct(*_PIECE.names, F.lit(0).cast("long").alias("offset"))).alias("items"))
    key = F.xxhash64(F.element_at("items", 1))
    level, finished = 0, []
    while True:
        level += 1
        spread = one.repartition(parts, key) if parts > 1 else one.coalesce(1)
        ordered = spread.sortWithinPartitions(F.desc("used"), F.element_at("items", 1))
        last = parts == 1
        bins = cut(ordered.mapInArrow(_round(level, limit, slack, spare), _BIN))
        finished.append(bins if last else bins.where("level = -1"))
        if last:
            break
        one = bins.where("level <> -1")
        parts = -(-parts // fan_in)
    bins = finished[0]
    for more in finished[1:]:
        bins = bins.unionByName(more)
    return bins.select(F.col("bin").alias("sequence_id"), F.inline("items")).select(*_PIECE.names, "sequence_id", "offset")
