"""Ids of odd texts against the plain tokenizer, and how few bins are handed on."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "B", "İ", ".", "!", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", " ", "\n", "é", "É", "Σ", "ß", "9", "'s", "'S", "\x01", "́", "漢", "_", "|", "ﬁ", " ", "ſ", "K", "ı", "\x1f", "\x85", "\u0958", "ŉ", "ǰ", "ÿ", "Ÿ", "ȇ", "×", "º"]


def test_ids_equal_the_plain_tokenizer():
    plain, own, rng = Tokenizer.from_file(VOCABULARY), packing.ChunkTokenizer(VOCABULARY), random.Random(4)
    texts = ["Hello <|ENDOFTEXT|> world", "a <|EndOfText|>.", "İ.", "ABCİ. x", "<|endoftext|>", "é. É! ŒUF."]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 12))) for _ in range(5_000)]
    for t in texts:
        assert own.encode(t) == np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def sizes(spark, lengths):
    return spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing._PIECE)


def check(rows, lengths):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
    assert sorted(r.length for r in rows) == sorted(lengths)
    return len(by)


def test_lengths_that_never_fit_do_not_reach_the_last_task():
    total = np.array([2100] * 500 + [4090, 10])
    again = packing._open(total, 4096, 8, 4)
    assert again.sum() == 5 and again[-1] and not again[-2]


def test_rounds_keep_every_piece_and_fill_well(spark):
    rng = random.Random(2)
    for lengths in ([2100] * 2000, [2100] * 1200 + [1500] * 400, [rng.randint(1, 4096) for _ in range(6000)], [1] * 900, [4096] * 50 + [3000] * 50 + [7] * 500):
        rows = packing.packed(sizes(spark, lengths), each=500, fan_in=3, spare=16).collect()
        n = check(rows, lengths)
        assert n <= 1.02 * len(set(packing.best_fit(lengths, 4096))) + 4, (n, lengths[:3])
    assert packing.packed(sizes(spark, [])).count() == 0


def test_sequence_numbers_are_no_hashes(spark):
    rows = packing.packed(sizes(spark, [3000] * 100), each=10)
    assert rows.agg(F.count_distinct("sequence_id")).first()[0] == 100 and rows.where("sequence_id < 0").count() == 0
