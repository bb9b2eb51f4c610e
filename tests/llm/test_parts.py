"""Chunks of common scripts are parted here, with the ids of the plain tokenizer; capitals that compose with marks keep theirs."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillspark.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def same(own, plain, text):
    assert own.encode(text) == np.asarray(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), ascii(text)


def test_capitals_without_a_composed_form_keep_their_marks():
    plain, own = Tokenizer.from_file(VOCABULARY), packing.ChunkTokenizer(VOCABULARY)
    for t in ["H̱", "T̈x", "J̌.", "W̊", "Y̊", "a H̱amid, ẖ", "İ.", "Ị̇", "ΣΣ.", "KÅẞ"]:
        same(own, plain, t)


def test_parts_have_the_ids_of_the_plain_tokenizer(monkeypatch):
    plain, own, rng = Tokenizer.from_file(VOCABULARY), packing.ChunkTokenizer(VOCABULARY), random.Random(7)
    signs = [c for c in map(chr, range(1, 0x10000)) if packing._SIMPLE.fullmatch(c)]
    for c in signs[:1500] + signs[1500::50]:
        same(own, plain, f"x{c}y {c}. {c}'s {c}{c}7 A{c}")
    odd = ["́", "̱", "̇", "゙", "İ", "Σ", "ς", "ᄀ", "ᅡ", "ᆨ", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "\x01", "\x85", "\xa0", "\U0001f600", "'LL", "'s", "H", "J", "a", ".", " ", "\n"]
    for k in range(4_000):
        monkeypatch.setattr(packing, "REMEMBERED", rng.choice([3, 50, 10**6]))
        same(own, plain, "".join(rng.choice(odd if k % 2 else odd + rng.sample(signs, 20)) for _ in range(rng.randint(1, 12))))


def test_common_scripts_never_reach_the_whole_tokenizer(monkeypatch):
    plain, own = Tokenizer.from_file(VOCABULARY), packing.ChunkTokenizer(VOCABULARY)
    texts = ["Don't stop... it's 2024%%%, (really)!", "«Ça» coûte 5€ – “très” cher…", "Żółw, ПРИВЕТ. γειά 漢字です 한글"]
    wanted = [np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    own.encode("")
    monkeypatch.setattr(own, "inner", None)
    assert own.encode_all(texts) == wanted
    assert len(own.known) < 60 and "stop" in own.known and "stop..." not in own.known
