"""Words of letters are learnt without marks between them, with the ids of the plain tokenizer."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillspark.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_words_take_no_mark_and_keep_their_ids(monkeypatch):
    plain, own, rng = Tokenizer.from_file(VOCABULARY), packing.ChunkTokenizer(VOCABULARY), random.Random(5)
    letters = "abcdefgnostxyzABCZéßÉÑıſʰªº漢字ΣσςİǅŉДдⅷ가각가́\U00010428\U0001e900\U00016ea0Ƛᲊ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(4_000)] + list(letters)
    for t in [*words, " ".join(words)]:
        assert own.encode(t) == np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)
    asked = []
    own.forget()
    monkeypatch.setattr(own, "inner", type("Counted", (), {"encode_batch_fast": lambda _, x, **kw: asked.append(x) or plain.encode_batch_fast(x, **kw)})())
    own.encode("some plain words, and others.")
    assert not [x for x in asked for c in x if "plain" in c]
