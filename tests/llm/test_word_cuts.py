"""Words cut at marks have the ids of whole texts."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402
from tessera.llm import tokenfile  # noqa: E402

PATH = P.path("word_bpe_49k.json")


def test_words_end_at_marks():
    got = tokenfile.Encoder.words(["Ab%%% don't é, x-y", None, "%a", "b÷, ö", "<|x|>-y z"])
    assert got == [[b"ab", b"%%%", b"don't", "é".encode(), b",", b"x", b"-", b"y"], [], [b"%", b"a"], ["b÷,".encode(), "ö".encode()], [b"<|x|>-y", b"z"]]


def test_cut_words_have_the_ids_of_whole_texts():
    rng, own = random.Random(5), tokenfile.Encoder(PATH, most=3000)
    parts = [*"abcdefgzABZ019 \n\t.,;:!?%$&*#@()[]{}\"/\\-_+=~^|<>`''''", "'s", "'ll", "'RE", "é", "Ö", "ß", "÷", "×", "ÿ", "é", "≠", "́", "…", "漢", "ж", "Σ", "İ", "K", "²", "½", " ", " ", "🙂", "<|endoftext|>", "<", "|>"]
    for _ in range(60):
        texts = ["".join(rng.choices(parts, k=rng.randrange(0, 60))) for _ in range(50)]
        want = [e.ids for e in own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, own.kind).tolist() for x in own(texts)] == want
