"""The language model trains on every id of every training text."""

import numpy as np
import pytest

from tessera.llm import lm
from tessera.llm.common import fold, materialize

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")


def test_windows_predict_every_id_once():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, lm.END, n) for n in (0, 1, 2, 13, 14, 15, 16, 17, 29, 30, 31, 500)]
    raws = [np.concatenate([[lm.END], t, [lm.END]]).astype("<u2").tobytes() for t in texts]
    want = np.concatenate([np.append(t, lm.END) for t in texts])
    for most in (1, 3, 4096):
        got = [x[:, 1:][live] for x, live in lm.windows(raws, most)]
        assert np.array_equal(np.concatenate(got), want)
    ids, live = next(lm.windows(raws))
    assert len(ids) == lm.how_many(np.array([len(t) + 1 for t in texts])).sum()
    assert all(x[1:][on].size == 0 or on[0] or not on[: lm.WINDOW - lm.STRIDE].any() for x, on in zip(ids, live))
    assert list(lm.windows([])) == []


def test_training_reads_texts_to_their_ends(spark):
    """A word far inside a long text, away from any 4096th byte, counts in the experts."""
    deep = "the house stands near a river " * 60 + "watermelon " * 60 + "and people walk " * 60
    docs = spark.createDataFrame([(i, deep if i == 9 else None if i == 6 else f"a river and people {i}") for i in range(40)], "doc_id long, text string")
    assert docs.where("doc_id = 9").select(fold(F.col("doc_id"))).first()[0] != 1
    stored = materialize(lm.text_ids(docs, PATH, "doc_id", "text"), "ids", "zstd")
    assert stored.count() == docs.where(fold(F.col("doc_id")) != 1).count()
    encode = lm.Encoder(PATH)
    own = next(bytes(r["t"]) for r in stored.collect() if len(r["t"]) > 1000)
    assert own == b"".join([lm.END.to_bytes(2, "little"), *encode(lm.words_of(deep)), lm.END.to_bytes(2, "little")])
    share = lm.train_model(stored, PATH)["share"]
    met, unmet = (int(lm.window_ids(encode([w])[0])[0]) for w in (b"watermelon", b"telescope"))
    assert share[met].max() > 5 * share[unmet].max()


def test_lexicon_learns_without_copying_what_it_knows():
    steps = (np.array([], np.int64), np.array([], np.float32))
    words = [f"word{i}".encode() for i in range(400)]
    lexicon, once = lm.Lexicon(PATH, steps, {}), lm.Lexicon(PATH, steps, {})
    held = set()
    for at in range(0, len(words), 4):
        lexicon([*words[at : at + 4], b""])
        held.add(lexicon.size.__array_interface__["data"][0])
    assert len(held) < 20
    for got, want in zip(lexicon(words)[1:], once(words)[1:]):
        assert np.array_equal(got, want)
