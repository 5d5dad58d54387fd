"""The language model's words are worked out once a worker, its batches go through one set of buffers, and its windows share one order."""

import zlib

import numpy as np
import pytest

from tessera.llm import lm

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")
NONE = (np.array([], np.int64), np.array([], np.float32))


class Counted:
    def __init__(self, one):
        self.one, self.calls = one, 0

    def __call__(self, piece):
        self.calls += 1
        return self.one(piece)


def test_words_that_recur_are_encoded_once_when_memory_is_full():
    encode = lm.Encoder(PATH, remember=40)
    encode.known.one = counted = Counted(encode.known.one)
    often = [f"often{i}".encode() for i in range(20)]
    for k in range(30):
        words = [*often, *(f"once{k}x{i}".encode() for i in range(20))]
        got = encode(words)
        assert got == [np.array(counted.one(b" " + w), "<u2").tobytes() for w in words]
    assert counted.calls == 20 + 30 * 20


def test_lexicon_keeps_what_it_met_again():
    lexicon, known = lm.Lexicon(PATH, NONE, {b"often1": 7}, remember=100), []
    learn = lexicon.learn
    lexicon.learn = lambda words: (known.extend(words), learn(words))
    often = [f"often{i}".encode() for i in range(20)]
    for k in range(30):
        words = [*often, b"", *(f"once{k}x{i}".encode() for i in range(20))]
        number, ids, into, stop = lexicon(words)
        fresh = lm.Lexicon(PATH, NONE, {b"often1": 7})
        want = fresh(words)
        assert all(np.array_equal(a, b) for a, b in zip((ids, into, stop), want[1:]))
        for name in ("at", "crc", "size"):
            assert np.array_equal(getattr(lexicon, name)[number], getattr(fresh, name)[want[0]]), name
        assert len(lexicon.number) == lexicon.words <= 100 + len(words)
    assert sum(w in often for w in known) == 20 and len(known) == 20 + 30 * 20


def test_batches_of_unlike_sizes_share_buffers():
    """Gradients of a batch don't depend on the batches before it."""
    rng, starts = np.random.default_rng(2), lm.starts_of(PATH)
    counts = np.zeros((lm.VOCAB, lm.TOPICS))
    counts[rng.integers(0, lm.VOCAB, 5000)] = rng.integers(0, 50, (5000, lm.TOPICS))
    embed, share = lm.features(counts, starts), lm.shares(counts, starts).astype(np.float32)
    slopes = lm.Slopes(lm.start_weights())
    for n in (3, 64, 3, 1):
        ids = rng.integers(0, lm.VOCAB, (n, lm.WINDOW + 1))
        live = (rng.random((n, lm.WINDOW)) < 0.8).astype(np.float32).ravel()
        rows = lm.by_place(embed, share, starts, ids)
        held = slopes.room
        right, s = slopes(*rows, live)
        got, again = slopes.grad.copy(), lm.Slopes(lm.start_weights())
        assert np.array_equal(right, again(*rows, live)[0]) and np.array_equal(got, again.grad)
        slopes(*rows, live)
        assert slopes.room is not held and np.array_equal(got, slopes.grad)


def test_rare_words_are_sorted_once(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 1)
    df = spark.createDataFrame([(i, f"alpha beta w{i % 3} gamma") for i in range(20)], "doc_id long, text string")
    plan = lm.score(df, PATH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Window") == 3 and plan.count("Sort [light") == 1


def test_all_of_a_text_tells_its_topic(spark):
    """Two texts with the same beginning of thirteen words and other words after it are counted under the topics of these."""
    starts, share = lm.starts_of(PATH), np.full((lm.VOCAB, lm.TOPICS), 1e-6)
    for k, word in ((2, b" water"), (5, b" engine")):
        share[lm._library(PATH)._core_bpe.encode_single_piece(word), k] = 0.1
    model = {"share": share, "prior": np.full(lm.TOPICS, 1 / lm.TOPICS), "starts": starts}
    begin = "one two three four five six seven eight nine ten eleven twelve thirteen "
    texts = [begin + "water " * 30 + "alpha", begin + "engine " * 30 + "beta", "", None]
    keys = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 1][: len(texts)]
    df = spark.createDataFrame(list(zip(keys, texts)), "doc_id long, text string").repartition(1)
    for hold in (1, 300_000):
        got = {}
        for r in lm.word_counts(df, model, PATH, "doc_id", "text", hold).collect():
            got[bytes(r["word"])] = [r[f"c{k}"] for k in range(lm.TOPICS)]
            assert r["n"] == r["every"] == sum(got[bytes(r["word"])])
        at = lambda word: dict((k, n) for k, n in enumerate(got[word]) if n)
        assert at(b"alpha") == {2: 1} and at(b"beta") == {5: 1} and at(b"water") == {2: 30} and at(b"one") == {2: 1, 5: 1} and sum(got[b""]) == 4
    # Scoring finds the same topics from the texts' ids.
    cut = [[*lm.words_of(t or ""), b""] for t in texts]
    number, ids, *_ = lm.Lexicon(PATH, NONE, {})([w for words in cut for w in words])
    parts = lm.topic_parts(model)
    ends = np.flatnonzero(ids == lm.END)
    by_ids = lm.add_runs(parts[0], ids, np.append(0, ends + 1)[:-1]) + parts[1][:, None]
    assert np.array_equal(by_ids.argmax(axis=0), lm.Topics(PATH, *parts)(cut)[2])
