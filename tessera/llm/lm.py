"""Language-model scoring: causal self-attention in numpy over subword ids, with corpus counts as output, beside an exact unigram base.

Model. Words of a lower-cased text become the ids of a public byte-level vocabulary, one end id closes the text. One attention layer
reads a window of ids (the end id first) and gives, at every place, the weights of TOPICS experts and the chance that the word is over;
inside a word, and for half of its first id, shares of steps between ids in the distinct training words come first, and attention has what their discounts leave.
An expert is a distribution over the ids that start a word and one over those that go on with it; both, and the embeddings that attention
reads, come from counts over windows of all training texts (experts by expectation-maximisation). Windows overlap: each scores only its
last `stride` places (the first all), so every id is scored once, with at least window - stride ids before it except at the start
of a text. Batches of windows go through masked attention together. A word's probability is

    (1 - WORDS - PAIRS) * attention's probability of its ids and of its end
    + WORDS * the word's share in the training texts, by topic, topics weighted by attention at the word's start (of words that are
      not frequent: the share in the likeliest topic times its weight, mixed with the share in all training texts)
    + PAIRS * the word's share after the word before it in the training texts (words that are not frequent only)

and each of the three adds up to at most 1 over all words. Words and pairs of words are counted over all training texts.

Training. The ids of all training texts are stored whole and cut into the windows that scoring uses, so every id of every training text is
predicted once a round. Topics are started on a bounded sample of windows on the driver and counted over all windows; attention is started on that sample,
and then trained by Adam in every task on all windows, the tasks' weights being averaged after each round.

Scaling. Words that make over 1/HOT of all tokens (at most HOT of them, whatever the corpus) go to the tasks as a table; the occurrences of
the others meet by word, where their counts are window sums, so no count table has to fit anywhere and no frequent word is a hot key.

Training texts are those whose crc32(id as text) mod 5 is not 1. Null texts count as empty: one token, the end. Rows are told apart by
a number given when they are scored and stored, so repeated rows are each answered. Without training texts N and V are 0. An empty table stays
empty; other columns are not read, whatever their names. A text is scored whole; slices of rows are bounded by bytes, so very long texts go alone.
"""

from __future__ import annotations

import base64
import math
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, keep_memory, map_batches, materialize, roomy

END = 50256
VOCAB = END + 1
BEGIN = VOCAB  # stands before the first id of a word
WINDOW, STRIDE, DIM, TOPICS = 16, 14, 8, 8
GATES = TOPICS + 1
FEATURES = TOPICS + 4
WORDS, PAIRS = 0.75, 0.05
ONE_TOPIC = 0.8  # of WORDS, for words outside the table: the likeliest topic's share; the rest is the share in all texts
HOT = 500_000
END_CRC = np.int32(zlib.crc32(b"") - (1 << 31))
FINE = 200  # logarithms travel as integers of this many parts
EXACT = 1 << 20  # parts of a logarithm in sums that no order may change


# ---- subword ids


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, split at 0x20 and 0x09-0x0D


@lru_cache(maxsize=1)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=1)
def starts_of(path: str) -> np.ndarray:
    """Whether an id starts a word (or ends the text)."""
    out = np.zeros(VOCAB, bool)
    out[[i for b, i in _ranks(path).items() if b[:1] == b" "]] = True
    out[END] = True
    return out


@lru_cache(maxsize=1)
def _library(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=r" [^ ]+", mergeable_ranks=_ranks(path), special_tokens={})


class Coded(dict):
    """Ids of words as bytes, worked out where they are asked for first."""

    def __init__(self, one: Callable[[bytes], list[int]], older: dict[bytes, bytes]):
        self.one, self.older = one, older

    def __missing__(self, word: bytes) -> bytes:
        self[word] = out = self.older.get(word) or array("H", self.one(b" " + word)).tobytes()
        return out


class Encoder:
    """Ids of words as bytes (16 bits an id); words met before are remembered. When there are over `remember`, those met since the last time stay."""

    def __init__(self, path: str, remember: int = 200_000):
        self.remember, self.known = remember, Coded(_library(path)._core_bpe.encode_single_piece, {})

    def __call__(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > self.remember:
            older, self.known.older = self.known, {}
            self.known = Coded(older.one, older)
        return list(map(self.known.__getitem__, words))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of this worker."""
    return Encoder(path)


class Numbers(dict):
    """Words by their numbers; a word that isn't there gets the next one and is noted."""

    def __init__(self, words: Iterable[bytes]):
        super().__init__(zip(words, count()))
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Steps:
    """Kept shares of steps within words."""

    def __init__(self, pairs: tuple[np.ndarray, np.ndarray]):
        self.keys, self.kept = pairs

    def share(self, before: np.ndarray, to: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(to), np.float32)
        key = before.astype(np.int64) << 16 | to
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.kept[at], np.float32(0))


def word_ids(encode: Encoder, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all words, and which are the first and the last of a word."""
    coded = encode(words)
    size = np.fromiter(map(len, coded), np.int64, len(coded)) // 2
    ids = window_ids(b"".join(coded))
    first, last = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    ends = np.cumsum(size)
    first[ends - size], last[ends - 1] = True, True
    return ids, first, last


class Lexicon:
    """Ids, kept steps, place in the table of frequent words and CRC of words, worked out once for each word that is met.

    When they are over `remember` in number or over 10 * remember in ids, words are forgotten that were met in one call only
    (all, if those that stay were over half of that). The empty word is the end.
    """

    def __init__(self, path: str, pairs: tuple[np.ndarray, np.ndarray], place: dict[bytes, int], remember: int = 200_000):
        self.encode, self.steps, self.place, self.remember = encoder(path), Steps(pairs), place, remember
        self.clear()

    def clear(self) -> None:
        self.number = Numbers([b""])
        self.words = self.met = 1  # of the arrays of words and of ids so many places are taken
        self.size, self.at, self.base = np.ones(1, np.int64), np.array([self.place.get(b"", -1)], np.int64), np.zeros(1, np.int64)
        self.again = np.zeros(1, bool)  # met in a later call
        self.crc, self.stop = np.array([END_CRC], np.int32), np.zeros(1, np.float32)
        self.ids, self.into = np.array([END], np.uint16), np.zeros(1, np.float32)

    def forget(self) -> None:
        self.again[0] = True
        keep = np.flatnonzero(self.again[: self.words])
        size = self.size.take(keep)
        if 2 * len(keep) > self.remember or size.sum() > 5 * self.remember:
            return self.clear()
        names, base = list(self.number), np.cumsum(size) - size  # numbers are in the order of the names
        pick = np.arange(size.sum()) + np.repeat(self.base.take(keep) - base, size)
        self.number = Numbers([names[i] for i in keep.tolist()])
        self.words, self.met, self.size, self.base, self.again = len(keep), len(pick), size, base, np.zeros(len(keep), bool)
        self.at, self.crc, self.stop, self.ids, self.into = self.at.take(keep), self.crc.take(keep), self.stop.take(keep), self.ids.take(pick), self.into.take(pick)

    def learn(self, words: list[bytes]) -> None:
        ids, first, last = word_ids(self.encode, words)

        def put(old: np.ndarray, taken: int, new) -> np.ndarray:
            if taken + len(new) > len(old):
                old = np.concatenate([old[:taken], np.empty(len(new) + taken, old.dtype)])  # twice as long, so that copies add up to little
            old[taken : taken + len(new)] = new
            return old

        size = np.diff(np.append(-1, np.flatnonzero(last)))
        self.size = put(self.size, self.words, size)
        self.base = put(self.base, self.words, self.met + np.cumsum(size) - size)
        self.at = put(self.at, self.words, np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words)))
        self.again = put(self.again, self.words, np.zeros(len(words), bool))
        self.crc = put(self.crc, self.words, np.fromiter(map(zlib.crc32, words), np.int64, len(words)) - (1 << 31))
        self.stop = put(self.stop, self.words, self.steps.share(ids[last], np.full(len(words), END)))
        self.into = put(self.into, self.met, self.steps.share(np.where(first, BEGIN, np.roll(ids, 1)), ids))
        self.ids = put(self.ids, self.met, ids)
        self.words, self.met = self.words + len(words), self.met + len(ids)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words, and of all their ids: the ids, the kept share of the step into each, and of the word's end after it."""
        if self.words > self.remember or self.met > 10 * self.remember:
            self.forget()
        number, known = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)), self.words
        if self.number.new:
            self.learn(self.number.new)
            self.number.new = []
        self.again[number[number < known]] = True
        size = self.size.take(number)
        ends = np.cumsum(size)
        pick = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.base.take(number) - (ends - size), size)
        stop = np.zeros(len(pick), np.float32)
        stop[ends - 1] = self.stop.take(number)
        return number, self.ids.take(pick).astype(np.int64), self.into.take(pick), stop


def inner(counts: DataFrame, path: str, most: int = 400_000, drop: float = 0.75) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Steps within words: (keys before << 16 | id, kept shares) and, by id before, the weight that is left to attention.

    counts: word_counts(). Every distinct training word counts once; BEGIN stands before its first id and END after its last. Shares are discounted by
    `drop` a step. All steps are counted; the `most` frequent go to the tasks (a bound on the model, like that of its vocabulary).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held, parts = encoder(path), [], []

        def take():
            ids, first, last = word_ids(encode, held)
            held.clear()
            steps = np.concatenate([np.where(first, BEGIN, np.roll(ids, 1)) << 16 | ids, ids[last] << 16 | END])
            parts.append(np.unique(steps, return_counts=True))

        def pack():
            keys, n = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            keys, at = np.unique(keys, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(at, n).astype(np.int64))], names=["key", "n"])

        for batch in batches:
            held += filter(None, batch.column(0).to_pylist())
            if len(held) >= 20_000:
                take()
            if len(parts) >= 20:
                yield pack()
        if held:
            take()
        if parts:
            yield pack()

    steps = materialize(counts.where("n > 0").select("word").mapInArrow(roomy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "steps")
    sizes = sorted(((r["m"], r["count"]) for r in steps.groupBy(F.least("n", F.lit(10_000)).alias("m")).count().collect()), reverse=True)
    least, met = 10_001, 0
    for m, n in sizes:
        met += n
        if met > most:
            break
        least = m
    of = steps.groupBy(F.shiftright("key", 16).alias("before")).agg(F.sum("n").alias("n")).toArrow()
    total = np.ones(BEGIN + 1)
    total[of["before"].to_numpy()] = of["n"].to_numpy()
    table = steps.where(F.col("n") >= least).orderBy("key").toArrow()
    keys, n = table["key"].to_numpy().astype(np.int64), table["n"].to_numpy()
    kept = np.maximum(n - drop, 0) / total[keys >> 16]
    return (keys, kept.astype(np.float32)), (1 - np.bincount(keys >> 16, kept, BEGIN + 1)).clip(0, 1).astype(np.float32)


def window_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2").astype(np.int64)


def text_ids(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """(t binary, n long): all ids of every training text between two end ids, and how many windows they make."""

    def start():
        keep_memory()
        encode = encoder(path)
        end = END.to_bytes(2, "little")

        def work(cols):
            cut = [words_of(text) for text in cols[0]]
            coded, out, k = encode(list(chain.from_iterable(cut))), [], 0
            for words in cut:
                out.append(b"".join([end, *coded[k : k + len(words)], end]))
                k += len(words)
            return [out, how_many(np.fromiter(map(len, out), np.int64, len(out)) // 2 - 1).tolist()]

        return work

    own = docs.where(fold(F.col(id_col)) != 1).select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return map_batches(own, "t binary, n long", start, 256)


def how_many(length: np.ndarray) -> np.ndarray:
    """Windows of texts of so many ids, the closing one included."""
    return np.maximum(1, -(-(length - (WINDOW - STRIDE)) // STRIDE))


def windows(raws: list[bytes], most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of at most `most` windows of whole texts, as packed() gives them. Every id is predicted in one window, that in which it is scored."""
    if not raws:
        return
    flat = np.append(np.frombuffer(b"".join(raws), "<u2"), np.full(WINDOW, END, np.uint16))
    size = np.fromiter(map(len, raws), np.int64, len(raws)) // 2
    base, length = np.cumsum(size) - size, size - 1
    many = how_many(length)
    ends = np.cumsum(many)
    place = np.arange(WINDOW + 1)
    for a in range(0, int(ends[-1]), most):
        at = np.arange(a, min(a + most, int(ends[-1])))
        d = np.searchsorted(ends, at, "right")
        k = at - (ends - many)[d]
        ids = flat[(base[d] + STRIDE * k)[:, None] + place].astype(np.int64)
        left = (length[d] - STRIDE * k)[:, None]
        ids[place > left] = END
        yield ids, (place[:-1] < left) & ((place[:-1] >= WINDOW - STRIDE) | (k == 0)[:, None])


def packed(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """ids (windows x WINDOW + 1, filled with the end) and which of ids[:, 1:] are there."""
    ids, live = np.full((len(raws), WINDOW + 1), END, np.int64), np.zeros((len(raws), WINDOW), bool)
    for k, raw in enumerate(raws):
        got = window_ids(raw)
        ids[k, : len(got)], live[k, : len(got) - 1] = got, True
    return ids, live


# ---- experts


def shares(counts: np.ndarray, starts: np.ndarray, pull: float = 100.0) -> np.ndarray:
    """(id x topic): an expert's distribution over starting ids and over the others, pulled towards that of all topics."""
    out = np.empty_like(counts)
    for own in (starts, ~starts):
        c = counts[own]
        every = c.sum(axis=1, keepdims=True) + 0.02
        out[own] = (c + pull * every / every.sum()) / (c.sum(axis=0) + pull)
    return out


def duty(ids: np.ndarray, live: np.ndarray, log_share: np.ndarray, log_prior: np.ndarray) -> np.ndarray:
    """(window x topic): probabilities of the topics of whole windows."""
    z = np.where(live[:, :, None], log_share[ids[:, 1:]], 0).sum(axis=1) + log_prior
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def topic_counts(ids: np.ndarray, live: np.ndarray, r: np.ndarray) -> np.ndarray:
    flat, owner = ids[:, 1:][live], np.nonzero(live)[0]
    return np.stack([np.bincount(flat, r[owner, k], VOCAB) for k in range(TOPICS)], axis=1)


def start_topics(ids: np.ndarray, live: np.ndarray, starts: np.ndarray, rounds: int = 25, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Expert counts and prior after expectation-maximisation on a sample, from windows that the experts so far explain worst."""
    rng = np.random.default_rng(seed)
    if not len(ids):
        return np.zeros((VOCAB, TOPICS)), np.full(TOPICS, 1 / TOPICS)
    every = shares(topic_counts(ids, live, np.full((len(ids), TOPICS), 1 / TOPICS)), starts)
    common = every[:, 0]
    table = np.log(common)[:, None].repeat(TOPICS, axis=1)
    n = np.maximum(live.sum(axis=1), 1)
    for k in range(TOPICS):
        seen = np.where(live[:, :, None], table[ids[:, 1:]][:, :, : max(k, 1)], 0).sum(axis=1).max(axis=1) / n
        worst = np.argsort(seen, kind="stable")[: max(1, len(ids) // 10)]
        pick = rng.choice(worst, min(len(worst), 30), replace=False) if k else rng.choice(len(ids), min(len(ids), 30), replace=False)
        own = np.bincount(ids[pick][:, 1:][live[pick]], minlength=VOCAB)
        table[:, k] = np.log(0.5 * common + 0.5 * own / max(own.sum(), 1) + 1e-12)
    prior = np.full(TOPICS, 1 / TOPICS)
    for _ in range(rounds):
        r = duty(ids, live, table, np.log(prior))
        counts = topic_counts(ids, live, r)
        table, prior = np.log(shares(counts, starts)), (r.sum(axis=0) + 1) / (len(ids) + TOPICS)
    return counts, prior


def features(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Embeddings of ids from their counts: topic shares about their mean, start, end, frequency, and a constant."""
    prior = counts.sum(axis=0) + 1
    own = (counts + 0.5 * prior / prior.sum()) / prior
    own /= own.sum(axis=1, keepdims=True)
    n = counts.sum(axis=1)
    out = np.concatenate([2 * (own - 1 / TOPICS), starts[:, None], np.zeros((VOCAB, 1)), (np.log1p(n) / np.log1p(n.max() + 1))[:, None], np.ones((VOCAB, 1))], axis=1)
    out[END, TOPICS + 1] = 1
    return out.astype(np.float32)


# ---- attention


def softmax(z: np.ndarray) -> np.ndarray:
    np.exp(np.clip(z, -60, 60, out=z), out=z)
    z /= z.sum(axis=-1, keepdims=True)
    return z


#: Added to attention scores: nothing from later places.
MASK = np.where(np.tril(np.ones((WINDOW, WINDOW), bool)), 0, -1e9).astype(np.float32)
BACK = np.maximum(np.arange(WINDOW)[:, None] - np.arange(WINDOW), 0)  # how far back


def start_weights(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return {"Q": normal(0.3, FEATURES, DIM), "K": normal(0.3, FEATURES, DIM), "V": normal(0.2, FEATURES, GATES), "R": normal(0.2, FEATURES, GATES), "far": np.zeros(WINDOW, np.float32), "place": np.zeros((WINDOW, GATES), np.float32)}


class Slopes:
    """Parameters as one vector, and their gradients over batches of windows. Places are columns throughout, so that no product needs a copy."""

    QUERIES, KEYS, VALUES, RESIDUALS = (slice(*x) for x in ((0, DIM), (DIM, 2 * DIM), (2 * DIM, 2 * DIM + GATES), (2 * DIM + GATES, 2 * DIM + 2 * GATES)))
    ROWS, CUT = 2 * DIM + 2 * GATES, (2 * DIM + 2 * GATES) * FEATURES

    def __init__(self, w: dict[str, np.ndarray]):
        self.flat = np.concatenate([w["Q"].T.ravel(), w["K"].T.ravel(), w["V"].T.ravel(), w["R"].T.ravel(), w["far"], w["place"].T.ravel()])
        self.grad, kind = np.empty_like(self.flat), self.flat.dtype
        self.scale = kind.type(DIM**-0.5)
        self.lines = np.zeros((self.ROWS + 1, FEATURES), kind)  # queries, keys, values, sums of attention, residuals
        self.lines[self.VALUES.stop, -1] = 1  # the last feature is constant
        self.mask, self.far_of = MASK.T.astype(kind), np.equal.outer(BACK.T.ravel(), np.arange(WINDOW)).astype(kind)
        self.own = self.weights(self.flat)
        self.room: list[np.ndarray] = [np.empty((0, 0, 0), kind)]  # for one batch after another


    def weights(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        lines = flat[: self.CUT].reshape(self.ROWS, FEATURES)
        out = {k: lines[rows].T for k, rows in zip("QKVR", (self.QUERIES, self.KEYS, self.VALUES, self.RESIDUALS))}
        return {**out, "far": flat[self.CUT : self.CUT + WINDOW], "place": flat[self.CUT + WINDOW :].reshape(GATES, WINDOW).T}

    def __call__(self, x: np.ndarray, share: np.ndarray, begin: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By place: embeddings, the next id's share (topics are rows), whether it starts a word, and weight in the loss. Sets grad;
        gives the next id's probability by topics and that of a word's start. Attention stays unnormalised; its sums are a row below the values."""
        n, lines = len(x) // WINDOW, self.lines
        lines[: self.VALUES.stop] = self.flat[: self.VALUES.stop * FEATURES].reshape(-1, FEATURES)
        lines[self.VALUES.stop + 1 :] = self.flat[self.VALUES.stop * FEATURES : self.CUT].reshape(-1, FEATURES)
        lines[self.QUERIES] *= self.scale
        if len(self.room[0]) != n:
            shapes = (n, WINDOW, WINDOW), (n, WINDOW, WINDOW), (len(lines), len(x)), (GATES + 1, len(x)), (GATES + 1, len(x)), (self.ROWS, len(x))
            self.room = [np.empty(shape, x.dtype) for shape in shapes]
        a, ds, line, read, back, d = self.room
        by_window = lambda rows: rows.reshape(-1, n, WINDOW).transpose(1, 0, 2)
        np.matmul(lines, x.T, out=line)
        q, k, v = by_window(line[self.QUERIES]), by_window(line[self.KEYS]), by_window(line[self.VALUES.start : self.VALUES.stop + 1])
        np.matmul(k.transpose(0, 2, 1), q, out=a)  # (window, place read, reading place)
        a += self.own["far"][BACK.T] + self.mask
        if a.max() > 60:
            np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        np.matmul(v, a, out=by_window(read))
        over = 1 / read[GATES]
        read = read[:GATES]
        read *= over
        z = line[self.VALUES.stop + 1 :]
        z += read
        z.reshape(GATES, n, WINDOW)[...] += self.own["place"].T[:, None]
        z.clip(-60, 60, out=z)
        np.exp(z, out=z)
        part = z[:TOPICS] * share
        total, right = z[:TOPICS].sum(axis=0), part.sum(axis=0)
        right += 1e-30
        s = z[TOPICS] / (1 + z[TOPICS])
        dz = d[self.RESIDUALS]
        np.multiply(z[:TOPICS], live / total, out=dz[:TOPICS])
        part *= live / right
        dz[:TOPICS] -= part
        np.multiply(s - begin, live, out=dz[TOPICS])
        np.multiply(dz, over, out=back[:GATES])
        read *= back[:GATES]
        np.negative(read.sum(axis=0), out=back[GATES])
        np.matmul(v.transpose(0, 2, 1), by_window(back), out=ds)
        ds *= a
        np.matmul(k, ds, out=by_window(d[self.QUERIES]))
        np.matmul(q, ds.transpose(0, 2, 1), out=by_window(d[self.KEYS]))
        np.matmul(by_window(back)[:, :GATES], a.transpose(0, 2, 1), out=by_window(d[self.VALUES]))
        np.matmul(d, x, out=self.grad[: self.CUT].reshape(self.ROWS, FEATURES))
        self.grad[: DIM * FEATURES] *= self.scale
        self.grad[self.CUT : self.CUT + WINDOW] = ds.sum(axis=0).ravel() @ self.far_of
        np.einsum("gnp->gp", dz.reshape(GATES, n, WINDOW), out=self.grad[self.CUT + WINDOW :].reshape(GATES, WINDOW))
        return right / total, s


def by_place(embed: np.ndarray, share: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    want = ids[:, 1:].ravel()
    return embed.take(ids[:, :-1].ravel(), axis=0), np.ascontiguousarray(share.take(want, axis=0).T), starts.take(want)


def loss_of(right: np.ndarray, s: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return -np.log(right * np.where(begin, s, 1 - s) + 1e-38)


def step(w: dict[str, np.ndarray], embed: np.ndarray, share: np.ndarray, starts: np.ndarray, ids: np.ndarray, live: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss and gradients over a batch of windows."""
    slopes, (x, chance, begin) = Slopes(w), by_place(embed, share, starts, ids)
    weight = (live.ravel() / max(live.sum(), 1)).astype(x.dtype)
    loss = loss_of(*slopes(x, chance, begin, weight), begin) @ weight
    return float(loss), slopes.weights(slopes.grad)


def fit(w: dict[str, np.ndarray], model: dict, ids: np.ndarray, live: np.ndarray, epochs: int = 1, batch: int = 64, rate: float = 0.02, seed: int = 11) -> list[float]:
    """Adam on windows; w is changed in place. The mean loss of each epoch."""
    rng, slopes = np.random.default_rng(seed), Slopes(w)
    flat, g = slopes.flat, slopes.grad
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    t, losses = 0, []
    for epoch in range(epochs):
        mix, total = rng.permutation(len(ids)), 0.0
        for block in range(0, len(mix), 64 * batch):
            pick = mix[block : block + 64 * batch]
            x, chance, begin = by_place(model["embed"], model["share"], model["starts"], ids[pick])
            on = live[pick]
            size = np.add.reduceat(on.sum(axis=1), np.arange(0, len(pick), batch))
            weight = (on / np.maximum(size, 1).repeat(batch)[: len(pick), None]).astype(x.dtype).ravel()
            right, s = np.empty((2, len(x)), x.dtype)
            for at in range(0, len(pick), batch):
                own, t = slice(at * WINDOW, (at + batch) * WINDOW), t + 1
                right[own], s[own] = slopes(x[own], chance[:, own], begin[own], weight[own])
                pace = rate * (1 - 0.9 * (epoch + (block + at) / len(mix)) / epochs) * math.sqrt(1 - 0.99**t) / (1 - 0.9**t)
                first *= 0.9
                first += 0.1 * g
                second *= 0.99
                second += 0.01 * g * g
                flat -= np.float32(pace) * first / (np.sqrt(second) + 1e-6)
            total += float(loss_of(right, s, begin) @ (weight.reshape(len(pick), -1) * np.minimum(batch, len(pick) - np.arange(len(pick)) // batch * batch)[:, None]).ravel())
        losses.append(total / max(len(ids), 1))
    for k, own in slopes.weights(flat).items():
        w[k][...] = own
    return losses


class Scorer:
    """Queries, keys, values and residuals of an id are taken from tables; projections run once at the start."""

    def __init__(self, model: dict, batch: int = 512):
        w, e, self.batch = model["weights"], model["embed"], batch
        self.ids = np.concatenate([e @ (w["Q"] * np.float32(DIM**-0.5)), e @ w["K"], e @ w["V"], e[:, -1:], e @ w["R"]], axis=1)  # the last feature is constant
        self.bias, self.place = w["far"][BACK] + MASK, np.ascontiguousarray(w["place"].T)
        self.share, self.starts, self.left = model["share"], model["starts"], model["left"]

    def __call__(self, ids: np.ndarray, steps_into: np.ndarray, steps_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all words of the texts in `ids` (each closed by the end id, a word of its own): the probability's logarithm, the topic
        weights at the word's start, and the word's place in `ids`. The kept steps are those of a Lexicon."""
        total_length = len(ids)
        flat = np.append(ids, np.full(WINDOW, END))
        base = np.append(0, np.flatnonzero(flat[:total_length] == END) + 1)
        length, base = np.diff(base), base[:-1]
        before = np.concatenate([[END], flat[:-1]])
        before[base] = END
        begin = self.starts.take(flat)
        begin[total_length:] = False
        at_word = np.flatnonzero(begin)
        slot = np.cumsum(begin) - 1
        goes, over, gates = np.zeros(len(flat), np.float32), np.zeros(len(flat), np.float32), np.empty((len(at_word), TOPICS), np.float32)
        many = how_many(length)
        doc = np.repeat(np.arange(len(length)), many)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        place = np.arange(WINDOW)
        for a in range(0, len(doc), self.batch):
            d, k = doc[a : a + self.batch], number[a : a + self.batch]
            at = (base[d] + STRIDE * k)[:, None] + place
            live = (place < (length[d] - STRIDE * k)[:, None]) & ((place >= WINDOW - STRIDE) | (k == 0)[:, None])
            np.minimum(at, len(flat) - 1, out=at)
            to = at[live]
            g, s, p = self.windows(before[at], flat.take(to), live)
            starting = begin.take(to)
            over_p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            last = before.take(to)
            left = self.left.take(last)  # what the steps seen leave to attention
            into = steps_into.take(to)
            goes[to] = np.log(np.where(starting, 0.5 * into + (0.5 + 0.5 * self.left[BEGIN]) * p, into + left * (1 - over_p) * p) + 1e-30)
            over[to] = np.log(steps_stop.take(to - 1) + left * over_p + 1e-30)
            gates[slot.take(to[starting])] = g.compress(starting, axis=1).T
        if not len(at_word):
            return np.zeros(0), gates, at_word
        total = np.add.reduceat(goes[:total_length].astype(np.float64), at_word)
        total[:-1] += np.where(before.take(at_word[1:]) == END, 0, over.take(at_word[1:]))  # a word is over where the next starts
        return total, gates, at_word

    def windows(self, ids: np.ndarray, want: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(ids)
        x = self.ids.take(ids.ravel(), axis=0).reshape(n, WINDOW, -1)
        a = np.matmul(x[:, :, :DIM], np.ascontiguousarray(x[:, :, DIM : 2 * DIM].transpose(0, 2, 1)))  # products with transposed views are slow
        a += self.bias
        np.exp(np.minimum(a, 60, out=a), out=a)
        read = np.matmul(a, x[:, :, 2 * DIM : 2 * DIM + GATES + 1]).reshape(n * WINDOW, -1)  # the sums last
        at = np.flatnonzero(live)
        read = np.ascontiguousarray(read.take(at, axis=0).T)
        z = read[:GATES] / read[GATES]
        z += x.reshape(n * WINDOW, -1)[:, 2 * DIM + GATES + 1 :].take(at, axis=0).T
        z += self.place.take(at % WINDOW, axis=1)
        g = np.exp(np.clip(z[:TOPICS], -60, 60))
        g /= g.sum(axis=0)
        return g, z[TOPICS], (g * self.share.take(want, axis=0).T).sum(axis=0)


def train_model(stored: DataFrame, path: str, sample: int = 20_000, warm: int = 4000, rounds: int = 2) -> dict:
    """stored: text_ids(). Experts and attention start on at most 2 * `sample` windows, by hash; all windows of all texts count and train."""
    spark, starts = stored.sparkSession, starts_of(path)
    n = stored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    one_of = max(1, -(-n // sample))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = np.random.default_rng(7).integers(0, 1 << 63, WINDOW + 1, np.uint64) | np.uint64(1)
        for batch in batches:
            for ids, live in windows(batch.column(0).to_pylist()):
                mixed = (ids.astype(np.uint64) * odd).sum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                got = np.flatnonzero((mixed >> np.uint64(24)) % np.uint64(one_of) == 0)
                rows = [[x.tobytes() for x in kept[got]] for kept in (ids.astype("<u2"), live)]
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.binary()) for r in rows], names=["w", "live"])

    some = sorted((bytes(r[0]), bytes(r[1])) for r in stored.select("t").mapInArrow(roomy(choose), "w binary, live binary").limit(2 * sample).collect())
    ids = packed([w for w, _ in some])[0]
    live = np.frombuffer(b"".join(x for _, x in some), bool).reshape(len(some), WINDOW)
    counts, prior = start_topics(ids, live, starts)
    shared = spark.sparkContext.broadcast((np.log(shares(counts, starts)).astype(np.float32), np.log(prior)))
    names = [f"c{k}" for k in range(TOPICS)]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, log_prior = shared.value
        total, prior = np.zeros((VOCAB, TOPICS)), np.zeros(TOPICS)
        for batch in batches:
            for own in windows(batch.column(0).to_pylist()):
                r = duty(*own, table, log_prior)
                total += topic_counts(*own, r)
                prior += r.sum(axis=0)
        met = np.flatnonzero(total.sum(axis=1))
        rows = np.concatenate([total[met], prior[None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1).astype(np.int32)), *(pa.array(rows[:, k]) for k in range(TOPICS))], names=["id", *names])

    table = stored.select("t").mapInArrow(roomy(tally), "id int, " + ", ".join(f"{c} double" for c in names)).groupBy("id").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    at, rows = table["id"].to_numpy(), np.stack([table[c].to_numpy() for c in names], axis=1).reshape(-1, TOPICS)
    counts, prior = np.zeros((VOCAB, TOPICS)), np.ones(TOPICS)
    counts[at[at >= 0]] = rows[at >= 0]
    prior += rows[at < 0].sum(axis=0)
    model = {"share": shares(counts, starts).astype(np.float32), "embed": features(counts, starts), "starts": starts, "prior": prior / prior.sum()}
    w = start_weights()
    pick = np.random.default_rng(1).permutation(len(ids))[:warm]
    model["losses"] = fit(w, model, ids[pick], live[pick], epochs=3)
    for _ in range(rounds if n else 0):
        sent = spark.sparkContext.broadcast((model, w))

        def turn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            model, w = sent.value
            w, seen = {k: v.copy() for k, v in w.items()}, 0
            for batch in batches:
                for own in windows(batch.column(0).to_pylist()):
                    fit(w, model, *own, rate=0.004)
                    seen += len(own[0])
            if seen:
                flat = np.concatenate([w[k].ravel() for k in sorted(w)]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * seen), pa.array(np.full(len(flat), float(seen)))], names=["p", "x", "n"])

        mean = stored.select("t").mapInArrow(roomy(turn), "p int, x double, n double").groupBy("p").agg((F.sum("x") / F.sum("n")).alias("x")).orderBy("p").toArrow()["x"].to_numpy()
        cuts = np.cumsum([w[k].size for k in sorted(w)])[:-1]
        w = {k: part.reshape(w[k].shape).astype(np.float32) for k, part in zip(sorted(w), np.split(mean, cuts))}
    model["weights"] = w
    return model


# ---- words


def word_counts(docs: DataFrame, model: dict, path: str, id_col: str, text_col: str, hold: int = 300_000) -> DataFrame:
    """(word binary, n, every, c0, ..): occurrences in training texts, in all texts, and in training texts by topic.

    A task adds up words and sends them on whenever it holds `hold` of them. The end is the empty word. A text's topic is that of all its ids.
    """
    names = [f"c{k}" for k in range(TOPICS)]
    shared = docs.sparkSession.sparkContext.broadcast(topic_parts(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics = Topics(path, *shared.value)
        counts = np.zeros((1024, TOPICS + 1), np.int64)  # the last: texts that don't train

        def pack():
            words, own = list(topics.number), counts[: len(topics.number)]
            at, k = np.nonzero(own)
            n = own[at, k]
            own[...] = 0
            topics.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).take(pa.array(at)), pa.array(n), pa.array(k.astype(np.int8))], names=["word", "n", "k"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                cut = [[*words_of(t), b""] for t in batch.column(0).slice(at, 64).to_pylist()]
                number, size, topic = topics(cut)
                if len(topics.number) > len(counts):
                    counts = np.concatenate([counts, np.zeros((2 * len(topics.number) - len(counts), TOPICS + 1), np.int64)])
                into = np.where(np.array(batch.column(1).slice(at, 64).to_pylist(), bool), topic, TOPICS)
                key, n = np.unique(number * (TOPICS + 1) + np.repeat(into, size), return_counts=True)
                counts.ravel()[key] += n
                if len(topics.number) >= hold:
                    yield pack()
        yield pack()

    own = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), (fold(F.col(id_col)) != 1).alias("trains"))
    pieces = own.mapInArrow(roomy(run), "word binary, n long, k byte")
    n = F.col("n")
    return pieces.groupBy("word").agg(F.coalesce(F.sum(F.when(F.col("k") < TOPICS, n)), F.lit(0)).alias("n"), F.sum("n").alias("every"), *(F.coalesce(F.sum(F.when(F.col("k") == k, n)), F.lit(0)).alias(c) for k, c in enumerate(names)))


def topic_parts(model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(topic x id, topic): logarithms of the experts' shares (none for the end) and of the prior, in whole parts: sums by words and by ids are the same."""
    share, prior = (np.ascontiguousarray(np.rint(np.log(model[k]) * EXACT).astype(np.int64).T) for k in ("share", "prior"))
    share[:, END] = 0
    return share, prior


def add_runs(table: np.ndarray, at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(topic x run): what the columns `at` of a table add up to from each place of `begin` to the next; a row at a time, so long texts need little room."""
    return np.stack([np.add.reduceat(row.take(at), begin) for row in table]) if len(begin) else np.zeros((len(table), 0), np.int64)


class Topics:
    """Numbers of words, and the likeliest topic of each text by all its ids; what a word adds to the topics is worked out once."""

    def __init__(self, path: str, share: np.ndarray, prior: np.ndarray):
        self.encode, self.share, self.prior = encoder(path), share, prior
        self.clear()

    def clear(self) -> None:
        self.number, self.adds = Numbers([b""]), np.zeros((TOPICS, 1024), np.int64)

    def __call__(self, cut: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all words, the texts' words, and their topics; every text has its end, the empty word."""
        flat = list(chain.from_iterable(cut))
        number, size = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat)), np.fromiter(map(len, cut), np.int64, len(cut))
        new = self.number.new
        if new:
            known = len(self.number) - len(new)
            if len(self.number) > self.adds.shape[1]:
                self.adds = np.concatenate([self.adds[:, :known], np.zeros((TOPICS, 2 * len(self.number) - known), np.int64)], axis=1)
            ids, first, _ = word_ids(self.encode, new)
            self.adds[:, known : known + len(new)] = add_runs(self.share, ids, np.flatnonzero(first))
            self.number.new = []
        return number, size, np.argmax(add_runs(self.adds, number, np.cumsum(size) - size) + self.prior[:, None], axis=0)


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    names = [f"c{k}" for k in range(TOPICS)]
    model = train_model(materialize(text_ids(docs, path, id_col, text_col), "ids", "zstd"), path)
    counts = materialize(word_counts(docs, model, path, id_col, text_col), "words")
    model["steps"], model["left"] = inner(counts, path)
    sums = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["n", "every", *names]), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    total, every, distinct = sums["n"], sums["every"], sums["v"]
    below = total + 0.5 * (distinct + 1)
    of_topic = np.array([max(sums[c], 1) for c in names], np.float64)
    frequent = counts.where(F.col("every") * HOT > every).drop("every").toArrow()
    place = {w: i for i, w in enumerate(frequent["word"].to_pylist())}
    known = frequent["n"].to_numpy().astype(np.float64)
    by_topic = np.stack([frequent[c].to_numpy() / n for c, n in zip(names, of_topic)], axis=1).reshape(-1, TOPICS)
    most = every / HOT  # no word outside the table occurs more often
    shared = spark.sparkContext.broadcast((model, place, known, by_topic.astype(np.float32), np.log(of_topic)))

    def start():
        keep_memory()
        model, place, known, by_topic, log_topic = shared.value
        if "readers" not in model:  # kept beside the model, as long as this worker has it
            model["readers"] = Scorer(model), Lexicon(path, model["steps"], place)
        (scorer, lexicon), end = model["readers"], place.get(b"", -1)
        share, prior = topic_parts(model)
        logs_base = np.log10((np.append(known, 0) + 0.5) / below)
        fine = lambda x: np.rint(x * (FINE / math.log(10))).astype(np.int32)

        def work(cols):
            cut = [[*words_of(t), b""] for t in cols[2]]
            flat = list(chain.from_iterable(cut))
            size = np.fromiter(map(len, cut), np.int64, len(cut))
            doc = np.repeat(np.arange(len(cut)), size)
            number, ids, *steps = lexicon(flat)
            logs, g, at_word = scorer(ids, *steps)
            at = lexicon.at.take(number)
            hot, rare = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            here = at[hot]
            value = np.log((1 - WORDS - PAIRS) * np.exp(logs[hot]) + WORDS * np.einsum("ij,ij->i", g[hot], by_topic[here]))
            by_doc = lambda x: np.bincount(doc[hot], x, len(cut))
            done = [size, by_doc(known[here] > 0).astype(np.int64), by_doc(logs_base[here]), by_doc(value) / math.log(10)]
            text_ends = np.flatnonzero(ids == END)  # as many as texts
            topic = np.argmax(add_runs(share, ids, np.append(0, text_ends + 1)[:-1]) + prior[:, None], axis=0)
            label = np.where(np.array(cols[1], bool)[doc[rare]], g[rare].argmax(axis=1), topic[doc[rare]])
            weight = np.log(g[rare, label] + 1e-9) - log_topic[label]
            first = np.append(True, doc[1:] != doc[:-1])[rare]
            before = np.where(first, end, at[rare - 1])  # the end stands before the first word
            times = np.where(before >= 0, np.maximum(np.append(known, 0)[before], 1), max(most, 1))
            crc = lexicon.crc.take(number[rare - 1])  # the empty word's is the end's
            cuts = pa.array(np.append(0, np.cumsum(np.bincount(doc[rare], minlength=len(cut)))), pa.int32())
            entry = [pa.array([flat[i] for i in rare.tolist()], pa.binary()), np.where(first, END_CRC, crc), label.astype(np.int8), fine(logs[rare]), fine(weight), fine(np.log(times))]
            return [cols[0], cols[1], cols[3], *done, *(pa.ListArray.from_arrays(cuts, pa.array(x)) for x in entry)]

        return work

    lists = "light array<binary>, before array<int>, label array<byte>, own array<int>, weight array<int>, times array<int>"
    schema = f"id {kind}, held_out boolean, row long, n_tokens long, known long, base double, value double, {lists}"
    rows = docs.select(F.col(id_col).alias("id"), (fold(F.col(id_col)) == 1).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("row"))
    scored = materialize(map_batches(rows, schema, start, 64, 2_000_000), "scored")
    met = scored.select("row", (~F.col("held_out")).cast("int").alias("in"), F.explode(F.arrays_zip("light", "before", "label", "own", "weight", "times")).alias("x")).select("row", "in", "x.*")
    met = met.repartition("light").sortWithinPartitions("light", "label", "before")  # one order for all three windows
    seen = lambda *keys: F.sum("in").over(Window.partitionBy(*keys))
    met = met.withColumns({"pairs": seen("light", "label", "before"), "same": seen("light", "label"), "c": seen("light")})
    power = lambda c: F.pow(F.lit(10.0), F.col(c) / FINE)
    p = (1 - WORDS - PAIRS) * power("own") + WORDS * (ONE_TOPIC * F.col("same") * power("weight") + (1 - ONE_TOPIC) * F.col("c") / max(total, 1)) + PAIRS * F.least(F.lit(1.0), F.col("pairs") / power("times"))
    more = met.groupBy("row").agg(F.sum(F.log10(p)).alias("more"), F.sum(F.log10((F.col("c") + 0.5) / F.lit(float(below)))).alias("rest"), F.count(F.when(F.col("c") > 0, 1)).alias("found"))
    done = scored.drop("light", "before", "label", "own", "weight", "times").join(more, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return done.select(F.col("id").alias(id_col), "held_out", "n_tokens", plus("known", "found").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base", "rest").alias("base_score"), plus("value", "more").alias("score"))
