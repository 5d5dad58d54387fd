"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of all subwords of all its words (byte n-grams of the marked word, hashed). Since the
softmax is linear, every bucket's contribution to the scores is folded into one table before scoring, and a word's sum is
kept, so a known word costs one gather. Temperature and a rejection threshold are calibrated on a part of the sample
that SGD doesn't see: `rejected` marks predictions below the score that nearly all right ones of that part reach.

Training rows: about `per_class` of each language (one in so many, by hash of the id), of fold 1-4, whole texts; all their languages are learned. A text that is null or
has no letter gets `und` and score 0, as does everything if nothing could be learned. With one language learned that one is
predicted. Repeated rows repeat their results, an empty table stays empty, other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_batches

BUCKETS, GRAMS, DIM = 1 << 16, (1, 2, 3, 4), 16


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every <word>, and the number of n-grams by word."""
    flat = np.frombuffer(b"".join(b"<%s>" % w for w in words), np.uint8).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), size)
    rolled = np.zeros(len(flat), np.uint64)
    buckets, owners = [], []
    for n in range(1, max(GRAMS) + 1):
        keep = len(flat) - n + 1
        if keep <= 0:
            break
        rolled = rolled[:keep] * np.uint64(0x100000001B3) + flat[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            inside = owner[:keep] == owner[n - 1 :]
            mixed = (rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed[inside] >> np.uint64(48)).astype(np.int64))
            owners.append(owner[:keep][inside])
    bucket, who = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return bucket[order], np.bincount(who, minlength=len(words))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their shares of the text's subwords."""
    words = tokens(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    bucket, size = subwords(list(counts))
    total = np.bincount(bucket, np.repeat(np.fromiter(counts.values(), np.float64, len(counts)), size), BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / total.sum()).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], langs: list[str], epochs: int = 4, rate: float = 2.0, seed: int = 7) -> dict:
    """SGD over nine tenths of the rows, calibration on the rest; the same rows in the same order give the same model."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    held = rows[::10] if len(rows) >= 50 else rows
    used = [r for i, r in enumerate(rows) if i % 10] if len(rows) >= 50 else rows
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(used)).tolist():
            at, share, y = used[i]
            if not len(at):
                continue
            mean = share @ embed[at]
            g = softmax(mean @ out + bias)
            g[y] -= 1
            back = out @ g
            out -= step * np.outer(mean, g)
            bias -= 0.1 * step * g
            embed[at] -= (step * 20 * share)[:, None] * back
    table = embed @ out
    z = np.array([share @ table[at] + bias for at, share, _ in held]).reshape(-1, len(langs))
    y = np.array([r[2] for r in held], np.int64)
    heats = np.geomspace(0.25, 8, 26)
    loss = [-np.log(softmax(z / h)[np.arange(len(y)), y] + 1e-12).mean() for h in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = softmax(z / heat)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    return {"langs": langs, "table": (table / heat).astype(np.float32), "bias": bias / heat, "reject": float(np.quantile(right, 0.005)) if len(right) else 0.0}


class Scorer:
    def __init__(self, model: dict, remember: int = 300_000):
        self.model, self.remember = model, remember
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.sums = np.zeros((0, len(self.model["langs"]) + 1), np.float32)

    def learn(self, words: list[bytes]) -> None:
        bucket, size = subwords(words)
        begin = np.cumsum(size) - size
        new = np.column_stack([np.add.reduceat(self.model["table"][bucket], begin), size]).astype(np.float32)
        n = len(self.row)
        if n + len(new) > len(self.sums):
            self.sums = np.concatenate([self.sums[:n], new, np.zeros((n + 20_000, new.shape[1]), np.float32)])
        else:
            self.sums[n : n + len(new)] = new
        self.row.update(zip(words, range(n, n + len(words))))

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        langs, out = self.model["langs"], ([], [], [])
        cut = [tokens(t) for t in texts]
        if langs:
            new = set().union(*cut).difference(self.row)
            if new:
                self.learn(list(new))
        for text, words in zip(texts, cut):
            if not langs or not has_letter(text):
                lang, score = "und", 0.0
            else:
                s = self.sums[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
                p = softmax(s[:-1] / max(s[-1], 1) + self.model["bias"])
                best = int(np.argmax(p))
                lang, score = langs[best], float(min(p[best], 1.0))
            out[0].append(lang)
            out[1].append(score)
            out[2].append(score < self.model["reject"] or lang == "und")
        if len(self.row) > self.remember:
            self.clear()
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = 600) -> dict:
    """The model as plain arrays, over all languages that training rows name."""
    own = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(lang_col).alias("l")).where(F.col("l").isNotNull() & (fold(F.col("i")) > 0))
    spark = docs.sparkSession
    sizes = {r[0]: r[1] for r in own.groupBy("l").count().collect()}
    if not sizes:
        return {"langs": [], "reject": 0.0}
    langs = sorted(sizes)
    steps = spark.createDataFrame([(k, max(1, round(n / per_class))) for k, n in sizes.items()], "l string, step long")
    own = own.join(F.broadcast(steps), "l").where(F.pmod(F.xxhash64("i"), F.col("step")) == 0)  # by hash in place: no language meets in one task

    def start():
        def work(cols):
            made = [features(t) for t in cols[0]]
            return [cols[1], cols[2], [a.tobytes() for a, _ in made], [s.tobytes() for _, s in made]]

        return work

    found = map_batches(own.select("t", "l", F.xxhash64("i").alias("h")), "l string, h long, at binary, share binary", start, 64).collect()
    rows = sorted((r["h"], langs.index(r["l"]), bytes(r["at"]), bytes(r["share"])) for r in found)
    return fit([(np.frombuffer(a, np.int32), np.frombuffer(s, np.float32), y) for _, y, a, s in rows], langs) if rows else {"langs": [], "reject": 0.0}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(shared.value)
        return lambda cols: [cols[0], cols[1], *scorer(cols[2])]

    rows = docs.select(F.col(id_col), (fold(F.col(id_col)) == 0).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    return map_batches(rows, f"{id_col} {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double, rejected boolean", start, 256)
