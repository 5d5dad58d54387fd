"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is computed in linear time as half of
|sum v_i x_i|^2 - sum |v_i|^2 x_i^2. Words are the distinct lower-cased words of a whole text, hashed; structure
statistics are shares of character kinds, repeated words and lines, and lengths, each in a few bins; metadata are numeric
columns in bins of powers of two.

Training rows: at most `per_class` labelled rows of either label, by hash of the id, of fold 1-4; the intercept is moved
back to the label shares of all labelled rows of these folds. Without labelled rows of both labels every score is the
share of label 1 (0.5 if there is none). Null texts count as empty and are scored; a null metadata value has its own bin.
Repeated rows repeat their scores, an empty table stays empty; labels, lang, source and ids are never inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, map_batches

WORDS, BINS, RANK = 1 << 16, 12, 8
KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"\t\r", b".", b",", b"!", b"?", b"|", b"#$%&*", b"<>{}[]()", b"\"'", b"/\\@_=+~^`", b":;", b"-", bytes(range(128, 256)), bytes([*range(9), *range(14, 32), 127])]
EDGES = np.array([0, 0.001, 0.003, 0.01, 0.025, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7])
STATS = len(KINDS) + 8
KIND_OF = np.zeros((256, len(KINDS)))
for _k, _chars in enumerate(KINDS):
    KIND_OF[list(_chars), _k] = 1


def structure(raw: bytes, words: list[bytes], distinct: int) -> np.ndarray:
    """Bin numbers of all statistics."""
    n, m = max(len(raw), 1), max(len(words), 1)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ KIND_OF / n
    lines = raw.split(b"\n")
    seen = set(lines)
    pairs = 1 - len(set(zip(words, words[1:]))) / max(m - 1, 1) if m > 1 else 0.0
    rest = [1 - distinct / m, 1 - len(seen) / len(lines), pairs]
    longest = max(map(len, words), default=0)
    scale = [np.log2(len(raw) + 1) / 2, np.log2(m + 1) / 2, len(raw) / m / 2, np.log2(len(raw) / len(lines) + 1), np.log2(longest + 1)]
    binned = np.searchsorted(EDGES, np.concatenate([shares, rest]), "left")
    return np.concatenate([binned, np.clip(np.array(scale), 0, BINS - 1).astype(np.int64)]) + np.arange(STATS) * BINS


class Features:
    """Feature numbers and values of a row; word hashes are remembered up to `remember` words."""

    def __init__(self, extra: int, remember: int = 150_000):
        self.extra, self.remember = extra, remember
        self.known = _Hashes()

    @property
    def size(self) -> int:
        return WORDS + STATS * BINS + self.extra * 64

    def __call__(self, text: str, metadata: Sequence) -> tuple[np.ndarray, np.ndarray]:
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.lower().split()
        distinct = set(words)
        if len(self.known) > self.remember:
            self.known.clear()
        hashed = np.unique(np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct)))
        shape = structure(raw, raw.split(), len(distinct)) + WORDS
        bins = [WORDS + STATS * BINS + 64 * j + (0 if v is None or v != v else 1 + min(62, int(abs(v)).bit_length())) for j, v in enumerate(metadata)]
        at = np.concatenate([hashed, shape, np.array(bins, np.int64)])
        value = np.full(len(at), 0.5, np.float32)
        value[: len(hashed)] = 1 / np.sqrt(max(len(hashed), 1))
        return at, value


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = zlib.crc32(word) % WORDS
        return value


def raw_scores(model: dict, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The machine's value before the sigmoid, by the identity: table columns are w, |v|^2 and v."""
    table, out = model["table"], np.empty(len(rows))
    for k, (at, x) in enumerate(rows):
        part = table[at]
        out[k] = x @ part[:, 0] + 0.5 * (((x @ part[:, 2:]) ** 2).sum() - (x * x) @ part[:, 1])
    return out + model["w0"]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, epochs: int = 8, rate: float = 0.1, decay: float = 1e-4, seed: int = 3, batch: int = 64) -> dict:
    """Adagrad over mini-batches; only the rows of the weight table that a batch touches are updated."""
    rng = np.random.default_rng(seed)
    w = np.zeros((size, 1 + RANK), np.float64)
    w[:, 1:] = rng.normal(0, 0.02, (size, RANK))
    seen, w0, seen0 = np.full_like(w, 1e-6), 0.0, 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            at = np.concatenate([rows[i][0] for i in pick])
            x = np.concatenate([rows[i][1] for i in pick]).astype(np.float64)[:, None]
            length = np.array([len(rows[i][0]) for i in pick])
            begin = np.cumsum(length) - length
            part = w[at]
            sums = np.add.reduceat(part[:, 1:] * x, begin)
            squares = np.add.reduceat((part[:, 1:] * x) ** 2, begin).sum(axis=1)
            z = w0 + np.add.reduceat(part[:, 0] * x[:, 0], begin) + 0.5 * ((sums**2).sum(axis=1) - squares)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]
            gx = np.repeat(g, length)[:, None] * x
            grad = np.concatenate([gx, gx * (np.repeat(sums, length, axis=0) - part[:, 1:] * x)], axis=1)
            to = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], at[to][1:] != at[to][:-1]]))
            own = at[to][first]
            grad = np.add.reduceat(grad[to], first) / len(pick) + decay * w[own]
            seen[own] += grad**2
            w[own] -= rate * grad / np.sqrt(seen[own])
            g0 = g.mean()
            seen0 += g0 * g0
            w0 -= rate * g0 / np.sqrt(seen0)
    return {"w0": w0, "table": np.column_stack([w[:, 0], (w[:, 1:] ** 2).sum(axis=1), w[:, 1:]]).astype(np.float32)}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", metadata: Sequence[str] = (), per_class: int = 3000) -> dict:
    marked = labels.where(F.col(label).isin(0, 1) & (fold(F.col(id_col)) != 0)).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("ones")).first()
    own = docs.select(F.col(id_col), F.col(text_col), *(F.col(c).cast("double").alias(f"__m{j}") for j, c in enumerate(metadata)))
    rows = labelled_sample(own, labels, label, id_col, text_col, per_class, [f"__m{j}" for j in range(len(metadata))])
    columns = ["__text", "__h", "__y", *(f"__m{j}" for j in range(len(metadata)))]

    def start():
        make = Features(len(metadata))

        def work(cols):
            made = [make(t, m) for t, m in zip(cols[0], zip(*cols[3:]) if cols[3:] else [()] * len(cols[0]))]
            return [cols[1], cols[2], [a.astype(np.int32).tobytes() for a, _ in made], [x.tobytes() for _, x in made]]

        return work

    got = sorted((r["h"], r["y"], bytes(r["a"]), bytes(r["x"])) for r in map_batches(rows.select(columns), "h long, y int, a binary, x binary", start, 64).collect())
    share = marked["ones"] / marked["n"] if marked["n"] else 0.5
    y = np.array([r[1] for r in got], np.float64)
    if not len(y) or y.min() == y.max():
        edge = min(max(share, 1e-3), 1 - 1e-3)
        return {"w0": float(np.log(edge / (1 - edge))), "table": None}
    made = [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(x, np.float32)) for _, _, a, x in got]
    model = fit(made, y, Features(len(metadata)).size)
    here = y.mean()
    model["w0"] += float(np.log(share / (1 - share)) - np.log(here / (1 - here)))
    return model


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", metadata: Sequence[str] = (), threshold: float = 0.3, keep: Sequence[str] = ()) -> DataFrame:
    """(id, held_out, score, predicted) and the columns named in `keep`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    m = len(metadata)

    def start():
        own, make = shared.value, Features(m)

        def work(cols):
            if own["table"] is None:
                z = np.full(len(cols[0]), own["w0"])
            else:
                z = raw_scores(own, [make(t or "", row) for t, row in zip(cols[2], zip(*cols[3 : 3 + m]) if m else [()] * len(cols[0]))])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return [cols[0], cols[1], p, (p >= threshold).astype(np.int32), *cols[3 + m :], *([cols[2]] if text_col in keep else [])]

        return work

    kinds, others = dict(docs.dtypes), [c for c in keep if c != text_col]
    rows = docs.select(F.col(id_col).alias("__id"), (fold(F.col(id_col)) == 0).alias("__held"), F.col(text_col).alias("__text"), *(F.col(c).cast("double").alias(f"__m{j}") for j, c in enumerate(metadata)), *others)
    schema = f"`{id_col}` {kinds[id_col]}, held_out boolean, score double, predicted int" + "".join(f", `{c}` {kinds[c]}" for c in others + [c for c in keep if c == text_col])
    return map_batches(rows, schema, start, 256)
