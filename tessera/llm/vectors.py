"""Vector code compression: product quantisation in whole numbers, by exact matrix products of limbs.

Components become integers, vectors are cut into equal parts, and every part position has a codebook. Distances to all entries
need the dot products of rows and entries. Integers are broken into limbs so short that a float64 product of two matrices of limbs
stays below 2^53 and is exact whatever order BLAS adds in; the products of limbs are shifted together in int64. Squared norms less twice the
dot product give the squared distance, and the first least one is the nearest entry. Where a distance could pass 2^63, that block
is worked out in Python's integers instead.

Codebooks start as the parts of the first vectors by id. Every round, tasks assign their rows and send one count and one sum a
codebook entry, whatever the number of rows or copies; the sums meet in Spark, the new entries are broadcast.

Left out: vectors that are null, are empty, hold a null or non-finite component (or one of 2^52 and beyond, whose integer doesn't fit), have a length that
the number of parts doesn't divide, or another length than the vector of the least id kept. Ids: null ids come after all others when the
codebook is chosen, equal ids in the order of their vectors. Repeated rows are rows of their own. With fewer rows than entries
codebooks are shorter. An empty table stays empty. An error that doesn't fit a long is null, and so is a label's sum with it. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, join_by_class, materialize

ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
BLOCK = 4096


def limb_bits(width: int) -> int:
    """The most bits for which `width` products of two limbs add up to less than 2^53."""
    return (52 - max(0, (width - 1).bit_length())) // 2


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 limbs of int64 values, the lowest first; all but the last are of `bits` bits and not negative, the last has the sign."""
    out, rest = [], values
    while len(rest) and (rest.max(initial=0) >= 1 << bits or rest.min(initial=0) < -(1 << bits)):
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return [*out, rest.astype(np.float64)]


def dots(rows: list[np.ndarray], entries: list[np.ndarray], bits: int) -> np.ndarray:
    """Dot products modulo 2^64 from the limbs of both sides (entries transposed)."""
    total = None
    for i, a in enumerate(rows):
        for j, b in enumerate(entries):
            if bits * (i + j) >= 64:
                continue  # nothing of it is left modulo 2^64
            product = (a @ b).astype(np.int64)
            product = product << (bits * (i + j)) if i + j else product
            total = product if total is None else total + product
    return total


class Codebook:
    """The entries of one part position, ready to be compared with rows."""

    def __init__(self, entries: list[list[int]]):
        self.entries = np.array(entries, np.int64)
        self.width, self.bits = self.entries.shape[1], limb_bits(self.entries.shape[1])
        self.limbs = limbs(np.ascontiguousarray(self.entries.T), self.bits)
        self.norms = (self.entries * self.entries).sum(1)  # modulo 2^64, like all of it
        self.most = max(int(self.entries.max()), -int(self.entries.min()))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, list[int] | np.ndarray]:
        """Number of the nearest entry (the first of equals) and the squared distance, for int64 rows."""
        most = max(int(rows.max(initial=0)), -int(rows.min(initial=0)))
        if self.width * (most + self.most) ** 2 >= 1 << 63:
            entries = self.entries.astype(object)
            far = [((entries - row) ** 2).sum(1) for row in rows.astype(object)]
            code = [min(range(len(d)), key=d.__getitem__) for d in far]
            return np.array(code, np.int64), [int(d[c]) for d, c in zip(far, code)]
        with np.errstate(over="ignore"):
            far = (rows * rows).sum(1)[:, None] - 2 * dots(limbs(rows, self.bits), self.limbs, self.bits) + self.norms
        code = far.argmin(1)
        return code, far[np.arange(len(rows)), code]


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> DataFrame:
    """The stored (id, label, v): kept vectors as arrays of longs."""
    x = F.col("x").cast("array<double>")
    whole = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 52))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x")).where((F.size("x") > 0) & (F.size("x") % parts == 0) & F.forall(x, whole))
    ints = kept.select("id", "label", F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"))
    made = materialize(ints, "integer-vectors")
    first = made.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v")).first()
    return made.where(F.size("v") == first[0]) if first else made


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> list[list[list[int]]]:
    got = [r["v"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    if not got:
        return []
    width = len(got[0]) // parts
    return [[v[p * width : (p + 1) * width] for v in got] for p in range(parts)]


def refine(rows: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """One round: every entry becomes the floored mean of its parts, entries without parts stay."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = len(books), len(books[0]), len(books[0][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in shared.value]
        count = np.zeros((parts, entries), np.int64)
        low, high = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            every = _matrix(batch.column(0))
            for at in range(0, len(every), BLOCK):
                for p, book in enumerate(own):
                    block = np.ascontiguousarray(every[at : at + BLOCK, p * width : (p + 1) * width])
                    code = book.nearest(block)[0]
                    order = np.argsort(code, kind="stable")
                    met, begin = np.unique(code[order], return_index=True)
                    count[p, met] += np.diff(np.append(begin, len(code)))
                    low[p, met] += np.add.reduceat(block[order] & 0xFFFFFFFF, begin)  # halves of 32 bits: no sum of them overflows
                    high[p, met] += np.add.reduceat(block[order] >> 32, begin)
        met = np.flatnonzero(count.ravel())
        sums = np.concatenate([low.reshape(-1, width), high.reshape(-1, width), count.reshape(-1, 1)], 1)[met]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1) * (2 * width + 1), pa.int32()), pa.array(sums.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(met), lists], ["slot", "sums"])
        give_back()

    sums = rows.select("v").mapInArrow(run, "slot long, sums array<long>").select("slot", F.posexplode("sums").alias("at", "x"))
    found = sums.groupBy("slot", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).toArrow()
    table: dict[int, dict[int, int]] = {}
    for slot, at, x in zip(found["slot"].to_pylist(), found["at"].to_pylist(), found["x"].to_pylist()):
        table.setdefault(slot, {})[at] = int(x)
    out = [[list(e) for e in b] for b in books]
    for slot, x in table.items():
        out[slot // entries][slot % entries] = [(x[k] + (x[width + k] << 32)) // x[2 * width] for k in range(width)]
    return out


def digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def assign(rows: DataFrame, books: list[list[list[int]]]) -> DataFrame:
    """(id, label, code, error) of every row; code has two hex digits a part."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    kinds = dict(rows.dtypes)
    width = len(books[0][0]) if books else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in shared.value]
        for batch in batches:
            every = _matrix(batch.column(2))
            codes, errors = [np.zeros((0, len(own)), np.uint8)], []
            for at in range(0, len(every), BLOCK):
                found = [b.nearest(np.ascontiguousarray(every[at : at + BLOCK, p * width : (p + 1) * width])) for p, b in enumerate(own)]
                codes.append(np.stack([c for c, _ in found], 1).astype(np.uint8))
                errors += [sum(map(int, e)) for e in zip(*(d for _, d in found))]
            hexes = [row.tobytes().hex() for row in np.concatenate(codes)]
            fit = [e if e < 1 << 63 else None for e in errors]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hexes, pa.string()), pa.array(fit, pa.int64())], ["id", "label", "code", "error"])
        give_back()

    return rows.select("id", "label", "v").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """The codes, (id, code, error, label_error, codebooks_sha256), and the final codebooks [part][entry][position]."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    rows = integer_rows(vectors, id_col, vector_col, label_col, parts)
    books = first_codebooks(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = refine(rows, books)
    coded = materialize(assign(rows, books).withColumn("of", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "vector-codes")
    wide = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = materialize(coded.groupBy("of").agg(F.count("*").alias("n"), F.when((F.count("error") == F.count("*")) & (wide < F.lit(str(2**63)).cast("decimal(38,0)")), wide).cast("long").alias("label_error")), "label-errors")
    joined = join_by_class(coded, sums, "of", coded.count())
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")), books


def decode(code: str, books: list[list[list[int]]]) -> list[int]:
    """The integer vector that a code stands for."""
    return [x for p, book in enumerate(books) for x in book[int(code[2 * p : 2 * p + 2], 16)]]


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL: every round joins all parts with all entries of their position."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT r, vec_id, k, v[k * (len(v) // {parts}) + 1 : (k + 1) * (len(v) // {parts})] AS x FROM v, range({parts}) AS t(k))",
        f"b0 AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id, x) - 1 AS e, x AS c FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY vec_id, x) <= {entries})",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (SELECT r, k, min_by(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, p.k, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM p JOIN b{n} USING (k)) GROUP BY r, k)"""
        )
        if n < rounds:
            steps.append(
                f"""m{n} AS (SELECT k, e, list(m ORDER BY i) AS c FROM (SELECT k, e, i, CAST(floor(sum(xi) / count(*)) AS BIGINT) AS m
  FROM (SELECT k, e, unnest(x) AS xi, generate_subscripts(x, 1) AS i FROM p JOIN a{n} USING (r, k)) GROUP BY k, e, i) GROUP BY k, e)"""
            )
            steps.append(f"b{n + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m ON b.k = m.k AND b.e = m.e)")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT r, string_agg(lower(printf('%02x', e)), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(t, ',' ORDER BY k, e)) FROM (SELECT k, e, array_to_string(c, ',') AS t FROM b{rounds})) AS codebooks_sha256
FROM v JOIN coded USING (r)"""


ORACLE = oracle()
