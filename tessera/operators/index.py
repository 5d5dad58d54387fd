"""Incremental maintenance of an embedding index: what changed, what can be reused, what a build would cost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, deleted, changed or unchanged; manifests: path, file_sha256."""
    met = old.select("path", F.col("file_sha256").alias("a")).join(new.select("path", F.col("file_sha256").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return met.select("path", change.alias("change"))


def valid_vector(vector, dim: int):
    return (F.size(vector) == dim) & F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def reusable(chunks: DataFrame, cache: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks whose cached vectors may be kept: their file is unchanged, has the same chunks, and every entry of it is valid.

    chunks: path, chunk_id, text_sha256, file_sha256; cache: path, chunk_id, text_sha256, valid; manifest: path, file_sha256 as cached.
    """
    met = chunks.join(cache.select("chunk_id", F.col("text_sha256").alias("old"), "valid"), "chunk_id", "full_outer")
    path = F.coalesce("path", F.regexp_replace("chunk_id", "#[0-9]+$", ""))
    files = met.groupBy(path.alias("path")).agg(F.bool_and(F.coalesce((F.col("text_sha256") == F.col("old")) & F.col("valid"), F.lit(False))).alias("whole"), F.max("file_sha256").alias("now"))
    kept = files.where("whole").join(manifest, (files.path == manifest.path) & (files.now == manifest.file_sha256), "left_semi").select("path")
    return chunks.join(kept, "path", "left_semi")


def snapshot_signature(rows: DataFrame, *columns: str) -> DataFrame:
    """One hash of a table that no order changes: rows are hashed where they are, and 256 sorted digests by first byte are hashed again."""
    hashed = rows.select(F.sha2(F.concat_ws("|", *columns), 256).alias("h"))
    parts = hashed.groupBy(F.substring("h", 1, 2).alias("k")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ""), 256).alias("signature"), F.sum("n").alias("rows"))


def embed(texts: DataFrame, call: Callable[[list[str]], list[list[float]]], batch: int = 16, most_bytes: int = 1_000_000) -> DataFrame:
    """(chunk_id, embedding) by an external model, in batches of at most `batch` texts and `most_bytes` bytes.

    A batch whose answer has another length, or vectors of several dimensions or with parts that aren't finite, fails the task.
    """
    import math

    import pyarrow as pa

    def run(batches):
        for rows in batches:
            ids, values = (c.to_pylist() for c in rows.columns)
            out, part, size = [], [], 0
            for text in [*values, None]:
                n = len((text or "").encode())
                if part and (text is None or len(part) == batch or size + n > most_bytes):
                    got = call(part)
                    if len(got) != len(part) or len({len(v) for v in got}) != 1 or not all(math.isfinite(x) for v in got for x in v):
                        raise ValueError("the model's answer doesn't fit its batch")
                    out, part, size = [*out, *got], [], 0
                part.append(text)
                size += n
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.list_(pa.float32()))], names=["chunk_id", "embedding"])

    return texts.select("chunk_id", "text").mapInArrow(run, "chunk_id string, embedding array<float>")


def hashed_embedding(texts: list[str], dim: int = 16) -> list[list[float]]:
    """A deterministic stand-in for a model: signed counts of hashed words."""
    import zlib

    out = []
    for text in texts:
        v = [0.0] * dim
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            v[h % dim] += 1.0 if h & 0x10000 else -1.0
        out.append(v)
    return out
