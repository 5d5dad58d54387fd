"""Queries that plan incremental indexing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build, index, structure
from ..registry import query, table
from ..session import shared_folder
from ..sources import corpus
from . import base

OLD = (
    base.FILES
    + ", old AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN sha256('old' || text) ELSE sha256(text) END AS file_sha256 FROM files WHERE doc_id % 10 <> 3), new AS (SELECT path, sha256(text) AS file_sha256 FROM files WHERE doc_id % 9 <> 5), diff AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.file_sha256 <> n.file_sha256 THEN 'changed' ELSE 'unchanged' END AS change FROM old o FULL JOIN new n ON o.path = n.path)"
)


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stored manifest that lacks every tenth file and has other content for every seventh, and the present one without every ninth."""
    own, k = base.files(spark, sf_dir), F.col("doc_id")
    old = own.where(k % 10 != 3).select("path", F.when(k % 7 == 0, F.sha2(F.concat(F.lit("old"), "text"), 256)).otherwise(F.sha2("text", 256)).alias("file_sha256"))
    return old, own.where(k % 9 != 5).select("path", F.sha2("text", 256).alias("file_sha256"))


@query("WITH " + OLD + " SELECT * FROM diff")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.diff_manifests(*_manifests(spark, sf_dir))


CHUNKED = base.PAGES + (
    ", hashed AS (SELECT c.path, c.chunk_id, sha256(c.text) AS text_sha256, sha256(f.text) AS file_sha256, f.doc_id FROM chunks c JOIN files f USING (path)), cache AS (SELECT path, chunk_id, CASE WHEN doc_id % 6 = 1 THEN 'x' ELSE text_sha256 END AS text_sha256, doc_id % 8 <> 2 AS valid FROM hashed WHERE NOT (doc_id % 5 = 0 AND ends_with(chunk_id, '#0001'))), stored AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'y' ELSE sha256(text) END AS file_sha256 FROM files), whole AS (SELECT h.path FROM hashed h LEFT JOIN cache c USING (chunk_id) GROUP BY h.path HAVING bool_and(coalesce(h.text_sha256 = c.text_sha256 AND c.valid, false))), reused AS (SELECT h.path, h.chunk_id FROM hashed h JOIN whole w USING (path) JOIN stored s ON s.path = h.path AND s.file_sha256 = h.file_sha256)"
)


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    own, k = base.files(spark, sf_dir).select("doc_id", "path", F.sha2("text", 256).alias("file_sha256")), F.col("doc_id")
    chunks = base.pages(spark, sf_dir).select("path", "chunk_id", F.sha2("text", 256).alias("text_sha256")).join(own, "path")
    cache = chunks.where(~((k % 5 == 0) & F.col("chunk_id").endswith("#0001"))).select("path", "chunk_id", F.when(k % 6 == 1, "x").otherwise(F.col("text_sha256")).alias("text_sha256"), (k % 8 != 2).alias("valid"))
    return chunks.drop("doc_id"), cache, own.select("path", F.when(k % 7 == 0, "y").otherwise(F.col("file_sha256")).alias("file_sha256"))


@query("WITH " + CHUNKED + " SELECT path, chunk_id FROM reused")
def reuse_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All or nothing by file: same hash, same chunks, every entry valid."""
    return index.reusable(*_cache(spark, sf_dir)).select("path", "chunk_id")


@query("WITH " + CHUNKED + ", n AS (SELECT (SELECT count(*) FROM hashed) AS total_chunks, (SELECT count(*) FROM reused) AS reused_chunks) SELECT total_chunks, reused_chunks, total_chunks - reused_chunks AS generated_chunks, round((total_chunks - reused_chunks) / CAST(12.5 AS DOUBLE), 3) AS estimated_seconds, CASE WHEN total_chunks = reused_chunks THEN 'no_embedding' ELSE 'estimated' END AS estimate_status FROM n")
def index_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a build would embed anew, at a rate of 12.5 chunks a second."""
    chunks, cache, stored = _cache(spark, sf_dir)
    n = chunks.agg(F.count("*").alias("total_chunks")).join(index.reusable(chunks, cache, stored).agg(F.count("*").alias("reused_chunks")))
    made = F.col("total_chunks") - F.col("reused_chunks")
    return n.select("total_chunks", "reused_chunks", made.alias("generated_chunks"), F.round(made / 12.5, 3).alias("estimated_seconds"), F.when(made == 0, "no_embedding").otherwise("estimated").alias("estimate_status"))


@query("WITH " + CHUNKED + ", h AS (SELECT sha256(chunk_id || '|' || file_sha256 || '|' || text_sha256) AS h FROM hashed), p AS (SELECT substr(h, 1, 2) AS k, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM h GROUP BY 1) SELECT sha256('model-a|' || sha256(string_agg(h, '' ORDER BY k))) AS generation, CAST(sum(n) AS BIGINT) AS rows FROM p")
def generation_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of the model and of every chunk's identity."""
    chunks = _cache(spark, sf_dir)[0]
    return index.snapshot_signature(chunks, "chunk_id", "file_sha256", "text_sha256").select(F.sha2(F.concat(F.lit("model-a|"), "signature"), 256).alias("generation"), "rows")


@query("WITH h AS (SELECT sha256(CAST(doc_id AS VARCHAR) || '|' || text) AS h FROM documents), p AS (SELECT substr(h, 1, 2) AS k, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM h GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY k)) AS signature, CAST(sum(n) AS BIGINT) AS rows FROM p")
def snapshot_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.snapshot_signature(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("WITH " + CHUNKED + ", v AS (SELECT vec_id, len(embedding) AS dim FROM embeddings) SELECT h.chunk_id, v.dim IS NOT NULL AS has_vector, v.dim = 64 AS right_size FROM hashed h LEFT JOIN v ON v.vec_id = h.doc_id WHERE ends_with(h.chunk_id, '#0001')")
def index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's first chunk with whether its linked vector is there and valid."""
    own = base.files(spark, sf_dir).select("doc_id", "path")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), index.valid_vector(F.col("embedding"), 64).alias("right_size"))
    first = base.pages(spark, sf_dir).where(F.col("chunk_id").endswith("#0001")).select("path", "chunk_id").join(own, "path")
    return first.join(vectors, "doc_id", "left").select("chunk_id", F.col("right_size").isNotNull().alias("has_vector"), "right_size")


@query(
    "WITH "
    + base.PAGES.replace("FROM documents)", "FROM documents WHERE doc_id % 9 <> 5)", 1)
    + ", old AS (SELECT path FROM files WHERE doc_id % 10 <> 3 AND doc_id % 7 <> 0) SELECT c.path, c.chunk_id, sha256(c.text) AS text_sha256, sha256(f.text) AS file_sha256, CAST(16 AS INT) AS dimension, o.path IS NOT NULL AS reused FROM chunks c JOIN files f USING (path) LEFT JOIN old o USING (path)"
)
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index built over files of which every tenth isn't there yet and every seventh reads otherwise, then brought up to the files as they are.

    The builds are told apart by their vectors' first components: what the second one embeds has a fixed one.
    """
    own, k = base.files(spark, sf_dir), F.col("doc_id")
    before = own.where(k % 10 != 3).withColumn("text", F.when(k % 7 == 0, F.concat(F.lit("old"), "text")).otherwise(F.col("text")))
    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    kept = build.Index(spark, root)
    kept.build(_chunks(before), build.Model("stand-in", "1", index.hashed_embedding))
    kept.build(_chunks(own.where(k % 9 != 5)), build.Model("stand-in", "1", marked_embedding))
    return kept.entries().select("path", "chunk_id", "text_sha256", "file_sha256", F.size("embedding").alias("dimension"), (F.get("embedding", F.lit(0)) != 1000).alias("reused"))


def marked_embedding(texts: list[str]) -> list[list[float]]:
    return [[1000.0, *v[1:]] for v in index.hashed_embedding(texts)]


def _chunks(files: DataFrame) -> DataFrame:
    pages = structure.page_chunks(corpus.with_headings(corpus.lines(files))).select("path", "chunk_id", F.sha2("text", 256).alias("text_sha256"), "text")
    return pages.join(files.select("path", F.sha2("text", 256).alias("file_sha256")), "path").select(*build.CHUNK, "text")
