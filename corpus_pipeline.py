"""Preparation of a training corpus: five stages over documents, each written as Parquet and reread.

What every stage does with awkward rows: a null text counts as empty (it stays null where the row stays); a null or repeated id is no
reason to drop a row, rows being told apart by their texts; rows equal in id and text are copies of each other, of which the
near-copy stage keeps one; texts are read whole, however long; an empty table stays empty; further columns are passed on as they
are, whatever their names. Ties (equal ids in a group of copies) fall to the smaller MD5 of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, quality, simhash, spread
from tessera.llm.common import materialize, read
from tessera.llm.queries import vocabulary
from tessera.session import ready


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, as they are."""
    model = quality.train(docs, read(ready(spark), sf_dir, "labels"), metadata=["n_chars"])
    carried = {c: f"__{k}" for k, c in enumerate(docs.columns) if c != "text"}  # names of their own beside those of the scores
    own = docs.select("doc_id", "text", "n_chars", *(F.col(f"`{c}`").alias(n) for c, n in carried.items()))
    kept = quality.score(own, model, metadata=["n_chars"], keep=[*carried.values(), "text"]).where("predicted = 1")
    return kept.select(*(F.col(carried.get(c, c)).alias(c) for c in docs.columns))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that five sites or more share (their first occurrence stays); n_chars follows the text."""
    ready(spark)
    clash = {c: f"__{c}" for c in docs.columns if c in ("n_lines", "n_dropped")}
    out = spread.drop_spread_lines(docs.withColumnsRenamed(clash), min_sites=5)
    out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every group of near copies: links of the vantage-point tree first, those outside its radius after them, all checked."""
    ready(spark)
    return simhash.keep_one(docs, words=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make less than a twentieth."""
    text = F.coalesce(docs["text"], F.lit(""))
    th = F.md5(text.cast("binary"))
    found = decontaminate.contaminated(docs.select(th.alias("th"), text.alias("text")), read(ready(spark), sf_dir, "benchmark"), "th")
    bad = found.where("contaminated").select(F.col("th").alias("__t")).distinct()  # by text: ids may be missing or repeated
    return docs.join(bad.hint("shuffle_hash"), th == bad["__t"], "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    ready(spark)
    return bpe.bpe_digest(docs, vocabulary())


STAGES = [
    ("quality_fm", keep_quality),
    ("line_spread", drop_boilerplate),
    ("simhash_vptree", drop_near_copies),
    ("decontam_index", drop_contaminated),
    ("bpe_codec", encode),
]

#: SQL can't express the trained classifier or the vocabulary; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(ready(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
