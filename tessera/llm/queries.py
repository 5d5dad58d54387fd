"""The queries of the thirteen operators, applied to their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, lexical, lm, media, quality, secrets, simhash, spread, tokenfile, toxicity, vectors
from .common import read


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"), metadata=["n_chars"])
    return quality.score(docs, model, metadata=["n_chars"])


def op2_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(secrets.labelled_tokens(docs)))


def op3_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spread.drop_spread_lines(read(spark, sf_dir, "documents"), min_sites=5)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


def op4_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(read(spark, sf_dir, "documents"))


def op5_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(read(spark, sf_dir, "documents"), vocabulary())


def op7_toxicity_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op8_lm_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"), vocabulary())


def op9_langid_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op10_decontam_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.compress(read(spark, sf_dir, "embeddings"))[0]


def op13_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


_EVERY = (
    op1_quality_fm, op2_secret_markov, op3_line_spread, op4_media_tiles, op5_simhash_vptree, op6_bpe_codec, op7_toxicity_automata, op8_lm_attention, op9_langid_subword, op10_decontam_index,
    op11_token_files, op12_vector_codes, op13_best_position,
)
QUERIES = {f.__name__: f for f in _EVERY}
ORACLES: dict[str, str] = {"op3_line_spread": spread.ORACLE, "op12_vector_codes": vectors.ORACLE, "op13_best_position": lexical.ORACLE}
