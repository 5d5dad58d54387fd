"""Queries over keyword, vector and fused rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk, evidence, rank, titles
from ..registry import query, table
from ..session import stored
from . import base


@query("WITH " + base.PAGES + ", " + base.TERMS + ", d AS (SELECT DISTINCT term FROM terms) SELECT d.term, count(*) AS df FROM d JOIN chunks c ON contains(lower(c.path || ' ' || c.heading || ' ' || c.text), d.term) GROUP BY d.term")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = rank.question_terms(base.questions(spark, sf_dir))
    return rank.document_frequency(rank.term_hits(base.pages(spark, sf_dir), terms, F.concat_ws(" ", "path", "heading", "text")))


KEYWORD = (
    "WITH "
    + base.PAGES
    + ", "
    + base.TERMS
    + r""", hay AS (SELECT *, lower(path || ' ' || heading || ' ' || text) AS h, lower(regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '')) AS stem FROM chunks),
dt AS (SELECT DISTINCT term FROM terms),
hit AS (SELECT h.chunk_id, t.term, (length(h.h) - length(replace(h.h, t.term, ''))) / length(t.term) AS n, contains(lower(h.heading), t.term) AS in_heading, contains(h.stem, t.term) AS in_stem FROM hay h JOIN dt t ON contains(h.h, t.term)),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
one AS (SELECT h.chunk_id, h.term, 2.0 * h.n / (h.n + 1.0) * (ln(CAST((SELECT count(*) FROM chunks) AS DOUBLE) + 1.0) - ln(CAST(d.df AS DOUBLE) + 1) + 1.0) + CASE WHEN in_heading THEN 3.0 ELSE 0.0 END + CASE WHEN in_stem THEN 2.0 ELSE 0.0 END AS s FROM hit h JOIN df d USING (term)),
kw AS (SELECT t.query_id, o.chunk_id, sum(o.s) AS s FROM terms t JOIN one o USING (term) GROUP BY t.query_id, o.chunk_id),
bare AS (SELECT query_id, regexp_replace(query, '\s+', '', 'g') AS q FROM questions),
grams AS (SELECT DISTINCT query_id, lower(substr(q, i, n)) AS g FROM (SELECT *, unnest(range(1, length(q) - n + 2)) AS i FROM (SELECT *, unnest(range(3, 9)) AS n FROM bare) WHERE length(q) >= n)),
wanted AS (SELECT DISTINCT g FROM grams),
has AS (SELECT DISTINCT s.chunk_id, s.g FROM (SELECT chunk_id, substr(h, i, n) AS g FROM (SELECT *, unnest(range(1, length(h) - n + 2)) AS i FROM (SELECT chunk_id, h, unnest(range(3, 9)) AS n FROM hay))) s SEMI JOIN wanted USING (g)),
pairs AS (SELECT g.query_id, h.chunk_id, count(*) AS n FROM has h JOIN grams g USING (g) GROUP BY g.query_id, h.chunk_id),
both_sums AS (SELECT query_id, chunk_id, round(coalesce(k.s, 0.0) + least(1.0, 0.1 * coalesce(p.n, 0)), 4) AS score FROM pairs p FULL JOIN kw k USING (query_id, chunk_id)),
scored AS (SELECT b.query_id, b.chunk_id, h.path, b.score FROM both_sums b JOIN hay h USING (chunk_id)),
places AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank0 FROM scored WHERE score > 0)"""
)


@query(KEYWORD + " SELECT * FROM places WHERE rank0 < 8")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.keyword_scores(base.questions(spark, sf_dir), base.pages(spark, sf_dir), 8)


@query("WITH " + base.LISTS + " SELECT query_id, path, chunk_id, score, hits, rank0 FROM kw")
def legacy_file_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.keyword_list(spark, sf_dir)


@query("SELECT vec_id, len(embedding) AS dim, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm, len(embedding) > 0 AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0 AS usable FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.norms(table(spark, sf_dir, "embeddings"))


COSINE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
c AS (SELECT q.vec_id AS query_id, i.vec_id, round(list_dot_product(q.v, i.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(i.v, i.v))), 4) AS score FROM v q JOIN v i ON {0})
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank0 FROM c WHERE score >= {1}) WHERE rank0 < 8"""


@query(COSINE.format("q.vec_id % 20 = 0", "0.3"))
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id 20 divides against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return rank.cosine_scores(vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), vectors, 8, 0.3)


@query(
    """WITH v AS (SELECT vec_id, vec_id % 20 = 0 AS asks, vec_id // 100 AS question, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
c AS (SELECT q.question AS query_id, i.vec_id, max(round(list_dot_product(q.v, i.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(i.v, i.v))), 4)) AS score FROM v q JOIN v i ON q.asks GROUP BY q.question, i.vec_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank0 FROM c WHERE score >= 0.1) WHERE rank0 < 8"""
)
def cosine_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of up to five vectors each (those whose ids 20 divides, by hundreds): the best of its vectors counts for every row."""
    vectors = table(spark, sf_dir, "embeddings")
    near = rank.cosine_scores(vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), vectors, 8, 0.1)
    best = near.groupBy(F.floor(F.col("query_id") / 100).alias("query_id"), "vec_id").agg(F.max("score").alias("score"))
    return rank.top(best, 8, "vec_id")


FIELDS = "query_id, path, chunk_id, rrf_score, keyword_score, embedding_score, source, rank0"


@query("WITH " + base.FUSED + f" SELECT {FIELDS} FROM fused")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.fused(spark, sf_dir)


@query("WITH " + base.FUSED + f" SELECT {FIELDS} FROM fused WHERE rrf_score >= 0.015")
def rrf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.fused(spark, sf_dir).where("rrf_score >= 0.015")


@query("WITH " + base.FUSED + f" SELECT {FIELDS} FROM (SELECT *, max(rrf_score) OVER (PARTITION BY query_id) AS best FROM fused) WHERE rrf_score >= 0.3 * best")
def relative_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.relative_floor(base.fused(spark, sf_dir))


@query(KEYWORD + " SELECT query_id, path, chunk_id, rank0 FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY rank0) AS k FROM places WHERE rank0 < 40) WHERE k <= 2")
def per_file_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the forty best chunks of a question, two of each file."""
    ranked = rank.keyword_scores(base.questions(spark, sf_dir), base.pages(spark, sf_dir), 40).drop("score")
    return rank.per_file(ranked, 2)


@query(
    "WITH "
    + base.FUSED
    + """, v AS (SELECT query_id % 4 AS topic, query_id, path, chunk_id, rank0, 1.0 / (60.0 + rank0 + 1) AS w FROM fused),
b AS (SELECT topic, path, query_id, max(w) AS w, min(query_id * 1000 + rank0) AS seen FROM v GROUP BY ALL), d AS (SELECT topic, path, round(sum(w), 8) AS document_score, min(seen) AS document_seen FROM b GROUP BY topic, path),
c AS (SELECT topic, path, chunk_id, round(sum(w), 8) AS chunk_score, min(query_id * 1000 + rank0) AS chunk_seen FROM v GROUP BY ALL)
SELECT topic, path, chunk_id, chunk_score, document_score, row_number() OVER (PARTITION BY topic ORDER BY document_score DESC, document_seen, chunk_score DESC, chunk_seen) AS place FROM c JOIN d USING (topic, path)"""
)
def doc_rrf_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as viewpoints of four topics."""
    return rank.order_by_document(base.fused(spark, sf_dir).withColumn("topic", F.col("query_id") % 4))


@query(
    "WITH "
    + base.EVIDENCE
    + r""", t AS (SELECT *, lower(snippet) AS sn, lower(heading) AS hd, lower(regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '')) AS stem, list_distinct(list_filter(list_transform(string_split_regex(lower(query), '[\s,、。・/\\]+'), lambda x: trim(x)), lambda x: length(x) >= 2)) AS ts FROM evidence),
s AS (SELECT *, round(rrf_score + list_sum(list_transform(ts, lambda x: CASE WHEN contains(sn || ' ' || hd || ' ' || stem, x) THEN 1.0 ELSE 0.0 END + CASE WHEN contains(hd, x) THEN 2.0 ELSE 0.0 END + CASE WHEN contains(stem, x) THEN 0.75 ELSE 0.0 END)) + 1.0 / CAST(rank0 + 100 AS DOUBLE), 6) AS rerank_score FROM t)
SELECT query_id, chunk_id, rerank_score, place, CASE source WHEN 'embedding' THEN 'embedding+rerank' WHEN 'keyword' THEN 'keyword+rerank' ELSE 'embedding+keyword+rerank' END AS source
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank0) AS place FROM s) WHERE place <= 8"""
)
def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.evidence(spark, sf_dir)
    return rank.rerank(rows.drop("heading", "snippet", "query"), base.questions(spark, sf_dir), rows.select("chunk_id", "heading", "snippet").distinct())


FATES = (
    "WITH "
    + base.FUSED
    + """, g AS (SELECT query_id % 4 AS topic, path, chunk_id, query_id * 100 + rank0 AS rank0 FROM fused), k AS (SELECT *, row_number() OVER (PARTITION BY topic, path ORDER BY rank0) AS k FROM g),
n AS (SELECT *, sum(CASE WHEN k <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY topic ORDER BY rank0 ROWS UNBOUNDED PRECEDING) AS n FROM k),
fates AS (SELECT topic AS query_id, path, chunk_id, rank0, CASE WHEN k > 2 THEN 'per_file_limit' WHEN n > 40 THEN 'total_limit' ELSE 'selected' END AS fate FROM n)"""
)


def _fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.fused(spark, sf_dir).select((F.col("query_id") % 4).alias("topic"), "path", "chunk_id", (F.col("query_id") * 100 + F.col("rank0")).alias("rank0"))
    return rank.select_candidates(rows.withColumnRenamed("topic", "query_id"), 2, 40)


@query(FATES + " SELECT * FROM fates")
def candidate_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fates(spark, sf_dir)


@query(FATES + " SELECT query_id, count(*) AS ranked, count(*) FILTER (fate = 'selected') AS selected, count(*) FILTER (fate = 'per_file_limit') AS over_file, count(*) FILTER (fate = 'total_limit') AS over_total FROM fates GROUP BY query_id")
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was ranked is what was selected and what was left out."""
    count = lambda fate, name: F.count_if(F.col("fate") == fate).alias(name)
    return _fates(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("ranked"), count("selected", "selected"), count("per_file_limit", "over_file"), count("total_limit", "over_total"))


@query(
    "WITH "
    + base.EVIDENCE
    + """, m AS (SELECT t.query_id, t.term FROM terms t WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.query_id = t.query_id AND contains(lower(e.snippet), t.term))),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY term) AS k FROM m)
SELECT q.query_id, q.query || coalesce(' ' || (SELECT string_agg(term, ' ' ORDER BY term) FROM k WHERE k.query_id = q.query_id AND k.k <= 4), '') AS retry FROM questions q"""
)
def retry_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question with up to four terms that no evidence has."""
    seen = base.evidence(spark, sf_dir).groupBy("query_id").agg(F.lower(F.array_join(F.collect_list("snippet"), "\n")).alias("text"))
    own = base.questions(spark, sf_dir).join(seen, "query_id", "left")
    missing = F.slice(F.array_sort(F.filter(T.split_terms(F.col("query")), lambda t: ~F.coalesce(F.contains(F.col("text"), t), F.lit(False)))), 1, 4)
    return own.select("query_id", F.array_join(F.concat(F.array("query"), missing), " ").alias("retry"))


@query(
    "WITH "
    + base.FILES
    + ", "
    + base.QUESTIONS
    + r""", d AS (SELECT path, regexp_replace(lower(regexp_extract(text, '^[^\n]*', 0)), '[^\p{L}\p{N}]+', '', 'g') AS core FROM files), q AS (SELECT query_id, regexp_replace(lower(query), '[^\p{L}\p{N}]+', '', 'g') AS q FROM questions),
p AS (SELECT q.query_id, d.path, d.core, q.q, list_distinct(list_transform(range(1, greatest(length(core), 1)), lambda i: substr(core, i, 2))) AS g FROM q, d WHERE length(core) >= 4),
s AS (SELECT query_id, path, CASE WHEN contains(q, core) THEN 2 WHEN CAST(len(list_filter(g, lambda x: contains(q, x))) AS DOUBLE) / len(g) >= 0.5 THEN 1 ELSE 0 END AS strength, round(CAST(len(list_filter(g, lambda x: contains(q, x))) AS DOUBLE) / len(g), 4) AS coverage FROM p)
SELECT query_id, path, strength, coverage, count(*) FILTER (strength = 2) OVER (PARTITION BY query_id) = 1 AND strength = 2 AS confirmed FROM s WHERE strength > 0"""
)
def title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose title is in the question (2) or shares half its 2-grams (1); one strong match alone is confirmed."""
    asked = base.questions(spark, sf_dir).select("query_id", T.compact_raw(F.col("query")).alias("q"))
    own = base.files(spark, sf_dir).select("path", T.compact_raw(F.regexp_extract("text", r"^[^\n]*", 0)).alias("core")).where("length(core) >= 4")
    scored = titles.share_of_grams(own, asked)
    # Rows are not moved: strong ones are counted by question, and questions are the small side.
    alone = scored.where("strength = 2").groupBy("query_id").count().where("count = 1").select("query_id", F.lit(True).alias("alone"))
    out = scored.join(F.broadcast(alone), "query_id", "left")
    return out.select("query_id", "path", "strength", F.round("coverage", 4).alias("coverage"), (F.coalesce("alone", F.lit(False)) & (F.col("strength") == 2)).alias("confirmed"))


# ---- evidence


@query()
def hybrid_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every file by greedy line folding, ranked by keywords and linked vectors, fused, capped and graded."""
    chunks = stored(chunk.chunk_files(base.files(spark, sf_dir)), "chunks")
    asked = base.questions(spark, sf_dir)
    keyword = rank.keyword_scores(asked, chunks, 20)
    first = chunks.where("start_line = 1").groupBy("doc_id", "path").agg(F.min("chunk_id").alias("chunk_id"))
    vector = base.linked_vectors(spark, sf_dir, first, 20, 0.1).join(first, "doc_id").drop("doc_id")
    kept = stored(rank.per_file(rank.relative_floor(rank.fuse(keyword, vector, 16)), 2), "kept")
    text = chunks.select("chunk_id", "heading", F.substring("text", 1, 1200).alias("snippet"))
    few = kept.select("chunk_id").distinct()
    met = text.join(F.broadcast(few) if kept.count() <= 1_000_000 else few, "chunk_id", "left_semi")  # only texts of rows that are left travel
    rows = kept.join(met, "chunk_id").join(asked, "query_id").withColumn("group_id", F.lit(None).cast("string"))
    return evidence.confidence(rows)
