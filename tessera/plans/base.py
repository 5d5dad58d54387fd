"""Inputs that several queries share, in Spark and as common table expressions of DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rank, structure
from ..registry import table
from ..session import stored
from ..sources import corpus

FILES = "files AS (SELECT doc_id, source || '/' || lang || '/doc-' || printf('%06d', doc_id) || '.md' AS path, lang, source, text FROM documents)"
LINES = (
    FILES
    + r""",
arr AS (SELECT doc_id, path, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS ls
        FROM (SELECT doc_id, path, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS p FROM files)),
lines AS (SELECT doc_id, path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM arr)"""
)
MD = (
    LINES
    + """,
md AS (SELECT doc_id, path, line_no, CASE WHEN line_no = 1 THEN '# ' WHEN line_no % 7 = 0 THEN '### ' WHEN line_no % 4 = 0 THEN '## ' ELSE '' END || line AS line FROM lines),
sizes AS (SELECT path, count(*) AS n_lines FROM md GROUP BY path)"""
)
HEADS = (
    MD
    + r""",
heads AS (SELECT path, line_no, length(regexp_extract(line, '^ {0,3}(#{1,6})(?:[ \t]+(.*))?$', 1)) AS level,
                 trim(regexp_replace(regexp_extract(line, '^ {0,3}(#{1,6})(?:[ \t]+(.*))?$', 2), '(^|[ \t]+)#+[ \t]*$', '')) AS heading
          FROM md WHERE regexp_matches(line, '^ {0,3}(#{1,6})(?:[ \t]+(.*))?$')),
sections AS (SELECT h.path, h.line_no, h.level, h.heading,
                    coalesce((SELECT min(n.line_no) FROM heads n WHERE n.path = h.path AND n.line_no > h.line_no AND n.level <= h.level) - 1, s.n_lines) AS section_end,
                    (SELECT max(p.line_no) FROM heads p WHERE p.path = h.path AND p.line_no < h.line_no AND p.level < h.level) AS parent_line
             FROM heads h JOIN sizes s USING (path))"""
)
PAGES = (
    MD
    + r""",
marked AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^ {0,3}#{1,6}[ \t]') THEN regexp_extract(line, '^ {0,3}#{1,6}[ \t]+(.*)$', 1) END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no) AS heading0 FROM md),
chunks AS (SELECT path, path || '#' || printf('%04d', (line_no - 1) // 8 + 1) AS chunk_id, coalesce(arg_min(heading0, line_no), '') AS heading,
                  min(line_no) AS start_line, max(line_no) AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS text
           FROM marked GROUP BY path, (line_no - 1) // 8)"""
)
QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
#: Documents dealt over all benchmark items, by the items' order.
DEALT = "dealt AS (SELECT f.doc_id, f.path, b.text AS query FROM files f JOIN (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM benchmark) b ON b.k = f.doc_id % b.n)"
TERMS = (
    QUESTIONS
    + r""",
terms AS (SELECT query_id, unnest(list_distinct(list_filter(list_transform(string_split_regex(query, '[\s,、。・/\\]+'), lambda x: lower(trim(x))), lambda x: length(x) >= 2))) AS term FROM questions)"""
)
#: Two ranked lists of 20 files a question: by rarity of the terms they have, and by the vectors linked to them.
LISTS = (
    FILES
    + ", "
    + TERMS
    + """,
distinct_terms AS (SELECT DISTINCT term FROM terms),
found AS (SELECT f.path, t.term, contains('doc-' || printf('%06d', f.doc_id), t.term) AS in_stem
          FROM files f JOIN distinct_terms t ON contains(lower(f.path || ' ' || f.text), t.term)),
dfs AS (SELECT term, count(*) AS df FROM found GROUP BY term),
idf AS (SELECT t.query_id, f.path, round(sum(ln(CAST((SELECT count(*) FROM files) AS DOUBLE) / d.df) * CASE WHEN f.in_stem THEN 4.0 ELSE 1.0 END), 4) AS score, count(*) AS hits
        FROM terms t JOIN found f USING (term) JOIN dfs d USING (term) GROUP BY t.query_id, f.path),
kw AS (SELECT * FROM (SELECT query_id, path, path || '#0001' AS chunk_id, score, hits, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path || '#0001') - 1 AS rank0 FROM idf WHERE score > 0) WHERE rank0 < 20),
vecs AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
cos AS (SELECT q.vec_id AS q, i.vec_id, round(list_dot_product(q.v, i.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(i.v, i.v))), 4) AS score
        FROM vecs q JOIN vecs i ON q.vec_id % 20 = 0),
asks AS (SELECT q.query_id, v.vec_id AS q FROM questions q JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k, count(*) OVER () AS n FROM vecs WHERE vec_id % 20 = 0) v ON v.k = q.query_id % v.n),
em AS (SELECT * FROM (SELECT qq.query_id, f.path, f.path || '#0001' AS chunk_id, c.score, row_number() OVER (PARTITION BY qq.query_id ORDER BY c.score DESC, c.vec_id) - 1 AS rank0
       FROM asks qq JOIN cos c ON c.q = qq.q AND c.score >= 0.1 JOIN files f ON f.doc_id = c.vec_id) WHERE rank0 < 20)"""
)
FUSED = (
    LISTS
    + """,
both_lists AS (SELECT query_id, path, chunk_id, rank0, score AS keyword_score, NULL AS embedding_score, 'keyword' AS source, 0 AS list FROM kw
         UNION ALL SELECT query_id, path, chunk_id, rank0, NULL, score, 'embedding', 1 FROM em),
merged AS (SELECT query_id, path, chunk_id, round(sum(1.0 / CAST(rank0 + 60 AS DOUBLE)), 6) AS rrf_score, max(keyword_score) AS keyword_score, max(embedding_score) AS embedding_score,
                  array_to_string(list_sort(list_distinct(list(source))), '+') AS source, min(list * 1000 + rank0) AS seen FROM both_lists GROUP BY query_id, path, chunk_id),
fused AS (SELECT * EXCLUDE (seen) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, seen) - 1 AS rank0 FROM merged) WHERE rank0 < 20)"""
)
#: Fused rows with the text of their files, as evidence.
EVIDENCE = (
    FUSED
    + r""",
evidence AS (SELECT f.*, q.query, substr(d.text, 1, 1200) AS snippet, regexp_extract(d.text, '^[^\n]*', 0) AS heading FROM fused f JOIN files d USING (path) JOIN questions q USING (query_id))"""
)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(table(spark, sf_dir, "documents"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.lines(files(spark, sf_dir))


def md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.with_headings(lines(spark, sf_dir))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = md(spark, sf_dir)
    return structure.sections(structure.headings(rows), rows.groupBy("path").agg(F.count("*").alias("n_lines")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.page_chunks(md(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def number_rows(rows: DataFrame, order: str) -> DataFrame:
    """rows with row_no, from 0 in the order of a column: sorted into ranges, counted by range, and numbered within; no task sees all rows."""
    sorted_rows = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    placed = stored(sorted_rows.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)), "numbered")
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())  # one row a range
    before, done = {}, 0
    for part, n in counts:
        before[part], done = done, done + n
    offsets = rows.sparkSession.createDataFrame(list(before.items()), "_part int, _before long")
    return placed.join(F.broadcast(offsets), "_part").withColumn("row_no", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, query): documents dealt over all benchmark items, by the items' order (as if the items were a user's questions)."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    n = items.count()
    numbered = number_rows(items, "item_id").withColumnRenamed("row_no", "k")
    return files(spark, sf_dir).select("doc_id", "path", (F.col("doc_id") % F.lit(max(n, 1))).alias("k")).join(numbered, "k").select("doc_id", "path", "query")


def keyword_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = files(spark, sf_dir).select("path", F.concat("path", F.lit("#0001")).alias("chunk_id"), F.lit("").alias("heading"), "text")
    return rank.idf_scores(questions(spark, sf_dir), whole, 20)


def linked_vectors(spark: SparkSession, sf_dir: str, linked: DataFrame, top_k: int, least: float) -> DataFrame:
    """(query_id, doc_id, score, rank0): every question's vector (one of those whose id 20 divides) against all vectors that `linked` (doc_id) has."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    own = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = rank.cosine_scores(own, vectors.join(linked.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"), top_k, least)
    asked = number_rows(own.select(F.col("query_id").alias("q")), "q")
    asks = questions(spark, sf_dir).select("query_id", (F.col("query_id") % F.lit(max(own.count(), 1))).alias("row_no")).join(asked, "row_no").select("query_id", "q")
    return asks.join(near.withColumnRenamed("query_id", "q"), "q").select("query_id", F.col("vec_id").alias("doc_id"), "score", "rank0")


def vector_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir).select("doc_id", "path", F.concat("path", F.lit("#0001")).alias("chunk_id"))
    return linked_vectors(spark, sf_dir, own, 20, 0.1).join(own, "doc_id").drop("doc_id")


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.fuse(keyword_list(spark, sf_dir), vector_list(spark, sf_dir), 20)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused rows with snippets: the text meets the few rows that are left by a join on path."""
    text = files(spark, sf_dir).select("path", F.substring("text", 1, 1200).alias("snippet"), F.regexp_extract("text", r"^[^\n]*", 0).alias("heading"))
    return fused(spark, sf_dir).join(text, "path").join(F.broadcast(questions(spark, sf_dir)), "query_id")
