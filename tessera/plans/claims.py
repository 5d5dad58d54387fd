"""Queries that check claims, quotes and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import claims, quotes
from ..registry import query, table
from . import base

NORM = r"regexp_replace(regexp_replace({0}, '\[E\d+\]', '', 'g'), '[\s、。，．,.・「」『』:：;；\[\]［］（）()【】<>＜＞" + '"' + r"''“”‘’|｜*＊_＿~〜\-‐‑–—―]+', '', 'g')"


@query(
    "WITH "
    + base.LINES
    + ", q AS (SELECT doc_id AS quote_id, path, substr(text, 40, 60) AS quote FROM files), n AS (SELECT path, line_no, "
    + NORM.format("line")
    + " AS t FROM lines), w AS (SELECT path, string_agg(t, '' ORDER BY line_no) AS text FROM n GROUP BY path), m AS (SELECT q.quote_id, q.path, "
    + NORM.format("quote")
    + " AS q, w.text FROM q JOIN w USING (path)), p AS (SELECT quote_id, path, q, instr(text, q) AS a FROM m WHERE length(q) >= 6 AND contains(text, q)), c AS (SELECT path, line_no, sum(length(t)) OVER (PARTITION BY path ORDER BY line_no) AS past FROM n)"
    + " SELECT p.quote_id, min(c.line_no) FILTER (c.past >= p.a) AS start_line, min(c.line_no) FILTER (c.past >= p.a + length(p.q) - 1) AS end_line FROM p JOIN c USING (path) GROUP BY p.quote_id"
)
def quote_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = base.files(spark, sf_dir)
    return claims.locate_quotes(base.lines(spark, sf_dir), own.select(F.col("doc_id").alias("quote_id"), "path", F.substring("text", 40, 60).alias("quote")))


@query(
    "WITH c AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations), n AS (SELECT conv_id, turn, list_distinct(regexp_extract_all("
    + NORM.format("text")
    + r", '\d+')) AS a, list_distinct(regexp_extract_all("
    + NORM.format("before")
    + r", '\d+')) AS b FROM c) SELECT conv_id, turn, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS missing FROM n"
)
def numbers_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each turn that the turn before does not have."""
    own = table(spark, sf_dir, "conversations").withColumn("before", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    return own.select("conv_id", "turn", F.array_join(claims.numbers_missing(F.col("text"), F.col("before")), ",").alias("missing"))


@query(
    r"""WITH a AS (SELECT doc_id AS answer_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT answer_id, unnest(ls) AS line0, generate_subscripts(ls, 1) - 1 AS line_no FROM a),
c AS (SELECT answer_id, line_no, line0 || CASE line_no % 3 WHEN 0 THEN ' [E1]' WHEN 1 THEN ' [E9]' ELSE '' END AS line FROM l)
SELECT answer_id, line_no, CASE WHEN NOT regexp_matches(line, '\[E\d+\]') THEN 'uncited' ELSE 'unknown_id' END AS problem FROM c WHERE trim(line) <> '' AND NOT regexp_matches(line, '^\s*#') AND NOT contains(line, '[E1]')"""
)
def uncited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers whose lines cite a known id, an unknown one, or none, in turns."""
    cited = F.transform(F.split("text", "\n"), lambda l, i: F.concat(l, F.when(i % 3 == 0, " [E1]").when(i % 3 == 1, " [E9]").otherwise("")))
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), F.array_join(cited, "\n").alias("text"), F.array(F.lit("E1"), F.lit("E2")).alias("known"))
    return claims.uncited(own)


@query("WITH " + base.LINES + ", n AS (SELECT path, line_no, lower(" + NORM.format("line") + ") AS n FROM lines) SELECT path, min(line_no) AS line_no FROM n WHERE n <> '' GROUP BY path, n")
def dup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.drop_duplicate_lines(base.lines(spark, sf_dir), "path").select("path", "line_no")


@query("WITH " + base.LINES + ", t AS (SELECT path, " + NORM.format("line") + " AS t FROM lines), p AS (SELECT path, substr(t, 1, 12) AS prefix, count(*) AS n FROM t WHERE length(t) >= 12 GROUP BY 1, 2) SELECT * FROM p WHERE n >= 3")
def repeated_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of 12 characters, in the form in which quotes are compared, that three lines of a file share."""
    own = base.lines(spark, sf_dir).select("path", quotes.normal(F.col("line")).alias("t"))
    return own.where(F.length("t") >= 12).groupBy("path", F.substring("t", 1, 12).alias("prefix")).agg(F.count("*").alias("n")).where("n >= 3")


@query(
    "WITH "
    + base.FILES
    + ", s AS (SELECT doc_id, path, substr(text, doc_id % 50 + 1, 30) || CASE WHEN doc_id % 7 = 0 THEN '?' ELSE '' END AS excerpt, CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE sha256(text) END AS sha, CASE WHEN doc_id % 13 = 0 THEN 'gone' ELSE path END AS at_path FROM files) SELECT s.doc_id, CASE WHEN f.path IS NULL THEN 'missing' WHEN sha256(f.text) <> s.sha THEN 'changed' WHEN substr(f.text, s.doc_id % 50 + 1, length(s.excerpt)) = s.excerpt THEN 'matched' ELSE 'excerpt_mismatch' END AS state FROM s LEFT JOIN files f ON f.path = s.at_path"
)
def span_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored spans against the files as they are: missing, changed, excerpt_mismatch or matched."""
    own, k = base.files(spark, sf_dir), F.col("doc_id")
    spans = own.select("doc_id", F.concat(F.expr("substring(text, int(doc_id % 50 + 1), 30)"), F.when(k % 7 == 0, "?").otherwise("")).alias("excerpt"), F.when(k % 11 == 0, "x").otherwise(F.sha2("text", 256)).alias("sha"), F.when(k % 13 == 0, "gone").otherwise(F.col("path")).alias("path"))
    met = spans.join(own.select("path", "text"), "path", "left")
    here = F.expr("substring(text, int(doc_id % 50 + 1), length(excerpt))")
    return met.select("doc_id", F.when(F.col("text").isNull(), "missing").when(F.sha2("text", 256) != F.col("sha"), "changed").when(here == F.col("excerpt"), "matched").otherwise("excerpt_mismatch").alias("state"))


NEGATIONS = ["ではありません", "含まれません", "not ", "no "]


@query(
    r"""WITH s AS (SELECT conv_id, turn, unnest(string_split_regex(text, '[。\n.]+')) AS sentence FROM conversations WHERE role = 'assistant'),
f AS (SELECT conv_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]{2,}'), lambda t: lower(t))))[1:2] AS tokens FROM conversations WHERE turn = 0)
SELECT s.conv_id, s.turn, bool_or(len(list_filter(f.tokens, lambda t: contains(lower(s.sentence), t))) = len(f.tokens)) AS mentions,
 bool_or(len(list_filter(f.tokens, lambda t: contains(lower(s.sentence), t))) = len(f.tokens) AND NOT (contains(sentence, 'ではありません') OR contains(sentence, '含まれません') OR contains(sentence, 'not ') OR contains(sentence, 'no '))) AS diverted
FROM s JOIN f USING (conv_id) WHERE trim(s.sentence) <> '' AND len(f.tokens) > 0 GROUP BY s.conv_id, s.turn"""
)
def diversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns that repeat the two least terms of the conversation's first turn in one sentence, with and without a negation."""
    own = table(spark, sf_dir, "conversations")
    tokens = F.slice(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{2,}"), F.lit(0)), F.lower))), 1, 2)
    facts = own.where("turn = 0").select("conv_id", tokens.alias("tokens")).where("size(tokens) > 0")
    cut = own.where("role = 'assistant'").select("conv_id", "turn", F.explode(F.split("text", r"[。\n.]+")).alias("sentence")).where(F.trim("sentence") != "")
    met = cut.join(facts, "conv_id")
    says = F.forall("tokens", lambda t: F.contains(F.lower("sentence"), t))
    return met.groupBy("conv_id", "turn").agg(F.bool_or(says).alias("mentions"), F.bool_or(claims.divert(F.col("sentence"), F.col("tokens"), NEGATIONS)).alias("diverted"))


@query(
    """WITH g AS (SELECT doc_id % 50 AS answer_id, CASE WHEN quality IS NULL THEN 'not_run' WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'uncertain' ELSE 'passed' END AS status FROM documents LEFT JOIN labels USING (doc_id))
SELECT answer_id, CASE max(CASE status WHEN 'passed' THEN 0 WHEN 'uncertain' THEN 1 WHEN 'not_run' THEN 2 ELSE 3 END) WHEN 0 THEN 'passed' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'not_run' ELSE 'failed' END AS status,
 count(*) FILTER (status = 'failed') AS failed, count(*) AS n FROM g GROUP BY answer_id"""
)
def gate_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "not_run").when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "uncertain").otherwise("passed")
    return marks.select((F.col("doc_id") % 50).alias("answer_id"), status.alias("s")).groupBy("answer_id").agg(claims.worst(F.col("s")).alias("status"), F.count_if(F.col("s") == "failed").alias("failed"), F.count("*").alias("n"))
