"""Queries on what questions ask and what passages are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guidance as G
from ..registry import query, table
from . import base

LITERALS = ["全体をまとめて", "申請の期限と必要書類", "詳細は不要、概要だけ", "詳しく手順を知りたい", "準備の進め方", "出張について", "手順は不要"]
TURNS = "asked AS (SELECT conv_id * 1000 + turn AS id, replace(replace(text, ' the ', '手順'), ' la ', '期限') AS text FROM conversations UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}, '{t}')" for i, t in enumerate(LITERALS)) + ") v(id, text))"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with cue words put in, and literals."""
    text = F.replace(F.replace("text", F.lit(" the "), F.lit("手順")), F.lit(" la "), F.lit("期限"))
    own = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), text.alias("text"))
    return own.unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(LITERALS)], "id long, text string"))


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


CUE = "len(list_filter({0}, lambda c: len(list_filter(range(1, length(text) - length(c) + 2), lambda i: substr(text, i, length(c)) = c AND len(list_filter(" + _quoted(G.NEGATIONS) + ", lambda n: contains(substr(text, i + length(c), 9), n))) = 0)) > 0)) > 0"


@query("WITH " + TURNS + " SELECT id, CASE WHEN " + CUE.format(_quoted(G.DETAIL_CUES)) + " THEN 'detail' WHEN " + CUE.format(_quoted(G.PRACTICAL_CUES)) + " THEN 'practical' ELSE 'overview' END AS granularity FROM asked")
def intent_granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("id", G.granularity(F.col("text")).alias("granularity"))


@query(
    "WITH "
    + TURNS
    + ", i AS (SELECT id, text, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(text, '{'|'.join(c)}') THEN '{k}' END" for k, c in G.ITEM_CUES.items())
    + f"], lambda x: x IS NOT NULL) AS items FROM asked) SELECT id, CASE WHEN regexp_matches(text, '{G.OVERVIEW}') THEN 'overview' WHEN len(items) > 0 THEN 'specific' ELSE 'broad' END AS scope, CASE WHEN regexp_matches(text, '{G.OVERVIEW}') THEN '' ELSE array_to_string(items, ',') END AS items FROM i"
)
def guided_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).withColumn("s", G.guided_scope(F.col("text"))).select("id", "s.scope", F.array_join("s.items", ",").alias("items"))


DRESSED = (
    base.PAGES
    + ", dressed AS (SELECT chunk_id, heading || CASE start_line % 5 WHEN 0 THEN ' 別紙' WHEN 1 THEN ' 例外' WHEN 2 THEN ' 背景' ELSE '' END AS heading, replace(replace(text, ', ', 'ただし、'), '. ', 'を踏まえ') AS text FROM chunks)"
)


@query(
    "WITH "
    + DRESSED
    + f""", l AS (SELECT chunk_id, heading, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM dressed),
r AS (SELECT *, greatest(len(ls), 1) AS n, CAST(len(list_filter(ls, lambda x: starts_with(ltrim(x), '|'))) AS DOUBLE) / greatest(len(ls), 1) AS tr, CAST(len(list_filter(ls, lambda x: regexp_matches(x, '{G.QUESTION_END}'))) AS DOUBLE) / greatest(len(ls), 1) AS qr, CAST(len(list_filter(ls, lambda x: regexp_matches(x, '{G.ITEM_LINE}'))) AS DOUBLE) / greatest(len(ls), 1) AS ir, regexp_matches(heading, '{G.ANNEX}') AS annex FROM l),
s AS (SELECT chunk_id, CASE WHEN tr >= 0.5 THEN CASE WHEN qr >= 0.4 OR annex THEN 1.2 ELSE 0.5 END ELSE 0.0 END + CASE WHEN qr >= 0.4 THEN 1.0 ELSE 0.0 END + CASE WHEN annex THEN 1.0 ELSE 0.0 END + CASE WHEN ir >= 0.6 AND qr >= 0.2 THEN 0.4 ELSE 0.0 END AS p,
 CASE WHEN regexp_matches(heading, '{G.QUALIFIER_HEAD}') THEN 1.0 ELSE 0.0 END + CAST(0.45 AS DOUBLE) * least(len(regexp_extract_all(text, '{G.QUALIFIER_BODY}')), 2) AS q, CASE WHEN regexp_matches(heading, '{G.BACKGROUND_HEAD}') THEN 1.0 ELSE 0.0 END + CAST(0.6 AS DOUBLE) * least(len(regexp_extract_all(text, '{G.BACKGROUND_BODY}')), 2) AS b FROM r),
t AS (SELECT *, greatest(p, q, b) AS top, list_sort([CAST(p AS DOUBLE), q, b])[2] AS second FROM s)
SELECT chunk_id, CASE WHEN top >= CAST(0.6 AS DOUBLE) AND top - second >= CAST(0.15 AS DOUBLE) THEN CASE WHEN q = top THEN 'qualifier_reference' WHEN p = top THEN 'practical_detail' ELSE 'background' END ELSE 'unclassified' END AS role, round(least(1.0, CAST(top AS DOUBLE) / 2), 3) AS confidence FROM t"""
)
def role_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents with headings and wordings of the roles put in."""
    k = F.col("start_line") % 5
    own = base.pages(spark, sf_dir).select("chunk_id", F.concat("heading", F.when(k == 0, " 別紙").when(k == 1, " 例外").when(k == 2, " 背景").otherwise("")).alias("heading"), F.replace(F.replace("text", F.lit(", "), F.lit("ただし、")), F.lit(". "), F.lit("を踏まえ")).alias("text"))
    return G.classify_role(own).select("chunk_id", "role", "confidence")


@query(
    "WITH "
    + base.FILES
    + ", n AS (SELECT path, source || '/' || lang AS folder, doc_id // 7 % 10 AS number, doc_id % 5 AS cites FROM files), c AS (SELECT path, folder, (number + cites) % 10 AS cited FROM n WHERE cites > 0), m AS (SELECT DISTINCT n.path, c.path AS related FROM n JOIN c ON c.folder = n.folder AND c.cited = n.number AND c.path <> n.path) SELECT path, related FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY related) AS k FROM m) WHERE k <= 2"
)
def find_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file has a seventh of its id, modulo ten, as its number and cites one up to four above."""
    k, c = F.floor(F.col("doc_id") / 7) % 10, F.col("doc_id") % 5
    own = base.files(spark, sf_dir).select("path", F.concat(F.lit("REG第"), k.cast("string"), F.lit("号")).alias("head"), F.when(c > 0, F.concat(F.lit("see: REG第"), ((k + c) % 10).cast("string"), F.lit("号"))).otherwise("").alias("text"))
    return G.related(own, 2)


@query(
    "WITH "
    + base.LINES
    + ", n AS (SELECT path, line_no, (line_no - 1) % (2 + doc_id % 4) + 1 AS number FROM lines WHERE line_no % 9 <> 0), i AS (SELECT *, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS i, line_no - number AS d FROM n) SELECT path, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS items FROM i GROUP BY path, i, d HAVING min(number) = 1"
)
def numbered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines numbered in rounds, with every ninth line left out."""
    n = F.col("line_no")
    rows = base.lines(spark, sf_dir).where(n % 9 != 0).select("path", "line_no", ((n - 1) % (2 + F.col("doc_id") % 4) + 1).alias("number"))
    return G.numbered_lists(rows)


@query(
    "WITH t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Result: ' || props || '.' ELSE 'none' END AS answer FROM events) SELECT event_id, TRY_CAST(json_extract(nullif(regexp_extract(answer, '(?s)\\{.*\\}', 0), ''), '$.k') AS BIGINT) AS k FROM t".replace("\\\\", "\\")
)
def parse_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 3
    answer = F.when(m == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(m == 1, F.concat(F.lit("Result: "), "props", F.lit("."))).otherwise("none")
    return table(spark, sf_dir, "events").select("event_id", G.parse_object(answer, "k long")["k"].alias("k"))


@query(
    "WITH d AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events) SELECT event_id, user_id, event_type FROM d WHERE k = 1"
)
def job_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions repeated under one request (user, type and day here) are one job: the first counts."""
    from ..streaming.jobs import with_instants

    first = F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")
    return with_instants(table(spark, sf_dir, "events")).groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(first).select("event_id", "user_id", "event_type")
