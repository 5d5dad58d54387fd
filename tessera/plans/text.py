"""Queries over the text functions; literal rows cover the scripts that documents lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query, table
from . import base

LITERALS = [(1, "出張旅費の精算手順を教えてください"), (2, "リモートワーク規程、在宅勤務/VPN 接続"), (3, "会発1225第002号の通知"), (4, "What is the travel policy 2024?"), (5, "申請 期限は何日ですか")]
VALUES = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in LITERALS) + ") v(query_id, query)"
ASKED = base.QUESTIONS + f", asked AS (SELECT query_id + 1000 AS query_id, query FROM questions UNION ALL {VALUES})"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark question, and literals."""
    own = base.questions(spark, sf_dir).select((F.col("query_id") + 1000).alias("query_id"), "query")
    return own.unionByName(spark.createDataFrame(LITERALS, "query_id long, query string"))


SPLIT = r"list_distinct(flatten(list_transform(list_filter(list_transform(string_split_regex(query, '[\s,、。・/\\]+'), lambda t: lower(trim(t))), lambda t: t <> ''), lambda t: (CASE WHEN length(t) >= 2 THEN [t] ELSE [] END) || regexp_extract_all(t, '[\x{3400}-\x{9fff}々]{2,}|[ァ-ヶー]{2,}'))))"
GRAMS = "list_transform(range(1, greatest(length({0}) - {1} + 2, 1)), lambda i: substr({0}, i, {1}))"


@query(f"WITH {ASKED} SELECT query_id, array_to_string(list_sort({SPLIT}), '|') AS terms FROM asked")
def split_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("query_id", F.array_join(F.array_sort(T.split_terms(F.col("query"))), "|").alias("terms"))


@query(
    f"WITH {ASKED}, bare AS (SELECT query_id, regexp_replace(query, '\\s+', '', 'g') AS q FROM asked), sized AS (SELECT query_id, q, unnest(range(3, 9)) AS n FROM bare)"
    + " SELECT query_id, count(DISTINCT lower(substr(q, i, n))) AS n_grams, min(lower(substr(q, i, n))) AS least, max(lower(substr(q, i, n))) AS most FROM (SELECT *, unnest(range(1, length(q) - n + 2)) AS i FROM sized WHERE length(q) >= n) GROUP BY query_id"
)
def query_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = T.query_ngrams(F.col("query"))
    return asked(spark, sf_dir).select("query_id", F.size(grams).cast("long").alias("n_grams"), F.array_min(grams).alias("least"), F.array_max(grams).alias("most"))


@query(
    f"WITH {ASKED}, t AS (SELECT query_id, unnest({SPLIT}) AS term FROM asked), g AS (SELECT query_id, CASE WHEN regexp_matches(term, '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}]') AND length(term) > 2 THEN {GRAMS.format('term', 2)} ELSE [term] END AS l FROM t)"
    + " SELECT query_id, string_agg(DISTINCT x, '|' ORDER BY x) AS terms FROM (SELECT query_id, unnest(l) AS x FROM g) GROUP BY query_id"
)
def coverage_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("query_id", F.array_join(F.array_sort(T.coverage_terms(F.col("query"))), "|").alias("terms"))


@query(
    f"WITH {ASKED} SELECT query_id, array_to_string(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(query, '[一-龥々ァ-ヴー]{{2,}}|[A-Za-z0-9]{{2,}}'), lambda t: lower(t))), lambda t: t NOT IN ('場合', '手順', '方法', '手続', '必要', '内容', '詳細', '具体的', '一覧', '概要') AND NOT starts_with(t, '何'))), '|') AS terms FROM asked"
)
def content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("query_id", F.array_join(F.array_sort(T.content_terms(F.col("query"))), "|").alias("terms"))


COMPACT_RAW = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
COMPACT = "replace(replace(replace(replace(replace(" + COMPACT_RAW + ", '教えてください', ''), '教えて下さい', ''), '何ですか', ''), 'いくらですか', ''), 'どうすればよいですか', '')"


@query("SELECT doc_id, sha256(" + COMPACT.format("text") + ") AS compact_sha256, length(" + COMPACT.format("text") + ") AS n FROM documents")
def compact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.compact(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(c, 256).alias("compact_sha256"), F.length(c).cast("long").alias("n"))


PAIRED = "WITH c AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), p AS (SELECT conv_id, turn, lower(text) AS text, lower(before) AS before FROM c WHERE before IS NOT NULL)"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the turn before it."""
    from pyspark.sql import Window

    own = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return own.where("before is not null").select("conv_id", "turn", F.lower("text").alias("text"), F.lower("before").alias("before"))


@query(
    PAIRED
    + ", b AS (SELECT conv_id, turn, text, before, list_distinct("
    + GRAMS.format("text", 2)
    + ") AS g, list_distinct("
    + GRAMS.format("before", 2)
    + ") AS h FROM p) SELECT conv_id, turn, round(CASE WHEN length(text) < 2 THEN CASE WHEN text <> '' AND contains(before, text) THEN 1.0 ELSE 0.0 END ELSE CAST(len(list_intersect(g, h)) AS DOUBLE) / len(g) END, 6) AS coverage FROM b"
)
def bigram_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(spark, sf_dir).select("conv_id", "turn", F.round(T.bigram_coverage(F.col("before"), F.col("text")), 6).alias("coverage"))


@query(
    PAIRED
    + ", k AS (SELECT conv_id, turn, "
    + COMPACT.format("text")
    + " AS a, "
    + COMPACT.format("before")
    + " AS b FROM p), s AS (SELECT *, unnest(range(4, 13)) AS n FROM k) SELECT conv_id, turn, coalesce(max(CASE WHEN length(a) >= n AND list_bool_or(list_transform("
    + GRAMS.format("a", "n")
    + ", lambda g: contains(b, g))) THEN n END), 0) AS anchor FROM s GROUP BY conv_id, turn"
)
def lexical_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run that a turn shares with the turn before."""
    own = paired(spark, sf_dir).select("conv_id", "turn", T.compact(F.col("text")).alias("a"), T.compact(F.col("before")).alias("b"))
    return own.select("conv_id", "turn", T.lexical_anchor(F.col("a"), F.col("b")).cast("long").alias("anchor"))


@query(
    "WITH n AS (SELECT doc_id, '会発' || (doc_id % 30) || '第0' || (doc_id % 7) || '号 and REG第' || doc_id || '号' AS head FROM documents)"
    + r", m AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(head, '[ 　\t]+', '', 'g'), '([一-龥ァ-ヶA-Za-z]{0,4}[0-9]*)第([0-9]+)号', 0)) AS x FROM n)"
    + r" SELECT doc_id, string_agg(DISTINCT lower(regexp_extract(x, '^(.*)第([0-9]+)号$', 1)) || '|' || regexp_replace(regexp_extract(x, '^(.*)第([0-9]+)号$', 2), '^0+([0-9])', '\1'), ',' ORDER BY lower(regexp_extract(x, '^(.*)第([0-9]+)号$', 1)) || '|' || regexp_replace(regexp_extract(x, '^(.*)第([0-9]+)号$', 2), '^0+([0-9])', '\1')) AS numbers FROM m GROUP BY doc_id"
)
def document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    head = F.concat(F.lit("会発"), (k % 30).cast("string"), F.lit("第0"), (k % 7).cast("string"), F.lit("号 and REG第"), k.cast("string"), F.lit("号"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.document_numbers(head), ",").alias("numbers"))


@query(
    "WITH w AS (SELECT doc_id, text, unnest(range(1, least(length(text), 300) + 1)) AS n FROM documents WHERE strlen(text) > 300) SELECT doc_id, substr(text, 1, max(n)) AS head FROM w WHERE strlen(substr(text, 1, n)) <= 300 GROUP BY doc_id, text"
    + " UNION ALL SELECT doc_id, text FROM documents WHERE strlen(text) <= 300"
)
def truncate_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_utf8(F.col("text"), 300).alias("head"))
