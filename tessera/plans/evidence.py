"""Queries over selected evidence: support, conflict, confidence, slots and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, expand, structure
from ..session import stored
from ..registry import query
from . import base
from .text import COMPACT, COMPACT_RAW, GRAMS

HAY = "path || ' ' || heading || ' ' || snippet"
ANCHORED = (
    "WITH "
    + base.EVIDENCE
    + ", packed AS (SELECT *, "
    + COMPACT.format("query")
    + " AS a, "
    + COMPACT.format(HAY)
    + " AS b FROM evidence), tried AS (SELECT *, unnest(range(4, 13)) AS n FROM packed), anchors AS (SELECT query_id, chunk_id, coalesce(max(CASE WHEN length(a) >= n AND list_bool_or(list_transform("
    + GRAMS.format("a", "n")
    + ", lambda g: contains(b, g))) THEN n END), 0) AS anchor FROM tried GROUP BY query_id, chunk_id), anchored AS (SELECT e.*, k.anchor FROM evidence e JOIN anchors k USING (query_id, chunk_id))"
)


@query(ANCHORED + " SELECT query_id, chunk_id, anchor, anchor >= 4 OR coalesce(embedding_score, 0) >= 0.55 AS supported FROM anchored")
def relevance_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.with_support(base.evidence(spark, sf_dir)).select("query_id", "chunk_id", "anchor", "supported")


CASES = [
    (1, "海外出張の日当", "国内出張に日当を支給する。海外出張の日当は支給しない。"),
    (2, "海外出張の日当", "本規程の日当は支給しない。\n海外については別に定める。"),
    (3, "在宅勤務手当の支給", "在宅勤務手当は適用しない"),
    (4, "travel", "適用しない travel"),
    (5, "日当", "日当は対象外"),
]


@query(
    "WITH v AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{q}', E'{e}')".replace("\n", "\\n") for i, q, e in CASES)
    + ") v(query_id, query, evidence)), base AS (SELECT query_id, query, evidence FROM v UNION ALL SELECT item_id + 1000, text, replace(text, '.', '。対象外 ') FROM benchmark), q AS (SELECT query_id, evidence, "
    + COMPACT.format("query")
    + " AS c FROM base), g AS (SELECT query_id, evidence, list_filter(list_distinct("
    + GRAMS.format("c", 4)
    + r"), lambda x: NOT regexp_matches(x, '[\x{3041}-\x{3096}]')) AS anchors FROM q), s AS (SELECT query_id, anchors, unnest(string_split_regex(evidence, '[。！？\n]+')) AS sentence FROM g) SELECT query_id, bool_or(regexp_matches(sentence, '対象外|適用しない|適用されない|含まない|定めない|支給しない|記載がない|記載なし') AND len(list_filter(anchors, lambda x: contains("
    + COMPACT_RAW.format("sentence")
    + ", x))) > 0) AS conflict FROM s GROUP BY query_id"
)
def constraint_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..registry import table

    own = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000).alias("query_id"), F.col("text").alias("query"), F.replace("text", F.lit("."), F.lit("。対象外 ")).alias("evidence"))
    rows = own.unionByName(spark.createDataFrame(CASES, "query_id long, query string, evidence string"))
    return rows.select("query_id", evidence.conflicts(F.col("query"), F.col("evidence")).alias("conflict"))


GROUPS = ", grouped AS (SELECT *, CASE WHEN rank0 % 3 = 0 THEN substr(sha256(path || ':' || (rank0 // 6)), 1, 16) END AS group_id FROM {0})"


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.substring(F.sha2(F.concat_ws(":", "path", F.floor(F.col("rank0") / 6)), 256), 1, 16)
    return base.evidence(spark, sf_dir).withColumn("group_id", F.when(F.col("rank0") % 3 == 0, group))


@query(
    "WITH "
    + base.FUSED
    + ", grouped AS (SELECT *, CASE WHEN rank0 % 3 = 0 THEN 'g' || (rank0 // 6) END AS group_id FROM fused) SELECT query_id, coalesce('group:' || group_id, 'chunk:' || chunk_id) AS key, count(*) AS n, arg_min(chunk_id, rank0) AS representative FROM grouped GROUP BY 1, 2"
)
def group_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.fused(spark, sf_dir)
    group = F.when(F.col("rank0") % 3 == 0, F.concat(F.lit("g"), F.floor(F.col("rank0") / 6).cast("string")))
    return rows.groupBy("query_id", F.coalesce(F.concat(F.lit("group:"), group), F.concat(F.lit("chunk:"), "chunk_id")).alias("key")).agg(F.count("*").alias("n"), F.min_by("chunk_id", "rank0").alias("representative"))


@query(
    ANCHORED
    + GROUPS.format("anchored")
    + r""", firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce('group:' || group_id, 'chunk:' || chunk_id) ORDER BY rank0) = 1 AS f FROM grouped),
got AS (SELECT query_id, query, lower(string_agg(snippet || ' ' || heading, ' ' ORDER BY rank0)) AS text, count(*) FILTER (f) AS n, count(*) FILTER (f AND snippet <> '') AS full_n, arg_min(CASE WHEN group_id IS NULL THEN rrf_score ELSE 0.0 END, rank0) AS top, count(DISTINCT CASE WHEN f THEN path END) AS files,
 bool_or(f AND contains(source, 'embedding')) AS semantic, bool_or(f AND group_id IS NULL AND contains(source, 'embedding') AND coalesce(embedding_score, 0) >= 0.7 AND anchor >= 4) AS strong, max(embedding_score) FILTER (embedding_score > 0) AS nearest FROM firsts GROUP BY query_id, query),
terms0 AS (SELECT query_id, list_distinct(list_filter(list_transform(string_split_regex(query, '[\s,、。・/\\]+'), lambda x: lower(trim(x))), lambda x: length(x) >= 2)) AS ts, list_filter(list_distinct(list_transform(regexp_extract_all(query, '[一-龥々ァ-ヴー]{2,}|[A-Za-z0-9]{2,}'), lambda t: lower(t))), lambda t: NOT starts_with(t, '何')) AS cs FROM questions),
c AS (SELECT g.*, CASE WHEN len(ts) = 0 THEN 0.0 ELSE CAST(len(list_filter(ts, lambda x: contains(g.text, x))) AS DOUBLE) / len(ts) END AS coverage, CASE WHEN len(cs) = 0 THEN 1.0 ELSE CAST(len(list_filter(cs, lambda x: contains(g.text, x))) AS DOUBLE) / len(cs) END AS content FROM got g JOIN terms0 USING (query_id)),
v AS (SELECT *, least(1.0, coverage * 0.45 + CAST(full_n AS DOUBLE) / greatest(n, 1) * 0.25 + least(top / 0.035, 1.0) * 0.2 + least(files / CAST(2 AS DOUBLE), 1.0) * 0.1) AS conf FROM c)
SELECT query_id, round(coverage, 4) AS coverage, round(conf, 3) AS confidence, CASE WHEN (n >= 2 OR (n = 1 AND strong)) AND conf >= 0.55 AND semantic THEN CASE WHEN coalesce(nearest < 0.7, false) AND 1 - content >= 0.5 THEN 'partial' ELSE 'sufficient' END WHEN conf >= 0.28 THEN 'partial' ELSE 'insufficient' END AS status FROM v"""
)
def confidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.confidence(_grouped(spark, sf_dir))


@query(
    "WITH "
    + base.EVIDENCE
    + ", u AS (SELECT query_id, chunk_id, rank0, snippet, 9000 - coalesce(sum(length(snippet)) OVER (PARTITION BY query_id ORDER BY rank0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_chars FROM evidence) SELECT query_id, chunk_id, rank0, CAST(least(length(snippet), left_chars) AS BIGINT) AS kept_chars, length(snippet) > left_chars AS cut FROM u WHERE left_chars > 0"
)
def char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.fit_budget(base.evidence(spark, sf_dir), 9000).select("query_id", "chunk_id", "rank0", "kept_chars", "cut")


@query(
    "WITH "
    + base.EVIDENCE
    + """, r AS (SELECT query_id, chunk_id, rank0, length(snippet) AS n, CASE rank0 % 3 WHEN 0 THEN 'practical_detail' WHEN 1 THEN 'background' ELSE 'direct_answer' END AS role FROM evidence),
w AS (SELECT *, sum(n) OVER (PARTITION BY query_id, role ORDER BY rank0 ROWS UNBOUNDED PRECEDING) AS used FROM r)
SELECT query_id, chunk_id, role, CAST(used AS BIGINT) AS used FROM w WHERE used <= CASE role WHEN 'practical_detail' THEN 3150 WHEN 'background' THEN 1800 ELSE 9000 END"""
)
def role_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of 9000 characters by role in an overview: practical 35 %, background 20 %."""
    from pyspark.sql import Window

    k = F.col("rank0") % 3
    rows = base.evidence(spark, sf_dir).withColumn("role", F.when(k == 0, "practical_detail").when(k == 1, "background").otherwise("direct_answer"))
    used = F.sum(F.length("snippet")).over(Window.partitionBy("query_id", "role").orderBy("rank0").rowsBetween(Window.unboundedPreceding, 0))
    cap = F.when(F.col("role") == "practical_detail", 3150).when(F.col("role") == "background", 1800).otherwise(9000)
    return rows.withColumn("used", used).where(F.col("used") <= cap).select("query_id", "chunk_id", "role", "used")


@query(
    "WITH "
    + base.EVIDENCE
    + GROUPS.format("evidence")
    + """, firsts AS (SELECT query_id, group_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank0)) AS g FROM grouped WHERE group_id IS NOT NULL GROUP BY query_id, group_id),
r AS (SELECT x.query_id, x.chunk_id, x.rank0, f.g, row_number() OVER (PARTITION BY x.query_id, x.group_id ORDER BY rank0) AS k, count(*) FILTER (x.group_id IS NULL) OVER (PARTITION BY x.query_id) AS nd, coalesce(max(f.g) OVER (PARTITION BY x.query_id), 0) AS ng
 FROM grouped x LEFT JOIN firsts f ON f.query_id = x.query_id AND f.group_id = x.group_id),
s AS (SELECT *, least(ng, CASE WHEN nd > 0 THEN 7 ELSE 8 END) AS granted FROM r),
t AS (SELECT *, g IS NULL AND k <= 8 - granted OR g IS NOT NULL AND k = 1 AND g <= granted AS sure, greatest(8 - granted - nd, 0) AS spare FROM s),
u AS (SELECT *, CASE WHEN g IS NOT NULL AND NOT sure THEN row_number() OVER (PARTITION BY query_id, g IS NOT NULL AND NOT sure ORDER BY g, k) END AS e FROM t)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(g, 0), k) AS place FROM u WHERE sure OR e <= spare"""
)
def slot_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.allocate_slots(_grouped(spark, sf_dir).withColumn("group_order", F.col("rank0")).select("query_id", "chunk_id", "rank0", "group_id", "group_order"), 8)


WINDOWS = (
    "WITH "
    + base.LINES
    + ", "
    + base.DEALT
    + """, focus AS (SELECT doc_id, list_distinct(list_transform(range(1, length(query)), lambda i: substr(query, i, 2))) AS g FROM dealt),
s AS (SELECT l.doc_id, l.line_no, length(l.line) + 1 AS cost, trim(l.line) = '' AS empty, len(list_intersect(list_distinct(list_transform(range(1, greatest(length(l.line), 1)), lambda i: substr(l.line, i, 2))), f.g)) AS s FROM lines l JOIN focus f USING (doc_id)),
c AS (SELECT *, sum(cost) OVER (PARTITION BY doc_id ORDER BY line_no) AS c FROM s),
p AS (SELECT a.doc_id, a.line_no AS start_line, b.line_no, b.s, b.empty FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.line_no >= a.line_no AND (b.c - (a.c - a.cost) - 1 <= 500 OR b.line_no = a.line_no) WHERE NOT a.empty),
w AS (SELECT doc_id, start_line, CAST(sum(s) AS BIGINT) AS score, max(line_no) FILTER (NOT empty) AS end_line FROM p GROUP BY doc_id, start_line)
SELECT doc_id AS ref_id, start_line, end_line, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start_line) AS k FROM w) WHERE k = 1"""
)


@query(WINDOWS)
def excerpt_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document, the lines within 500 characters that share most 2-grams with a benchmark text."""
    from ..registry import table

    rows = base.lines(spark, sf_dir).select(F.col("doc_id").alias("ref_id"), "line_no", "line")
    focus = base.dealt(spark, sf_dir).select(F.col("doc_id").alias("ref_id"), F.col("query").alias("focus"))
    return evidence.best_window(rows, focus, 500)


@query()
def parent_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found by keywords whose title stands over sections: what is shown of these instead (held against brute force in the tests).

    Every eighth line begins a title, the one after it and the fourth after that a section; pairs of lines are chunks.
    """
    n = F.col("line_no")
    mark = F.when(n % 8 == 1, "# ").when(n % 8 == 2, "## ").when(n % 8 == 5, "## ").otherwise("")
    rows = stored(base.lines(spark, sf_dir).select("path", "line_no", F.concat(mark, "line").alias("line")), "lines")
    own = structure.sections(structure.headings(rows), rows.groupBy("path").agg(F.count("*").alias("n_lines")))
    files = base.files(spark, sf_dir).select("path", F.sha2("text", 256).alias("file_sha256"))
    chunks = structure.page_chunks(rows, 2).join(files, "path").select("path", "chunk_id", "start_line", "end_line", "file_sha256")
    hits = base.keyword_list(spark, sf_dir).select("query_id", "path", "chunk_id", "rank0").withColumn("start_line", F.lit(1).cast("long")).join(files, "path")
    made = expand.expand(hits, rows, own, chunks, files)[0]
    return made.select("query_id", "chunk_id", "path", "start_line", "end_line", F.sha2("snippet", 256).alias("snippet_sha256"), "group_order", "group_priority", F.array_join("group_partial_reasons", ",").alias("reasons"))
