"""Queries that score retrieval and aggregate the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate
from ..registry import query, table
from . import base

SCORED = (
    "WITH "
    + base.FUSED
    + """, returned AS (SELECT query_id, path, rank0, rank0 % 5 + 1 AS start_line, rank0 % 5 + 3 AS end_line FROM fused),
expected AS (SELECT q.query_id, f.path, CAST(4 AS BIGINT) AS start_line, CAST(6 AS BIGINT) AS end_line, f.doc_id % 7 = 0 AS forbidden FROM benchmark b JOIN questions q ON q.query_id = b.item_id JOIN files f ON contains(f.text, b.text)),
wanted AS (SELECT * FROM expected WHERE NOT forbidden), nw AS (SELECT query_id, count(DISTINCT path) AS n_paths, count(*) AS n_ranges FROM wanted GROUP BY query_id),
mk AS (SELECT r.*, EXISTS (SELECT 1 FROM wanted w WHERE w.query_id = r.query_id AND w.path = r.path) AS good, EXISTS (SELECT 1 FROM expected e WHERE e.forbidden AND e.query_id = r.query_id AND e.path = r.path) AS bad FROM returned r),
bq AS (SELECT query_id, count(*) AS returned, count(*) FILTER (good) AS good, count(DISTINCT CASE WHEN good THEN path END) AS good_paths, bool_or(good AND rank0 = 0) AS first, count(*) FILTER (bad) AS forbidden_hits FROM mk GROUP BY query_id),
ln AS (SELECT w.query_id, count(*) AS ranges_hit FROM wanted w WHERE EXISTS (SELECT 1 FROM returned r WHERE r.query_id = w.query_id AND r.path = w.path AND r.start_line <= w.end_line AND w.start_line <= r.end_line) GROUP BY w.query_id),
scores AS (SELECT q.query_id, CASE WHEN n_paths IS NOT NULL THEN coalesce(good, 0) > 0 END AS hit, CASE WHEN n_paths IS NOT NULL THEN coalesce(first, false) END AS hit_at_1, CASE WHEN n_paths IS NOT NULL THEN round(coalesce(good_paths, 0) / CAST(n_paths AS DOUBLE), 4) END AS coverage,
 CASE WHEN n_paths IS NOT NULL THEN CASE WHEN coalesce(returned, 0) > 0 THEN round(good / CAST(returned AS DOUBLE), 4) ELSE 0.0 END END AS precision, CASE WHEN n_paths IS NOT NULL THEN round(coalesce(ranges_hit, 0) / CAST(n_ranges AS DOUBLE), 4) END AS line_overlap, coalesce(forbidden_hits, 0) AS forbidden_hits, coalesce(returned, 0) AS returned
 FROM questions q LEFT JOIN nw USING (query_id) LEFT JOIN bq USING (query_id) LEFT JOIN ln USING (query_id)),
routes AS (SELECT *, CASE query_id % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'hybrid' ELSE 'retry' END AS route FROM scores)"""
)
RATES = "SELECT route, count(*) AS questions, count(hit) AS measured, round(avg(CAST(CAST(hit AS INTEGER) AS DOUBLE)), 4) AS hit_rate, round(avg(CAST(CAST(hit_at_1 AS INTEGER) AS DOUBLE)), 4) AS hit_at_1_rate, round(avg(coverage), 4) AS coverage, round(avg(precision), 4) AS precision, round(avg(line_overlap), 4) AS line_overlap, CAST(sum(forbidden_hits) AS BIGINT) AS forbidden_hits FROM routes GROUP BY route"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused rows against the files that quote a benchmark passage; every seventh of these is forbidden."""
    asked = base.questions(spark, sf_dir)
    k = F.col("rank0") % 5
    returned = base.fused(spark, sf_dir).select("query_id", "path", "rank0", (k + 1).alias("start_line"), (k + 3).alias("end_line"))
    begins = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("b"))
    expected = base.files(spark, sf_dir).join(F.broadcast(begins), F.contains("text", "b")).select("query_id", "path", F.lit(4).cast("long").alias("start_line"), F.lit(6).cast("long").alias("end_line"), (F.col("doc_id") % 7 == 0).alias("forbidden"))
    return evaluate.score_questions(returned, expected, asked)


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("query_id") % 3
    return _scores(spark, sf_dir).withColumn("route", F.when(k == 0, "keyword").when(k == 1, "hybrid").otherwise("retry"))


@query(SCORED + " SELECT * FROM scores")
def score_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


@query(SCORED + " " + RATES)
def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summarize(_routes(spark, sf_dir), "route")


@query(
    SCORED
    + ", s AS ("
    + RATES
    + """), v AS (SELECT route, CASE WHEN hit_rate IS NULL THEN 'NOT_MEASURED' WHEN hit_rate >= 0.9 THEN 'PASS' ELSE 'FAIL' END AS hit_verdict, CASE WHEN coverage IS NULL THEN 'NOT_MEASURED' WHEN coverage >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS coverage_verdict, CASE WHEN precision IS NULL THEN 'NOT_MEASURED' WHEN precision >= 0.5 THEN 'PASS' ELSE 'FAIL' END AS precision_verdict, CASE WHEN forbidden_hits <= 0 THEN 'PASS' ELSE 'FAIL' END AS forbidden_verdict FROM s)
SELECT *, CASE WHEN 'FAIL' IN (hit_verdict, coverage_verdict, precision_verdict, forbidden_verdict) THEN 'FAIL' WHEN 'NOT_MEASURED' IN (hit_verdict, coverage_verdict, precision_verdict, forbidden_verdict) THEN 'NOT_MEASURED' ELSE 'PASS' END AS verdict FROM v"""
)
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.summarize(_routes(spark, sf_dir), "route")
    tests = {"hit_verdict": evaluate.accept(F.col("hit_rate"), 0.9), "coverage_verdict": evaluate.accept(F.col("coverage"), 0.8), "precision_verdict": evaluate.accept(F.col("precision"), 0.5), "forbidden_verdict": evaluate.accept(F.col("forbidden_hits"), 0, at_most=True)}
    v = s.select("route", *(c.alias(n) for n, c in tests.items()))
    names = F.array(*tests)
    worst = F.when(F.array_contains(names, "FAIL"), "FAIL").when(F.array_contains(names, "NOT_MEASURED"), "NOT_MEASURED").otherwise("PASS")
    return v.withColumn("verdict", worst)


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query("WITH r AS (SELECT event_type, event_id % 5 AS run, round(avg(value), 6) AS mean_value, max(value) AS max_value FROM events GROUP BY 1, 2), l AS (SELECT event_type, 'mean_value' AS metric, mean_value AS value FROM r UNION ALL SELECT event_type, 'max_value', max_value FROM r) SELECT event_type, metric, min(value) AS least, round(median(value), 6) AS median, max(value) AS most FROM l GROUP BY 1, 2")
def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five interleaved runs of the events."""
    runs = table(spark, sf_dir, "events").groupBy("event_type", (F.col("event_id") % 5).alias("run")).agg(F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value"))
    return evaluate.stability(runs, "event_type", ["mean_value", "max_value"])


@query(
    "WITH m AS (SELECT doc_id, CASE WHEN quality = 1 THEN 2 ELSE 1 END AS off_rank, CASE WHEN toxic = 1 THEN 0 WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS on_rank FROM labels), c AS (SELECT CASE WHEN on_rank > off_rank THEN 'up' WHEN on_rank < off_rank THEN 'down' ELSE 'same' END AS change, doc_id FROM m) SELECT change, count(*) AS n, min(doc_id) AS first_id FROM c GROUP BY change"
)
def expansion_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a status changes from one run to the other."""
    marks = table(spark, sf_dir, "labels")
    off = F.when(F.col("quality") == 1, 2).otherwise(1)
    on = F.when(F.col("toxic") == 1, 0).when(F.col("doc_id") % 4 == 0, 2).otherwise(1)
    return marks.groupBy(F.when(on > off, "up").when(on < off, "down").otherwise("same").alias("change")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query(
    "WITH i AS (SELECT item_id, item_id % 4 AS category, item_id % 3 = 0 AS critical, list_filter(string_split(lower(text), ' '), lambda w: length(w) >= 6) AS need FROM benchmark), f AS (SELECT DISTINCT unnest(need) AS w FROM i), h AS (SELECT f.w, count(*) AS n FROM f JOIN documents d ON contains(lower(d.text), f.w) GROUP BY f.w), u AS (SELECT item_id, category, critical, unnest(need) AS w FROM i), c AS (SELECT u.item_id, u.category, u.critical, bool_and(coalesce(h.n, 0) >= 2) AS covered FROM u LEFT JOIN h USING (w) GROUP BY ALL) SELECT category, count(*) AS items, count(*) FILTER (covered) AS covered, count(*) FILTER (critical AND NOT covered) AS critical_misses FROM c GROUP BY category"
)
def coverage_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items all of whose required terms two documents or more have, by category."""
    from ..operators import rank

    items = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 4).alias("category"), (F.col("item_id") % 3 == 0).alias("critical"), F.explode(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) >= 6)).alias("term"))
    whole = base.files(spark, sf_dir).select("path", F.col("path").alias("chunk_id"), F.lit("").alias("heading"), "text")
    found = rank.document_frequency(rank.term_hits(whole, items.select("term"), F.col("text")))
    each = items.join(found, "term", "left").groupBy("item_id", "category", "critical").agg(F.bool_and(F.coalesce("df", F.lit(0)) >= 2).alias("ok"))
    return each.groupBy("category").agg(F.count("*").alias("items"), F.count_if("ok").alias("covered"), F.count_if(F.col("critical") & ~F.col("ok")).alias("critical_misses"))
