"""Scoring of retrieval against expected sources, and aggregation of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdicts from the worst down; what was not measured never passes.
VERDICTS = {"FAIL": 2, "NOT_MEASURED": 1, "PASS": 0}


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a <= d) & (c <= b)


def score_questions(returned: DataFrame, expected: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, hit, hit_at_1, coverage, precision, line_overlap, forbidden_hits, returned).

    returned: query_id, path, rank0, start_line, end_line; expected: query_id, path, start_line, end_line, forbidden.
    Questions without expected sources have null measures.
    """
    wanted = expected.where("not forbidden")
    bad = expected.where("forbidden").select("query_id", "path").distinct()
    n_wanted = wanted.groupBy("query_id").agg(F.countDistinct("path").alias("n_paths"), F.count("*").alias("n_ranges"))
    marked = returned.join(wanted.select("query_id", "path").distinct().withColumn("good", F.lit(True)), ["query_id", "path"], "left").join(bad.withColumn("bad", F.lit(True)), ["query_id", "path"], "left")
    by_query = marked.groupBy("query_id").agg(
        F.count("*").alias("returned"),
        F.count_if("good").alias("good"),
        F.countDistinct(F.when(F.col("good"), F.col("path"))).alias("good_paths"),
        F.bool_or(F.coalesce("good", F.lit(False)) & (F.col("rank0") == 0)).alias("first"),
        F.count_if("bad").alias("forbidden_hits"),
    )
    r, w = returned.alias("r"), wanted.alias("w")
    near = (F.col("r.query_id") == F.col("w.query_id")) & (F.col("r.path") == F.col("w.path")) & overlap(F.col("r.start_line"), F.col("r.end_line"), F.col("w.start_line"), F.col("w.end_line"))
    lines = w.join(r, near, "left_semi").groupBy("query_id").agg(F.count("*").alias("ranges_hit"))
    met = questions.select("query_id").join(n_wanted, "query_id", "left").join(by_query, "query_id", "left").join(lines, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    asked = F.col("n_paths").isNotNull()
    return met.select(
        "query_id",
        F.when(asked, zero("good") > 0).alias("hit"),
        F.when(asked, F.coalesce("first", F.lit(False))).alias("hit_at_1"),
        F.when(asked, F.round(zero("good_paths") / F.col("n_paths"), 4)).alias("coverage"),
        F.when(asked, F.when(zero("returned") > 0, F.round(F.col("good") / F.col("returned"), 4)).otherwise(0.0)).alias("precision"),
        F.when(asked, F.round(zero("ranges_hit") / F.col("n_ranges"), 4)).alias("line_overlap"),
        zero("forbidden_hits").alias("forbidden_hits"),
        zero("returned").alias("returned"),
    )


def summarize(scores: DataFrame, key: str) -> DataFrame:
    """Rates and means of a route; questions without measures are in no denominator."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    return scores.groupBy(key).agg(F.count("*").alias("questions"), F.count("hit").alias("measured"), rate("hit").alias("hit_rate"), rate("hit_at_1").alias("hit_at_1_rate"), rate("coverage").alias("coverage"), rate("precision").alias("precision"), rate("line_overlap").alias("line_overlap"), F.sum("forbidden_hits").alias("forbidden_hits"))


def accept(value: Column, threshold: float, at_most: bool = False) -> Column:
    reached = value <= threshold if at_most else value >= threshold
    return F.when(value.isNull(), "NOT_MEASURED").when(reached, "PASS").otherwise("FAIL")


def overall(verdicts: Column) -> Column:
    rank = F.create_map(*(F.lit(x) for kv in VERDICTS.items() for x in kv))
    return F.max_by(verdicts, F.element_at(rank, verdicts))


def nearest_rank(values: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank: the value at place ceil(n * share)."""
    exact = [F.expr(f"percentile_disc({s}) within group (order by {value})").alias(name) for name, s in shares.items()]
    return values.groupBy(key).agg(F.count("*").alias("n"), *exact)


def stability(runs: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, metric, least, median, most) over repeated runs."""
    long = runs.unpivot([key], metrics, "metric", "value")
    return long.groupBy(key, "metric").agg(F.min("value").alias("least"), F.round(F.median("value"), 6).alias("median"), F.max("value").alias("most"))
