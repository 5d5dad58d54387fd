"""Queries that hold altered quotes against their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quotes
from ..registry import query
from ..sources import corpus
from . import base
from .claims import NORM

#: A quote of every document: two pieces of its text with a few characters left out between them.
QUOTE = "substr(text, CAST(20 + doc_id % 40 AS INT), 25) || substr(text, CAST(48 + doc_id % 40 + doc_id % 3 AS INT), CAST(20 + doc_id % 30 AS INT))"

#: Files with a line end after every comma and full stop: lines about as long as those of rules.
SHORT_LINES = base.FILES.replace("source, text FROM", "source, replace(replace(text, ', ', ',' || chr(10)), '. ', '.' || chr(10)) AS text FROM") + base.LINES[len(base.FILES) :]


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    short = base.files(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"(?<=[,.]) ", "\n"))
    rows = corpus.lines(short).select(F.col("path").alias("source"), "line_no", "line")
    asked = base.files(spark, sf_dir).select(F.col("doc_id").alias("quote_id"), F.col("path").alias("source"), quotes.normal(F.expr(QUOTE)).alias("q"))
    return quotes.normal_lines(rows), asked


GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"


@query(
    "WITH "
    + SHORT_LINES
    + ", n AS MATERIALIZED (SELECT path, line_no, "
    + NORM.format("line")
    + " AS t FROM lines), w AS (SELECT path, string_agg(t, '' ORDER BY line_no) AS whole FROM n GROUP BY path), o AS MATERIALIZED (SELECT path, line_no, length(t) AS n, sum(length(t)) OVER (PARTITION BY path ORDER BY line_no) AS past FROM n),"
    + " q AS (SELECT doc_id AS quote_id, path, "
    + NORM.format(f"({QUOTE})")
    + " AS q FROM files), r AS (SELECT q.quote_id, q.q, a.line_no AS start_line, b.line_no AS end_line, substr(w.whole, CAST(a.past - a.n + 1 AS INT), CAST(b.past - a.past + a.n AS INT)) AS s FROM q JOIN o a USING (path) JOIN o b ON b.path = a.path AND b.line_no >= a.line_no AND b.past - a.past + a.n <= length(q.q) * 1.6 + 20 JOIN w ON w.path = a.path WHERE length(q.q) >= 12),"
    + " c AS (SELECT quote_id, start_line, end_line, length(s) AS chars, len("
    + GRAMS.format("q")
    + ") AS grams, len(list_intersect("
    + GRAMS.format("q")
    + ", "
    + GRAMS.format("s")
    + ")) AS shared FROM r), f AS (SELECT * FROM c WHERE shared >= 0.85 * grams QUALIFY row_number() OVER (PARTITION BY quote_id, start_line ORDER BY end_line) = 1)"
    + " SELECT quote_id, start_line, end_line, shared, grams, chars FROM f QUALIFY row_number() OVER (PARTITION BY quote_id ORDER BY shared DESC, chars, start_line) = 1"
)
def quote_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of lines nearest to every altered quote, whole files searched."""
    return quotes.nearest_ranges(*_asked(spark, sf_dir))


@query()
def quote_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Altered quotes put back to their source, where nothing was added (held against brute force in the tests)."""
    lines, asked = _asked(spark, sf_dir)
    found = quotes.snap(lines, asked)
    return found.select("quote_id", "start_line", "end_line", F.sha2("text", 256).alias("text_sha256"))
