"""Queries over headings, sections and line ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import structure
from ..registry import query
from . import base

RANGES = """, given AS (SELECT path, line_no AS start_line, line_no + (doc_id + line_no) % 5 AS end_line FROM md WHERE line_no % 3 = 0),
less AS (SELECT path, line_no AS start_line, line_no + doc_id % 2 AS end_line FROM md WHERE line_no % 5 = 0),
merged AS (SELECT path, min(start_line) AS start_line, max(end_line) AS end_line FROM (
  SELECT *, sum(new) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start_line > coalesce(max(end_line) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -2) + 1 THEN 1 ELSE 0 END AS new FROM given)) GROUP BY path, island)"""


def _ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, n = base.md(spark, sf_dir), F.col("line_no")
    given = rows.where(n % 3 == 0).select("path", n.alias("start_line"), (n + (F.col("doc_id") + n) % 5).alias("end_line"))
    return given, rows.where(n % 5 == 0).select("path", n.alias("start_line"), (n + F.col("doc_id") % 2).alias("end_line"))


@query("WITH " + base.LINES + """ SELECT path, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS n_lines FROM (SELECT path, line_no, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS island FROM lines WHERE trim(line) <> '') GROUP BY path, island""")
def paragraph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.paragraphs(base.lines(spark, sf_dir))


@query("WITH " + base.HEADS + " SELECT path, line_no, level, heading FROM heads")
def heading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.headings(base.md(spark, sf_dir))


@query("WITH " + base.HEADS + " SELECT path, line_no, level, section_end FROM sections")
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.sections(spark, sf_dir).select("path", "line_no", "level", "section_end")


@query("WITH " + base.HEADS + " SELECT path, line_no, parent_line FROM sections")
def heading_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.sections(spark, sf_dir).select("path", "line_no", "parent_line")


@query("WITH " + base.HEADS + " SELECT m.path, m.line_no, (SELECT max(s.line_no) FROM sections s WHERE s.path = m.path AND s.line_no <= m.line_no AND m.line_no <= s.section_end) AS section_line FROM md m")
def section_for_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.md(spark, sf_dir)
    return structure.innermost(rows.select("path", "line_no"), structure.headings(rows))


@query("WITH " + base.HEADS + " SELECT p.path, p.line_no AS parent_line, c.line_no AS start_line, c.section_end AS end_line FROM sections p JOIN sections c ON c.path = p.path AND c.parent_line = p.line_no")
def child_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = base.sections(spark, sf_dir)
    return own.where("parent_line is not null").select("path", "parent_line", F.col("line_no").alias("start_line"), F.col("section_end").alias("end_line"))


@query(
    "WITH RECURSIVE "
    + base.HEADS
    + """, chain AS (SELECT path, line_no, heading AS trail, parent_line AS up FROM sections
 UNION ALL SELECT c.path, c.line_no, s.heading || ' > ' || c.trail, s.parent_line FROM chain c JOIN sections s ON s.path = c.path AND s.line_no = c.up)
SELECT path, line_no, trail FROM chain WHERE up IS NULL"""
)
def heading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors from the root: a heading has five at most, so five joins on (path, parent) end every chain."""
    own = base.sections(spark, sf_dir)
    up = own.select("path", F.col("line_no").alias("up"), F.col("heading").alias("above"), F.col("parent_line").alias("next"))
    chain = own.select("path", "line_no", F.col("heading").alias("trail"), F.col("parent_line").alias("up"))
    for _ in range(5):
        met = chain.join(up, ["path", "up"], "left")
        chain = met.select("path", "line_no", F.when(F.col("above").isNull(), F.col("trail")).otherwise(F.concat("above", F.lit(" > "), "trail")).alias("trail"), F.col("next").alias("up"))
    return chain.select("path", "line_no", "trail")


@query(
    "WITH "
    + base.HEADS
    + """, first AS (SELECT p.path, p.line_no, p.section_end, min(c.line_no) AS child, count(*) AS children FROM sections p JOIN sections c ON c.path = p.path AND c.parent_line = p.line_no GROUP BY ALL)
SELECT f.path, f.line_no, f.child AS start_line, f.section_end AS end_line, f.children FROM first f WHERE NOT EXISTS (SELECT 1 FROM md m WHERE m.path = f.path AND m.line_no > f.line_no AND m.line_no < f.child AND trim(m.line) <> '')"""
)
def expand_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with children and nothing but blank lines before the first: they stand for their children's text."""
    own, rows = base.sections(spark, sf_dir), base.md(spark, sf_dir)
    kids = own.where("parent_line is not null").groupBy("path", F.col("parent_line").alias("line_no")).agg(F.min("line_no").alias("start_line"), F.count("*").alias("children"))
    first = own.select("path", "line_no", F.col("section_end").alias("end_line")).join(kids, ["path", "line_no"])
    full = rows.where(F.trim("line") != "").select(F.col("path").alias("p"), F.col("line_no").alias("n"))
    return first.join(full, (first.path == full.p) & (full.n > first.line_no) & (full.n < first.start_line), "left_anti")


@query("WITH " + base.MD + RANGES + " SELECT * FROM merged")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.merge_ranges(_ranges(spark, sf_dir)[0])


@query("WITH " + base.MD + RANGES + " SELECT l.path, l.start_line, l.end_line, EXISTS (SELECT 1 FROM merged m WHERE m.path = l.path AND m.start_line <= l.start_line AND m.end_line >= l.end_line) AS covered FROM less l")
def interval_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, less = _ranges(spark, sf_dir)
    return structure.covered(less, given)


@query(
    "WITH "
    + base.MD
    + RANGES
    + """, kept AS (SELECT m.path, unnest(range(m.start_line, m.end_line + 1)) AS n FROM merged m),
removed AS (SELECT DISTINCT path, unnest(range(start_line, end_line + 1)) AS n FROM less),
remaining AS (SELECT path, n, n - row_number() OVER (PARTITION BY path ORDER BY n) AS island FROM (SELECT * FROM kept EXCEPT SELECT * FROM removed))
SELECT path, min(n) AS start_line, max(n) AS end_line FROM remaining GROUP BY path, island"""
)
def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.subtract_ranges(*_ranges(spark, sf_dir))


@query("WITH " + base.HEADS + " SELECT s.path, s.line_no, string_agg(m.line, chr(10) ORDER BY m.line_no) AS text FROM sections s JOIN md m ON m.path = s.path AND m.line_no BETWEEN s.line_no AND s.section_end WHERE s.level = 3 GROUP BY s.path, s.line_no")
def section_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the lowest sections: slices of the file's array of lines, so no line is joined to its section."""
    whole = base.md(spark, sf_dir).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("ls"))
    own = base.sections(spark, sf_dir).where("level = 3").join(whole, "path")
    return own.select("path", "line_no", F.array_join(F.slice("ls", F.col("line_no").cast("int"), (F.col("section_end") - F.col("line_no") + 1).cast("int")), "\n").alias("text"))
