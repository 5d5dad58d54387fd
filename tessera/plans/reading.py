"""Queries over what is read of a document and in which portions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reading, units
from ..registry import query
from ..session import stored
from . import base
from .units import UNITS, notice, outline

INTROS = (
    UNITS
    + """,
intros AS MATERIALIZED (SELECT s.path, s.line_no, s.heading, s.parent_line, s.section_end, coalesce((SELECT min(n.line_no) FROM nsec n WHERE n.path = s.path AND n.line_no > s.line_no) - 1, e.n_lines) AS end_line FROM nsec s JOIN ends e USING (path)),
bodies AS MATERIALIZED (SELECT i.*, EXISTS (SELECT 1 FROM raw r WHERE r.path = i.path AND r.line_no > i.line_no AND r.line_no <= i.end_line AND r.bare <> '') AS filled, EXISTS (SELECT 1 FROM nsec c WHERE c.path = i.path AND c.parent_line = i.line_no) AS nested FROM intros i)"""
)


@query(
    "WITH "
    + INTROS
    + """ SELECT n.path, n.line_no, coalesce(i.line_no, 1) AS start_line, coalesce(i.end_line, (SELECT min(line_no) FROM nsec s WHERE s.path = n.path) - 1, 0) AS end_line, coalesce(i.heading, '') AS heading
FROM notice n LEFT JOIN intros i ON i.path = n.path AND n.line_no BETWEEN i.line_no AND i.end_line"""
)
def section_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section every line lies in, closed before the first section below it."""
    rows = notice(spark, sf_dir)
    return reading.section_ranges(rows.select("path", "line_no"), reading.introductions(rows, outline(rows)))


@query(
    "WITH RECURSIVE "
    + INTROS
    + """, asks AS (SELECT path || ':' || line_no AS ask_id, path, line_no FROM notice WHERE (doc_id + line_no) % 3 = 0),
start AS (SELECT a.ask_id, b.* FROM asks a JOIN bodies b ON b.path = a.path AND a.line_no BETWEEN b.line_no AND b.end_line),
down AS (SELECT ask_id, path, line_no, end_line, heading, nested AND NOT filled AS empty FROM start UNION ALL SELECT d.ask_id, b.path, b.line_no, b.end_line, b.heading, b.nested AND NOT b.filled FROM down d JOIN bodies b ON d.empty AND b.path = d.path AND b.parent_line = d.line_no),
up AS (SELECT ask_id, path, parent_line, line_no, end_line, heading, true AS skip FROM start UNION ALL SELECT u.ask_id, b.path, b.parent_line, b.line_no, b.end_line, b.heading, b.nested AND NOT b.filled FROM up u JOIN bodies b ON b.path = u.path AND b.line_no = u.parent_line),
every AS (SELECT ask_id, 0 AS part, line_no AS start_line, end_line, heading FROM down WHERE NOT empty
 UNION ALL SELECT ask_id, 1, line_no, end_line, heading FROM up WHERE NOT skip
 UNION ALL SELECT s.ask_id, 1, 1, f.first - 1, '' FROM start s JOIN (SELECT path, min(line_no) AS first FROM nsec GROUP BY path) f ON f.path = s.path AND f.first > 1
 UNION ALL SELECT a.ask_id, 0, 1, coalesce((SELECT min(line_no) FROM nsec n WHERE n.path = a.path) - 1, 0), '' FROM asks a WHERE NOT EXISTS (SELECT 1 FROM start s WHERE s.ask_id = a.ask_id)),
once AS (SELECT ask_id, start_line, end_line, heading, min(part) AS part FROM every GROUP BY ALL)
SELECT ask_id, start_line, end_line, heading, row_number() OVER (PARTITION BY ask_id ORDER BY part, start_line) AS place FROM once"""
)
def context_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to read for every third line: its section or those below it, and the text around it."""
    rows, n = stored(notice(spark, sf_dir), "notice"), F.col("line_no")
    asks = rows.where((F.col("doc_id") + n) % 3 == 0).select(F.concat("path", F.lit(":"), n.cast("string")).alias("ask_id"), "path", "line_no")
    return reading.with_context(asks, stored(reading.introductions(rows, outline(rows)), "introductions"))


LEAVES = INTROS + """,
leaves AS MATERIALIZED (SELECT path, line_no AS start_line, end_line, heading FROM bodies WHERE filled
 UNION ALL SELECT e.path, 1, coalesce(f.first - 1, e.n_lines), '' FROM ends e LEFT JOIN (SELECT path, min(line_no) AS first FROM nsec GROUP BY path) f USING (path) WHERE coalesce(f.first - 1, e.n_lines) >= 1)"""


def _leaves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = notice(spark, sf_dir)
    return rows, reading.leaves(reading.introductions(rows, outline(rows)), rows.groupBy("path").agg(F.count("*").alias("n_lines")))


@query("WITH " + LEAVES + " SELECT * FROM leaves")
def leaf_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaves(spark, sf_dir)[1]


#: Runs of lines up to a size: within a leaf, from each line to the last one that still fits; lines that are longer stand alone.
@query(
    "WITH RECURSIVE "
    + LEAVES
    + """, l AS MATERIALIZED (SELECT v.path || ':' || v.start_line AS range_id, n.line_no, length(n.line) AS n, v.end_line, sum(length(n.line) + 1) OVER (PARTITION BY v.path, v.start_line ORDER BY n.line_no) AS past FROM leaves v JOIN notice n ON n.path = v.path AND n.line_no BETWEEN v.start_line AND v.end_line),
reach AS MATERIALIZED (SELECT a.range_id, a.line_no, a.n, CASE WHEN a.n > 120 THEN a.line_no ELSE (SELECT max(b.line_no) FROM l b WHERE b.range_id = a.range_id AND b.line_no >= a.line_no AND b.past - a.past + a.n <= 120 AND b.line_no < coalesce((SELECT min(c.line_no) FROM l c WHERE c.range_id = a.range_id AND c.line_no > a.line_no AND c.n > 120), b.line_no + 1)) END AS last FROM l a),
walk AS (SELECT range_id, line_no, n, last FROM (SELECT * FROM reach QUALIFY row_number() OVER (PARTITION BY range_id ORDER BY line_no) = 1) UNION ALL SELECT r.range_id, r.line_no, r.n, r.last FROM walk w JOIN reach r ON r.range_id = w.range_id AND r.line_no = w.last + 1),
parts AS (SELECT range_id, line_no AS start_line, last AS end_line, NULL::BIGINT AS char_start, NULL::BIGINT AS char_end FROM walk WHERE n <= 120 UNION ALL SELECT range_id, line_no, line_no, k * 120, least((k + 1) * 120, n) - 1 FROM walk, LATERAL (SELECT unnest(range((n + 119) // 120)) AS k) WHERE n > 120)
SELECT *, row_number() OVER (PARTITION BY range_id ORDER BY start_line, char_start) AS portion FROM parts"""
)
def reading_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of every file in portions of at most 120 characters, longer lines cut."""
    rows, own = _leaves(spark, sf_dir)
    return reading.portions(rows, own.withColumn("range_id", F.concat("path", F.lit(":"), F.col("start_line").cast("string"))), reading.fold_units, 120)


@query(
    "WITH "
    + UNITS
    + """, intro AS (SELECT s.path, s.line_no, s.heading, coalesce((SELECT min(n.line_no) FROM nsec n WHERE n.path = s.path AND n.line_no > s.line_no) - 1, e.n_lines) AS stop FROM nsec s JOIN ends e USING (path)),
reads AS (SELECT u.path, u.start_line AS unit_line, i.line_no AS start_line, i.stop AS end_line FROM units u JOIN intro i ON u.kind = 'section' AND i.path = u.path AND i.line_no BETWEEN u.start_line AND u.end_line
 WHERE NOT u.ancillary AND EXISTS (SELECT 1 FROM raw r WHERE r.path = i.path AND r.line_no > i.line_no AND r.line_no <= i.stop AND r.bare <> '')
UNION ALL SELECT path, start_line, start_line, end_line FROM units WHERE kind <> 'section' AND NOT ancillary), d AS (SELECT *, row_number() OVER (PARTITION BY path, unit_line ORDER BY start_line) AS depth FROM reads)
SELECT path, unit_line, start_line, end_line, row_number() OVER (PARTITION BY path ORDER BY depth, unit_line) AS turn FROM d"""
)
def reading_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which main units are read: their first parts, then their second ones."""
    rows = notice(spark, sf_dir)
    own = outline(rows)
    main = units.main_units(rows, own).where("not ancillary")
    return reading.by_turns(units.read_ranges(rows, own, main)).select("path", "unit_line", "start_line", "end_line", "turn")
