"""Headings, sections, paragraphs, and the algebra of line ranges, as windows over (path, line_no)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+(.*))?$"
FENCE = r"^ {0,3}(`{3,}|~{3,})"


def by_line(*more: str):
    return Window.partitionBy("path", *more).orderBy("line_no")


def before(*more: str):
    return by_line(*more).rowsBetween(Window.unboundedPreceding, -1)


def after(*more: str):
    return by_line(*more).rowsBetween(1, Window.unboundedFollowing)


def unfenced(rows: DataFrame) -> DataFrame:
    """Drops lines of fenced code. A fence closes at a run of its own character that is as long or longer.

    The fold runs over the fence lines of a file only, and files without any are passed through.
    """
    run = F.regexp_extract("line", FENCE, 1)
    marks = rows.where(run != "").select("path", "line_no", run.alias("run"), F.regexp_extract("line", FENCE + r"[ \t]*$", 1).alias("bare"))
    ordered = marks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "run", "bare"))).alias("m"))
    state = F.struct(F.lit("").alias("run"), F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        closed = (F.substring(m["bare"], 1, 1) == F.substring(acc["run"], 1, 1)) & (F.length(m["bare"]) >= F.length(acc["run"]))
        end = F.struct(F.lit("").alias("run"), F.lit(0).cast("long").alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), m["line_no"].alias("b")))).alias("out"))
        begin = F.struct(m["run"].alias("run"), m["line_no"].alias("at"), acc["out"].alias("out"))
        return F.when(acc["run"] == "", begin).when(closed, end).otherwise(acc)

    spans = ordered.select("path", F.aggregate("m", state, step).alias("s")).select("path", F.when(F.col("s.run") == "", F.col("s.out")).otherwise(F.concat("s.out", F.array(F.struct(F.col("s.at").alias("a"), F.lit(2**31).cast("long").alias("b"))))).alias("spans"))
    return rows.join(spans, "path", "left").where(~F.coalesce(F.exists("spans", lambda s: F.col("line_no").between(s["a"], s["b"])), F.lit(False))).drop("spans")


def headings(rows: DataFrame) -> DataFrame:
    """(path, line_no, level, heading) of ATX headings outside code fences."""
    found = unfenced(rows).where(F.col("line").rlike(HEADING))
    text = F.trim(F.regexp_replace(F.regexp_extract("line", HEADING, 2), r"(^|[ \t]+)#+[ \t]*$", ""))
    return found.select("path", "line_no", F.length(F.regexp_extract("line", HEADING, 1)).cast("long").alias("level"), text.alias("heading"))


def by_level(value) -> Column:
    """value(level) for the row's own level."""
    out = F.when(F.col("level") == 1, value(1))
    for n in range(2, 7):
        out = out.when(F.col("level") == n, value(n))
    return out


def sections(heads: DataFrame, sizes: DataFrame) -> DataFrame:
    """Headings with section_end (line before the next heading of their level or higher, else the last line) and parent_line."""
    end = by_level(lambda n: F.min(F.when(F.col("level") <= n, F.col("line_no"))).over(after()))
    parent = by_level(lambda n: F.max(F.when(F.col("level") < n, F.col("line_no"))).over(before()))
    # The nearest earlier heading of a lower level is the parent: none between them closes it.
    return heads.withColumn("next", end).withColumn("parent_line", parent).join(sizes, "path").select("path", "line_no", "level", "heading", F.coalesce(F.col("next") - 1, "n_lines").alias("section_end"), "parent_line")


def innermost(rows: DataFrame, heads: DataFrame, *keep: str) -> DataFrame:
    """Every line with the heading line of its innermost section: the last heading at or before it (as-of by a window); and the columns to keep."""
    marked = rows.join(heads.select("path", "line_no", F.col("line_no").alias("here")), ["path", "line_no"], "left")
    return marked.select("path", "line_no", *keep, F.last("here", ignorenulls=True).over(by_line().rowsBetween(Window.unboundedPreceding, 0)).alias("section_line"))


def paragraphs(rows: DataFrame) -> DataFrame:
    """(path, start_line, end_line, n_lines): maximal runs of lines that aren't blank."""
    full = rows.where(F.trim("line") != "")
    island = full.withColumn("island", F.col("line_no") - F.row_number().over(by_line()))
    return island.groupBy("path", "island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count("*").alias("n_lines")).drop("island")


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges of a path united where one starts at most a line after the furthest end so far."""
    order = Window.partitionBy("path").orderBy("start_line", "end_line")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = ranges.withColumn("new", F.when(F.col("start_line") > F.coalesce(reach, F.lit(-2).cast("long")) + 1, 1).otherwise(0))
    numbered = apart.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("path", "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("island")


def covered(required: DataFrame, available: DataFrame) -> DataFrame:
    """required with whether one united available range holds it."""
    whole = merge_ranges(available).alias("a")
    met = required.alias("r").join(whole, (F.col("r.path") == F.col("a.path")) & (F.col("a.start_line") <= F.col("r.start_line")) & (F.col("a.end_line") >= F.col("r.end_line")), "left")
    return met.select("r.*", F.col("a.path").isNotNull().alias("covered"))


def subtract_ranges(ranges: DataFrame, minus: DataFrame) -> DataFrame:
    """What is left of the united ranges without the united others: the gaps between those, by windows, not by lines."""
    own, other = merge_ranges(ranges).alias("r"), merge_ranges(minus).alias("m")
    hit = (F.col("r.path") == F.col("m.path")) & (F.col("m.start_line") <= F.col("r.end_line")) & (F.col("m.end_line") >= F.col("r.start_line"))
    met = own.join(other, hit, "left").select("r.path", F.col("r.start_line").alias("a"), F.col("r.end_line").alias("b"), F.col("m.start_line").alias("x"), F.col("m.end_line").alias("y"))
    order = Window.partitionBy("path", "a").orderBy("x")
    around = met.withColumn("past", F.lag("y").over(order)).withColumn("next", F.lead("x").over(order))
    gap = F.struct(F.coalesce(F.col("past") + 1, "a").alias("start_line"), F.coalesce(F.col("x") - 1, "b").alias("end_line"))
    tail = F.when(F.col("next").isNull() & F.col("y").isNotNull(), F.struct((F.col("y") + 1).alias("start_line"), F.col("b").alias("end_line")))
    left = around.select("path", F.explode(F.array(gap, tail)).alias("s")).where("s is not null").select("path", "s.*")
    return left.where("start_line <= end_line")


def page_chunks(rows: DataFrame, per: int = 8) -> DataFrame:
    """Fixed blocks of lines as chunks: (path, chunk_id, heading, start_line, end_line, text)."""
    found = F.regexp_extract("line", r"^ {0,3}#{1,6}[ \t]+(.*)$", 1)
    current = F.last(F.when(F.col("line").rlike(r"^ {0,3}#{1,6}[ \t]"), found), ignorenulls=True).over(by_line().rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.withColumn("current", current).withColumn("no", F.floor((F.col("line_no") - 1) / per) + 1)
    out = numbered.groupBy("path", "no").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.min_by("current", "line_no").alias("heading"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return out.select("path", F.concat("path", F.lit("#"), F.format_string("%04d", "no")).alias("chunk_id"), F.coalesce("heading", F.lit("")).alias("heading"), "start_line", "end_line", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
