"""What is read of a document and in which portions: sections for lines, leaves over their ancestors, units and pages of bounded size, turns by depth."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import structure
from .units import BLANK

MOST_CHARS = 4000


def introductions(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """(path, line_no, end_line, heading, parent_line, full, nested): every heading with the text up to the next heading, whether that has
    any, and whether sections lie below."""
    order = structure.by_line()
    next_line = F.lead("line_no").over(order)
    own = sections.withColumn("nested", F.coalesce(next_line <= F.col("section_end"), F.lit(False))).withColumn("end_line", F.when(F.col("nested"), next_line - 1).otherwise(F.col("section_end")))
    marks = own.select("path", "line_no", F.col("line_no").alias("at"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("path", "line_no", "line").join(marks, ["path", "line_no"], "left").withColumn("of", F.last("at", ignorenulls=True).over(upto))
    full = inside.where((F.col("line_no") > F.col("of")) & ~F.col("line").rlike(BLANK)).select("path", F.col("of").alias("line_no")).distinct().withColumn("full", F.lit(True))
    return own.join(full, ["path", "line_no"], "left").select("path", "line_no", "end_line", "heading", "parent_line", F.coalesce("full", F.lit(False)).alias("full"), "nested")


def section_ranges(asked: DataFrame, intros: DataFrame) -> DataFrame:
    """asked (path, line_no, ..) with start_line, end_line and heading of the section a line lies in, closed before the first section below it.

    Lines before the first heading have the lines up to it; files without headings the empty range 1 to 0.
    """
    first = intros.groupBy("path").agg(F.min("line_no").alias("first"))
    heads = intros.select("path", "line_no", F.struct("line_no", "end_line", "heading").alias("of"))
    both = asked.select("path", "line_no").distinct().withColumn("of", F.lit(None).cast(heads.schema["of"].dataType)).unionByName(heads)
    order = Window.partitionBy("path").orderBy("line_no", F.col("of").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("in", F.last("of", ignorenulls=True).over(order)).where("of is null").drop("of")
    met = asked.join(found, ["path", "line_no"]).join(first, "path", "left")
    outside = F.struct(F.lit(1).cast("long").alias("line_no"), F.coalesce(F.col("first") - 1, F.lit(0)).alias("end_line"), F.lit("").alias("heading"))
    at = F.coalesce("in", outside)
    return met.select(*asked.columns, at["line_no"].alias("start_line"), at["end_line"].alias("end_line"), at["heading"].alias("heading"))


def leaves(intros: DataFrame, sizes: DataFrame) -> DataFrame:
    """(path, start_line, end_line, heading): all introductions with text, and the lines before the first heading; whole files without headings.

    sizes: path, n_lines.
    """
    own = intros.where("full").select("path", F.col("line_no").alias("start_line"), "end_line", "heading")
    first = intros.groupBy("path").agg(F.min("line_no").alias("first"))
    before = sizes.join(first, "path", "left").select("path", F.lit(1).cast("long").alias("start_line"), F.coalesce(F.col("first") - 1, "n_lines").alias("end_line"), F.lit("").alias("heading"))
    return own.unionByName(before.where((F.col("end_line") >= 1)))


def with_context(asked: DataFrame, intros: DataFrame) -> DataFrame:
    """(ask_id, place, start_line, end_line, heading): what to read for a line (ask_id, path, line_no): its section, or instead of headings without
    text the sections below them; then what stands before the first heading, and the text of the sections around it, the outermost first.

    Headings have six levels, so five steps reach every ancestor and every section below.
    """
    ranged = section_ranges(asked.select("ask_id", "path", "line_no"), intros)
    bodyless = F.col("nested") & ~F.col("full")
    nodes = intros.select("path", F.col("line_no").alias("node"), F.col("end_line").alias("to"), F.col("heading").alias("title"), F.col("parent_line").alias("up"), bodyless.alias("bodyless"))
    start = ranged.select("ask_id", "path", F.col("start_line").alias("node")).join(nodes, ["path", "node"])
    pick = lambda df, part: df.where("not bodyless").select("ask_id", F.lit(part).alias("part"), F.col("node").alias("start_line"), F.col("to").alias("end_line"), F.col("title").alias("heading"))
    found = pick(start, 0)
    below, above = start, start
    children = nodes.withColumnRenamed("up", "of").withColumnRenamed("path", "p")
    for _ in range(5):
        down = below.where("bodyless").select("ask_id", "path", F.col("node").alias("of"))
        below = down.join(children, (F.col("path") == F.col("p")) & (down["of"] == children["of"])).select("ask_id", "path", "node", "to", "title", F.lit(None).cast("long").alias("up"), "bodyless")
        above = above.where("up is not null").select("ask_id", "path", F.col("up").alias("node")).join(nodes, ["path", "node"]).select("ask_id", "path", "node", "to", "title", "up", "bodyless")
        found = found.unionByName(pick(below, 0)).unionByName(pick(above, 1))
    first = intros.groupBy("path").agg(F.min("line_no").alias("first"))
    preface = start.join(first, "path").where("first > 1").select("ask_id", F.lit(1).alias("part"), F.lit(1).cast("long").alias("start_line"), (F.col("first") - 1).alias("end_line"), F.lit("").alias("heading"))
    alone = ranged.join(start.select("ask_id").distinct(), "ask_id", "left_anti").select("ask_id", F.lit(0).alias("part"), "start_line", "end_line", "heading")
    every = found.unionByName(preface).unionByName(alone)
    once = every.groupBy("ask_id", "start_line", "end_line", "heading").agg(F.min("part").alias("part"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("ask_id").orderBy("part", "start_line"))).drop("part")


Portion = tuple[int, int, int | None, int | None]


def fold_units(sizes: np.ndarray, most: int) -> list[Portion]:
    """(first, last, from, to) of runs of lines of at most `most` characters with the line ends between them; lines that are longer are cut apart,
    their parts' characters counted from 0, `to` included."""
    past = np.cumsum(sizes + 1)
    long_at = np.append(np.flatnonzero(sizes > most), len(sizes))
    out: list[Portion] = []
    here = 0
    while here < len(sizes):
        if sizes[here] > most:
            out += [(here, here, at, min(at + most, int(sizes[here])) - 1) for at in range(0, int(sizes[here]), most)]
            here += 1
            continue
        stop = int(long_at[np.searchsorted(long_at, here)])
        end = min(int(np.searchsorted(past, past[here] + most - sizes[here], side="right")), stop)
        out.append((here, end - 1, None, None))
        here = end
    return out


def fold_pages(sizes: np.ndarray, most: int) -> list[Portion]:
    """(first, last, from, to) of pages of at most `most` characters: whole lines, or a part of a line that is longer; what is left of that
    begins the next page. from counts in the first line, to in the last, excluded."""
    past = np.cumsum(sizes + 1)
    out: list[Portion] = []
    here, column = 0, 0
    while here < len(sizes):
        left = int(sizes[here]) - column
        if left > most:
            out.append((here, here, column, column + most))
            column += most
            continue
        end = int(np.searchsorted(past, past[here] + most - left, side="right"))
        out.append((here, end - 1, column, int(sizes[end - 1])))
        here, column = end, 0
    return out


def portions(rows: DataFrame, ranges: DataFrame, fold: Callable[[np.ndarray, int], list[Portion]], most: int = MOST_CHARS) -> DataFrame:
    """(range_id, portion, start_line, end_line, char_start, char_end) of ranges (range_id, path, start_line, end_line) of lines (path, line_no, line).

    Only the lengths of lines travel; they are folded range by range.
    """
    sized = rows.select("path", "line_no", F.length("line").alias("n"))
    asked = ranges.where("end_line >= start_line").select("range_id", "path", F.explode(F.sequence("start_line", "end_line")).alias("line_no"))
    whole = asked.join(sized, ["path", "line_no"]).groupBy("range_id").agg(F.min("line_no").alias("start"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "n"))), lambda x: x["n"]).alias("sizes"))
    kind = dict(ranges.dtypes)["range_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for range_id, start, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for n, (a, b, x, y) in enumerate(fold(sizes.values.to_numpy().astype(np.int64), most), 1):
                    for column, value in zip(out, (range_id, n, start + a, start + b, x, y)):
                        column.append(value)
            kinds = [batch.schema.field(0).type] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=["range_id", "portion", "start_line", "end_line", "char_start", "char_end"])

    return whole.select("range_id", "start", "sizes").mapInArrow(run, f"range_id {kind}, portion long, start_line long, end_line long, char_start long, char_end long")


def by_turns(ranges: DataFrame) -> DataFrame:
    """ranges (path, unit_line, start_line, ..) with turn: the first range of every unit, then the second of every one that has two, and so on."""
    depth = F.row_number().over(Window.partitionBy("path", "unit_line").orderBy("start_line"))
    return ranges.withColumn("depth", depth).withColumn("turn", F.row_number().over(Window.partitionBy("path").orderBy("depth", "unit_line"))).drop("depth")
