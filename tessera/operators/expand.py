"""Headings that were found are replaced by what stands below them, within limits; then the evidence that is kept is graded as it is.

A heading whose sections begin at once stands for them. Sections are chosen by how near they are to the question, shown in the order of the
document, and cut at whole lines. What must be covered for a heading's text to be whole are the runs of its lines that aren't blank.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import evidence, structure
from .reading import introductions

# Parents and ranges of a question, lines that must be covered, characters that anchor a parent.
PARENTS, RANGES_EACH, RANGES, REQUIRED_RUNS, ANCHOR = 2, 4, 4, 500, 4
PART = "query_id long, expanded_from string, path string, heading string, file_sha256 string, parent_line long, group_id string, start_line long, end_line long, group_order int, group_priority int, reasons array<string>"


def standing_parents(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """(path, line_no, heading, first_line, last_line): headings with sections below them and only blank lines before the first."""
    intros = introductions(rows, sections).where("nested and not full").select("path", "line_no", "heading", (F.col("end_line") + 1).alias("first_line"))
    return intros.join(sections.select("path", "line_no", F.col("section_end").alias("last_line")), ["path", "line_no"])


def child_pieces(parents: DataFrame, sections: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks by the section right below a parent that holds them, (path, parent_line, section_line, chunk_id, start_line, end_line), and the runs of
    lines that they make, (path, parent_line, section_line, start_line, end_line)."""
    kids = sections.where("parent_line is not null").select("path", "parent_line", F.col("line_no").alias("section_line"), "section_end").join(parents.select("path", F.col("line_no").alias("parent_line")), ["path", "parent_line"], "left_semi")
    inside = kids.join(chunks.select("path", "chunk_id", "start_line", "end_line"), "path").where("start_line >= section_line and end_line <= section_end")
    held = inside.select("path", "parent_line", "section_line", "chunk_id", "start_line", "end_line")
    key = F.to_json(F.struct("path", "parent_line", "section_line"))
    merged = structure.merge_ranges(held.select(key.alias("path"), "start_line", "end_line"))
    of = F.from_json("path", "path string, parent_line bigint, section_line bigint")
    return held, merged.withColumn("of", of).select("of.path", "of.parent_line", "of.section_line", "start_line", "end_line")


def ordered_sections(eligible: DataFrame, sections: DataFrame, held: DataFrame, scores: DataFrame | None) -> DataFrame:
    """(query_id, expanded_from, section_line, place, sections): the sections below every found parent, best first.

    By the greatest similarity of their chunks to the question, then their best keyword score, then the order of the document; in that order alone
    where no chunk of the parent has a similarity. scores: query_id, chunk_id, similarity, keyword_score.
    """
    kids = sections.where("parent_line is not null").select("path", F.col("parent_line").alias("line_no"), F.col("line_no").alias("section_line"))
    own = eligible.select("query_id", "expanded_from", "path", "line_no").join(kids, ["path", "line_no"])
    if scores is not None:
        near = held.select("path", F.col("parent_line").alias("line_no"), "section_line", "chunk_id").join(scores, "chunk_id").groupBy("query_id", "path", "line_no", "section_line").agg(F.max("similarity").alias("similarity"), F.max("keyword_score").alias("keyword_score"))
        own = own.join(near, ["query_id", "path", "line_no", "section_line"], "left")
    else:
        own = own.withColumn("similarity", F.lit(None).cast("double")).withColumn("keyword_score", F.lit(None).cast("double"))
    whole = Window.partitionBy("query_id", "expanded_from")
    known = F.max("similarity").over(whole).isNotNull()
    ranked = own.withColumn("known", known).withColumn("sections", F.count("*").over(whole))
    order = whole.orderBy(F.when(F.col("known"), F.col("similarity")).desc_nulls_last(), F.when(F.col("known"), F.coalesce("keyword_score", F.lit(0.0))).desc_nulls_last(), "section_line")
    return ranked.withColumn("place", F.row_number().over(order)).select("query_id", "expanded_from", "section_line", "place", "sections")


def _choose(budget: int, parents: int, each: int, most: int):
    """The fold of one question's parents: at most `parents` that give anything, `each` ranges of one, `most` in all, `budget` characters each."""

    def fit(sizes: list[int], left: int) -> int:
        """Lines that fit, ends of lines between them counted."""
        used, n = 0, 0
        for size in sizes:
            used += size + (n > 0)
            if used > left:
                break
            n += 1
        return n

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, taken, total = [], 0, 0
        for _, own in pdf.sort_values(["rank0", "expanded_from"], kind="stable").groupby(["rank0", "expanded_from"], sort=True):
            if taken == parents or total >= most:
                break
            head = own.iloc[0]
            limit = min(each, most - total)
            reasons = ["range_limit"] if head.sections > limit else []
            ranges: list[list] = []
            for start, end, place, sizes in sorted(zip(own.start_line, own.end_line, own.place, own.sizes)):
                if place > limit:
                    continue
                if ranges and start == ranges[-1][1] + 1:
                    last = ranges[-1]
                    last[1], last[2], last[3] = end, min(last[2], place), [*last[3], *sizes]
                else:
                    ranges.append([start, end, place, list(sizes)])
            left, kept = budget, []
            for start, end, place, sizes in sorted(ranges, key=lambda r: (r[2], r[0])):
                if left <= 0:
                    reasons += ["char_budget"] if "char_budget" not in reasons else []
                    break
                n = fit(sizes, left)
                if n < end - start + 1:
                    reasons += ["char_budget"] if "char_budget" not in reasons else []
                    if not n:
                        continue
                left -= sum(sizes[:n]) + n - 1
                kept.append((start, start + n - 1, place))
            if not kept:
                continue
            taken, total = taken + 1, total + len(kept)
            ranks = {r: k for k, r in enumerate(sorted(kept, key=lambda r: (r[2], r[0])), 1)}
            for order, r in enumerate(sorted(kept), 1):
                out.append((head.query_id, head.expanded_from, head.path, head.heading, head.file_sha256, head.line_no, head.group_id, r[0], r[1], order, ranks[r], reasons))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PART.split(", ")])

    return fold


def expand(matches: DataFrame, rows: DataFrame, sections: DataFrame, chunks: DataFrame, files: DataFrame, scores: DataFrame | None = None, budget: int = 4500, parents: int = PARENTS, each: int = RANGES_EACH, most: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """Ranges that questions' parents stand for, and what each group must cover.

    matches: query_id, chunk_id, path, start_line, rank0, file_sha256 (null: not known); rows: path, line_no, line; sections; chunks: path, chunk_id,
    start_line, end_line, file_sha256; files: path, file_sha256 as they are; budget: characters for all parents of a question together.
    First: query_id, chunk_id, path, heading, start_line, end_line, snippet, source, group_id, expanded_from, group_order, group_priority, group_partial,
    group_partial_reasons. Second: group_id, start_line, end_line. A parent whose file or chunks are of another text isn't expanded.
    """
    standing = standing_parents(rows, sections)
    same = matches.join(files.select("path", F.col("file_sha256").alias("now")), "path").where("file_sha256 is null or lower(file_sha256) = lower(now)")
    stale = chunks.join(files.select("path", F.col("file_sha256").alias("now")), "path").where("lower(file_sha256) <> lower(now)").select("path").distinct()
    found = same.join(stale, "path", "left_anti").withColumn("line_no", F.col("start_line")).join(standing, ["path", "line_no"])
    group = F.substring(F.sha2(F.concat_ws(":", "now", "path", F.col("line_no").cast("string")), 256), 1, 16)
    eligible = stored(found.select("query_id", F.col("chunk_id").alias("expanded_from"), "path", "rank0", F.col("now").alias("file_sha256"), "line_no", "heading", "first_line", "last_line", group.alias("group_id")), "parents")
    held, pieces = child_pieces(eligible.select("path", "line_no").distinct(), sections, chunks)
    order = ordered_sections(eligible, sections, held, scores).where(F.col("place") <= each)
    per_parent = budget // parents if parents else 0
    apart = pieces.withColumn("line_no", F.explode(F.sequence("start_line", F.least("end_line", F.col("start_line") + per_parent + 1))))
    sized = apart.join(rows.select("path", "line_no", F.length("line").cast("long").alias("n")), ["path", "line_no"]).groupBy("path", "parent_line", "section_line", "start_line", "end_line").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "n"))), lambda x: x["n"]).alias("sizes"))
    offered = eligible.join(order, ["query_id", "expanded_from"]).join(sized.withColumnRenamed("parent_line", "line_no"), ["path", "line_no", "section_line"])
    chosen = stored(offered.groupBy("query_id").applyInPandas(_choose(per_parent, parents, each, most), PART), "expanded")
    # Lines below a parent that aren't blank, as runs.
    wanted = eligible.select("group_id", "path", "first_line", "last_line").distinct()
    runs = structure.paragraphs(rows.join(wanted.select("path").distinct(), "path", "left_semi")).drop("n_lines").withColumnRenamed("path", "p")
    clipped = wanted.join(runs, (F.col("path") == F.col("p")) & (F.col("start_line") <= F.col("last_line")) & (F.col("end_line") >= F.col("first_line"))).select("group_id", F.greatest("start_line", "first_line").alias("start_line"), F.least("end_line", "last_line").alias("end_line"))
    few = clipped.groupBy("group_id").count().where(F.col("count") <= REQUIRED_RUNS).select("group_id")
    required = clipped.join(few, "group_id", "left_semi")
    of = F.to_json(F.struct("query_id", "group_id"))
    asked = chosen.select("query_id", "group_id").distinct().join(required, "group_id").select(of.alias("path"), "start_line", "end_line")
    whole = structure.covered(asked, chosen.select(of.alias("path"), "start_line", "end_line")).groupBy("path").agg(F.bool_and("covered").alias("whole"))
    marked = chosen.withColumn("of", of).join(whole.withColumnRenamed("path", "of"), "of", "left")
    reasons = F.when(F.coalesce("whole", F.lit(False)), F.col("reasons")).otherwise(F.array_append("reasons", "uncovered_lines"))
    text = chosen.select("query_id", "group_id", "group_order", "path", F.explode(F.sequence("start_line", "end_line")).alias("line_no")).join(rows.select("path", "line_no", "line"), ["path", "line_no"]).groupBy("query_id", "group_id", "group_order").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("snippet"))
    out = marked.withColumn("group_partial_reasons", reasons).join(text, ["query_id", "group_id", "group_order"])
    chunk = F.concat("group_id", F.format_string("#r%02d", "group_order"))
    made = out.select("query_id", chunk.alias("chunk_id"), "path", "heading", "start_line", "end_line", "snippet", F.lit("expanded").alias("source"), "group_id", "expanded_from", "group_order", "group_priority", (F.size("group_partial_reasons") > 0).alias("group_partial"), "group_partial_reasons")
    return made, required


def apart_from_hits(expanded: DataFrame, direct: DataFrame, rows: DataFrame) -> DataFrame:
    """expanded without the lines that direct hits of the question show, cut where they lie and numbered anew; pieces of blank lines only are left out.

    direct: query_id, path, start_line, end_line.
    """
    of = F.to_json(F.struct("query_id", "group_id", "group_order"))
    own = expanded.withColumn("of", of)
    hits = own.select("of", "query_id", "path").join(direct.select("query_id", "path", "start_line", "end_line"), ["query_id", "path"])
    left = structure.subtract_ranges(own.select(F.col("of").alias("path"), "start_line", "end_line"), hits.select(F.col("of").alias("path"), "start_line", "end_line"))
    cut = own.drop("start_line", "end_line", "snippet").join(left.withColumnRenamed("path", "of"), "of")
    text = cut.select("of", "path", "start_line", F.explode(F.sequence("start_line", "end_line")).alias("line_no")).join(rows.select("path", "line_no", "line"), ["path", "line_no"]).groupBy("of", "start_line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("snippet"))
    full = cut.join(text, ["of", "start_line"]).where(F.trim(F.regexp_replace("snippet", r"[\s　]", "")) != "")
    number = F.row_number().over(Window.partitionBy("query_id", "group_id").orderBy("start_line")).cast("int")
    numbered = full.withColumn("group_order", number).withColumn("chunk_id", F.concat("group_id", F.format_string("#r%02d", "group_order")))
    return numbered.select(*expanded.columns)


FITTED = "query_id long, chunk_id string, snippet string, end_line long, snippet_truncated boolean, shortened boolean"


def fit_budget(rows: DataFrame, limit: int) -> DataFrame:
    """rows (query_id, place, chunk_id, source, group_id, start_line, end_line, snippet) that fit into `limit` characters, in order of place.

    A direct row is cut where the characters end; an expanded one at whole lines, its end line following, or left out if none fits. Adds
    snippet_truncated, and shortened for rows of groups that lost anything. A question has a few rows: each is folded in one call.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        used, out, short = 0, [], set()
        for k, r in enumerate(pdf.itertuples(index=False)):
            left, text, end, cut = limit - used, r.snippet or "", r.end_line, False
            if left <= 0:
                short |= set(pdf.group_id.iloc[k:].dropna())
                break
            if len(text) > left:
                if r.group_id:
                    short.add(r.group_id)
                if r.source == "expanded":
                    kept = []
                    for line in text.split("\n"):
                        if sum(map(len, kept)) + len(kept) + len(line) > left:
                            break
                        kept.append(line)
                    if not kept:
                        continue
                    text, end = "\n".join(kept), r.start_line + len(kept) - 1
                else:
                    text, cut = text[:left], True
            used += len(text)
            out.append((r.query_id, r.chunk_id, text, end, cut, r.group_id))
        done = [(*o[:5], o[5] in short if o[5] else False) for o in out]
        return pd.DataFrame(done, columns=[c.split()[0] for c in FITTED.split(", ")])

    fitted = rows.select("query_id", "place", "chunk_id", "source", "group_id", "start_line", "end_line", "snippet").groupBy("query_id").applyInPandas(fold, FITTED)
    return rows.drop("snippet", "end_line").join(fitted, ["query_id", "chunk_id"])


def whole_structures(rows: DataFrame, required: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, complete): questions for which the text below some parent is there as a whole.

    A group counts if it isn't partial, its parent is among the rows and anchored in the question, the rows of it and the direct rows of its file that
    weren't cut cover all it must, and hold all terms. rows: query_id, query, chunk_id, path, heading, start_line, end_line, snippet, source, group_id,
    expanded_from, group_partial, snippet_truncated, embedding_score; required: group_id, start_line, end_line; terms: query_id, terms (lower case).
    """
    anchored = evidence.with_support(rows.where("group_id is null")).where(F.col("anchor") >= ANCHOR).select("query_id", F.col("chunk_id").alias("expanded_from"))
    groups = rows.where("group_id is not null").groupBy("query_id", "group_id").agg(F.bool_or(F.coalesce("group_partial", F.lit(False))).alias("partial"), F.first("expanded_from").alias("expanded_from"), F.first("path").alias("path")).where("not partial")
    groups = groups.join(anchored.distinct(), ["query_id", "expanded_from"], "left_semi")
    key = F.to_json(F.struct("query_id", "group_id"))
    met = groups.select("query_id", "group_id", "path").join(rows.select("query_id", "path", "start_line", "end_line", "snippet", F.col("group_id").alias("of"), "snippet_truncated"), ["query_id", "path"])
    covering = met.where((F.col("of") == F.col("group_id")) | (F.col("of").isNull() & ~F.coalesce("snippet_truncated", F.lit(False)))).withColumn("key", key)
    must = groups.select("query_id", "group_id", key.alias("key")).join(required, "group_id")
    held = structure.covered(must.select(F.col("key").alias("path"), "start_line", "end_line"), covering.select(F.col("key").alias("path"), "start_line", "end_line")).groupBy("path").agg(F.bool_and("covered").alias("held")).where("held")
    text = covering.groupBy("query_id", "key").agg(F.lower(F.array_join(F.collect_list("snippet"), " ")).alias("text"))
    named = text.join(terms.where(F.size("terms") > 0), "query_id").where(F.forall("terms", lambda t: F.col("text").contains(t)))
    return named.join(held.select(F.col("path").alias("key")), "key", "left_semi").select("query_id").distinct().withColumn("complete", F.lit(True))


def select_final(rows: DataFrame, required: DataFrame, terms: DataFrame, limit: int, char_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that stay under limits of rows and characters, and the grade of what stayed: (query_id, confidence, status).

    rows: those of whole_structures with rank0, rrf_score, group_order, group_priority and conflict; a conflict found before the limits holds after them.
    """
    conflict = rows.groupBy("query_id").agg(F.bool_or(F.coalesce("conflict", F.lit(False))).alias("conflict"))
    places = evidence.allocate_slots(rows.select("query_id", "chunk_id", "rank0", "group_id", "group_order", "group_priority", "expanded_from"), limit)
    kept = rows.drop("snippet_truncated").join(places, ["query_id", "chunk_id"])
    if char_limit is None:
        kept = kept.withColumn("snippet_truncated", F.lit(False)).withColumn("shortened", F.lit(False))
    else:
        kept = fit_budget(kept, char_limit)
    seen = rows.where("group_id is not null").groupBy("query_id", "group_id").count().join(kept.where("group_id is not null").groupBy("query_id", "group_id").agg(F.count("*").alias("now")), ["query_id", "group_id"]).where(F.col("now") < F.col("count")).select("query_id", "group_id", F.lit(True).alias("fewer"))
    kept = kept.join(seen, ["query_id", "group_id"], "left")
    kept = kept.withColumn("group_partial", F.coalesce("group_partial", F.lit(False)) | F.col("shortened") | F.coalesce("fewer", F.lit(False))).drop("shortened", "fewer", "rank0").withColumn("rank0", F.col("place") - 1)
    signs = conflict.join(whole_structures(kept, required, terms), "query_id", "left")
    return kept, evidence.evidence_status(kept, signs)
