"""Support, conflict, confidence and budgets of selected evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CONFLICT, compact, compact_raw, content_terms, coverage_terms, lexical_anchor, windows

HIRAGANA = r"[\x{3041}-\x{3096}]"


def with_support(rows: DataFrame) -> DataFrame:
    """Adds anchor and supported: a shared run of 4 characters, or an embedding score of 0.55; rows: query, path, heading, snippet, embedding_score."""
    compacted = rows.withColumn("_q", compact(F.col("query"))).withColumn("_h", compact(F.concat_ws(" ", "path", "heading", "snippet")))
    anchored = compacted.withColumn("anchor", lexical_anchor(F.col("_q"), F.col("_h")).cast("long")).drop("_q", "_h")
    return anchored.withColumn("supported", (F.col("anchor") >= 4) | (F.coalesce("embedding_score", F.lit(0.0)) >= 0.55))


def conflicts(query: Column, evidence: Column) -> Column:
    """Whether a sentence with a negation marker has a 4-character run of the question that is free of hiragana."""
    anchors = F.filter(windows(compact(query), 4), lambda g: ~g.rlike(HIRAGANA))
    return F.exists(F.split(evidence, "[。！？\n]+"), lambda s: s.rlike("|".join(CONFLICT)) & F.exists(anchors, lambda g: F.contains(compact_raw(s), g)))


def confidence(rows: DataFrame) -> DataFrame:
    """(query_id, coverage, confidence, status); rows: query_id, query, rank0, path, heading, snippet, source, rrf_score, embedding_score, group_id.

    Rows of one group count once (their first, which has no scores of its own). sufficient needs two independent rows or one strong one,
    0.55, embedding evidence and support for the question's content terms.
    """
    key = F.coalesce(F.concat(F.lit("group:"), "group_id"), F.concat(F.lit("chunk:"), "chunk_id"))
    first = Window.partitionBy("query_id", key).orderBy("rank0")
    marked = with_support(rows).withColumn("_first", F.row_number().over(first) == 1)
    strong = F.col("group_id").isNull() & F.col("source").contains("embedding") & (F.coalesce("embedding_score", F.lit(0.0)) >= 0.70) & (F.col("anchor") >= 4)
    ordered = lambda *cols: F.array_sort(F.collect_list(F.struct("rank0", *cols)))
    direct = F.col("source") != "expanded"
    got = marked.groupBy("query_id", "query").agg(
        F.lower(F.array_join(F.transform(ordered("snippet", "heading"), lambda x: F.concat_ws(" ", x["snippet"], x["heading"])), " ")).alias("text"),
        F.count_if("_first").alias("n"),
        F.count_if(F.col("_first") & (F.col("snippet") != "")).alias("full"),
        F.coalesce(F.min_by(F.when(F.col("group_id").isNull(), F.col("rrf_score")).otherwise(0.0), "rank0"), F.lit(0.0)).alias("top"),
        F.countDistinct(F.when(F.col("_first"), F.col("path"))).alias("files"),
        F.bool_or(F.col("_first") & F.col("source").contains("embedding")).alias("semantic"),
        F.bool_or(F.col("_first") & strong).alias("strong"),
        F.max(F.when(direct & (F.col("embedding_score") > 0), F.col("embedding_score"))).alias("similar"),
    )
    share = lambda terms, if_none: F.when(F.size(terms) == 0, if_none).otherwise(F.size(F.filter(terms, lambda t: F.contains(F.col("text"), t))) / F.size(terms))
    got = got.withColumn("coverage", share(coverage_terms(F.col("query")), 0.0)).withColumn("content", share(content_terms(F.col("query")), 1.0))
    value = F.least(F.lit(1.0), F.col("coverage") * 0.45 + F.col("full") / F.greatest("n", F.lit(1)) * 0.25 + F.least(F.col("top") / 0.035, F.lit(1.0)) * 0.2 + F.least(F.col("files") / 2, F.lit(1.0)) * 0.1)
    got = got.withColumn("confidence", value)
    lacks = F.coalesce(F.col("similar") < 0.70, F.lit(False)) & (1 - F.col("content") >= 0.5)
    enough = ((F.col("n") >= 2) | ((F.col("n") == 1) & F.col("strong"))) & (F.col("confidence") >= 0.55) & F.col("semantic")
    status = F.when(enough & ~lacks, "sufficient").when(enough | (F.col("confidence") >= 0.28), "partial").otherwise("insufficient")
    return got.select("query_id", F.round("coverage", 4).alias("coverage"), F.round("confidence", 3).alias("confidence"), status.alias("status"))


def evidence_status(rows: DataFrame, signs: DataFrame) -> DataFrame:
    """(query_id, confidence, status): confidence of all rows, with what expanded rows may add to the status.

    rows: those of confidence(); signs: query_id, conflict, complete (whether the structural evidence is whole). Rows that were expanded
    don't make a question sufficient by themselves; whole structural evidence does from 0.55 on; a conflict makes partial of it.
    """
    views = F.when(F.col("source") == "expanded", F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    both = rows.withColumn("_direct", F.explode(views)).withColumn("query_id", F.struct("query_id", "_direct")).drop("_direct")
    had = rows.groupBy("query_id").agg(F.bool_or(F.col("source") == "expanded").alias("expanded"))
    of = lambda direct, c: F.max(F.when(F.col("query_id._direct") == direct, F.col(c)))
    got = confidence(both).groupBy(F.col("query_id.query_id").alias("query_id")).agg(of(False, "confidence").alias("confidence"), of(False, "status").alias("first"), of(True, "status").alias("direct"))
    got = got.join(had, "query_id").join(signs, "query_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("conflict", "complete")})
    alone = F.coalesce(F.col("direct") == "sufficient", F.lit(False))
    enough = (F.col("first") == "sufficient") & (~F.col("expanded") | alone)
    held = F.when((F.col("first") == "sufficient") & ~enough, "partial").otherwise(F.col("first"))
    whole = F.col("complete") & (F.col("confidence") >= 0.55)
    status = F.when(F.col("conflict"), F.when(enough, "partial").otherwise(held)).when(enough | whole, "sufficient").otherwise(held)
    return got.select("query_id", "confidence", status.alias("status"))


def fit_budget(rows: DataFrame, limit: int = 9000) -> DataFrame:
    """Snippets in rank order until `limit` characters are used; the last one is cut. Adds kept_chars and cut."""
    order = Window.partitionBy("query_id").orderBy("rank0").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("snippet")).over(order), F.lit(0))
    left = rows.withColumn("_left", F.lit(limit) - used).where("_left > 0")
    return left.withColumn("kept_chars", F.least(F.length("snippet"), "_left").cast("long")).withColumn("cut", F.length("snippet") > F.col("_left")).drop("_left")


def allocate_slots(rows: DataFrame, limit: int = 8, most_ranges: int = 4) -> DataFrame:
    """(query_id, chunk_id, place): which rows get the evidence slots of a question.

    rows: query_id, chunk_id, rank0, group_id, group_order and, if there, group_priority and expanded_from (the chunk a group was made from).
    Every group is granted one slot first, but for one slot that direct rows keep. Then rows and groups follow each other by rank, a group
    after its parent or last: a direct row takes a slot, a group takes more ranges while all ranges together number less than
    min(most_ranges, max(groups granted, limit // 2)). What is left goes to the groups. Ranges are chosen by priority and shown in
    their order. Questions have a few dozen rows at most, so each is allotted in one call.
    """
    for name, kind in (("group_priority", "long"), ("expanded_from", "string")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))

    def allot(pdf):
        pdf = pdf.sort_values(["rank0", "chunk_id"], kind="stable").reset_index(drop=True)
        direct = pdf[pdf.group_id.isna()]
        spot = {c: k for k, c in enumerate(direct.chunk_id)}
        ranges, walk = {}, [(k, -1, c) for k, c in enumerate(direct.chunk_id)]
        for number, name in enumerate(pdf.group_id.dropna().unique()):
            own = pdf[pdf.group_id == name]
            key = own.group_priority.where(own.group_priority.fillna(0) > 0, own.group_order).fillna(0)
            own = own.assign(key=key).sort_values(["key", "group_order"], kind="stable")
            ranges[name] = own
            walk.append((spot.get(own.expanded_from.iloc[0], len(direct)), number, name))
        walk.sort(key=lambda x: x[:2])
        names = [name for _, number, name in walk if number >= 0]
        granted = dict.fromkeys(names, 0) | dict.fromkeys(names[: max(0, limit - bool(len(direct)))], 1)
        left = limit - sum(granted.values())
        spare = min(most_ranges, max(limit - left, limit // 2)) - (limit - left)
        kept = set()
        for _, number, name in walk:
            if number < 0:
                kept |= {name} if left > 0 else set()
                left -= left > 0
                continue
            more = max(0, min(left, spare, len(ranges[name]) - granted[name]))
            granted[name], left, spare = granted[name] + more, left - more, spare - more
        for name in names:
            more = min(left, len(ranges[name]) - granted[name])
            granted[name], left = granted[name] + more, left - more
        shown = []
        for _, number, name in walk:
            shown += ([name] if name in kept else []) if number < 0 else list(ranges[name].iloc[: granted[name]].sort_values("group_order", kind="stable").chunk_id)
        out = pdf[["query_id"]].iloc[:1].merge(pd.DataFrame({"chunk_id": shown}), how="cross")
        return out.assign(place=range(1, len(out) + 1))

    return rows.groupBy("query_id").applyInPandas(allot, "query_id long, chunk_id string, place long")


def best_window(lines: DataFrame, focus: DataFrame, limit: int = 500) -> DataFrame:
    """(ref_id, start_line, end_line, score): the run of lines within `limit` characters that shares most 2-grams with the focus, the earliest of equals.

    lines: ref_id, line_no, line; focus: ref_id, focus. Lines are summed per start by a range of running totals.
    """
    grams = focus.select("ref_id", windows(F.col("focus"), 2).alias("g"))
    scored = lines.join(grams, "ref_id").select("ref_id", "line_no", "line", F.size(F.array_intersect(F.array_distinct(windows(F.col("line"), 2)), "g")).cast("long").alias("s"), (F.length("line") + 1).alias("cost"))
    upto = Window.partitionBy("ref_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    total = scored.withColumn("c", F.sum("cost").over(upto)).withColumn("t", F.sum("s").over(upto)).withColumn("empty", F.trim("line") == "")
    # The end of the window that starts at a line: the last line whose running cost is within the limit (a range frame on cost).
    reach = Window.partitionBy("ref_id").orderBy("c").rangeBetween(0, limit + 1)
    ends = total.withColumn("first_c", F.col("c") - F.col("cost"))
    ends = ends.withColumn("reach", F.array_sort(F.collect_list(F.struct("line_no", "c", "t", "empty")).over(reach)))
    fits = F.filter("reach", lambda x: (x["c"] - F.col("first_c") - 1 <= limit))
    ends = ends.withColumn("last", F.try_element_at(F.when(F.size(fits) > 0, fits).otherwise(F.slice("reach", 1, 1)), F.lit(-1)))
    ends = ends.withColumn("full", F.coalesce(F.try_element_at(F.filter(fits, lambda x: ~x["empty"]), F.lit(-1))["line_no"], F.col("line_no")))
    score = F.col("last.t") - F.col("t") + F.col("s")
    best = ends.where(~F.col("empty")).withColumn("score", score)
    order = Window.partitionBy("ref_id").orderBy(F.desc("score"), "line_no")
    return best.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("ref_id", F.col("line_no").alias("start_line"), F.col("full").alias("end_line"), "score")
