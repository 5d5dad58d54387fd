"""Queries over judged claims, conversations and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import structure
from ..registry import query, table
from ..sources import corpus
from . import base
from .claims import NORM
from .text import GRAMS


@query(
    "WITH r AS (SELECT doc_id AS claim_id, quality = 1 AS supported, CASE WHEN toxic = 1 THEN 'scope_overreach' ELSE 'ok' END AS reason FROM labels UNION ALL SELECT doc_id, true, 'ok' FROM labels WHERE doc_id % 9 = 0), o AS (SELECT claim_id, count(*) AS n, min(supported) AS supported, min(reason) AS reason FROM r GROUP BY claim_id) SELECT d.doc_id AS claim_id, CASE WHEN n IS NULL OR n > 1 THEN 'uncertain' WHEN supported THEN CASE WHEN reason = 'ok' THEN 'passed' ELSE 'uncertain' END ELSE 'failed' END AS status, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN supported AND reason <> 'ok' THEN 'contradictory' WHEN NOT supported THEN reason ELSE '' END AS code FROM documents d LEFT JOIN o ON o.claim_id = d.doc_id"
)
def claim_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels")
    results = marks.select(F.col("doc_id").alias("claim_id"), (F.col("quality") == 1).alias("supported"), F.when(F.col("toxic") == 1, "scope_overreach").otherwise("ok").alias("reason"))
    again = marks.where("doc_id % 9 = 0").select(F.col("doc_id").alias("claim_id"), F.lit(True).alias("supported"), F.lit("ok").alias("reason"))
    return A.judge_claims(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id")), results.unionByName(again))


@query(
    "WITH m AS (SELECT lang, CASE WHEN quality IS NULL THEN 'not_run' WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'uncertain' ELSE 'passed' END AS s FROM documents LEFT JOIN labels USING (doc_id)) SELECT lang, count(*) AS n, count(*) FILTER (s = 'passed') AS passed, count(*) FILTER (s = 'uncertain') AS uncertain, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'not_run') AS not_run, round(CAST(count(*) FILTER (s <> 'not_run') AS DOUBLE) / count(*), 4) AS completion FROM m GROUP BY lang"
)
def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    s = F.when(F.col("quality").isNull(), "not_run").when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "uncertain").otherwise("passed")
    counts = [F.count_if(F.col("s") == k).alias(k) for k in ("passed", "uncertain", "failed", "not_run")]
    return marks.withColumn("s", s).groupBy("lang").agg(F.count("*").alias("n"), *counts, F.round(F.count_if(F.col("s") != "not_run") / F.count("*"), 4).alias("completion"))


@query(
    "WITH RECURSIVE i AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), f AS (SELECT conv_id, k, turn, CAST(1 AS BIGINT) AS batch, 1 AS m, n AS used FROM i WHERE k = 1 UNION ALL SELECT i.conv_id, i.k, i.turn, f.batch + CASE WHEN f.m >= 3 OR f.used + i.n > 400 THEN 1 ELSE 0 END, CASE WHEN f.m >= 3 OR f.used + i.n > 400 THEN 1 ELSE f.m + 1 END, CASE WHEN f.m >= 3 OR f.used + i.n > 400 THEN i.n ELSE f.used + i.n END FROM f JOIN i ON i.conv_id = f.conv_id AND i.k = f.k + 1) SELECT conv_id, turn AS pos, batch FROM f"
)
def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns packed for judge calls: three at most, and 400 characters."""
    items = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.length("text").cast("long").alias("n"))
    return A.pack(items, "conv_id", 3, 400)


@query(
    "WITH c AS (SELECT conv_id, turn, lower(text) AS text, list_distinct("
    + GRAMS.format("lower(text)", 2)
    + ") AS g FROM conversations) SELECT a.conv_id, a.turn AS a, b.turn AS b FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn < b.turn AND len(a.g) > 0 AND len(b.g) > 0 AND CAST(len(list_intersect(a.g, b.g)) AS DOUBLE) / len(a.g) >= 0.6 AND CAST(len(list_intersect(a.g, b.g)) AS DOUBLE) / len(b.g) >= 0.6"
)
def same_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation that cover 60 % of each other's 2-grams."""
    return A.same_facts(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.lower("text").alias("text")), "conv_id", 0.6)


@query("SELECT conv_id, turn, last_value(nullif(regexp_extract(text, '[0-9]{2,}', 0), '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS carried FROM conversations")
def carry_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last number named so far in a conversation."""
    own = table(spark, sf_dir, "conversations")
    return A.carry(own, F.nullif(F.regexp_extract("text", "[0-9]{2,}", 0), F.lit(""))).select("conv_id", "turn", "carried")


@query("SELECT conv_id, turn, role, text FROM conversations")
def saved_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as texts with a payload, and read back."""
    return A.load(A.save(table(spark, sf_dir, "conversations")))


@query("WITH " + base.LINES + ", c AS (SELECT path, line_no, CAST(sum(length(line) + 1) OVER (PARTITION BY path ORDER BY line_no) - 1 AS BIGINT) AS used FROM lines) SELECT path, max(line_no) AS end_line, max(used) AS n_chars FROM c WHERE used <= 700 GROUP BY path")
def truncate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.whole_lines(base.lines(spark, sf_dir), 700)


@query("WITH b AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 2048 WHEN 1 THEN 8192 ELSE 1280 END AS context, length(text) AS shell FROM benchmark), t AS (SELECT item_id, least(9000, floor((context - 1024 - ceil(shell / CAST(1.5 AS DOUBLE)) - 256) * CAST(1.5 AS DOUBLE))) AS v FROM b) SELECT item_id, CASE WHEN v > 0 THEN CAST(v AS BIGINT) END AS char_limit FROM t")
def char_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = F.when(F.col("item_id") % 3 == 0, 2048).when(F.col("item_id") % 3 == 1, 8192).otherwise(1280)
    return table(spark, sf_dir, "benchmark").select("item_id", A.char_limit(context, F.length("text")).alias("char_limit"))


@query("WITH " + base.HEADS + " SELECT p.path, p.line_no, substr(sha256(sha256(f.text) || ':' || p.path || ':' || p.line_no), 1, 16) AS group_id, count(*) AS children FROM sections p JOIN sections c ON c.path = p.path AND c.parent_line = p.line_no JOIN files f ON f.path = p.path GROUP BY p.path, p.line_no, f.text")
def expansion_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of sections that stand for their children: hash of file, path and line."""
    own = base.sections(spark, sf_dir).where("parent_line is not null").groupBy("path", F.col("parent_line").alias("line_no")).agg(F.count("*").alias("children"))
    hashed = base.files(spark, sf_dir).select("path", F.sha2("text", 256).alias("sha"))
    return own.join(hashed, "path").select("path", "line_no", F.substring(F.sha2(F.concat_ws(":", "sha", "path", "line_no"), 256), 1, 16).alias("group_id"), "children")


@query(
    "WITH "
    + base.HEADS
    + ", "
    + base.DEALT
    + ", q AS (SELECT b.path, list_distinct(list_transform(range(1, greatest(length(b.query) - 1, 1)), lambda i: substr(lower(b.query), i, 3))) AS g FROM dealt b), o AS (SELECT path, line_no, line, max(CASE WHEN regexp_matches(line, '^ {0,3}(#{1,6})(?:[ \\t]+(.*))?$') THEN line_no END) OVER (PARTITION BY path ORDER BY line_no) AS section_line FROM md), s AS (SELECT o.path, o.section_line, o.line_no, len(list_intersect(list_distinct(list_transform(range(1, greatest(length(o.line) - 1, 1)), lambda i: substr(lower(o.line), i, 3))), q.g)) AS score FROM o JOIN q USING (path)) SELECT path, section_line, line_no, score FROM (SELECT *, row_number() OVER (PARTITION BY path, section_line ORDER BY score DESC, line_no) AS k FROM s WHERE score > 0) WHERE k = 1"
)
def focus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.md(spark, sf_dir)
    own = structure.innermost(rows, structure.headings(rows), "line")
    return A.focus_lines(own, base.dealt(spark, sf_dir).select("path", "query"))


@query(
    "WITH "
    + base.LINES
    + ", plain AS (SELECT doc_id, line_no, "
    + NORM.format("line")
    + r""" AS t FROM lines WHERE trim(line) <> ''),
n AS (SELECT doc_id, count(*) AS n_lines FROM plain GROUP BY doc_id),
g AS (SELECT doc_id, line_no, unnest(list_distinct(list_transform(range(1, length(t) - 8), lambda i: substr(t, i, 10)))) AS gram FROM plain WHERE length(t) >= 10),
c AS (SELECT doc_id, max(k) AS most FROM (SELECT doc_id, gram, count(*) AS k FROM g GROUP BY doc_id, gram) GROUP BY doc_id)
SELECT n.doc_id, n_lines, coalesce(most, 0) AS most, n_lines >= 5 AND coalesce(most, 0) >= greatest(4, CAST(floor(n_lines * CAST(0.6 AS DOUBLE)) AS BIGINT)) AS repeated FROM n LEFT JOIN c ON c.doc_id = n.doc_id"""
)
def repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run of ten characters, in the form in which quotes are compared, occurs in most lines of a document (four at least)."""
    own = corpus.lines(base.files(spark, sf_dir)).where(F.trim("line") != "").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.collect_list("line").alias("l"))
    out = own.select("doc_id", "n_lines", A.most_lines(F.col("l")).alias("most"))
    return out.withColumn("repeated", (F.col("n_lines") >= 5) & (F.col("most") >= F.greatest(F.lit(4), F.floor(F.col("n_lines") * 0.6))))


@query("WITH g AS (SELECT user_id, event_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / CAST(1000000 AS DOUBLE) AS gap FROM events) SELECT user_id, count(*) AS beats, count(*) FILTER (gap > 300) AS stale, count(*) FILTER (gap <= 45) AS fresh FROM g GROUP BY user_id")
def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats of a user: how often one came later than 300 seconds, or within 45, after the one before."""
    from pyspark.sql import Window

    from ..streaming.jobs import with_instants

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order)) / 1_000_000.0
    own = with_instants(table(spark, sf_dir, "events")).withColumn("gap", gap)
    return own.groupBy("user_id").agg(F.count("*").alias("beats"), F.count_if(F.col("gap") > 300).alias("stale"), F.count_if(F.col("gap") <= 45).alias("fresh"))


@query(r"WITH c AS (SELECT conv_id, turn, '【E' || (turn + 1) || '】' || text || ' [E' || (turn + 2) || '], （E3）' AS t FROM conversations) SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(t, '[【（(\[]\s*(E\d+)\s*[】）)\]]', '[\1]', 'g'), '\[(E\d+)\]', 1))), ',') AS ids FROM c")
def citation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence ids of a text in whatever brackets."""
    t = F.concat(F.lit("【E"), (F.col("turn") + 1).cast("string"), F.lit("】"), "text", F.lit(" [E"), (F.col("turn") + 2).cast("string"), F.lit("], （E3）"))
    plain = F.regexp_replace(t, r"[【（(\[]\s*(E\d+)\s*[】）)\]]", "[$1]")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"\[(E\d+)\]"), F.lit(1)))), ",").alias("ids"))


# What an overview reads first.
ROLES = ["direct_answer", "qualifier_reference", "unclassified", "background", "practical_detail"]


@query(
    "WITH "
    + base.FUSED
    + ", r AS (SELECT query_id, chunk_id, rank0, list_position(['direct_answer', 'qualifier_reference', 'unclassified', 'background', 'practical_detail'], ['background', 'direct_answer', 'practical_detail', 'unclassified', 'qualifier_reference'][rank0 % 5 + 1]) AS priority FROM fused) SELECT query_id, chunk_id, priority, row_number() OVER (PARTITION BY query_id ORDER BY priority, rank0) AS place FROM r"
)
def role_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence in the order of role priorities of an overview, rank order inside a role."""
    from pyspark.sql import Window

    given = F.array(*map(F.lit, ["background", "direct_answer", "practical_detail", "unclassified", "qualifier_reference"]))
    role = F.element_at(given, (F.col("rank0") % 5 + 1).cast("int"))
    rows = base.fused(spark, sf_dir).withColumn("priority", F.array_position(F.array(*map(F.lit, ROLES)), role))
    return rows.select("query_id", "chunk_id", "priority", F.row_number().over(Window.partitionBy("query_id").orderBy("priority", "rank0")).cast("long").alias("place"))


