"""Queries over files, lines, chunks and sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunk, reading
from ..registry import query, table
from ..sources import corpus
from . import base


@query("WITH " + base.FILES + " SELECT path, sha256(text) AS file_sha256, strlen(text) AS n_bytes FROM files")
def text_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.files(spark, sf_dir).select("path", F.sha2("text", 256).alias("file_sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(
    "WITH "
    + base.FILES
    + r""", odd AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN path WHEN 1 THEN '.git/' || path WHEN 2 THEN 'node_modules/' || path WHEN 3 THEN replace(path, '.md', '.exe')
 WHEN 4 THEN source || '/.env.local' WHEN 5 THEN source || '/server.pem' WHEN 6 THEN path || '.metadata.json' WHEN 7 THEN source || '/my_credentials.txt' WHEN 8 THEN replace(path, '.md', '.HTML') ELSE source || '/notes.csv' END AS path FROM files)
SELECT doc_id, path, (NOT list_bool_or(list_transform(string_split(path, '/')[1:-2], lambda p: starts_with(p, '.') OR lower(p) IN ('__pycache__', 'node_modules')) || [false]))
  AND regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '') <> '' AND regexp_matches(lower(string_split(path, '/')[-1]), '\.(md|txt|csv|json|yaml|yml|html|htm)$')
  AND NOT regexp_matches(lower(string_split(path, '/')[-1]), '^(\.env|\.env\..*|secrets\..*|.*\.secret\..*|.*\.pem|.*\.key|.*\.pfx|.*\.p12|.*\.metadata\.json)$') AS allowed FROM odd"""
)
def path_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, k = base.files(spark, sf_dir), F.col("doc_id") % 10
    odd = F.when(k == 0, F.col("path"))
    for n, path in enumerate([F.concat(F.lit(".git/"), "path"), F.concat(F.lit("node_modules/"), "path"), F.replace("path", F.lit(".md"), F.lit(".exe")), F.concat("source", F.lit("/.env.local")), F.concat("source", F.lit("/server.pem")), F.concat("path", F.lit(".metadata.json")), F.concat("source", F.lit("/my_credentials.txt")), F.replace("path", F.lit(".md"), F.lit(".HTML"))], 1):
        odd = odd.when(k == n, path)
    return own.select("doc_id", odd.otherwise(F.concat("source", F.lit("/notes.csv"))).alias("path")).withColumn("allowed", corpus.allowed(F.col("path")))


@query("WITH " + base.FILES + r""" SELECT doc_id, array_to_string(list_filter(string_split(replace('./' || source || '\..\' || lang || '//./doc-' || doc_id || '.md', '\', '/'), '/'), lambda p: p NOT IN ('', '.', '..')), '/') AS path FROM files""")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("./"), "source", F.lit("\\..\\"), "lang", F.lit("//./doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return base.files(spark, sf_dir).select("doc_id", corpus.normalize_path(raw).alias("path"))


@query("WITH " + base.LINES + " SELECT path, line_no, line FROM lines")
def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.lines(spark, sf_dir).select("path", "line_no", "line")


@query(
    "WITH RECURSIVE "
    + base.LINES
    + """, run AS MATERIALIZED (SELECT path, line_no, length(line) AS n, sum(length(line) + 1) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS past FROM lines), tops AS (SELECT path, max(line_no) AS n_lines FROM run GROUP BY path),
pages AS (SELECT path, CAST(0 AS BIGINT) AS portion, CAST(1 AS BIGINT) AS next_line, CAST(0 AS BIGINT) AS next_char, CAST(0 AS BIGINT) AS start_line, CAST(0 AS BIGINT) AS end_line, CAST(0 AS BIGINT) AS char_start, CAST(0 AS BIGINT) AS char_end FROM tops
 UNION ALL SELECT p.path, p.portion + 1, CASE WHEN cut THEN p.next_line ELSE last + 1 END, CASE WHEN cut THEN p.next_char + 4000 ELSE 0 END, p.next_line, last, p.next_char, CASE WHEN cut THEN p.next_char + 4000 ELSE last_n END
  FROM pages p, LATERAL (SELECT a.n - p.next_char > 4000 AS cut, CASE WHEN a.n - p.next_char > 4000 THEN a.line_no ELSE max(b.line_no) END AS last, arg_max(b.n, b.line_no) AS last_n FROM run a LEFT JOIN run b ON b.path = a.path AND b.line_no >= a.line_no AND b.past - a.past + a.n - p.next_char <= 4000 WHERE a.path = p.path AND a.line_no = p.next_line GROUP BY a.line_no, a.n))
SELECT path, portion, start_line, end_line, char_start, char_end FROM pages WHERE portion > 0"""
)
def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in pages of at most 4000 characters: whole lines, or a part of a longer line, of which the rest begins the next page."""
    rows = base.lines(spark, sf_dir)
    whole = rows.groupBy(F.col("path").alias("range_id"), "path").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"))
    return reading.portions(rows, whole, reading.fold_pages).withColumnRenamed("range_id", "path")


# The fold of chunk_lines as a recursion over line numbers: one step a line, which closes no, one or two chunks.
@query(
    "WITH RECURSIVE "
    + base.MD
    + r""", mark AS (SELECT path, line_no, line, regexp_extract(line, '^\s{0,3}(#{1,6})\s+(.+?)\s*$', 2) AS found, regexp_matches(line, '^\s{0,3}(#{1,6})\s+(.+?)\s*$') AS is_head, n_lines FROM md JOIN sizes USING (path)),
fold AS (
  SELECT path, 0 AS seen, CAST(NULL AS VARCHAR) AS buf, CAST(1 AS BIGINT) AS start, '' AS shown, '' AS current, CAST([] AS STRUCT(h VARCHAR, s BIGINT, e BIGINT, t VARCHAR)[]) AS made FROM sizes
  UNION ALL
  SELECT path, line_no, CASE WHEN over AND length(full2) > 200 THEN right(full2, 200) WHEN over THEN NULL ELSE buf2 END,
         CASE WHEN over AND length(full2) > 200 THEN line_no WHEN over THEN line_no + 1 ELSE start2 END,
         CASE WHEN over THEN current1 ELSE shown2 END, current1,
         made1 || CASE WHEN (over OR line_no = n_lines) AND full2 <> '' THEN [{'h': shown2, 's': start2, 'e': line_no, 't': full2}] ELSE [] END
         || CASE WHEN over AND line_no = n_lines AND length(full2) > 200 AND trim(right(full2, 200), E' \n\t\r') <> '' THEN [{'h': current1, 's': line_no, 'e': line_no, 't': trim(right(full2, 200), E' \n\t\r')}] ELSE [] END
  FROM (SELECT *, trim(buf2, E' \n\t\r') AS full2, length(buf2) + 1 >= 2000 AS over FROM (
    SELECT *, CASE WHEN buf1 IS NULL THEN line ELSE buf1 || chr(10) || line END AS buf2, CASE WHEN is_head OR buf1 IS NULL THEN line_no ELSE start END AS start2, CASE WHEN is_head OR buf1 IS NULL THEN current1 ELSE shown END AS shown2 FROM (
      SELECT m.path, m.line_no, m.line, m.is_head, m.n_lines, f.start, f.shown, CASE WHEN m.is_head THEN trim(m.found) ELSE f.current END AS current1,
             CASE WHEN m.is_head AND f.buf IS NOT NULL THEN CASE WHEN length(trim(f.buf, E' \n\t\r')) > 200 THEN right(trim(f.buf, E' \n\t\r'), 200) END ELSE f.buf END AS buf1,
             f.made || CASE WHEN m.is_head AND f.buf IS NOT NULL AND trim(f.buf, E' \n\t\r') <> '' THEN [{'h': f.shown, 's': f.start, 'e': m.line_no - 1, 't': trim(f.buf, E' \n\t\r')}] ELSE [] END AS made1
      FROM fold f JOIN mark m ON m.path = f.path AND m.line_no = f.seen + 1)))
), last AS (SELECT path, made FROM fold JOIN sizes USING (path) WHERE seen = n_lines)
SELECT path, path || '#' || printf('%04d', k) AS chunk_id, made[k].h AS heading, made[k].s AS start_line, made[k].e AS end_line, sha256(made[k].t) AS text_sha256
FROM (SELECT path, made, unnest(range(1, len(made) + 1)) AS k FROM last)"""
)
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = lambda x, i: F.concat(F.when(i == 0, "# ").when((i + 1) % 7 == 0, "### ").when((i + 1) % 4 == 0, "## ").otherwise(""), x)
    marked = base.files(spark, sf_dir).select("doc_id", "path", F.transform(corpus.split_lines(F.col("text")), mark).alias("lines"))
    return chunk.chunk_lines(marked).select("path", "chunk_id", "heading", "start_line", "end_line", "text_sha256")


@query("WITH " + base.PAGES + " SELECT c.path, min(sha256(f.text)) AS file_sha256, count(*) AS chunk_count, array_to_string(list_sort(list(chunk_id)), ',') AS chunk_ids FROM chunks c JOIN files f USING (path) GROUP BY c.path")
def chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = base.files(spark, sf_dir).select("path", F.sha2("text", 256).alias("file_sha256"))
    return corpus.manifest(base.pages(spark, sf_dir).select("path", "chunk_id").join(hashed, "path")).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query(
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS page, CASE WHEN event_type IN ('title', 'text', 'table', 'figure', 'caption', 'header', 'footer', 'reference', 'equation') THEN event_type ELSE 'unknown' END AS layout_type,
 json_extract(props, '$.k') IS NOT NULL AS valid FROM events"""
)
def metadata_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecar JSON read with a schema; unknown layout types become `unknown`."""
    parsed = F.from_json("props", "k long")
    layout = F.when(F.col("event_type").isin(corpus.LAYOUTS[:-1]), F.col("event_type")).otherwise("unknown")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("page"), layout.alias("layout_type"), parsed["k"].isNotNull().alias("valid"))


BLOCKS = """, begun AS (SELECT *, sum(CASE WHEN starts_with(line, '#') OR line_no = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS block0 FROM md),
filled AS (SELECT *, dense_rank() OVER (PARTITION BY path ORDER BY block0) AS block FROM begun WHERE block0 IN (SELECT b.block0 FROM begun b WHERE b.path = begun.path AND trim(b.line) <> '')),
blocks AS (SELECT path, string_split(path, '/')[-1] || '#b' || printf('%04d', block) AS block_id, CASE WHEN starts_with(arg_min(line, line_no), '#') AND count(*) = 1 THEN 'title' ELSE 'text' END AS layout_type, min(line_no) AS start_line, max(line_no) AS end_line FROM filled GROUP BY path, block)"""


@query("WITH " + base.MD + BLOCKS + " SELECT * FROM blocks")
def sidecar_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.line_blocks(base.md(spark, sf_dir))


@query(
    "WITH "
    + base.PAGES
    + BLOCKS
    + """, met AS (SELECT c.path, c.chunk_id, b.block_id, b.layout_type, least(c.end_line, b.end_line) - greatest(c.start_line, b.start_line) + 1 AS shared, b.start_line AS first_line
 FROM chunks c LEFT JOIN blocks b ON b.path = c.path AND b.start_line <= c.end_line AND c.start_line <= b.end_line)
SELECT path, chunk_id, arg_max(block_id, shared * 1000000 - first_line) AS block_id, arg_max(layout_type, shared * 1000000 - first_line) AS layout_type, max(shared) AS shared FROM met GROUP BY path, chunk_id"""
)
def sidecar_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = base.pages(spark, sf_dir).select("path", "chunk_id", "start_line", "end_line")
    return corpus.metadata_for_ranges(ranges, corpus.line_blocks(base.md(spark, sf_dir))).drop("start_line", "end_line")


@query(
    "WITH "
    + base.LINES
    + """, refs AS (SELECT doc_id AS ref_id, path, doc_id % 5 + 1 AS start_line, doc_id % 5 + 3 AS end_line FROM files),
met AS (SELECT r.ref_id, l.path, l.line_no, l.line, l.line_no BETWEEN r.start_line AND r.end_line AS highlight FROM lines l JOIN refs r ON l.path = r.path AND l.line_no BETWEEN r.start_line - 10 AND r.end_line + 10)
SELECT * FROM (SELECT *, CAST(sum(strlen(line) + 1) OVER (PARTITION BY ref_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes FROM met) WHERE bytes <= 65536"""
)
def evidence_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = base.files(spark, sf_dir).select(F.col("doc_id").alias("ref_id"), "path", (F.col("doc_id") % 5 + 1).alias("start_line"), (F.col("doc_id") % 5 + 3).alias("end_line"))
    return corpus.evidence_view(base.lines(spark, sf_dir), refs)


@query(
    """WITH named AS (SELECT doc_id, source || '/rule-' || (doc_id // 4) || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '_part1' WHEN 2 THEN '_part2' ELSE '-resegmented-03' END || '.md' AS path, source FROM documents)
SELECT regexp_replace(regexp_replace(path, '\\.[^.]*$', ''), '(?:[-_](?:resegmented|part)[-_]?[0-9]+)+$', '') AS base, count(*) AS parts,
 array_to_string(list(path ORDER BY coalesce(TRY_CAST(nullif(regexp_extract(path, '(?:resegmented|part)[-_]?([0-9]+)', 1), '') AS INTEGER), 0), path), ',') AS paths FROM named GROUP BY 1""".replace("\\\\", "\\")
)
def document_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split documents: siblings that differ in a part suffix only, parts in order."""
    k = F.col("doc_id") % 4
    suffix = F.when(k == 0, "").when(k == 1, "_part1").when(k == 2, "_part2").otherwise("-resegmented-03")
    named = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/rule-"), F.floor(F.col("doc_id") / 4).cast("string"), suffix, F.lit(".md")).alias("path"))
    stem = F.regexp_replace(F.regexp_replace("path", r"\.[^.]*$", ""), r"(?:[-_](?:resegmented|part)[-_]?[0-9]+)+$", "")
    part = F.coalesce(F.expr(r"try_cast(regexp_extract(path, '(?:resegmented|part)[-_]?([0-9]+)', 1) as int)"), F.lit(0))
    out = named.select(stem.alias("base"), F.struct(part.alias("n"), "path").alias("p")).groupBy("base").agg(F.count("*").alias("parts"), F.array_sort(F.collect_list("p")).alias("p"))
    return out.select("base", "parts", F.array_join(F.transform("p", lambda x: x["path"]), ",").alias("paths"))
