"""Queries over the main units of documents that are made into notices: titles, sections, forms, notes, addresses and provisos by line number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching, structure, units
from ..registry import query
from . import base

#: A line of a notice from a document's line; the same text in both dialects.
NOTICE_LINE = """CASE WHEN doc_id % 5 = 1 AND line_no BETWEEN 3 AND 5 THEN CASE line_no WHEN 3 THEN '## 3 適用日' WHEN 4 THEN '令和6年4月1日から適用する。' ELSE '## 取扱い' END
 WHEN doc_id % 11 = 3 AND line_no IN (1, 4) THEN '---'
 WHEN line_no = 1 + doc_id % 2 AND doc_id % 3 = 0 THEN '# ' || line
 WHEN line_no % 6 = 0 AND doc_id % 9 <> 2 THEN '## ' || CASE (doc_id + line_no) % 4 WHEN 0 THEN '照会先' WHEN 1 THEN '3 適用日' WHEN 2 THEN '取扱い' ELSE line END
 WHEN line_no % 10 = 9 AND doc_id % 9 <> 2 THEN '### ' || line
 WHEN (doc_id + 3 * line_no) % 17 = 0 THEN '　 '
 WHEN (doc_id + 3 * line_no) % 17 = 1 THEN '（別紙' || (line_no % 9) || '）'
 WHEN (doc_id + 3 * line_no) % 17 = 2 THEN ' ※ ' || line
 WHEN (doc_id + 3 * line_no) % 17 = 3 OR doc_id % 13 = 5 AND line_no % 3 = 1 THEN '| 氏名 | ○○ | |' || CASE WHEN doc_id % 2 = 0 THEN ' 済みか |' ELSE '' END
 WHEN (doc_id + 3 * line_no) % 17 = 4 THEN '|---|:--|'
 WHEN (doc_id + 3 * line_no) % 17 = 5 THEN '会計課長 殿'
 WHEN (doc_id + 3 * line_no) % 17 = 6 THEN 'ただし、' || line
 WHEN (doc_id + 3 * line_no) % 17 = 7 THEN '> 令和6年4月1日から適用する。'
 WHEN (doc_id + 3 * line_no) % 17 = 8 THEN '**以上**'
 WHEN (doc_id + 3 * line_no) % 17 = 9 THEN '連絡先 内線 12'
 WHEN (doc_id + 3 * line_no) % 17 = 10 THEN '申請者：'
 WHEN (doc_id + 3 * line_no) % 17 = 11 THEN line || 'の場合'
 WHEN (doc_id + 3 * line_no) % 17 = 12 THEN ''
 ELSE line END"""


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _share(test: str) -> str:
    return f"CASE WHEN is_row THEN len(list_filter(cells, lambda c: {test})) END"


EMPTY = f"regexp_matches(c, {_re(units.PLACEHOLDER)})"
NOTICE = (
    base.LINES
    + f""",
notice AS MATERIALIZED (SELECT doc_id, path, line_no, {NOTICE_LINE} AS line FROM lines),
nheads AS (SELECT path, line_no, length(regexp_extract(line, '{structure.HEADING}', 1)) AS level, trim(regexp_replace(regexp_extract(line, '{structure.HEADING}', 2), '(^|[ \\t]+)#+[ \\t]*$', '')) AS heading
           FROM notice WHERE regexp_matches(line, '{structure.HEADING}')),
ends AS (SELECT path, max(line_no) AS n_lines FROM notice GROUP BY path),
nsec AS MATERIALIZED (SELECT h.path, h.line_no, h.level, h.heading, coalesce((SELECT min(n.line_no) FROM nheads n WHERE n.path = h.path AND n.line_no > h.line_no AND n.level <= h.level) - 1, e.n_lines) AS section_end,
                (SELECT max(p.line_no) FROM nheads p WHERE p.path = h.path AND p.line_no < h.line_no AND p.level < h.level) AS parent_line FROM nheads h JOIN ends e USING (path)),
raw AS (SELECT *, regexp_replace(line, '^[\\s　]+|[\\s　]+$', '', 'g') AS bare, regexp_replace(line, {_re(units.LINE_MARKUP)}, '', 'g') AS s FROM notice),
cut AS (SELECT *, starts_with(bare, '|') AND NOT regexp_matches(bare, {_re(units.TABLE_RULE)}) AS is_row,
          list_transform(string_split(regexp_replace(bare, '^\\|+|\\|+$', '', 'g'), '|'), lambda c: regexp_replace(c, '^[\\s　]+|[\\s　]+$', '', 'g')) AS cells FROM raw),
feat AS MATERIALIZED (SELECT *, {_share("true")} AS c_all, {_share(EMPTY + " OR contains(c, '○○') OR contains(c, '●●')")} AS c_blank, {_share("NOT " + EMPTY)} AS c_filled,
          {_share("NOT " + EMPTY + " AND regexp_matches(c, '[。？?][\\s　]*$|か[\\s　]*$')")} AS c_asked FROM cut)"""
)


def _judged(source: str, keys: str, heading: str, header: str) -> str:
    """Rows of `source` (path, line_no, features, body boolean) judged by group; `heading` and `header` are expressions over grouped keys."""
    rest = lambda c: f"coalesce(sum({c}) FILTER (body) - arg_min({c}, line_no) FILTER (body AND is_row), 0)"
    seen = lambda p: f"coalesce(bool_or(regexp_matches(line, {_re(p)})) FILTER (body), false)"
    every = lambda p: f"coalesce(bool_and({p}) FILTER (body AND s <> ''), true)"
    short = f"NOT contains(s, '。') AND length(s) <= {units.SHORT_LINE}"
    return f"""SELECT *, CASE WHEN NOT headed AND content > 0 AND closing THEN true WHEN form AND NOT strong THEN true WHEN NOT headed AND contact AND NOT strong THEN true
 WHEN hd AND NOT headed AND content > 0 AND short THEN true WHEN qualifying THEN false WHEN headed THEN regexp_matches(hx, {_re(units.ANCILLARY_HEADING)}) ELSE content > 0 AND anc END AS ancillary
FROM (SELECT *, hx <> '' AS headed, n_rows >= 2 AND cells > 0 AND blank >= 0.3 * cells AND NOT (filled > 0 AND asked >= 0.3 * filled) AND form_lines AS form
FROM (SELECT {keys}, min(line_no) AS a, max(line_no) AS b, {heading} AS hx, {header} AS hd, count(*) FILTER (body AND is_row) AS n_rows, {rest("c_all")} AS cells, {rest("c_blank")} AS blank, {rest("c_filled")} AS filled, {rest("c_asked")} AS asked,
 coalesce(bool_and(regexp_matches(s, '(：|:)$') OR regexp_matches(s, '^(※|（注|注)') OR (NOT contains(s, '。') AND length(s) <= 20)) FILTER (body AND bare <> '' AND NOT starts_with(bare, '#') AND NOT starts_with(bare, '|')), true) AS form_lines,
 {every("regexp_matches(s, '^(記|以上)$')")} AS closing, {every(short)} AS short, {every(f"regexp_matches(s, {_re(units.ANCILLARY_LINE)})")} AS anc, {seen(units.CONTACT)} AS contact, {seen(units.STRONG_QUALIFIER)} AS strong, {seen(units.QUALIFYING)} AS qualifying,
 count(*) FILTER (body AND s <> '') AS content, coalesce(bool_or(bare <> '') FILTER (body), false) AS any_full FROM {source} GROUP BY {keys}))"""


UNITS = (
    NOTICE
    + f""",
roots AS (SELECT path, count(*) FILTER (parent_line IS NULL) AS n_roots, min(line_no) FILTER (parent_line IS NULL) AS root FROM nsec GROUP BY path),
us AS (SELECT s.*, EXISTS (SELECT 1 FROM nsec c WHERE c.path = s.path AND c.parent_line = s.line_no) AS nested FROM nsec s JOIN roots r USING (path) WHERE CASE WHEN n_roots > 1 THEN parent_line IS NULL ELSE parent_line = root END),
placed AS (SELECT f.*, u.line_no AS start, u.heading AS section, u.nested, coalesce(f.line_no < r.root, false) AS header, f.line_no = r.root AND r.n_roots = 1 AS title, lag(f.bare, 1, '') OVER (PARTITION BY f.path ORDER BY f.line_no) AS above
           FROM feat f LEFT JOIN roots r USING (path) LEFT JOIN us u ON u.path = f.path AND f.line_no BETWEEN u.line_no AND u.section_end),
marks AS (SELECT *, CASE WHEN start IS NULL OR line_no = start OR nested THEN NULL WHEN regexp_matches(s, {_re(units.APPENDIX)}) THEN regexp_replace(s, '^[（）()]+|[（）()]+$', '', 'g')
                         WHEN regexp_matches(s, {_re(units.NOTE)}) AND NOT starts_with(above, '※') THEN '注記' END AS mark FROM placed),
cutup AS (SELECT *, count(mark) OVER w AS number, last_value(mark IGNORE NULLS) OVER w AS label, count(*) FILTER (bare = '') OVER (PARTITION BY path ORDER BY line_no) AS gaps, start IS NULL OR line_no > start AS body FROM marks WINDOW w AS (PARTITION BY path, start ORDER BY line_no)),
kinds AS (SELECT *, CASE WHEN start IS NULL THEN 'paragraph' WHEN label IS NULL THEN 'body' WHEN label = '注記' THEN 'note' ELSE 'appendix' END AS kind FROM cutup),
grains AS (SELECT *, CASE WHEN kind IN ('paragraph', 'note') THEN gaps ELSE -1 END AS para FROM kinds WHERE NOT (kind IN ('paragraph', 'note') AND bare = '') AND NOT (kind = 'paragraph' AND coalesce(title, false))),
pieces AS ({_judged("grains", "path, start, section, kind, number, label, para, header", "CASE WHEN kind = 'body' THEN section ELSE '' END", "start IS NULL AND header")}),
several AS (SELECT *, count(*) OVER (PARTITION BY path, start) AS n FROM pieces WHERE kind <> 'body' OR any_full),
wholes AS ({_judged("(SELECT * FROM kinds WHERE start IS NOT NULL)", "path, start, section", "section", "false")}),
units AS MATERIALIZED (SELECT path, a AS start_line, b AS end_line, CASE WHEN start IS NULL THEN '' WHEN kind = 'body' THEN section ELSE section || '／' || label END AS heading, kind, ancillary FROM several WHERE start IS NULL OR n > 1
 UNION ALL SELECT path, start, b, section, 'section', ancillary FROM wholes w WHERE NOT EXISTS (SELECT 1 FROM several s WHERE s.path = w.path AND s.start = w.start AND s.n > 1))"""
)


def notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.lines(spark, sf_dir).select("doc_id", "path", "line_no", F.expr(NOTICE_LINE).alias("line"))


def outline(rows: DataFrame) -> DataFrame:
    return structure.sections(structure.headings(rows), rows.groupBy("path").agg(F.count("*").alias("n_lines")))


@query("WITH " + UNITS + " SELECT * FROM units")
def primary_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notice(spark, sf_dir)
    return units.main_units(rows, outline(rows))


@query(
    "WITH "
    + UNITS
    + """, intro AS (SELECT s.path, s.line_no, s.heading, coalesce((SELECT min(n.line_no) FROM nsec n WHERE n.path = s.path AND n.line_no > s.line_no) - 1, e.n_lines) AS stop FROM nsec s JOIN ends e USING (path))
SELECT u.path, u.start_line AS unit_line, i.line_no AS start_line, i.stop AS end_line, i.heading FROM units u JOIN intro i ON u.kind = 'section' AND i.path = u.path AND i.line_no BETWEEN u.start_line AND u.end_line
 WHERE EXISTS (SELECT 1 FROM raw r WHERE r.path = i.path AND r.line_no > i.line_no AND r.line_no <= i.stop AND r.bare <> '')
UNION ALL SELECT path, start_line, start_line, end_line, heading FROM units WHERE kind <> 'section'"""
)
def unit_read_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notice(spark, sf_dir)
    own = outline(rows)
    return units.read_ranges(rows, own, units.main_units(rows, own))


@query(
    "WITH "
    + NOTICE
    + f""", ranges AS (SELECT path || ':' || line_no AS range_id, path, line_no AS start_line, line_no + (doc_id + line_no) % 5 AS end_line FROM notice WHERE line_no % 2 = 1),
front AS (SELECT path, min(line_no) FILTER (bare = '---' AND line_no BETWEEN 2 AND 200) AS closing FROM raw GROUP BY path HAVING bool_or(line_no = 1 AND bare = '---')),
firsts AS (SELECT path, min(line_no) AS first_heading FROM nsec GROUP BY path),
inside AS (SELECT r.range_id, coalesce(h.heading, '') AS own, f.*, NOT (f.line_no = r.start_line AND h.line_no IS NOT NULL) AS body, least(r.end_line, e.n_lines) < coalesce(fi.first_heading, e.n_lines + 1) AS header
  FROM ranges r JOIN feat f ON f.path = r.path AND f.line_no BETWEEN r.start_line AND r.end_line JOIN ends e ON e.path = r.path LEFT JOIN firsts fi ON fi.path = r.path LEFT JOIN nsec h ON h.path = r.path AND h.line_no = r.start_line),
gapped AS (SELECT *, count(*) FILTER (bare = '') OVER (PARTITION BY range_id ORDER BY line_no) AS gap FROM inside),
whole AS ({_judged("gapped", "range_id, own", "own", "false")}),
paras AS (SELECT range_id, bool_and(ancillary) AS every FROM ({_judged("(SELECT * FROM gapped WHERE body AND bare <> '')", "range_id, gap, header", "''", "header")}) GROUP BY range_id)
SELECT r.range_id, r.path, r.start_line, r.end_line, CASE WHEN f.closing IS NOT NULL AND (r.end_line <= f.closing OR NOT EXISTS (SELECT 1 FROM raw x WHERE x.path = r.path AND x.line_no > f.closing AND x.line_no BETWEEN r.start_line AND r.end_line AND x.bare <> '')) THEN true
 WHEN w.own <> '' THEN w.ancillary ELSE coalesce(p.every OR (w.form AND NOT w.strong), false) END AS ancillary
FROM ranges r LEFT JOIN front f USING (path) LEFT JOIN whole w USING (range_id) LEFT JOIN paras p USING (range_id)"""
)
def range_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether ranges of one to five lines hold ancillary matter only."""
    rows, n = notice(spark, sf_dir), F.col("line_no")
    asked = rows.where(n % 2 == 1).select(F.concat("path", F.lit(":"), n.cast("string")).alias("range_id"), "path", n.alias("start_line"), (n + (F.col("doc_id") + n) % 5).alias("end_line"))
    return units.classify_ranges(rows, outline(rows), asked)


@query(
    "WITH "
    + UNITS
    + f""", t AS (SELECT u.path, u.start_line, u.heading, count(*) AS n, min(r.line_no) AS line_no, min(r.line) AS line FROM units u JOIN raw r ON u.ancillary AND r.path = u.path AND r.line_no BETWEEN u.start_line AND u.end_line AND r.bare <> '' AND NOT starts_with(ltrim(r.line), '#') GROUP BY ALL),
d AS (SELECT * FROM t WHERE n = 1 AND regexp_matches(regexp_replace(line, '[\\s　>]+', '', 'g'), {_re(matching.OPERATIVE_DATE)}))
SELECT path, min(line_no) AS line_no, min(heading) AS heading FROM d GROUP BY path HAVING count(*) = 1"""
)
def operative_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of a file's one ancillary unit that says from when a rule holds (as a quotation, its mark left out)."""
    rows = notice(spark, sf_dir)
    return units.operative_dates(rows, units.main_units(rows, outline(rows)), F.regexp_replace("line", r"[\s　>]+", "").rlike(matching.OPERATIVE_DATE))


@query(
    "WITH RECURSIVE "
    + UNITS
    + """, m AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start_line) AS i, count(*) OVER (PARTITION BY path) AS n FROM units WHERE NOT ancillary),
c AS MATERIALIZED (SELECT m.path, m.i, m.start_line, r.line_no, sum(length(r.line) + 1) OVER (PARTITION BY m.path, m.i ORDER BY r.line_no) AS c FROM m JOIN notice r ON r.path = m.path AND r.line_no BETWEEN m.start_line AND m.end_line),
f AS MATERIALIZED (SELECT m.path, m.i, m.n, coalesce(max(c.c), 0) AS used FROM m LEFT JOIN c ON c.path = m.path AND c.i = m.i AND c.c <= 1000 // m.n GROUP BY m.path, m.i, m.n),
g AS MATERIALIZED (SELECT path, i, used, 1000 - sum(used) OVER (PARTITION BY path) AS pool FROM f),
walk AS (SELECT path, CAST(0 AS BIGINT) AS i, CAST(max(pool) AS BIGINT) AS pool, CAST(0 AS BIGINT) AS reach FROM g GROUP BY path
 UNION ALL SELECT w.path, w.i + 1, CAST(w.pool - (x.reach - x.used) AS BIGINT), CAST(x.reach AS BIGINT) FROM walk w JOIN LATERAL (SELECT g.used, coalesce(max(c.c), 0) AS reach FROM g LEFT JOIN c ON c.path = g.path AND c.i = g.i AND c.c <= g.used + w.pool WHERE g.path = w.path AND g.i = w.i + 1 GROUP BY g.used) x ON true),
taken AS (SELECT m.*, coalesce((SELECT max(c.line_no) FROM c WHERE c.path = m.path AND c.i = m.i AND c.c <= w.reach), m.start_line - 1) AS upto FROM m JOIN walk w ON w.path = m.path AND w.i = m.i)
SELECT path, 'read' AS part, start_line, upto AS end_line, heading, upto >= end_line AS complete FROM taken WHERE upto >= start_line
UNION ALL SELECT path, 'unread', greatest(start_line, upto + 1), end_line, heading, false FROM taken WHERE upto < end_line
UNION ALL SELECT path, 'ancillary', start_line, end_line, heading, false FROM units WHERE ancillary"""
)
def section_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read of every file's main units within 1000 characters."""
    rows = notice(spark, sf_dir)
    return units.share_budget(rows, units.main_units(rows, outline(rows)), 1000)
