"""Queries that match questions with documents by title, number, issuer and subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import titles
from ..registry import query
from . import base

WORDS = r"(?:[^\s]+\s+){4}[^\s]+"
#: A document's titles (as metadata, heading and file name have them) and header; what is asked of it, by the document's number.
HEADING = "CASE doc_id % 4 WHEN 0 THEN '会計課長通知（' || w || 'について）（通知）' WHEN 1 THEN 'n-' || (doc_id % 90) || '-' || w || 'に関する件（別紙2）' WHEN 2 THEN w || '（' || substr(w, 1, 12) || '）-part-3' ELSE w || '（写）についての件' END"
HEAD_TEXT = "CASE WHEN doc_id % 3 = 0 THEN 'REG 第 0' || (doc_id % 50) || '号' WHEN doc_id % 3 = 1 THEN '監査室長' ELSE '' END"
QUESTION = "CASE query_id % 5 WHEN 0 THEN query WHEN 1 THEN 'REG第' || (query_id % 50) || '号の内容' WHEN 2 THEN '「' || regexp_extract(query, '(?:[^ ]+ +){4}[^ ]+', 0) || '」の内容詳細と監査室長' WHEN 3 THEN '会計課長の' || regexp_extract(query, '[^ ]+', 0) || '通知' ELSE '第' || (query_id % 7) || '号、' || query END"


def _sql_core(t: str, times: int = 4) -> str:
    out = f"trim({t})"
    for _ in range(times):
        out = f"trim(regexp_replace({out}, '{titles.NOISE}', '', 'g'))"
    return out


def _compare(t: str) -> str:
    from .rules import MATCH

    return f"regexp_replace(lower({t}), '{MATCH}', '', 'g')"


def _issuer_only(t: str) -> str:
    return f"{_compare(f'''regexp_replace(regexp_replace({t}, '{titles.KINDS}', '', 'g'), '{titles.ISSUER}', '', 'g')''')} = ''"


BARE = f"regexp_replace(regexp_replace(trim(t), '{titles.FILE_PREFIX}', ''), '{titles.FILE_SUFFIX}', '')"
TITLED = (
    base.FILES
    + f""",
words AS (SELECT doc_id, path, text, regexp_extract(text, '(?:[^ \\n]+ +){{4}}[^ \\n]+', 0) AS w FROM files),
named AS MATERIALIZED (SELECT doc_id, path, [{HEADING}, path] AS titles, {HEAD_TEXT} AS head_text FROM words WHERE w <> ''),
apart AS (SELECT path, i, {BARE} AS b FROM (SELECT path, unnest(titles) AS t, generate_subscripts(titles, 1) AS i FROM named)),
forms AS (SELECT path, i, unnest([b] || regexp_extract_all(b, '{titles.BRACKET}', 1) || [regexp_replace(b, '{titles.BRACKET}', '', 'g')]) AS f, generate_subscripts([b] || regexp_extract_all(b, '{titles.BRACKET}', 1) || [''], 1) AS j FROM apart WHERE b <> ''),
cores AS (SELECT path, i, j, {_sql_core("f")} AS c FROM forms),
variants AS MATERIALIZED (SELECT path, c, min(i * 1000 + j) AS k FROM cores WHERE c <> '' AND NOT {_issuer_only("c")} GROUP BY path, c)"""
)


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = base.files(spark, sf_dir).withColumn("w", F.regexp_extract("text", r"(?:[^ \n]+ +){4}[^ \n]+", 0)).where("w <> ''")
    return words.select("path", F.array(F.expr(HEADING), F.col("path")).alias("titles"), F.expr(HEAD_TEXT).alias("head_text"))


@query("WITH " + TITLED + " SELECT path, array_to_string(list(c ORDER BY k), '|') AS variants FROM variants GROUP BY path")
def title_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("path", F.array_join(titles.variants(F.col("titles")), "|").alias("variants"))


NUMBERS = "list_transform(regexp_extract_all(regexp_replace({0}, '[ 　\\t]+', '', 'g'), '[一-龥ァ-ヶA-Za-z]{{0,4}}[0-9]*第[0-9]+号'), lambda n: lower(regexp_extract(n, '^(.*)第', 1)) || '|' || regexp_replace(regexp_extract(n, '第([0-9]+)号', 1), '^0+([0-9])', '\\1'))"


@query(
    "WITH "
    + TITLED
    + ", "
    + base.QUESTIONS
    + f""", asked0 AS (SELECT query_id, {QUESTION} AS n FROM questions),
asked1 AS (SELECT query_id, n, {_compare("n")} AS q, {NUMBERS.format("n")} AS numbers, list_distinct(list_transform(regexp_extract_all(n, '{titles.ISSUER}'), lambda x: {_compare("x")})) AS issuers FROM asked0),
asked AS MATERIALIZED (SELECT *, list_distinct(list_transform(list_filter(regexp_extract_all(n, '{titles.SUBJECT}'), lambda t: NOT list_contains({titles.GENERIC_TERMS}, t) AND len(list_filter(issuers, lambda i: contains({_compare("t")}, i))) = 0 AND NOT (regexp_matches(t, '{titles.KINDS}') AND {_issuer_only("t")})), lambda t: {_compare("t")})) AS subjects FROM asked1),
docs AS MATERIALIZED (SELECT path, {_compare("array_to_string(titles, ' ')")} AS title_text, {_compare("head_text")} AS header, {NUMBERS.format("head_text")} AS numbers FROM named),
vs AS MATERIALIZED (SELECT DISTINCT path, {_compare("c")} AS v FROM variants),
sized AS MATERIALIZED (SELECT path, v, list_distinct(list_transform(range(1, length(v)), lambda i: substr(v, i, 2))) AS g, length(regexp_replace(v, '{titles.GENERIC_TITLE}', '', 'g')) AS own FROM vs),
shares AS (SELECT a.query_id, s.path, s.v, s.own, CASE WHEN len(g) = 0 THEN 0 ELSE len(list_filter(g, lambda x: contains(a.q, x))) / len(g) END AS c, contains(a.q, s.v) AS inside FROM asked a, sized s),
by_title AS (SELECT query_id, path, max(c) AS c, bool_or(length(v) >= 4 AND c >= 0.5) AS partly, coalesce(arg_max(v, length(v)) FILTER (length(v) >= 4 AND inside AND own >= 4), '') AS core FROM shares GROUP BY query_id, path),
facts AS (SELECT a.query_id, d.path, coalesce(t.c, 0) AS c, coalesce(t.partly, false) AS partly, coalesce(t.core, '') AS core, len(list_filter(a.numbers, lambda x: len(list_filter(d.numbers, lambda y: CASE WHEN starts_with(x, '|') THEN string_split(y, '|')[2] = substr(x, 2) ELSE x = y END)) > 0)) > 0 AS numbered,
 len(list_filter(a.subjects, lambda s: contains(d.title_text, s))) AS hits, len(list_filter(a.issuers, lambda i: contains(d.title_text || d.header, i))) > 0 AS issued, len(a.subjects) AS n, coalesce(list_sum(list_transform(a.subjects, lambda s: length(s))), 0) AS chars
 FROM asked a CROSS JOIN docs d LEFT JOIN by_title t ON t.query_id = a.query_id AND t.path = d.path),
graded AS (SELECT *, CASE WHEN core <> '' OR numbered THEN 2 WHEN issued AND hits > 0 OR n > 0 AND hits = n AND chars >= 4 OR partly THEN 1 ELSE 0 END AS strength,
 CASE WHEN core <> '' AND numbered THEN 'title,document_number' WHEN core <> '' THEN 'title' WHEN numbered THEN 'document_number' WHEN issued AND hits > 0 THEN 'issuer_subject' WHEN n > 0 AND hits = n AND chars >= 4 THEN 'subject' ELSE 'title_partial' END AS reasons FROM facts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, hits DESC, round(c, 4) DESC, path) AS place FROM graded WHERE strength > 0),
top AS (SELECT query_id, count(*) AS n, arg_max(path, (length(core), -place)) AS path, arg_max(core, (length(core), -place)) AS core FROM ranked WHERE strength = 2 GROUP BY query_id)
SELECT r.query_id, r.path, r.strength, round(r.c, 4) AS coverage, r.hits AS subject_hits, r.reasons, r.core AS matched_core, r.place, coalesce(r.path = t.path AND (t.n = 1 OR t.core <> '' AND NOT EXISTS (SELECT 1 FROM ranked o WHERE o.query_id = r.query_id AND o.strength = 2 AND o.path <> t.path AND NOT (length(o.core) < length(t.core) AND contains(t.core, o.core) AND o.reasons = 'title'))), false) AS confirmed
FROM ranked r LEFT JOIN top t USING (query_id)"""
)
def document_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that a question may be about, from all documents and questions, without pairing them all."""
    asked = base.questions(spark, sf_dir).select("query_id", F.expr(QUESTION).alias("query"))
    out = titles.match_documents(named(spark, sf_dir), asked)
    return out.withColumn("reasons", F.array_join("reasons", ","))
