"""Queries over forms of comparison, provisions, path references, pinned documents, sidecars and the status of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims, evidence, matching
from ..registry import query, table
from ..sources import corpus
from . import base
from .evidence import ANCHORED, _grouped

MATCH = r"[\s\x{3000}、。，．,.・:：;；" + '"' + r"''“”‘’「」『』（）()\[\]【】〔〕<>＜＞/／\\|｜~〜～\-－―‐]+"
LINE = r"[\s、。，．,.・「」『』:：;；\[\]［］]+"


@query(
    "SELECT doc_id, sha256(regexp_replace(lower(text), '" + MATCH + "', '', 'g')) AS title_form, sha256(regexp_replace(regexp_replace(text || ' [E12]', '\\[E\\d+\\]', '', 'g'), '" + LINE + "', '', 'g')) AS line_form FROM documents"
)
def match_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of whole texts in the two forms of comparison."""
    own = table(spark, sf_dir, "documents")
    forms = own.select("doc_id", matching.normalize_title(F.col("text")).alias("a"), matching.normalize_line(F.concat("text", F.lit(" [E12]"))).alias("b"))
    return forms.select("doc_id", F.sha2("a", 256).alias("title_form"), F.sha2("b", 256).alias("line_form"))


@query(
    r"""WITH t AS (SELECT doc_id, '第' || CASE WHEN doc_id % 2 = 0 THEN translate(doc_id::VARCHAR, '0123456789', '〇一二三四五六七八九') ELSE doc_id::VARCHAR END || '条' || text || '第 ' || (doc_id % 7) || ' 項' AS text FROM documents),
m AS (SELECT doc_id, regexp_extract_all(text, '第\s*([0-9一二三四五六七八九十百千〇零]{1,12})\s*(条|項|号|款|節)', 1) AS n, regexp_extract_all(text, '第\s*([0-9一二三四五六七八九十百千〇零]{1,12})\s*(条|項|号|款|節)', 2) AS k FROM t)
SELECT doc_id, array_to_string(list_transform(range(1, len(n) + 1), lambda i: '第' || CAST(translate(n[i], '〇一二三四五六七八九零', '01234567890') AS BIGINT) || k[i]), '|') AS provisions FROM m"""
)
def provision_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents between an article of their number, in digits or Kanji, and a paragraph."""
    k = F.col("doc_id").cast("string")
    number = F.when(F.col("doc_id") % 2 == 0, F.translate(k, "0123456789", "〇一二三四五六七八九")).otherwise(k)
    text = F.concat(F.lit("第"), number, F.lit("条"), "text", F.lit("第 "), (F.col("doc_id") % 7).cast("string"), F.lit(" 項"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(matching.provisions(text), "|").alias("provisions"))


@query(
    r"""WITH """
    + base.LINES
    + r""", c AS (SELECT path, line_no, CASE line_no % 5 WHEN 0 THEN '本通知は、令和6年4月1日から適用する。' WHEN 1 THEN '平成 30年 10月 1日より施行する。' WHEN 2 THEN '令和6年から適用する。' ELSE line END AS line FROM lines),
s AS (SELECT path, line_no, CASE WHEN line_no % 97 = 4 THEN '申請の真正性を' || substr(path, 1, 20) || '確認した上で、迅速かつ適切に対応する。' || line ELSE line END AS line FROM lines),
f AS (SELECT path, trim(unnest(regexp_extract_all(line, '[^。！？\n]+。'))) AS x FROM s WHERE NOT regexp_matches(ltrim(line), '^(#|\||>|```)')),
o AS (SELECT path, CASE WHEN count(*) = 1 THEN min(x) END AS duty FROM f WHERE regexp_matches(x, '真正性.{0,300}確認した(?:上|うえ)で[、,]?\s*迅速かつ適切に') GROUP BY path)
SELECT c.path, count(*) FILTER (regexp_matches(regexp_replace(line, '\s+', '', 'g'), '^(?:(?:本|この)(?:通知|規程|要綱|要領|通達|事務連絡)は[、,]?)?(?:(?:令和|平成|昭和)?(?:元|[0-9]+)年)[0-9]+月[0-9]+日(?:から|より)(?:適用|施行|実施)する。$')) AS dates, coalesce(min(o.duty), '') AS duty FROM c LEFT JOIN o USING (path) GROUP BY c.path"""
)
def dates_and_duties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that state a date, and the one sentence that asks for a check, of files whose lines carry such clauses in turns."""
    n = F.col("line_no")
    own = base.lines(spark, sf_dir)
    dated = F.when(n % 5 == 0, "本通知は、令和6年4月1日から適用する。").when(n % 5 == 1, "平成 30年 10月 1日より施行する。").when(n % 5 == 2, "令和6年から適用する。").otherwise(F.col("line"))
    dates = own.select("path", matching.operative_date(dated).alias("d")).groupBy("path").agg(F.count_if("d").alias("dates"))
    asks = F.concat(F.lit("申請の真正性を"), F.substring("path", 1, 20), F.lit("確認した上で、迅速かつ適切に対応する。"), "line")
    few = own.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", F.when(n % 97 == 4, asks).otherwise(F.col("line")).alias("l")))).alias("ls"))
    duty = few.select("path", matching.follow_through(F.transform("ls", lambda x: x["l"])).alias("duty"))
    return dates.join(duty, "path", "left").select("path", "dates", F.coalesce("duty", F.lit("")).alias("duty"))


@query(
    "WITH "
    + base.FILES
    + r""", v AS (SELECT doc_id, path, CASE doc_id % 10 WHEN 1 THEN '/' || path WHEN 2 THEN 'C:' || path WHEN 3 THEN 'a/../' || path WHEN 4 THEN replace(path, '/', '\') WHEN 5 THEN '.git/' || path WHEN 6 THEN path || '.metadata.json' WHEN 7 THEN 'a//' || path WHEN 8 THEN '  ' || path || ' ' WHEN 9 THEN path || '.exe' ELSE path END AS given FROM files)
SELECT doc_id, given, CASE WHEN doc_id % 10 IN (0, 4, 8) THEN path END AS path FROM v"""
)
def reference_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as references may give them, good and bad in turns."""
    p, k = F.col("path"), F.col("doc_id") % 10
    bad = {1: F.concat(F.lit("/"), p), 2: F.concat(F.lit("C:"), p), 3: F.concat(F.lit("a/../"), p), 4: F.replace(p, F.lit("/"), F.lit("\\")), 5: F.concat(F.lit(".git/"), p), 6: F.concat(p, F.lit(".metadata.json")), 7: F.concat(F.lit("a//"), p), 8: F.concat(F.lit("  "), p, F.lit(" ")), 9: F.concat(p, F.lit(".exe"))}
    given: Column = F.coalesce(*(F.when(k == n, c) for n, c in bad.items()), p)
    return base.files(spark, sf_dir).select("doc_id", given.alias("given")).withColumn("path", matching.reference_path(F.col("given")))


@query(
    "WITH "
    + base.FILES
    + """, m AS (SELECT doc_id % 97 AS query_id, path, CASE WHEN doc_id % 61 = 0 THEN 'x' ELSE sha256(text) END AS sha256, sha256(text) AS present FROM files WHERE doc_id % 3 = 0),
r AS (SELECT doc_id % 97 AS query_id, path, path || '#0001' AS chunk_id FROM files UNION ALL SELECT doc_id % 97, path, path || '#0002' FROM files)
SELECT r.* FROM r JOIN m USING (query_id, path) WHERE query_id NOT IN (SELECT query_id FROM m WHERE sha256 <> present)"""
)
def pinned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of questions (97 of them) that are pinned to documents of several parts, a few of which have changed."""
    own = base.files(spark, sf_dir).select((F.col("doc_id") % 97).alias("query_id"), "doc_id", "path", F.sha2("text", 256).alias("sha256"))
    rows = own.select("query_id", "path", F.explode(F.array(F.concat("path", F.lit("#0001")), F.concat("path", F.lit("#0002")))).alias("chunk_id"))
    stated = F.when(F.col("doc_id") % 61 == 0, "x").otherwise(F.col("sha256"))
    return matching.restrict_to_documents(rows, own.where("doc_id % 3 = 0").select("query_id", "path", stated.alias("sha256")), own.select("path", "sha256"))


SIDECAR = """CASE doc_id % 9 WHEN 7 THEN 'no json' ELSE '{"schemaVersion": ' || CASE doc_id % 9 WHEN 3 THEN '2' ELSE '1' END || ', "sourcePath": "' || CASE doc_id % 9 WHEN 4 THEN '' ELSE path END || '", "warnings": ' || CASE doc_id % 9 WHEN 5 THEN '[1]' WHEN 0 THEN '["w"]' ELSE '[]' END
 || ', "pages": [{"page": 1, "blocks": [{"layoutType": "text", "lineStart": ' || CASE doc_id % 9 WHEN 6 THEN 'true' ELSE '1' END || ', "lineEnd": null}]}]' || CASE doc_id % 9 WHEN 2 THEN '' WHEN 1 THEN ', "contentSha256": "x"' ELSE ', "contentSha256": "' || {0} || '"' END || '}' END"""


@query("WITH " + base.FILES + ", s AS (SELECT doc_id, path, " + SIDECAR.replace("{0}", "sha256(text)") + " AS content FROM files) SELECT path, CASE WHEN doc_id % 9 IN (0, 2, 8) THEN content END AS content FROM s")
def sidecar_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the metadata that may be used: sidecars are valid, of another text, or broken in turns; some have both names."""
    own = base.files(spark, sf_dir).select("doc_id", "path", "text")
    made = own.select("doc_id", "path", F.expr(SIDECAR.replace("{0}", "sha2(text, 256)")).alias("content"))
    first, second = F.concat("path", F.lit(".metadata.json")), F.concat(F.regexp_replace("path", r"\.md$", ""), F.lit(".metadata.json"))
    lone = made.select(F.when(F.col("doc_id") % 9 == 8, second).otherwise(first).alias("path"), "content")
    both = made.where("doc_id % 9 = 7").select(second.alias("path"), F.lit('{"schemaVersion": 1, "sourcePath": "x", "pages": []}').alias("content"))
    return corpus.load_sidecars(own.select("path", "text"), lone.unionByName(both))


STATUS = """CASE WHEN doc_id % {0} = 0 THEN 'failed' WHEN doc_id % {0} = 1 THEN 'uncertain' ELSE 'passed' END"""


@query(
    f"""WITH g AS (SELECT doc_id, {STATUS.format(5)} AS g1, {STATUS.format(7)} AS g2, CASE WHEN quality IS NOT NULL THEN {STATUS.format(11)} END AS g3, CASE WHEN coalesce(toxic, 0) = 1 THEN 'failed' ELSE 'passed' END AS g4, doc_id % 3 = 0 AS still, doc_id % 4 = 0 AS removed, doc_id % 13 = 0 AS corrected, doc_id % 17 = 0 AS fallback FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN fallback THEN 'failed' WHEN coalesce(g1 = 'passed' AND g2 = 'passed' AND g3 = 'passed' AND g4 = 'passed', false) AND NOT still AND NOT removed AND NOT corrected THEN 'passed' WHEN still AND g4 = 'passed' THEN 'partial' ELSE 'needs_review' END AS state FROM g"""
)
def answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of answers whose gates, open aspects and corrections follow from document numbers and labels."""
    own = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    k = F.col("doc_id")
    gates = [F.expr(STATUS.format(5)), F.expr(STATUS.format(7)), F.when(F.col("quality").isNotNull(), F.expr(STATUS.format(11))), F.when(F.coalesce("toxic", F.lit(0)) == 1, "failed").otherwise("passed")]
    still = F.when(k % 3 == 0, F.array(F.lit("期限"), F.lit(""))).otherwise(F.array(F.lit("")))
    state = claims.quality_state(F.when(k % 17 == 0, "fallback").otherwise("answer"), gates, still, F.when(k % 4 == 0, 1).otherwise(0), F.when(k % 13 == 0, 2).otherwise(0))
    return own.select("doc_id", state.alias("state"))


TERM_SETS = r"""terms0 AS (SELECT query_id, list_distinct(list_filter(list_transform(string_split_regex(query, '[\s,、。・/\\]+'), lambda x: lower(trim(x))), lambda x: length(x) >= 2)) AS ts, list_filter(list_distinct(list_transform(regexp_extract_all(query, '[一-龥々ァ-ヴー]{2,}|[A-Za-z0-9]{2,}'), lambda t: lower(t))), lambda t: NOT starts_with(t, '何')) AS cs FROM questions)"""


def _graded(name: str, rows: str) -> str:
    """Confidence and status of `rows` as common table expressions that end in one called `name`."""
    return f""", {name}_f AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce('group:' || group_id, 'chunk:' || chunk_id) ORDER BY rank0) = 1 AS f FROM ({rows})),
{name}_g AS (SELECT query_id, lower(string_agg(snippet || ' ' || heading, ' ' ORDER BY rank0)) AS text, count(*) FILTER (f) AS n, count(*) FILTER (f AND snippet <> '') AS full_n, arg_min(CASE WHEN group_id IS NULL THEN rrf_score ELSE 0.0 END, rank0) AS top, count(DISTINCT CASE WHEN f THEN path END) AS files,
 bool_or(f AND contains(source, 'embedding')) AS semantic, bool_or(f AND group_id IS NULL AND contains(source, 'embedding') AND coalesce(embedding_score, 0) >= 0.7 AND anchor >= 4) AS strong, max(embedding_score) FILTER (source <> 'expanded' AND embedding_score > 0) AS nearest FROM {name}_f GROUP BY query_id),
{name}_c AS (SELECT g.*, CASE WHEN len(ts) = 0 THEN 0.0 ELSE CAST(len(list_filter(ts, lambda x: contains(g.text, x))) AS DOUBLE) / len(ts) END AS coverage, CASE WHEN len(cs) = 0 THEN 1.0 ELSE CAST(len(list_filter(cs, lambda x: contains(g.text, x))) AS DOUBLE) / len(cs) END AS content FROM {name}_g g JOIN terms0 USING (query_id)),
{name}_v AS (SELECT *, least(1.0, coverage * 0.45 + CAST(full_n AS DOUBLE) / greatest(n, 1) * 0.25 + least(top / 0.035, 1.0) * 0.2 + least(files / CAST(2 AS DOUBLE), 1.0) * 0.1) AS conf FROM {name}_c),
{name} AS (SELECT query_id, round(conf, 3) AS confidence, CASE WHEN (n >= 2 OR (n = 1 AND strong)) AND conf >= 0.55 AND semantic THEN CASE WHEN coalesce(nearest < 0.7, false) AND 1 - content >= 0.5 THEN 'partial' ELSE 'sufficient' END WHEN conf >= 0.28 THEN 'partial' ELSE 'insufficient' END AS status FROM {name}_v)"""


@query(
    ANCHORED
    + ", made AS (SELECT * REPLACE (CASE WHEN rank0 % 3 = 0 THEN 'expanded' ELSE source END AS source), CASE WHEN rank0 % 3 = 0 THEN substr(sha256(path || ':' || (rank0 // 6)), 1, 16) END AS group_id FROM anchored), "
    + TERM_SETS
    + _graded("whole", "SELECT * FROM made")
    + _graded("direct", "SELECT * FROM made WHERE source <> 'expanded'")
    + """, held AS (SELECT w.query_id, w.confidence, CASE WHEN w.status = 'sufficient' AND coalesce(d.status, '') <> 'sufficient' AND w.query_id IN (SELECT query_id FROM made WHERE source = 'expanded') THEN 'partial' ELSE w.status END AS status FROM whole w LEFT JOIN direct d USING (query_id))
SELECT query_id, confidence, CASE WHEN query_id % 5 = 0 AND status = 'sufficient' THEN 'partial' WHEN query_id % 5 <> 0 AND query_id % 4 = 0 AND confidence >= 0.55 THEN 'sufficient' ELSE status END AS status FROM held"""
)
def evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of questions whose every third row is an expanded one; conflicts and whole structures by question number."""
    rows = _grouped(spark, sf_dir).withColumn("source", F.when(F.col("rank0") % 3 == 0, "expanded").otherwise(F.col("source")))
    k = F.col("query_id")
    return evidence.evidence_status(rows, base.questions(spark, sf_dir).select("query_id", (k % 5 == 0).alias("conflict"), (k % 4 == 0).alias("complete")))
