"""A query over the scopes of answers' sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scopes
from ..registry import query, table

#: Documents as claims: fifty to an answer, five to a section, the first of a section its scope; statuses and faults by number. One text for both dialects.
CLAIM = {
    "answer_id": "k // 50",
    "section_id": "k // 5 % 10",
    "claim_no": "k % 5",
    "is_scope": "k % 5 = 0 AND k % 35 <> 0",
    "first": "CASE WHEN k % 5 = 0 AND k % 3 = 0 OR k % 41 = 7 THEN 'failed' ELSE 'passed' END",
    "second": "CASE WHEN k % 5 = 0 AND k % 3 = 0 OR k % 41 = 7 THEN NULL WHEN k % 5 = 0 AND k % 4 = 1 OR k % 23 = 4 THEN 'failed' WHEN k % 29 = 3 THEN 'uncertain' ELSE 'passed' END",
    "first_code": "CASE k % 8 WHEN 0 THEN 'quote_not_in_evidence' WHEN 1 THEN 'no_evidence' WHEN 2 THEN 'unknown_evidence_id' WHEN 3 THEN 'quote_not_in_source' WHEN 4 THEN 'source_instruction_adopted' ELSE 'quote_not_in_evidence' END",
    "second_code": "CASE k % 3 WHEN 0 THEN 'scope_overreach' WHEN 1 THEN 'not_in_source' ELSE 'number_changed' END",
}
SQL = ", ".join(f"{v} AS {n}" for n, v in CLAIM.items())


@query(
    f"""WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS k, doc_id FROM documents), c AS (SELECT doc_id, {SQL} FROM n),
s AS (SELECT * FROM c WHERE is_scope),
p AS (SELECT s.*, (SELECT count(*) FROM c WHERE c.answer_id = s.answer_id AND c.section_id = s.section_id AND NOT c.is_scope AND c.second IS NOT NULL) AS checked, NOT EXISTS (SELECT 1 FROM c WHERE c.answer_id = s.answer_id AND c.section_id = s.section_id AND NOT c.is_scope AND c.second <> 'passed') AS proven FROM s),
f AS (SELECT *, CASE WHEN checked > 0 AND proven AND first <> 'passed' AND first_code IN ('quote_not_in_evidence', 'quote_not_in_source', 'no_evidence') THEN 'inherited' WHEN first = 'passed' AND second = 'passed' THEN 'verified'
 WHEN checked > 0 AND proven AND first = 'passed' AND second = 'failed' AND second_code IN ('scope_overreach', 'not_in_source') THEN 'detached' ELSE 'failed' END AS fate FROM p)
SELECT c.doc_id, CASE WHEN c.is_scope THEN f.fate WHEN NOT coalesce(c.first = 'passed' AND c.second = 'passed', false) THEN 'failed' WHEN f.fate = 'failed' THEN 'dropped' ELSE 'verified' END AS state,
 CASE WHEN c.is_scope AND f.fate = 'inherited' THEN (SELECT string_agg('E' || o.doc_id, ',' ORDER BY o.claim_no) FROM c o WHERE o.answer_id = c.answer_id AND o.section_id = c.section_id AND NOT o.is_scope AND o.second IS NOT NULL) ELSE 'E' || c.doc_id END AS refs
FROM c LEFT JOIN f ON f.answer_id = c.answer_id AND f.section_id = c.section_id"""
)
def scope_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with what becomes of them and of their sections' scopes."""
    from .base import number_rows

    rows = number_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").withColumnRenamed("row_no", "k")
    made = rows.select("doc_id", *(F.expr(v.replace("//", "div")).alias(n) for n, v in CLAIM.items()))
    codes = lambda status, code: F.when(F.col(status) == "failed", F.array(code)).otherwise(F.array().cast("array<string>"))
    ref = F.array(F.struct(F.concat(F.lit("E"), F.col("doc_id").cast("string")).alias("evidence_id"), F.lit("q").alias("quote")))
    claims = made.select("answer_id", "section_id", "claim_no", F.col("doc_id").alias("claim_id"), "is_scope", "first", codes("first", "first_code").alias("first_codes"), "second", codes("second", "second_code").alias("second_codes"), ref.alias("refs"))
    out = scopes.propagate(claims)
    return out.select(F.col("claim_id").alias("doc_id"), "state", F.array_join(F.transform("refs", lambda r: r["evidence_id"]), ",").alias("refs"))
