"""Scopes of an answer's sections: what a section's claims prove for the statement of its scope, and what a scope that isn't proven takes with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Faults of a scope's quote that its claims make good, and faults for which only its line goes.
INHERITABLE = ["quote_not_in_evidence", "quote_not_in_source", "no_evidence"]
DETACHABLE = ["scope_overreach", "not_in_source"]
REFS = "array<struct<evidence_id:string,quote:string>>"


def _only(codes: Column, allowed: list[str]) -> Column:
    return F.size(F.array_except(F.coalesce(codes, F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))) == 0


def propagate(claims: DataFrame) -> DataFrame:
    """claims with refs as they are then, and state: verified, inherited, detached, dropped (its scope isn't verified) or failed.

    claims: answer_id, section_id, claim_no, claim_id, is_scope, first, first_codes (check of quotes), second, second_codes (check of meaning; null
    where it wasn't reached), refs. A scope whose quotes alone failed counts as proven if all claims of its section that were checked for
    meaning passed, and takes their references. A scope that says more than they do is taken away by itself if they all passed. The claims of
    a section whose scope is neither verified nor taken away go with it. One aggregate a section decides; no claim is met with another.
    """
    key = ["answer_id", "section_id"]
    own = lambda c: F.when(~F.col("is_scope"), c)
    checked = own(F.col("second"))
    ordered = F.array_sort(F.collect_list(F.when(~F.col("is_scope") & F.col("second").isNotNull(), F.struct("claim_no", F.coalesce("refs", F.array().cast(REFS)).alias("refs")))))
    sections = claims.groupBy(key).agg(
        F.count(checked).alias("checked"),
        F.coalesce(F.bool_and(checked == "passed"), F.lit(False)).alias("proven"),
        F.max(F.when(F.col("is_scope"), F.struct("first", "first_codes", "second", "second_codes"))).alias("scope"),
        F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["refs"]))).alias("proofs"),
    )
    held = (F.col("checked") > 0) & F.col("proven")
    inherits = held & (F.col("scope.first") != "passed") & (F.size("scope.first_codes") > 0) & _only(F.col("scope.first_codes"), INHERITABLE)
    passes = (F.col("scope.first") == "passed") & (F.col("scope.second") == "passed")
    detaches = held & (F.col("scope.first") == "passed") & (F.col("scope.second") == "failed") & _only(F.col("scope.second_codes"), DETACHABLE)
    fate = F.when(F.col("scope").isNull(), "none").when(F.coalesce(inherits, F.lit(False)), "inherited").when(F.coalesce(passes, F.lit(False)), "verified").when(F.coalesce(detaches, F.lit(False)), "detached").otherwise("failed")
    met = claims.join(sections.select(*key, fate.alias("fate"), "proofs"), key)
    good = F.coalesce((F.col("first") == "passed") & (F.col("second") == "passed"), F.lit(False))
    state = F.when(F.col("is_scope"), F.col("fate")).when(~good, "failed").when(F.col("fate") == "failed", "dropped").otherwise("verified")
    refs = F.when(F.col("is_scope") & (F.col("fate") == "inherited"), F.col("proofs")).otherwise(F.col("refs"))
    return met.select(*(refs.alias("refs") if c == "refs" else c for c in claims.columns), state.alias("state"))
