"""Secret scans in DataFrame operations only: fixed patterns, and Markov models of random strings and of identifiers.

Patterns give the base spans. Further spans are long tokens that a character Markov model of random strings explains
better than one of ordinary identifiers: the sum of log-likelihood ratios over adjacent characters must reach
`min_llr`. Tokens without small letters are read in small letters; numbers are no candidates. Both models are trained on labelled samples (token, label): adjacent character pairs are counted by
aggregation and smoothed, so without secrets to learn from the first is the uniform model.

Positions come from the pieces between matches (split) and the matches themselves, in code points. Null texts count as
empty, which have no spans. Repeated rows repeat their results, an empty table stays empty, other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and the least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ["assign", "access", "hex", "markov"]
#: Candidates of the models, never starting inside a longer run.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}+"
LOW, WIDE = 43, 80  # character codes from "+" to "z" as numbers from 0


def match_places(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches whose group has at least `least` characters."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    steps = F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size")))
    steps = F.filter(steps, lambda s: s["size"].isNotNull())
    # A running sum over the matches, kept as one string: appending to an array would copy it at each step.
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct((acc["at"] + s["gap"] + s["size"]).alias("at"), F.concat(acc["out"], (acc["at"] + s["gap"]).cast("string"), F.lit(",")).alias("out")),
        lambda acc: acc["out"],
    )
    starts = F.filter(F.split(walked, ","), lambda x: x != "")
    placed = F.zip_with(F.zip_with(starts, found, lambda s, m: F.struct(s.cast("int").alias("s"), F.length(m).alias("n"))), value, lambda x, v: F.struct(x["s"].alias("start"), (x["s"] + x["n"]).alias("end"), v.alias("value")))
    placed = F.filter(placed, lambda x: F.length(x["value"]) >= least) if least else placed
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def pair_counts(samples: DataFrame) -> DataFrame:
    """(label, pair, n): adjacent characters of the distinct labelled tokens; at most 2 x 80 x 80 rows."""
    apart = samples.select("label", "token").distinct()
    pairs = apart.where(F.length("token") > 1).select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))).alias("two"))
    code = (F.ascii("two") - LOW) * WIDE + F.ascii(F.substring("two", 2, 1)) - LOW
    inside = F.ascii("two").between(LOW, LOW + WIDE - 1) & F.ascii(F.substring("two", 2, 1)).between(LOW, LOW + WIDE - 1)
    return pairs.where(inside).groupBy("label", code.alias("pair")).count()


def train(samples: DataFrame, pull: float = 20.0) -> list[float]:
    """Log-likelihood ratios, random over ordinary, of all 80 x 80 pairs; samples: token string, label 1 (random) or 0.

    A pair's probability is its share among pairs of the same first character, pulled with the weight of `pull` pairs
    towards the share of its second character, itself smoothed by half a count over the 67 characters that tokens have. Half of the
    random model is uniform, as secrets of other alphabets than those learned from are random too.
    """
    import math

    letters = [c - LOW for c in range(LOW, LOW + WIDE) if chr(c).isalnum() or chr(c) in "+/_=-."]
    seen = {(r["label"], r["pair"]): r["count"] for r in pair_counts(samples).collect()}
    out = [0.0] * (WIDE * WIDE)
    alone = []
    for y in (0, 1):
        n = [0.5 + sum(seen.get((y, a * WIDE + b), 0) for a in letters) for b in letters]
        alone.append({b: k / sum(n) for b, k in zip(letters, n)})
    for a in letters:
        total = [sum(seen.get((y, a * WIDE + b), 0) for b in letters) + pull for y in (0, 1)]
        for b in letters:
            p = [(seen.get((y, a * WIDE + b), 0) + pull * alone[y][b]) / total[y] for y in (0, 1)]
            out[a * WIDE + b] = round(math.log((0.5 * p[1] + 0.5 / len(letters)) / p[0]), 4)
    return out


def labelled_tokens(docs: DataFrame, text_col: str = "text", often: int = 3) -> DataFrame:
    """(token, label), distinct, of all documents: values of base spans are random, other tokens of six characters or more ordinary.

    Ordinary tokens must occur `often` times: secrets that no pattern marks would teach the wrong model.
    """
    own = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    values = F.concat(match_places(F.col("t"), ASSIGN, 2, ASSIGN_LEAST), match_places(F.col("t"), ACCESS), match_places(F.col("t"), HEX))
    found = own.select("t", F.transform(values, lambda v: v["value"]).alias("v"))
    plain = F.array_except(F.array_distinct(F.regexp_extract_all("t", F.lit(r"[A-Za-z0-9+/_=-]{6,}"), F.lit(0))), F.col("v"))
    rows = found.select(F.array(F.struct(F.col("v").alias("w"), F.lit(1).alias("label")), F.struct(plain.alias("w"), F.lit(0).alias("label"))).alias("both")).select(F.explode("both").alias("b"))
    counted = rows.select(F.explode("b.w").alias("token"), F.col("b.label").alias("label")).groupBy("token", "label").count()
    return counted.where((F.col("label") == 1) | (F.col("count") >= often)).select("token", "label")


def ratio(token: Column, table: list[float]) -> Column:
    """The token's log-likelihood ratio, 0 for fewer than two characters."""
    ratios = F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<double>")
    code = lambda i: (F.ascii(F.substring(token, i, F.lit(1))) - LOW) * WIDE + F.ascii(F.substring(token, i + 1, F.lit(1))) - LOW
    return F.aggregate(F.filter(F.sequence(F.lit(0), F.length(token) - 1), lambda i: i > 0), F.lit(0.0), lambda acc, i: acc + F.coalesce(F.get(ratios, code(i)), F.lit(0.0)))


def scan(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text", min_llr: float = 16.0) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_markov, base_sha256, spans)."""
    own = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    text = F.col("__t")
    own = own.select(id_col, match_places(text, ASSIGN, 2, ASSIGN_LEAST).alias("assign"), match_places(text, ACCESS).alias("access"), match_places(text, HEX).alias("hex"), match_places(text, TOKEN).alias("tokens"))
    named = lambda kind: F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end")))
    own = own.withColumn("base", F.concat(*map(named, KINDS[:3])))
    spoken = lambda v: F.when(v.rlike("[a-z]"), v).otherwise(F.lower(v))  # noqa: E731  capitals are read as small letters, which the models know better
    likely = F.filter(F.col("tokens"), lambda s: s["value"].rlike("[A-Za-z]") & (ratio(spoken(s["value"]), table) >= min_llr) & ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    own = own.withColumn("markov", F.when(F.size("tokens") > 0, likely).otherwise(F.col("tokens")))
    name = F.array(*map(F.lit, KINDS))
    listed = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(name, s["k"]), s["start"], s["end"])), ",")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return own.select(id_col, *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", named("markov"))).alias("spans"))
