"""Line dedup by distinct-site spread.

Every line hash gets a HyperLogLog sketch of the sites it occurs on; sketches merge by aggregation. Lines whose estimate
is clearly above the threshold are cross-site boilerplate, those clearly below are not, and lines near the threshold get
exact distinct counts. Of a boilerplate line the first occurrence (least id, then position) stays, the others go.

Lines are compared as they are, by two independent 64-bit hashes; lines of blanks only never go. A null text has no lines
and stays null; a null site is a site of its own. Rows are told apart by id, site and text, so rows without an id and rows repeated under one id with
another text or site each lose their own lines; only rows equal in all three share what they lose (of ids in order missing ones
come first, then places by text). All columns of the input are kept, whatever their names; an empty table stays empty. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, materialize

LG_K = 12
#: Five standard errors of a sketch of 2^12 registers, and one site more for small counts.
SLACK, ONE_MORE = 5 * 1.04 / 2 ** (LG_K / 2), 1.0
#: A line that makes over one of this many of all lines is hot; there are fewer hot lines than this, so they can be broadcast.
HOT = 2000


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _row_key(text: Column, site: Column) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(text, F.coalesce(site.cast("string"), F.lit("\x00")))


def line_table(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, key, pos, h1, h2, site): a row for every line that isn't blank."""
    site = F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("\x00"))
    cut = docs.select(F.col(f"`{id_col}`").alias("id"), _row_key(F.col(f"`{text_col}`"), F.col(f"`{site_col}`")).alias("key"), site.alias("site"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n", -1)).alias("pos", "line"))
    return cut.where(F.trim("line") != "").select("id", "key", "pos", *_hashes(F.col("line")), F.xxhash64("site").alias("site"))


def line_spread(lines: DataFrame) -> DataFrame:
    """(h1, h2, n, est, first): occurrences, estimated sites, and the first place of every line (its key too, if lines have one)."""
    place = F.struct(*(c for c in ("id", "pos", "key") if c in lines.columns))
    seen = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(place).alias("first"))
    return seen.select("h1", "h2", "n", F.hll_sketch_estimate("sketch").alias("est"), "first")


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2, n, first) of lines on at least `min_sites` sites."""
    spread = materialize(line_spread(lines).where(F.col("est") >= min_sites * (1 - SLACK) - ONE_MORE), "spread")
    near = F.col("est") <= min_sites * (1 + SLACK) + ONE_MORE
    exact = lines.join(spread.where(near).select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").count().where(F.col("count") >= min_sites)
    sure = spread.where(~near).select("h1", "h2", "n", "first")
    return sure.unionByName(spread.where(near).join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "n", "first"))


def drop_spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 5) -> DataFrame:
    """`docs` with boilerplate lines taken out of the text, and two columns n_lines and n_dropped (replaced if there)."""
    lines = materialize(line_table(docs, id_col, text_col, site_col), "lines")
    found = materialize(boilerplate(lines, min_sites), "boilerplate")
    total = lines.count()
    hot = found.where(F.col("n") * HOT > total)
    rest = found.where(F.col("n") * HOT <= total)
    place = ["id", "key", "pos", "h1", "h2", "first"]
    met = lines.join(F.broadcast(hot), ["h1", "h2"]).select(place).unionByName(lines.join(rest, ["h1", "h2"]).select(place))
    # Own columns take names that the input doesn't have.
    own_id, own_key, gone_at, cut, at = fresh_names(docs.columns, 5)
    gone = met.where(~F.struct("id", "pos", "key").eqNullSafe(F.col("first"))).groupBy("id", "key").agg(F.collect_set(F.struct("pos", "h1", "h2")).alias(gone_at)).select(F.col("id").alias(own_id), F.col("key").alias(own_key), gone_at)
    base = docs.drop("n_lines", "n_dropped")
    # Places to drop are small beside texts: hashing them spares sorting the texts.
    same = (_row_key(base[f"`{text_col}`"], docs[f"`{site_col}`"]) == gone[own_key]) & base[f"`{id_col}`"].eqNullSafe(gone[own_id])
    joined = base.join(gone.hint("shuffle_hash"), same, "left")
    text = F.col(f"`{text_col}`")
    joined = joined.withColumn(cut, F.split(text, "\n", -1))
    held = lambda g: F.struct(g["pos"].alias("pos"), *_hashes(F.get(cut, g["pos"]))) == g  # noqa: E731  keys are hashes: the lines themselves decide
    joined = joined.withColumn(at, F.coalesce(F.transform(F.filter(F.array_sort(gone_at), held), lambda g: g["pos"]), F.array().cast("array<int>")))
    size, n = F.size(cut), F.size(at)
    # What stays are the runs of lines between dropped places, so a text costs in proportion to its lines.
    after = lambda k: F.when(k == 0, 0).otherwise(F.get(at, k - 1) + 1)
    runs = F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(cut, after(k) + 1, F.coalesce(F.get(at, k), size) - after(k)))
    kept = F.when(n == 0, text).otherwise(F.array_join(F.flatten(runs), "\n"))
    names = [F.col(f"`{c}`") if c != text_col else kept.alias(text_col) for c in base.columns]
    return joined.select(*names, F.when(text.isNull(), 0).otherwise(size).cast("long").alias("n_lines"), n.cast("long").alias("n_dropped"))


ORACLE = """
WITH cut AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), wide AS (
  SELECT line, min(struct_pack(doc_id := doc_id, pos := pos)) AS first FROM cut WHERE trim(line) <> ''
  GROUP BY line HAVING count(DISTINCT coalesce(source, chr(1))) >= 5
), marked AS (
  SELECT c.doc_id, c.line, c.pos, (w.line IS NOT NULL AND (c.doc_id <> w.first.doc_id OR c.pos <> w.first.pos)) AS gone
  FROM cut c LEFT JOIN wide w ON c.line = w.line
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
       length(coalesce(k.text, '')) AS kept_chars, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
