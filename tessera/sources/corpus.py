"""Line-oriented corpora: files, lines, path policy, sidecar metadata, evidence views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File kinds that are read, folders that are not entered, names that hold secrets or metadata.
SUFFIXES = ["md", "txt", "csv", "json", "yaml", "yml", "html", "htm"]
SKIPPED_FOLDERS = ["__pycache__", "node_modules"]
SECRET_NAMES = [r"\.env", r"\.env\..*", r"secrets\..*", r".*\.secret\..*", r".*\.pem", r".*\.key", r".*\.pfx", r".*\.p12", r".*\.metadata\.json"]
LAYOUTS = ["title", "text", "table", "figure", "caption", "header", "footer", "reference", "equation", "unknown"]
#: Line ends of Python's str.splitlines, which both regular-expression dialects understand.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, modified): allowed files below a folder. The policy prunes on path before any content is decoded."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace("path", "^.*?" + root.rstrip("/").split("/")[-1] + "/", "")
    return raw.select(below.alias("path"), "content", F.col("modificationTime").alias("modified")).where(allowed(F.col("path")))


def decode(content: Column) -> Column:
    """UTF-8 text, malformed parts replaced by U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def normalize_path(path: Column) -> Column:
    """Forward slashes; no empty, `.` or `..` parts."""
    return F.array_join(F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: ~p.isin("", ".", "..")), "/")


def allowed(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    kept = F.forall(folders, lambda p: ~p.startswith(".") & ~F.lower(p).isin(SKIPPED_FOLDERS))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return kept & (stem != "") & name.rlike(r"\.(" + "|".join(SUFFIXES) + ")$") & ~name.rlike("^(" + "|".join(SECRET_NAMES) + ")$")


def files(docs: DataFrame) -> DataFrame:
    """(doc_id, path, lang, source, text): documents as source files."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.format_string("%06d", "doc_id"), F.lit(".md"))
    return docs.select("doc_id", path.alias("path"), "lang", "source", "text")


def split_lines(text: Column) -> Column:
    """Lines as str.splitlines gives them: no empty piece after a final line end."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(source: DataFrame) -> DataFrame:
    """(doc_id, path, line_no, line), 1-based."""
    return source.select("doc_id", "path", F.posexplode(split_lines(F.col("text"))).alias("line_no", "line")).withColumn("line_no", (F.col("line_no") + 1).cast("long"))


def with_headings(rows: DataFrame) -> DataFrame:
    """Marks every first, fourth and seventh line as a heading: documents have none of their own."""
    n = F.col("line_no")
    mark = F.when(n == 1, "# ").when(n % 7 == 0, "### ").when(n % 4 == 0, "## ").otherwise("")
    return rows.withColumn("line", F.concat(mark, "line"))


def manifest(chunks: DataFrame) -> DataFrame:
    """(path, file_sha256, chunk_count, chunk_ids): what an index stores of each file."""
    return chunks.groupBy("path").agg(F.min("file_sha256").alias("file_sha256"), F.count("*").alias("chunk_count"), F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))


def line_blocks(rows: DataFrame) -> DataFrame:
    """(path, block_id, layout_type, start_line, end_line): blocks begin at lines with a leading `#`.

    A block of one line that begins so is a title. Blank blocks are left out and take no number.
    """
    begins = F.col("line").startswith("#")
    upto = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("block", F.sum(F.when(begins | (F.col("line_no") == 1), 1).otherwise(0)).over(upto))
    out = numbered.groupBy("path", "block").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.min_by("line", "line_no").startswith("#").alias("titled"), F.bool_or(F.trim("line") != "").alias("filled")).where("filled")
    out = out.withColumn("block", F.row_number().over(Window.partitionBy("path").orderBy("start_line"))).withColumn("titled", F.col("titled") & (F.col("start_line") == F.col("end_line")))
    name = F.element_at(F.split("path", "/"), -1)
    return out.select("path", F.concat(name, F.lit("#b"), F.format_string("%04d", "block")).alias("block_id"), F.when(F.col("titled"), "title").otherwise("text").alias("layout_type"), "start_line", "end_line")


def valid_metadata(content: Column) -> Column:
    """Whether a sidecar's JSON is an object of version 1 with a source path, pages as a list of objects with lists of blocks, warnings as a
    list of strings if there, and line numbers that are whole numbers or null."""
    whole = F.try_parse_json(content)
    at = lambda p, kind: F.try_variant_get(whole, p, kind)
    kind = lambda p: F.coalesce(F.schema_of_variant(at(p, "variant")), F.lit("NONE"))
    path = kind("$.sourcePath")
    named = ~path.isin("NONE", "VOID", "OBJECT<>") & ~F.coalesce(at("$.sourcePath", "string"), F.lit("x")).isin("", "false", "0", "[]")
    warned = kind("$.warnings").isin("NONE", "ARRAY<STRING>") | (at("$.warnings", "string") == "[]")
    none_null = F.forall(F.coalesce(at("$.warnings", "array<string>"), F.array().cast("array<string>")), lambda w: w.isNotNull())
    object_ = lambda v: v.isNull() | F.schema_of_variant(v).startswith("OBJECT<")
    number = lambda v: v.isNull() | F.schema_of_variant(v).isin("BIGINT", "VOID")
    line = lambda b, p: number(F.try_variant_get(b, p, "variant"))
    blocks = lambda p: F.try_variant_get(p, "$.blocks", "variant")
    listed = lambda p: F.try_variant_get(p, "$.blocks", "array<variant>")
    good_block = lambda b: b.isNotNull() & object_(b) & line(b, "$.lineStart") & line(b, "$.lineEnd")
    good_page = lambda p: p.isNotNull() & object_(p) & (blocks(p).isNull() | (listed(p).isNotNull() & F.forall(listed(p), good_block)))
    pages = at("$.pages", "array<variant>")
    version = (at("$.schemaVersion", "double") == 1) & kind("$.schemaVersion").isin("BIGINT", "DOUBLE", "BOOLEAN", "DECIMAL(1,0)", "DECIMAL(2,1)")
    return F.coalesce(whole.isNotNull() & version & named & warned & none_null & pages.isNotNull() & F.forall(pages, good_page), F.lit(False))


def load_sidecars(source: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(path, content): each file with its metadata, null without. Of the two names a sidecar may have the first that exists decides.

    source: path, text; sidecars: path (of the sidecar), content. Metadata that isn't valid or is of another text (contentSha256) is left out.
    """
    own = sidecars.select(F.col("path").alias("_at"), F.col("content"))
    names = F.array(F.concat("path", F.lit(".metadata.json")), F.concat(F.regexp_replace("path", r"(?<=[^/])\.[^./]*$", ""), F.lit(".metadata.json")))
    asked = source.select("path", F.sha2("text", 256).alias("_sha"), F.posexplode(names).alias("_k", "_at"))
    found = asked.join(own, "_at").groupBy("path").agg(F.min_by(F.struct("_sha", "content"), "_k").alias("f"))
    stated = F.coalesce(F.get_json_object("f.content", "$.contentSha256"), F.lit(""))
    good = found.where(valid_metadata(F.col("f.content")) & ((stated == "") | (stated == F.col("f._sha"))))
    return source.select("path").join(good.select("path", "f.content"), "path", "left")


def metadata_for_ranges(ranges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each range with the block of its file that shares most lines; the first of equals; null without overlap."""
    shared = F.least("r.end_line", "b.end_line") - F.greatest("r.start_line", "b.start_line") + 1
    hit = (F.col("r.path") == F.col("b.path")) & (F.col("r.start_line") <= F.col("b.end_line")) & (F.col("b.start_line") <= F.col("r.end_line"))
    met = ranges.alias("r").join(blocks.alias("b"), hit, "left").select("r.*", F.col("b.block_id"), F.col("b.layout_type"), shared.alias("shared"), F.col("b.start_line").alias("at"))
    best = F.max_by(F.struct("block_id", "layout_type"), F.struct("shared", -F.col("at")))
    return met.groupBy(ranges.columns).agg(best.alias("m"), F.max("shared").alias("shared")).select(*ranges.columns, "m.block_id", "m.layout_type", "shared")


def evidence_view(rows: DataFrame, refs: DataFrame, around: int = 10, most_lines: int = 200, most_bytes: int = 65536) -> DataFrame:
    """Lines from `around` before to `around` after each reference, highlighted inside it, within line and byte limits."""
    near = (F.col("l.path") == F.col("e.path")) & F.col("l.line_no").between(F.col("e.start_line") - around, F.col("e.end_line") + around)
    met = rows.alias("l").join(refs.alias("e"), near).select("e.ref_id", "l.path", "l.line_no", "l.line", F.col("l.line_no").between(F.col("e.start_line"), F.col("e.end_line")).alias("highlight"))
    upto = Window.partitionBy("ref_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    sized = met.withColumn("k", F.count("*").over(upto)).withColumn("bytes", F.sum(F.octet_length("line") + 1).over(upto))
    return sized.where((F.col("k") <= most_lines) & (F.col("bytes") <= most_bytes)).drop("k")
