"""Helpers shared by the training-data operators: reading, splits, materialising, Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, modulus: int = 5) -> Column:
    """crc32(doc_id as text) mod `modulus`; a null id falls in no fold (-1)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus), F.lit(-1).cast("long"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one is set only where none is named and all runs in one process."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Rows of some MB each: Parquet looks at its buffers after every row instead of every hundred, and at the end of each block of 16 MB they are written.
#: A block is what a reader takes into memory at once.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def materialize(df: DataFrame, name: str, compression: str | None = None, options: dict[str, int] | None = None) -> DataFrame:
    """Writes `df` as Parquet in the shared folder and rereads it: lineage ends there and lost executors cost one reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def fresh_names(taken: list[str], n: int) -> list[str]:
    """`n` column names that aren't among `taken` (column names don't tell capitals apart)."""
    lower = {c.lower() for c in taken}
    stem = "__own"
    while any(c.startswith(stem) for c in lower):
        stem += "_"
    return [f"{stem}{k}" for k in range(n)]


def _cuts(batch: pa.RecordBatch, rows: int, size: int) -> list[int]:
    """Where slices begin: of at most `rows` rows and of about `size` bytes, or of one row."""
    cuts, held = [0], 0
    for at in range(batch.num_rows):
        own = batch.slice(at, 1).nbytes
        if at > cuts[-1] and (at - cuts[-1] >= rows or held + own > size):
            cuts.append(at)
            held = 0
        held += own
    return cuts


def map_batches(df: DataFrame, schema: str, start: Callable[[], Callable[[list[list]], list[list]]], rows: int = 512, size: int = 8_000_000) -> DataFrame:
    """Runs start()(columns) over slices of at most `rows` rows and about `size` bytes, columns being Python lists.

    start is called once a task, so models are unpacked once. The lists returned become the columns of `schema`. If what start
    returns has a function close, it is called when the task is over. Workers live on, so a task's memory is then given back.
    """
    out = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        work = start()
        for batch in batches:
            per_row = batch.nbytes / max(batch.num_rows, 1)
            cuts = list(range(0, batch.num_rows, rows)) if per_row * rows <= size / 4 else _cuts(batch, rows, size)  # long texts: cut by their sizes
            for at, end in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                part = batch.slice(at, end - at)
                made = work([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, type=f.type) for v, f in zip(made, arrow, strict=True)], schema=arrow)

        getattr(work, "close", lambda: None)()
        del work
        give_back()

    return df.mapInArrow(run, out)


def keep_memory() -> None:
    """Lets this worker keep memory that is freed, so that arrays of some 100 kB aren't mapped anew at each use; give_back() ends a task that does so."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


def roomy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, between keep_memory() and give_back()."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        yield from run(batches)
        give_back()

    return task


def give_back() -> None:
    """Returns free memory of this worker to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, per_class: int, keep: Sequence[str] = ()) -> DataFrame:
    """At most `per_class` labelled training rows of each class, chosen by the hash of the id: (__id, __h, __text, __y) and the columns to keep.

    Rows of fold 0 (held out), rows without a label and labels other than 0 or 1 are left out.
    An id that several labels name takes the smallest of them. Rows that repeat an id with another text (or other kept columns) count each, rows equal
    in all of it once; the bound holds after that.
    """
    marks = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y")).where("__y in (0, 1)").groupBy("__id").agg(F.min("__y").alias("__y"))
    marks = marks.where(fold(F.col("__id")) != 0).withColumn("__h", F.xxhash64("__id"))
    first = lambda rows, *order: rows.where("__y = 0").orderBy(*order).limit(per_class).unionByName(rows.where("__y = 1").orderBy(*order).limit(per_class))
    own = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), *(F.col(f"`{c}`") for c in keep))
    own = own.withColumn("__th", F.xxhash64("__text", *(F.col(f"`{c}`") for c in keep)))
    ids = first(marks, "__h", "__id")
    chosen = first(own.select("__id", "__th").join(F.broadcast(ids), "__id").distinct(), "__h", "__id", "__th")
    found = own.join(F.broadcast(chosen), ["__id", "__th"]).dropDuplicates(["__id", "__th"])
    return found.select("__id", "__h", "__text", "__y", *(f"`{c}`" for c in keep))


def join_by_class(rows: DataFrame, classes: DataFrame, key: str, total: int, hot: int = 2000) -> DataFrame:
    """Inner join of rows with one row a class by `key`, where a class may hold any share of the rows.

    classes has a column n, its number of rows. Classes of over 1/hot of all rows number less than `hot`: they are broadcast. The others join by key.
    """
    large, small = classes.where(F.col("n") * hot > total).drop("n"), classes.where(F.col("n") * hot <= total).drop("n")
    return rows.join(F.broadcast(large), key).unionByName(rows.join(small, key))
