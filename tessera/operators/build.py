"""Building an embedding index that can be stopped at any time: batches that resume, a candidate that is checked whole, a pointer swapped last.

An index folder holds versions (tables of entries and files), the batches of a build under way, and three small files: `current` names the
version in use, `status` tells how the last build stands, `lock` keeps a second writer out. Files are put in place by renames, so a
reader sees the old version or the new one. Everything goes through Spark's readers and Hadoop's file system: any store will do.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import diff_manifests, snapshot_signature

VERSION = 1


class BuildError(RuntimeError):
    """A build that ended without a new version; `code` says why. Its batches stay and serve the next build of the same chunks."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Store:
    """Small files of a folder, in whatever file system its address names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.root = spark._jvm, spark.sparkContext._gateway, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def _write(self, name: str, text: str, replace: bool) -> None:
        out = self.fs.create(self.path(name), replace)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file that must not be there yet; whether it wasn't."""
        try:
            self._write(name, text, False)
        except Exception as e:
            if self.exists(name):
                return False
            raise e
        return True

    def replace(self, name: str, text: str) -> None:
        """Writes a file under another name and renames it over the old one."""
        fresh = f".{name}-{uuid.uuid4().hex}"
        self._write(fresh, text, False)
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.files.rename(self.path(fresh), self.path(name), options)

    def read(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass
class Model:
    """An embedding model: its name, what tells its weights apart, and the call, which may raise `retryable` errors."""

    name: str
    digest: str
    call: Callable[[list[str]], list[list[float] | None]]
    retryable: tuple[type[Exception], ...] = (TimeoutError, ConnectionError)


def embed_or_null(chunks: DataFrame, model: Model, batch: int = 16) -> DataFrame:
    """chunks with embedding; null where the model gave none. A call that fails in a way worth repeating is repeated once in halves, and its texts
    are null if that fails too; answers of another length than their call are null."""
    call, retryable = model.call, model.retryable

    def once(texts: list[str]) -> list[list[float] | None]:
        got = call(texts)
        return got if len(got) == len(texts) else [None] * len(texts)

    def ask(texts: list[str]) -> list[list[float] | None]:
        try:
            return once(texts)
        except retryable:
            out, half = [], max(1, len(texts) // 2)
            for part in filter(None, (texts[:half], texts[half:])):
                try:
                    out += once(part)
                except retryable:
                    out += [None] * len(part)
            return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
            got = [v for at in range(0, len(texts), batch) for v in ask(texts[at : at + batch])]
            good = [v if v and all(isinstance(x, (int, float)) and math.isfinite(x) for x in v) else None for v in got]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(good, pa.list_(pa.float32()))], names=[*rows.schema.names, "embedding"])

    kinds = ", ".join(f"{n} {t}" for n, t in chunks.dtypes)
    return chunks.mapInArrow(run, f"{kinds}, embedding array<float>")


CHUNK = ["path", "chunk_id", "file_sha256", "text_sha256"]


def generation_of(chunks: DataFrame, model: Model) -> str:
    """What chunks and model a build is of, in one hash."""
    signature = snapshot_signature(chunks, *CHUNK).first()["signature"]
    return chunks.sparkSession.range(1).select(F.sha2(F.lit(f"{model.name}|{model.digest}|{signature}"), 256)).first()[0]


def manifest_of(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("path").agg(F.max("file_sha256").alias("file_sha256"), F.count("*").alias("chunks"))


def _finite(vector: str, dimension: int | None):
    size = F.size(vector) == dimension if dimension is not None else F.size(vector) > 0
    return F.coalesce(size & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


class Index:
    """The index kept in a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store, self.root = spark, Store(spark, root), root.rstrip("/")

    # ---- reading

    def current(self) -> dict | None:
        """The header of the version in use: folder, model, digest, generation, dimension, total."""
        return self.store.read("current")

    def entries(self, header: dict | None = None) -> DataFrame | None:
        header = header or self.current()
        return self.spark.read.parquet(f"{self.root}/{header['folder']}/entries") if header else None

    def files(self, header: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{header['folder']}/files")

    def _fits(self, header: dict | None, model: Model) -> bool:
        return header is not None and (header["version"], header["model"], header["digest"]) == (VERSION, model.name, model.digest)

    def differences(self, entries: DataFrame, chunks: DataFrame, dimension: int | None) -> dict[str, int]:
        """How entries fall short of chunks: missing, unknown and doubled ids, other texts, and vectors that aren't whole."""
        own = entries.select("chunk_id", F.col("text_sha256").alias("t"), _finite("embedding", dimension).alias("good")).groupBy("chunk_id").agg(F.count("*").alias("times"), F.max("t").alias("t"), F.bool_and("good").alias("good"))
        met = chunks.select("chunk_id", "text_sha256").join(own, "chunk_id", "full_outer")
        count = lambda test, name: F.count_if(F.coalesce(test, F.lit(False))).alias(name)
        row = met.agg(count(F.col("times").isNull(), "missing"), count(F.col("text_sha256").isNull(), "unknown"), count(F.col("times") > 1, "doubled"), count(F.col("t") != F.col("text_sha256"), "other_text"), count(~F.col("good"), "broken"))
        return row.first().asDict()

    def status(self, chunks: DataFrame, model: Model, validate: bool = True) -> dict:
        """ready, a state of the build under way or stopped over the same chunks, stale (there is another version), or missing."""
        generation, total, header = generation_of(chunks, model), chunks.count(), self.current()
        base = {"generation": generation, "total": total, "model": model.name}
        if self._fits(header, model) and header["generation"] == generation and header["total"] == total:
            changed = diff_manifests(self.files(header), manifest_of(chunks)).where("change <> 'unchanged'").limit(1).count()
            if not changed and (not validate or not any(self.differences(self.entries(header), chunks, header["dimension"]).values())):
                return {**base, "state": "ready", "processed": total, "failed": 0}
        last = self.store.read("status")
        if last and last.get("generation") == generation and last.get("state") in ("building", "cancelling", "paused", "cancelled", "failed"):
            return {**last, **base}
        return {**base, "state": "stale" if header else "missing", "processed": 0, "failed": 0}

    # ---- building

    def reusable(self, chunks: DataFrame, model: Model) -> DataFrame | None:
        """Entries of the version in use that may be kept: of files that are as they were, with the same chunks, all of them whole."""
        header = self.current()
        if not self._fits(header, model):
            return None
        old = self.entries(header).withColumn("good", _finite("embedding", header["dimension"]))
        met = chunks.select("path", "chunk_id", "text_sha256").join(old.select(F.col("path").alias("p"), "chunk_id", F.col("text_sha256").alias("t"), "good"), "chunk_id", "full_outer")
        whole = met.groupBy(F.coalesce("path", "p").alias("path")).agg(F.bool_and(F.coalesce((F.col("t") == F.col("text_sha256")) & F.col("good"), F.lit(False))).alias("whole")).where("whole").select("path")
        same = diff_manifests(self.files(header), manifest_of(chunks)).where("change = 'unchanged'").select("path")
        return old.join(whole, "path", "left_semi").join(same, "path", "left_semi").drop("good")

    def _batches(self, generation: str) -> list[str]:
        folder = f"building/{generation}"
        return [f"{self.root}/{folder}/{n}" for n in self.store.names(folder) if n.startswith("batch=") and self.store.exists(f"{folder}/{n}/_SUCCESS")]

    def build(
        self,
        chunks: DataFrame,
        model: Model,
        mode: str = "incremental",
        batch_chunks: int = 100_000,
        now: Callable[[], DataFrame] | None = None,
        cancelled: Callable[[], bool] = lambda: False,
        progress: Callable[[dict], None] = lambda event: None,
        lock_seconds: float = 6 * 3600,
    ) -> dict:
        """Brings the index up to `chunks` (path, chunk_id, file_sha256, text_sha256, text) and returns the header of the version in use then.

        mode: incremental (entries of unchanged files are kept) or full. now: the chunks as they are when the new version is about to be taken into
        use; if they differ from `chunks`, it isn't. Batches that were finished serve later builds of the same chunks, model and mode.
        """
        if mode not in ("incremental", "full"):
            raise ValueError(f"unknown mode {mode!r}")
        mine = json.dumps({"since": time.time(), "owner": uuid.uuid4().hex})
        if not self.store.create("lock", mine):
            held = self.store.read("lock")
            if held and time.time() - held["since"] > lock_seconds:  # its writer is gone
                self.store.replace("lock", mine)
            elif self.status(chunks, model)["state"] == "ready":
                return self.current()
            else:
                raise BuildError("BUSY", "the index is being built")
        folder = f"chunks-{uuid.uuid4().hex}"  # what the chunks are made of is read once; they are counted, hashed, dealt and compared from here
        try:
            chunks.select(*CHUNK, "text").write.parquet(f"{self.root}/{folder}/all")
            own = self.spark.read.schema(chunks.select(*CHUNK, "text").schema).parquet(f"{self.root}/{folder}/all")
            return self._build(own, model, mode, batch_chunks, now, cancelled, progress, folder)
        finally:
            self.store.remove(folder)
            held = self.store.read("lock")
            if held == json.loads(mine):
                self.store.remove("lock")

    def _build(self, chunks, model, mode, batch_chunks, now, cancelled, progress, scratch) -> dict:
        generation, total = generation_of(chunks, model), chunks.count()
        state = {"state": "building", "generation": generation, "model": model.name, "total": total, "processed": 0, "reused": 0, "generated": 0, "failed": 0, "checkpointed": 0}

        def tell(**more) -> None:
            state.update(more)
            self.store.replace("status", json.dumps(state))
            progress(dict(state))

        kept = self.reusable(chunks, model) if mode == "incremental" else None
        if kept is not None:
            kept.write.parquet(f"{self.root}/{scratch}/kept")
            kept = self.spark.read.schema(kept.schema).parquet(f"{self.root}/{scratch}/kept")
        folder = f"building/{generation}"
        terms = {"mode": mode, "version": VERSION, "based_on": (self.current() or {}).get("folder") if mode == "incremental" else None}
        plan = self.store.read(f"{folder}/plan") or {}
        if {k: plan.get(k) for k in terms} != terms:  # batches of another kind of build, or over another version, are of no use
            self.store.remove(folder)
            plan = {}
        pending = chunks if kept is None else chunks.join(kept.select("chunk_id"), "chunk_id", "left_anti")
        if not plan:
            plan = {**terms, "batches": max(1, -(-pending.count() // batch_chunks))}
            self.store.create(f"{folder}/plan", json.dumps(plan))
        reused = 0 if kept is None else kept.count()
        done = {int(p.rsplit("=", 1)[1]) for p in self._batches(generation)}
        tell(reused=reused, checkpointed=len(done), processed=reused)
        hashed, times = F.xxhash64("chunk_id"), plan["batches"]
        dealt = pending.select(*CHUNK, "text", F.pmod(hashed, F.lit(times)).alias("batch"))
        if times > 1:  # a folder a batch, so that each batch reads its own chunks; some files in each, for as many tasks
            dealt.repartition(F.pmod(hashed, F.lit(16 * times))).write.partitionBy("batch").parquet(f"{self.root}/{scratch}/dealt")
            dealt = self.spark.read.schema(dealt.schema).parquet(f"{self.root}/{scratch}/dealt")
        try:
            for n in range(plan["batches"]):
                if n in done:
                    continue
                if cancelled():
                    raise BuildError("CANCELLED", "the build was stopped")
                made = embed_or_null(dealt.where(F.col("batch") == n).select(*CHUNK, "text"), model).drop("text")
                made.write.mode("overwrite").parquet(f"{self.root}/{folder}/batch={n}")
                tell(checkpointed=state["checkpointed"] + 1)
            fresh = self.spark.read.parquet(*self._batches(generation)).select(*CHUNK, "embedding")
            sizes = fresh.agg(F.count_if(F.col("embedding").isNull()).alias("failed"), F.count("*").alias("n")).first()
            tell(failed=sizes["failed"], generated=sizes["n"] - sizes["failed"], processed=reused + sizes["n"])
            if sizes["failed"]:
                # Batches with gaps are made again by the next build; whole ones stay.
                gaps = fresh.where("embedding is null").select(F.pmod(F.xxhash64("chunk_id"), F.lit(plan["batches"])).alias("b")).distinct()
                for row in gaps.collect():  # one row a batch at most
                    self.store.remove(f"{folder}/batch={row['b']}")
                raise BuildError("EMBEDDING_FAILED", f"{sizes['failed']} chunks have no vector")
            header = self._candidate(chunks, fresh if kept is None else kept.select(*CHUNK, "embedding").unionByName(fresh), model, generation, total)
            try:
                if now is not None and generation_of(now(), model) != generation:
                    raise BuildError("SOURCE_CHANGED", "the chunks changed during the build")
                if cancelled():
                    raise BuildError("CANCELLED", "the build was stopped")
            except BaseException:
                self.store.remove(header["folder"])
                raise
            before = self.current()
            self.store.replace("current", json.dumps(header))
        except BaseException as e:
            code = getattr(e, "code", None)
            tell(state="cancelled" if code == "CANCELLED" else "failed", error=code or type(e).__name__)
            raise
        self.store.remove(folder)
        for name in self.store.names("versions"):  # the version before stays for readers that have it open
            if f"versions/{name}" not in (header["folder"], (before or {}).get("folder")):
                self.store.remove(f"versions/{name}")
        tell(state="ready", processed=total, checkpointed=0)
        return header

    def _candidate(self, chunks: DataFrame, entries: DataFrame, model: Model, generation: str, total: int) -> dict:
        """Writes a version, reads it back, and holds it against the chunks as a whole."""
        folder = f"versions/{generation[:16]}-{uuid.uuid4().hex}"
        try:
            entries.write.parquet(f"{self.root}/{folder}/entries")
            manifest_of(chunks).write.parquet(f"{self.root}/{folder}/files")
            written = self.spark.read.parquet(f"{self.root}/{folder}/entries")
            sizes = written.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
            if sizes[0] != sizes[1]:
                raise BuildError("INVALID", f"vectors have {sizes[0]} to {sizes[1]} components")
            short = {k: v for k, v in self.differences(written, chunks, sizes[0]).items() if v}
            if short or self.spark.read.parquet(f"{self.root}/{folder}/files").agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0] != total:
                raise BuildError("INVALID", f"the new version isn't whole: {short}")
        except BaseException:
            self.store.remove(folder)
            raise
        return {"version": VERSION, "model": model.name, "digest": model.digest, "generation": generation, "folder": folder, "dimension": sizes[0], "total": total}
