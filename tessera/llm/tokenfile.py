"""Token ids in files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Texts are encoded once; the ids of a vocabulary are counted over all of them and ranked, the most frequent first. A file holds
ranks, each in one to four bytes, and apart from them one control byte for every four ids with their lengths (two bits
each). Reading looks lengths up by control byte in a table of 256 rows and gathers all ranks of a file at once in numpy.

Documents are ordered by id (missing ids first), equal ids by a digest of their token ids, and those by a number that was stored with
them, so copies of a document spread over files. Every task of the ordered table writes its files into a folder of its
own attempt; only folders named in the stored list of parts count, so tasks that ran twice leave no trace in what is read.

Null texts count as empty: they have the end id alone. Repeated rows are documents of their own. A text is encoded whole, however
long it is; a long document makes a long file. An empty table makes no files. Other columns are not read, whatever their names.
Files are written by pyarrow's file systems (local, HDFS, S3, GCS) and read by Spark.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, map_batches, materialize, shared_dir

MAGIC = b"TIDFILE1"
HEAD = np.dtype([("part", "<i8"), ("base", "<i8"), ("docs", "<i8"), ("ids", "<i8"), ("keys", "<i8"), ("data", "<i8"), ("crc", "<i8")])
NO_KEY = 2**32 - 1
#: For every control byte the lengths of its four ids.
LENGTHS = np.stack([(np.arange(256) >> shift & 3) + 1 for shift in (0, 2, 4, 6)], 1).astype(np.uint8)
IDS_A_FILE = 2_000_000
#: A task sorts and writes about so many ids.
IDS_A_PART = 50_000_000


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    size = np.ones(len(values), np.uint8)
    for bits in (8, 16, 24):
        size += values >= 1 << bits
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int, step: int = 1 << 20) -> np.ndarray:
    """The n values again; `step` control bytes at a time bound the memory for places."""
    out, taken = np.empty(n, np.uint32), 0
    data = np.concatenate([data, np.zeros(3, np.uint8)])
    for at in range(0, len(control), step):
        size = LENGTHS[control[at : at + step]].ravel()[: n - 4 * at]
        ends = np.cumsum(size, dtype=np.int64)
        first = ends - size + taken
        value = data[first].astype(np.uint32)
        for k in range(1, int(size.max(initial=1))):
            value |= np.where(size > k, data[first + k], 0).astype(np.uint32) << np.uint32(8 * k)
        out[4 * at : 4 * at + len(size)] = value
        taken += int(ends[-1])
    return out


#: Words that the vocabulary's rules leave in one piece, whatever stands beside them: small Latin letters, composed.
ONE_PIECE = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: Between a letter and a mark a piece ends, and between a mark and a letter too (the apostrophe may begin a piece with letters). Of bytes after 0xC3 all but two end letters.
LETTER, MARK, LATIN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = True
MARK[list(b'.,;:!?%$&*#@()[]{}"/\\-_+=~^|<>`')] = True
LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


class Encoder:
    """Token ids of texts by the tokenizers library; words between ASCII white space are encoded apart and remembered.

    The vocabulary drops white space and no step of it looks past it, so the ids are those of whole texts. It also lower-cases, and takes marks
    apart from letters beside them, so both may be done first: fewer words are new then. Only texts that may hold special tokens, which are
    looked for in the text as it is, are left alone.
    """

    def __init__(self, path: str, most: int = 1_000_000, longest: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.longest = Tokenizer.from_file(path), most, longest
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[bytes, bytes] = {}
        self.last = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)  # ids that end a piece
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[bytes]) -> None:
        """Learns words: those of one piece many at a time, cut where a piece ends."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [k for k, t in enumerate(texts) if ONE_PIECE(t)]
        rest = set(range(len(words))).difference(plain)
        parts = [plain[at : at + 500] for at in range(0, len(plain), 500)]
        for part, ids in zip(parts, self._ids([" ".join(texts[k] for k in part) for part in parts])):
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                rest.update(part)
                continue
            size, whole = ids.itemsize, ids.tobytes()
            begin = 0
            for k, end in zip(part, (ends * size).tolist()):
                self.known[words[k]] = whole[begin:end]
                begin = end
        left = sorted(rest)
        for at in range(0, len(left), 5000):
            own = left[at : at + 5000]
            self.known.update((words[k], ids.tobytes()) for k, ids in zip(own, self._ids([texts[k] for k in own])))

    @staticmethod
    def words(texts: list[str | None]) -> list[list[bytes]]:
        """Words of all texts, cut between letters and marks; one pass over the texts' joined bytes."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        left = [b"<|" in x for x in raw]
        flat = np.frombuffer(b"".join(b"" if own else x.lower() for x, own in zip(raw, left)), np.uint8)
        ends = np.cumsum([0 if own else len(x) for x, own in zip(raw, left)])
        mark = np.flatnonzero(MARK[flat])
        before, after = flat[np.maximum(mark - 1, 0)], flat[np.minimum(mark + 1, len(flat) - 1)]
        ended = (mark > 0) & (LETTER[before] | LATIN[before] & (mark > 1) & (flat[np.maximum(mark - 2, 0)] == 0xC3))
        at = np.union1d(mark[ended], mark[LETTER[after] & (mark < len(flat) - 1)] + 1)  # a blank between two texts is dropped
        wide, after = np.insert(flat, at, 32).tobytes(), (ends + np.searchsorted(at, ends)).tolist()
        return [x.split() if own else wide[a:b].split() for x, own, a, b in zip(raw, left, [0, *after], after)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        cut = self.words(texts)
        coded = [list(map(self.known.get, words)) for words in cut]
        missing = [[k for k, x in enumerate(ids) if x is None] for ids in coded]
        fresh = {words[k] for words, places in zip(cut, missing) for k in places}
        if len(self.known) + len(fresh) > self.most:
            self.known = {w: x for words, ids in zip(cut, coded) for w, x in zip(words, ids) if x is not None}  # words that go on occurring
        self._new(list(fresh))
        for words, ids, places in zip(cut, coded, missing):
            for k in places:
                ids[k] = self.known[words[k]]
        out = list(map(b"".join, coded))
        for w in fresh:
            if len(w) > self.longest:
                del self.known[w]
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """This worker's encoder: the words it knows serve its next tasks too."""
    return Encoder(path)


def encode(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored (key, digest, number, wide, ids): ids of every text and the end id, as little-endian unsigned integers of two or four bytes."""

    def start():
        encoder = encoder_of(path)
        end = np.array([end_id], encoder.kind).tobytes()
        task, row = TaskContext.get().partitionId(), iter(range(1 << 40))

        def work(cols):
            keys, texts = cols
            ids = [x + end for x in encoder(texts)]
            return [keys, [zlib.crc32(x) for x in ids], [(task << 40) + next(row) for _ in ids], [encoder.kind == "<u4"] * len(ids), ids]

        return work

    kind = dict(docs.dtypes)[id_col]
    made = map_batches(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), f"key {kind}, digest long, number long, wide boolean, ids binary", start)
    return materialize(made, "token-ids", "zstd")


def frequency_ranks(encoded: DataFrame) -> tuple[np.ndarray, int]:
    """Ids by rank: most frequent first, of equally frequent ones the least; as many as the vocabulary has ids, at most. And the number of all ids met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(0, np.int64)
        for batch in batches:
            for wide, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.bincount(np.frombuffer(ids.as_buffer(), "<u4" if wide else "<u2"), minlength=len(count))
                own[: len(count)] += count
                count = own
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met])], ["id", "n"])

    found = encoded.select("wide", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = found["id"].to_numpy(), found["n"].to_numpy()
    return ids[np.lexsort((ids, -n))].astype(np.uint32), int(n.sum())


def file_bytes(part: int, base: int, keys: list[bytes | None], sizes: list[int], ranks: np.ndarray) -> bytes:
    """A file: head, key lengths, keys, ids a document, control bytes, data bytes."""
    control, data = pack(ranks)
    lengths = np.array([NO_KEY if k is None else len(k) for k in keys], "<u4").tobytes()
    named = b"".join(k for k in keys if k is not None)
    body = b"".join([lengths, named, np.array(sizes, "<u4").tobytes(), control, data])
    head = np.array([(part, base, len(keys), len(ranks), len(named), len(data), zlib.crc32(body))], HEAD)
    return MAGIC + head.tobytes() + body


def parse_file(content: memoryview) -> tuple[int, int, list[str | None], np.ndarray, np.ndarray]:
    """(part, base, keys, ids a document, ranks) of a file; ValueError if it isn't whole."""
    begin = len(MAGIC) + HEAD.itemsize
    if bytes(content[: len(MAGIC)]) != MAGIC or len(content) < begin:
        raise ValueError("not a file of token ids")
    head = np.frombuffer(content[len(MAGIC) : begin], HEAD)[0]
    body = content[begin:]
    if zlib.crc32(body) != head["crc"]:
        raise ValueError("a file of token ids is damaged")
    docs, n, at = int(head["docs"]), int(head["ids"]), 0

    def take(size: int) -> memoryview:
        nonlocal at
        at += size
        return body[at - size : at]

    lengths, named = np.frombuffer(take(4 * docs), "<u4"), bytes(take(int(head["keys"])))
    ends = np.cumsum(np.where(lengths == NO_KEY, 0, lengths), dtype=np.int64)
    keys = [None if size == NO_KEY else named[end - size : end].decode() for size, end in zip(lengths.tolist(), ends.tolist())]
    sizes = np.frombuffer(take(4 * docs), "<u4").astype(np.int64)
    control = np.frombuffer(take(-(-n // 4)), np.uint8)
    return int(head["part"]), int(head["base"]), keys, sizes, unpack(control, np.frombuffer(take(int(head["data"])), np.uint8), n)


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def _write(uri: str, content: bytes) -> None:
    fs, path = _store(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(content)


def write_ids(encoded: DataFrame, folder: str, ids_a_file: int = IDS_A_FILE, partitions: int | None = None) -> None:
    """Writes the encoded documents, in order, as files of about `ids_a_file` ids into `folder`: ranks, a list of parts, parts."""
    spark = encoded.sparkSession
    table, total = frequency_ranks(encoded)
    _write(f"{folder}/ranks.tid", file_bytes(0, 0, [], [], table))
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), f"{folder}/part-{uuid.uuid4().hex}"
        rank_of = np.zeros(int(shared.value.max(initial=0)) + 1, np.uint32)
        rank_of[shared.value] = np.arange(len(shared.value), dtype=np.uint32)
        keys, ids, held, base, files = [], [], 0, 0, 0

        def close() -> None:
            nonlocal keys, ids, held, base, files
            ranks = rank_of[np.concatenate(ids)]
            _write(f"{own}/{files:06d}.tid", file_bytes(part, base, keys, list(map(len, ids)), ranks))
            base, files, held, keys, ids = base + len(ranks), files + 1, 0, [], []

        for batch in batches:
            for key, wide, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own_ids = np.frombuffer(x.as_buffer(), "<u4" if wide else "<u2")
                if keys and held + len(own_ids) > ids_a_file:
                    close()
                keys.append(None if key is None else key.encode())
                ids.append(own_ids)
                held += len(own_ids)
        if keys:
            close()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([own]), pa.array([base], pa.int64()), pa.array([files], pa.int64())], ["part", "folder", "ids", "files"])
        give_back()

    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // IDS_A_PART)
    order = [F.col("key").asc_nulls_first(), "digest", "number"]
    dealt = encoded.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt.select(F.col("key").cast("string"), "wide", "ids").mapInArrow(run, "part long, folder string, ids long, files long").write.parquet(f"{folder}/parts")


def read_ids(spark: SparkSession, folder: str, key_type: str = "string", with_ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32 and, if asked for, ids) of every document of a folder, read from its files.

    The list of parts, one row for every task that wrote, comes to the driver; files don't.
    """
    parts = spark.read.schema("part long, folder string, ids long").parquet(f"{folder}/parts").orderBy("part").collect()
    schema = f"key {key_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not parts:
        return spark.createDataFrame([], schema)
    ranks = spark.read.format("binaryFile").load(f"{folder}/ranks.tid").first()["content"]
    ends = np.cumsum([p["ids"] for p in parts])
    before = dict(zip((p["part"] for p in parts), (ends - [p["ids"] for p in parts]).tolist()))
    shared = spark.sparkContext.broadcast((parse_file(memoryview(ranks))[4], before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, before = shared.value
        for batch in batches:
            for content in batch.column(0):
                part, base, keys, sizes, got = parse_file(memoryview(content.as_buffer()))
                ids = table[got].astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                cols = [pa.array(keys, pa.string()), pa.array(starts + (before[part] + base)), pa.array(sizes), pa.array(crc, pa.int64())]
                names = ["key", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.LargeListArray.from_arrays(pa.array(np.append(starts, len(ids))), pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
        give_back()

    found = spark.read.format("binaryFile").load([p["folder"] for p in parts]).select("content")
    text = found.mapInArrow(run, schema.replace(f"key {key_type}", "key string", 1))
    return text.withColumn("key", F.col("key").cast(key_type))


def token_files(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes `docs`, writes the files into the shared folder and reads them back: (id, start, n_tokens, ids_crc32)."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_ids(encode(docs, path, end_id, id_col, text_col), folder)
    return read_ids(spark, folder, kind, with_ids=False).withColumnRenamed("key", id_col)
