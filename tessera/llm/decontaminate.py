"""Benchmark decontamination by a distributed positional inverted index.

The index is a stored table of segments: each row covers a block of documents and holds, for every token of theirs, the sorted
places at which it occurs in the block (documents are set apart so that no phrase crosses them). Documents are dealt to
segments, and the test windows go to all of them in blocks of bounded size, so nothing is shuffled and no list of a
common term meets in one task. Windows with a term that a segment lacks are left out by one test of all of them; the others are looked up
from their rarest term: its posting list, moved back by the term's offset, is cut down by the next rarest until all terms agree (exact
phrases), or within a slack (proximity).

Null texts have no words; neither do texts of separators only. A repeated document is answered each time. Items repeated
under one id count once. An empty benchmark hits nothing. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LARGE_ROWS, map_batches, materialize

WINDOW = 13
GAP = 64  # positions between documents of a segment
#: A-Z become a-z; what is no word character (0x00-0x2F, 0x3A-0x60, 0x7B-0x7F) becomes a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Queries:
    """The distinct windows of a block of items, as term numbers, and which items have them."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            for w in windows_of(words_of(text), size):
                owners.setdefault(tuple(self.number.setdefault(x, len(self.number)) for x in w), set()).add(item)
        self.windows = [(np.array(w), sorted(o)) for w, o in owners.items()]
        self.table = np.full((len(owners), size), len(self.number))  # filled with a number that every segment counts as there
        for row, w in zip(self.table, owners):
            row[: len(w)] = w


class Segment:
    """Postings of one block of documents: places sorted within each term; terms are those of the queries."""

    def __init__(self, queries: Queries, terms: list[bytes], bounds: np.ndarray, places: np.ndarray):
        get = queries.number.get
        own = np.fromiter((get(t, -1) for t in terms), np.int64, len(terms))
        met = np.flatnonzero(own >= 0)
        self.begin, self.count = np.zeros(len(queries.number) + 1, np.int64), np.zeros(len(queries.number) + 1, np.int64)
        self.begin[own[met]], self.count[own[met]] = bounds[met], bounds[met + 1] - bounds[met]
        self.count[-1] = len(places) + 1
        self.places = places

    def lists(self, window: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(length, offset, places) of the window's terms, the rarest first."""
        found = [(int(self.count[t]), k, self.places[self.begin[t] : self.begin[t] + self.count[t]]) for k, t in enumerate(window.tolist())]
        return sorted(found, key=lambda x: x[:2])

    def possible(self, table: np.ndarray) -> np.ndarray:
        """Windows of which every term occurs here: one test of all windows' rarest terms."""
        return np.flatnonzero(self.count[table].min(axis=1) > 0) if len(table) else np.zeros(0, np.int64)

    def search(self, window: np.ndarray, slack: int = 0) -> np.ndarray:
        """First places of occurrences: offset-adjusted lists, intersected from the rarest term on; with a slack, terms may lie so far off their places."""
        lists = self.lists(window)
        starts = lists[0][2].astype(np.int64) - lists[0][1]
        for n, offset, found in lists[1:]:
            if not len(starts):
                break
            at = np.searchsorted(found, starts + offset - slack)
            starts = starts[(at < n) & (found[np.minimum(at, n - 1)] <= starts + offset + slack)]
        return starts


SEGMENT = "ids array<string>, first array<long>, n_words array<long>, terms array<binary>, bounds array<long>, places binary"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 2048, size: int = 16_000_000) -> DataFrame:
    """The segments, stored: postings of all tokens of blocks of at most `block` documents and about `size` bytes."""

    def start():
        def work(cols):
            ids, texts = cols
            number, first, sizes, terms, base = _Numbers(), [], [], [], GAP
            places = []
            for text in texts:
                words = words_of(text)
                terms.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                places.append(np.arange(base, base + len(words), dtype=np.int32 if base + len(words) < 2**31 else np.int64))
                first.append(base)
                sizes.append(len(words))
                base += len(words) + GAP
            term, place = np.concatenate(terms), np.concatenate(places)
            place = place[np.argsort(term, kind="stable")].astype("<i8" if place.dtype == np.int64 else "<i4")
            bounds = np.append(0, np.cumsum(np.bincount(term, minlength=len(number))))
            return [[ids], [first], [sizes], [list(number)], [bounds], [place.tobytes()]]

        return work

    kept = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return materialize(map_batches(kept, SEGMENT, start, block, size), "postings", options=LARGE_ROWS)


def search_index(index: DataFrame, queries: Queries, slack: int = 0) -> DataFrame:
    """One row a document and segment: id string, n_words, items (sorted), spans binary (pairs of word positions, half open).

    With a slack, occurrences are proximity matches instead of exact phrases. It must be so small that no match can reach from one document into the next.
    """
    size = queries.table.shape[1]
    if not 0 <= slack < (GAP - size) / 2:
        raise ValueError(f"a slack of 0 to {(GAP - size - 1) // 2} is possible for windows of {size} words")
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def start():
        queries = shared.value

        def work(cols):
            out = [[], [], [], []]
            for ids, first, sizes, terms, bounds, places in zip(*cols):
                wide = "<i8" if bounds and 8 * bounds[-1] == len(places) else "<i4"
                segment = Segment(queries, terms, np.array(bounds), np.frombuffer(places, wide))
                at = np.array(first)
                hits: dict[int, list] = {}
                for k in segment.possible(queries.table).tolist():
                    window, owners = queries.windows[k]
                    starts = segment.search(window, slack)
                    if len(starts):
                        doc = np.searchsorted(at, starts + slack, "right") - 1
                        for d, s in zip(doc.tolist(), (starts - at[doc]).tolist()):
                            hits.setdefault(d, []).append((s, s + len(window), owners))
                for d, (i, n) in enumerate(zip(ids, sizes)):
                    got = hits.get(d, ())
                    out[0].append(i)
                    out[1].append(n)
                    out[2].append(sorted({o for _, _, owners in got for o in owners}))
                    out[3].append(np.array([x[:2] for x in got], "<i8").tobytes())
            return out

        return work

    return map_batches(index, "id string, n_words long, items array<string>, spans binary", start, 1)


def covered(spans: bytes, n: int) -> int:
    """Words inside any span."""
    pairs = np.frombuffer(spans, "<i8").reshape(-1, 2)
    if not len(pairs):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(pairs[:, 0], 0, n), 1)
    np.add.at(edge, np.clip(pairs[:, 1], 0, n), -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    The benchmark is a stated query set: it goes to all documents in blocks of about `block_chars` characters (that bounds
    what is broadcast); with several blocks, a document's spans and items of all blocks meet by a shuffle on its id and text.
    """
    kind = dict(docs.dtypes)[id_col]
    sized = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    total = sized.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    parts = []
    if blocks > 1:  # a document's parts of all blocks meet by its id and text
        docs = docs.select(F.to_json(F.struct(F.col(id_col).alias("i"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("h"))).alias(id_col), F.col(text_col))
    index = build_index(docs, id_col, text_col)
    for k in range(blocks):
        own = sized if blocks == 1 else sized.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        queries = Queries([(str(r[0]), r[1]) for r in own.collect()])
        parts.append(search_index(index, queries))
    if blocks == 1:
        met = parts[0].withColumn("spans", F.array("spans")).withColumn("times", F.lit(1))
    else:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        met = every.groupBy("id").agg(F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.collect_list("spans").alias("spans"), (F.count("*") / blocks).cast("int").alias("times"))
        met = met.withColumn("id", F.get_json_object("id", "$.i"))

    def start():
        def work(cols):
            ids, sizes, items, spans, times = cols
            hit = [covered(b"".join(s), n) for s, n in zip(spans, sizes)]
            sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            return [ids, sizes, hit, list(map(len, items)), sha, [h > 0 and 20 * h >= n for h, n in zip(hit, sizes)], times]

        return work

    out = map_batches(met.select("id", "n_words", "items", "spans", "times"), "id string, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, times int", start)
    if blocks > 1:
        out = out.withColumn("times", F.explode(F.sequence(F.lit(1), "times")))
    return out.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
