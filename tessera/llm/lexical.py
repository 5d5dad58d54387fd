"""Ranked lexical search by the Best Position Algorithm over a distributed impact-ordered index.

The index is a stored table of segments. A segment covers a block of documents and holds, for all their terms, which documents have
them and how often. Documents are dealt to segments, so no list of a common term meets in one task. Searching, a segment
orders the lists of the query terms by impact, and a query walks down its lists side by side. Each document met
is looked up in all lists by direct access; its places there count as seen as well. The best position of a list is the end of the
run of seen places from its top, so no unseen document scores more than the sum of the impacts at the best positions.
That bound is never looser than the one from the last places read. A query stops once its bound is strictly below its
kth score: unseen documents can't even tie. The best of all segments are ranked by Spark, each task sending k rows a query at most.

A term's weight and a document's length need counts over all documents: these are summed from the index, without the texts.

Terms are maximal runs of digits, letters and characters beyond ASCII; A-Z alone are lower-cased. Null, empty and separator-only texts have no
terms and don't count as documents. Repeated rows are ranked each for itself; equal scores go by ascending id, missing ids last. Query
rows under one id are one query with the terms of all of them (a missing id is an id). Texts are read whole,
however long. Empty tables give an empty result. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import LARGE_ROWS, give_back, map_batches, materialize
from .decontaminate import words_of

#: A score's fixed point, and the share of length normalisation in hundredths.
UNIT, LENGTH_SHARE = 1_000_000_000, 90


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 4096, size: int = 8_000_000) -> DataFrame:
    """The segments, stored: (ids, lengths, terms, bounds, docs, counts) of at most `block` documents and about `size` bytes."""
    kind = dict(docs.dtypes)[id_col]

    def start():
        def work(cols):
            ids, texts = cols
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))  # documents in the order of ties
            number, keys, lengths = _Numbers(), [np.zeros(0, np.int64)], []
            for at, i in enumerate(order):
                words = words_of(texts[i])
                keys.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)) * len(ids) + at)
                lengths.append(len(words))
            met, n = np.unique(np.concatenate(keys), return_counts=True)
            bounds = np.searchsorted(met, np.arange(len(number) + 1) * len(ids))
            return [[[ids[i] for i in order]], [lengths], [list(number)], [bounds], [(met % max(len(ids), 1)).astype("<i4").tobytes()], [n.astype("<i4").tobytes()]]

        return work

    schema = f"ids array<{kind}>, lengths array<long>, terms array<binary>, bounds array<long>, docs binary, counts binary"
    return materialize(map_batches(docs.select(F.col(id_col), F.col(text_col)), schema, start, block, size), "impact-index", options=LARGE_ROWS)


def corpus_size(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms."""
    row = index.select(F.explode("lengths").alias("n")).where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return row[0], row[1]


def _lookup(terms: pa.ListArray, wanted: pa.Array) -> np.ndarray:
    """For every term of a segment its number among the wanted ones, or -1."""
    return pc.fill_null(pc.index_in(terms, value_set=wanted), -1).to_numpy(zero_copy_only=False)


def document_frequency(index: DataFrame, terms: list[bytes]) -> np.ndarray:
    """Documents that hold each of the terms, from the index's bounds alone."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, df = pa.array(shared.value, pa.binary()), np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for own, bounds in zip(batch.column(0), batch.column(1)):
                which = _lookup(own.values, wanted)
                held = np.flatnonzero(which >= 0)
                df[which[held]] += np.diff(bounds.values.to_numpy())[held]
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(df[met])], ["term", "df"])

    found = index.select("terms", "bounds").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[found["term"].to_numpy()] = found["df"].to_numpy()
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Lists:
    """The impact-ordered lists of one segment for the terms of a block of queries."""

    def __init__(self, weights: np.ndarray, which: np.ndarray, bounds: np.ndarray, docs: np.ndarray, counts: np.ndarray, spare: np.ndarray):
        """`weights` by wanted term, `which` wanted term each own term is, `spare` the length part of every document."""
        held = np.flatnonzero(which >= 0)
        held = held[np.argsort(which[held])]
        size = bounds[held + 1] - bounds[held]
        self.n_docs = len(spare)
        self.begin = np.zeros(len(weights) + 1, np.int64)
        self.begin[which[held] + 1] = size
        self.begin = np.cumsum(self.begin)
        at = np.repeat(bounds[held] - self.begin[which[held]], size) + np.arange(self.begin[-1])
        term, doc, tf = np.repeat(which[held], size), docs[at].astype(np.int64), counts[at].astype(np.int64)
        self.key = term * self.n_docs + doc  # ascending: lists in the order of terms, documents within
        self.impact = weights[term] * (UNIT * tf // (1000 * tf + spare[doc]))
        order = np.lexsort((-self.impact, term))
        self.by_impact = order  # place in the list of impacts -> entry
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order)) - np.repeat(self.begin[which[held]], size)
        self.doc = doc

    def best(self, terms: np.ndarray, k: int, depth: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, entries read in order) of the k best by score, then document; scores above 0 only."""
        terms = terms[self.begin[terms + 1] > self.begin[terms]]
        begin = self.begin[terms]
        size = self.begin[terms + 1] - begin
        empty = np.zeros(0, np.int64)
        if not len(terms):
            return empty, empty, 0
        seen = [np.zeros(n + 1, bool) for n in size.tolist()]  # the place past the end is never seen
        front, met = np.zeros(len(terms), np.int64), np.zeros(self.n_docs, bool)
        top, scores, read = empty, empty, 0
        while True:
            until = np.minimum(front + depth, size)
            fresh = []
            for begin_at, a, b, mark in zip(begin.tolist(), front.tolist(), until.tolist(), seen):
                fresh.append(self.doc[self.by_impact[begin_at + a : begin_at + b]])
                mark[a:b] = True
            read += int((until - front).sum())
            new = np.unique(np.concatenate(fresh))
            new = new[~met[new]]
            met[new] = True
            if len(new):
                wanted = terms[:, None] * self.n_docs + new
                entry = np.searchsorted(self.key, wanted)
                entry[entry == len(self.key)] = 0
                hit = self.key[entry] == wanted
                for mark, own, there in zip(seen, self.place[entry], hit):
                    mark[own[there]] = True
                own = np.where(hit, self.impact[entry], 0).sum(0)
                top, scores = np.append(top, new[own > 0]), np.append(scores, own[own > 0])
                order = np.lexsort((top, -scores))[:k]
                top, scores = top[order], scores[order]
            best = np.array([int(mark.argmin()) for mark in seen])  # the first unseen place: all before it are seen
            alive = best < size
            bound = int(self.impact[self.by_impact[(begin + best - (best > 0))[alive]]].sum()) if alive.any() else -1
            if not alive.any() or (len(top) == k and bound < scores[-1]):
                return top, scores, read
            # Places seen by direct access needn't be read again: reading goes on behind the best positions.
            front, depth = np.maximum(until, best), depth * 2


def query_blocks(queries: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with their distinct terms, in blocks of about `block_chars` characters, a block at a time."""
    sized = queries.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    total = sized.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    blocks = -(-total // block_chars)
    for b in range(blocks):
        own: dict[object, dict[bytes, None]] = {}
        for item, text in sized.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect():
            own.setdefault(item, {}).update(dict.fromkeys(words_of(text)))
        yield [(item, list(terms)) for item, terms in own.items() if terms]


def search(index: DataFrame, queries: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """(item, rank, doc_id, score): each query's k best documents.

    Queries are the small side: they go to the segments in blocks of about `block_chars` characters, which bounds what is broadcast.
    """
    spark = index.sparkSession
    n_docs, n_terms = corpus_size(index)
    item_kind, id_kind = dict(queries.dtypes)[item_col], dict(index.dtypes)["ids"][6:-1]
    item_type = to_arrow_type(queries.schema[item_col].dataType)
    found = None
    for own in query_blocks(queries, item_col, text_col, block_chars) if n_docs else ():
        number: dict[bytes, int] = {}
        items = [np.array(sorted({number.setdefault(t, len(number)) for t in terms}), np.int64) for _, terms in own]
        terms = list(number)
        weights = np.array([weight(n_docs, df) for df in document_frequency(index, terms).tolist()], np.int64)
        shared = spark.sparkContext.broadcast((terms, weights, items))
        names = pa.array([item for item, _ in own], item_type)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, names=names) -> Iterator[pa.RecordBatch]:
            terms, weights, items = shared.value
            wanted = pa.array(terms, pa.binary())
            for batch in batches:
                for ids, lengths, own, bounds, docs, counts in zip(*batch.columns):
                    spare = 8 * (100 - LENGTH_SHARE + LENGTH_SHARE * lengths.values.to_numpy() * n_docs // n_terms)
                    lists = Lists(weights, _lookup(own.values, wanted), bounds.values.to_numpy(), np.frombuffer(docs.as_buffer(), "<i4"), np.frombuffer(counts.as_buffer(), "<i4"), spare)
                    item, doc, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                    for q, own_terms in enumerate(items):
                        top, scores, _ = lists.best(own_terms, k)
                        item.append(np.full(len(top), q))
                        doc.append(top)
                        score.append(scores)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(item))), ids.values.take(pa.array(np.concatenate(doc))), pa.array(np.concatenate(score))], ["item", "id", "score"])
            give_back()

        part = index.mapInArrow(run, f"item {item_kind}, id {id_kind}, score long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"item {item_kind}, id {id_kind}, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)  # k rows a task and query are left before the shuffle
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias("doc_id"), "score")


ORACLE = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, text, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL
), sizes AS (
  SELECT count(*) AS docs, sum(len(w)) AS terms FROM words WHERE len(w) > 0
), tf AS MATERIALIZED (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM words) GROUP BY r, term
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * s.docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight
  FROM tf, sizes s GROUP BY term, s.docs
), scored AS (
  SELECT a.item_id, d.doc_id, d.r, CAST(sum(g.weight * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (10 + (90 * len(d.w) * s.docs) // s.terms)))) AS BIGINT) AS score
  FROM asked a JOIN tf t USING (term) JOIN weights g USING (term) JOIN words d ON d.r = t.r, sizes s GROUP BY a.item_id, d.doc_id, d.r
)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 10
"""
