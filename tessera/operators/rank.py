"""Keyword and vector ranking over chunks for a stated set of questions.

Questions are few beside the corpus: their terms and vectors go to every task in blocks of a checked size, each chunk is
read once, and only per-question candidates are shuffled. Text stays where it is; joins carry ids and scores.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import path_stem, query_ngrams, split_terms

#: Most distinct terms, and most vector components, that one pass over the corpus broadcasts.
TERMS_AT_ONCE, NUMBERS_AT_ONCE = 200_000, 4_000_000
#: Most cells of a table of texts by questions that a task holds, and texts after which the best so far are known anew.
CELLS, ROWS_AT_ONCE = 2_000_000, 512
CJK_TERM = r"^([\x{3400}-\x{9fff}々]{2,}|[ァ-ヶー]{2,})$"


def question_terms(questions: DataFrame) -> DataFrame:
    """(query_id, term): distinct terms of each question; the whole question where it has none."""
    terms = split_terms(F.col("query"))
    whole = F.array(F.lower(F.trim("query")))
    return questions.select("query_id", F.explode(F.when(F.size(terms) > 0, terms).otherwise(whole)).alias("term")).where("term <> ''")


def term_hits(chunks: DataFrame, terms: DataFrame, hay: Column) -> DataFrame:
    """(chunk_id, path, term, n, in_heading, in_stem): non-overlapping occurrences of the distinct terms, by one automaton pass.

    chunks: chunk_id, path, heading and what `hay` needs.
    """
    spark = chunks.sparkSession
    wanted = [r[0] for r in terms.select("term").distinct().collect()]
    blocks = [wanted[a : a + TERMS_AT_ONCE] for a in range(0, len(wanted), TERMS_AT_ONCE)]
    schema = "chunk_id string, path string, term string, n long, in_heading boolean, in_stem boolean"
    rows = chunks.select("chunk_id", "path", F.lower(F.coalesce("heading", F.lit(""))).alias("heading"), F.lower(path_stem(F.col("path"))).alias("stem"), F.lower(hay).alias("hay"))
    out = spark.createDataFrame([], schema)
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            count = _finder(shared.value)
            for batch in batches:
                made = [[] for _ in range(6)]
                for chunk, path, heading, stem, text in zip(*(c.to_pylist() for c in batch.columns)):
                    for term, n in count(text or "").items():
                        for column, value in zip(made, (chunk, path, term, n, term in heading, term in stem)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], names=["chunk_id", "path", "term", "n", "in_heading", "in_stem"])

        found = rows.mapInArrow(run, schema)
        out = found if block is blocks[0] else out.unionByName(found)
    return out


def document_frequency(hits: DataFrame) -> DataFrame:
    return hits.groupBy("term").agg(F.count("*").alias("df"))


def _finder(terms: list[str]):
    """text -> occurrences of each term it has, counted without overlap, by one pass of an automaton."""
    import ahocorasick

    find = ahocorasick.Automaton()
    for t in terms:
        find.add_word(t, t)
    if terms:
        find.make_automaton()

    def count(text: str) -> dict[str, int]:
        counts: dict[str, int] = {}
        free: dict[str, int] = {}
        for end, term in find.iter(text) if terms else ():
            if end - len(term) >= free.get(term, -1):
                counts[term] = counts.get(term, 0) + 1
                free[term] = end
        return counts

    return count


def keyword_scores(questions: DataFrame, chunks: DataFrame, top_k: int = 8) -> DataFrame:
    """(query_id, chunk_id, path, score, rank0): saturated term counts weighted by rarity, heading and name bonuses, n-gram fallback.

    Two passes over the chunks. The first counts how many chunks have each term; the second scores every chunk for the
    questions that share a term or 3-gram with it, where it is, and a task sends on its `top_k` best of each question.
    Questions and terms are broadcast in blocks of TERMS_AT_ONCE terms.
    """
    cjk = re.compile(CJK_TERM.replace("\\x{3400}", "\u3400").replace("\\x{9fff}", "\u9fff"))
    rarity = lambda t, df, total: (math.log((total + 1.0) / (df + 1)) + 1.0) * (min(len(t), 8) if cjk.match(t) else 1)
    worth = lambda n, w, in_heading, in_stem: 2.0 * n / (n + 1.0) * w + (3.0 if in_heading else 0.0) + (2.0 if in_stem else 0.0)
    return _by_blocks(questions, chunks, F.concat_ws(" ", "path", "heading", "text"), rarity, worth, True, top_k).drop("hits")


def idf_scores(questions: DataFrame, chunks: DataFrame, top_k: int = 20) -> DataFrame:
    """(query_id, chunk_id, path, score, rank0, hits): sum of ln(N/df) over the terms a file has, three more times for terms in its name."""
    rarity = lambda t, df, total: math.log(total / df) if df else 0.0
    worth = lambda n, w, in_heading, in_stem: w * (4.0 if in_stem else 1.0)
    return _by_blocks(questions, chunks, F.concat_ws(" ", "path", "text"), rarity, worth, False, top_k)


def _by_blocks(questions: DataFrame, chunks: DataFrame, hay: Column, rarity: Callable, worth: Callable, grams: bool, top_k: int) -> DataFrame:
    terms = question_terms(questions).groupBy("query_id").agg(F.collect_list("term").alias("t"))
    bare = questions.select("query_id", F.regexp_replace("query", r"\s+", "").alias("bare"))
    blocks: list[list[tuple]] = [[]]
    held = 0
    for q in map(tuple, bare.join(terms, "query_id").select("query_id", "bare", "t").orderBy("query_id").collect()):
        if blocks[-1] and held + len(q[2]) > TERMS_AT_ONCE:
            blocks.append([])
            held = 0
        blocks[-1].append(q)
        held += len(q[2])
    rows = chunks.select("chunk_id", "path", F.lower(F.coalesce("heading", F.lit(""))).alias("heading"), F.lower(path_stem(F.col("path"))).alias("stem"), F.lower(hay).alias("hay"))
    parts = [_best_of_block(rows, block, rarity, worth, grams, top_k) for block in blocks]
    return top(reduce(DataFrame.unionByName, parts), top_k)


def _best_of_block(rows: DataFrame, block: list[tuple], rarity: Callable, worth: Callable, grams: bool, top_k: int) -> DataFrame:
    context = rows.sparkSession.sparkContext
    words = sorted({t for _, _, ts in block for t in ts})
    plain = context.broadcast(words)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = _finder(plain.value), {None: 0}
        for batch in batches:
            seen[None] += batch.num_rows
            for text in batch.column(0).to_pylist():
                for t in count(text):
                    seen[t] = seen.get(t, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "df"])

    df = {r[0]: r[1] for r in rows.select("hay").mapInArrow(tally, "term string, df long").groupBy("term").agg(F.sum("df")).collect()}
    shared = context.broadcast((block, {t: rarity(t, df.get(t, 0), df.get(None, 0)) for t in words}))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = shared.value
        count, number = _finder(list(weight)), {t: i for i, t in enumerate(weight)}
        ask = _Askers(len(block), len(number), ((number[t], q) for q, (_, _, ts) in enumerate(block) for t in ts))
        shares = _Grams([bare for _, bare, _ in block]) if grams else None
        best: list[list[tuple]] = [[] for _ in block]
        least = np.zeros(len(block))  # what a chunk must reach to be among the best so far
        for batch in batches:
            step = max(1, min(ROWS_AT_ONCE, CELLS // max(1, len(block))))
            for a in range(0, batch.num_rows, step):
                own = list(zip(*(c.to_pylist() for c in batch.slice(a, step).columns)))
                table, hits = np.zeros((len(own), len(block))), np.zeros((len(own), len(block)), np.int32)
                for k, (_, _, heading, stem, text) in enumerate(own):
                    if found := count(text):
                        value = [worth(n, weight[t], t in heading, t in stem) for t, n in found.items()]
                        table[k], hits[k] = ask(np.fromiter(map(number.__getitem__, found), np.int64, len(found)), np.array(value))
                if shares:
                    table += 0.1 * _shared_grams(shares, [r[4] for r in own], table, least, top_k)
                table = np.floor(table * 1e4 + 0.5) / 1e4
                good = (table > 0) & (table >= least)
                if len(own) > top_k:
                    good &= table >= -np.partition(-table, top_k - 1, axis=0)[top_k - 1]
                for k, q in zip(*np.nonzero(good)):
                    best[q].append((-table[k, q], own[k][0], own[k][1], hits[k, q]))
                for q in np.flatnonzero(good.any(axis=0)):
                    if len(best[q]) >= top_k:
                        best[q] = heapq.nsmallest(top_k, best[q])
                        least[q] = -best[q][-1][0]
        found = [(q, c, p, -s, n) for (q, _, _), kept in zip(block, best) for s, c, p, n in kept]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names=["query_id", "chunk_id", "path", "score", "hits"])

    return rows.mapInArrow(score, "query_id long, chunk_id string, path string, score double, hits long")


class _Askers:
    """Which questions have each of some things; sums over the things that a text has."""

    def __init__(self, questions: int, things: int, pairs: Iterable[tuple[int, int]]):
        got = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.n, self.owner, self.starts = questions, got[:, 1], np.searchsorted(got[:, 0], np.arange(things + 1))

    def __call__(self, things: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.starts[things + 1] - self.starts[things]
        at = np.repeat(self.starts[things] - np.cumsum(size) + size, size) + np.arange(size.sum())
        owner = self.owner[at]
        return np.bincount(owner, np.repeat(values, size), self.n), np.bincount(owner, minlength=self.n)


def _shared_grams(shares: _Grams, texts: list[str], table: np.ndarray, least: np.ndarray, top_k: int) -> np.ndarray:
    """Shared n-grams, up to ten, of every text and question; those of over three characters are only counted where they could matter.

    Ten of them add no more than 1 to a score, so a text whose score and 1 stay below what the question's best texts have for certain isn't among them.
    """
    n = np.stack([shares(t) for t in texts])
    sure = table + 0.1 * np.minimum(n, 10)
    bound = least if len(texts) <= top_k else np.maximum(least, -np.partition(-sure, top_k - 1, axis=0)[top_k - 1])
    for k, q in zip(*np.nonzero((n > 0) & (n < 10) & (table + 1.001 >= bound))):
        n[k, q] += shares.longer(q, texts[k], 10 - n[k, q])
    return np.minimum(n, 10)


class _Grams:
    """How many distinct 3-grams of each question a text has, and how many longer ones."""

    def __init__(self, bare: list[str]):
        self.bare = bare
        threes = [{g for i in range(len(q) - 2) if len(g := q[i : i + 3].lower()) == 3} for q in bare]
        self.keys = np.unique(_threes("".join(sorted({g for own in threes for g in own})))[::3]) if any(threes) else np.zeros(0, np.uint64)
        pairs = ((k, q) for q, own in enumerate(threes) if own for k in np.searchsorted(self.keys, _threes("".join(own))[::3]).tolist())
        self.ask = _Askers(len(bare), len(self.keys), pairs)

    def __call__(self, text: str) -> np.ndarray:
        own = np.unique(_threes(text))
        at = np.searchsorted(self.keys, own)
        at = at[self.keys[np.minimum(at, len(self.keys) - 1)] == own] if len(self.keys) else at[:0]
        return self.ask(at, np.zeros(len(at)))[1]

    def longer(self, question: int, text: str, enough: int) -> int:
        """Distinct 4- to 8-grams, until there are enough; one can only be there if its first three characters are."""
        return self._longer(self.bare[question], text, enough)

    @staticmethod
    def _longer(bare: str, text: str, enough: int) -> int:
        found: set[str] = set()
        for i in range(len(bare) - 3):
            if bare[i : i + 3].lower() in text:
                for n in range(4, min(8, len(bare) - i) + 1):
                    if (g := bare[i : i + n].lower()) not in text:
                        break
                    found.add(g)
            if len(found) >= enough:
                break
        return len(found)


def _threes(text: str) -> np.ndarray:
    """Its 3-grams in order, as numbers."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:] if len(c) > 2 else np.zeros(0, np.uint64)


def top(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best of each question by score, ties by chunk, with rank0."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *(ties or ("chunk_id",)))
    return scored.withColumn("rank0", (F.row_number().over(order) - 1).cast("long")).where(F.col("rank0") < k)


def norms(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(id, dim, norm, usable): a vector is usable if it has components, all finite, and some length."""
    square = F.aggregate(F.transform(col, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    finite = F.forall(col, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(id_col, F.size(col).cast("long").alias("dim"), F.round(F.sqrt(square), 6).alias("norm"), (F.size(col) > 0).__and__(finite).__and__(square > 0).alias("usable"))


def cosine_scores(queries: DataFrame, index: DataFrame, top_k: int = 8, least: float = 0.3) -> DataFrame:
    """(query_id, vec_id, score, rank0): cosine of at least `least`, rounded to 4 places; queries: query_id, embedding.

    Queries go out in blocks of NUMBERS_AT_ONCE components, dealt by hash of their ids; a block is one pass over the index, one matrix
    product a batch, and each task sends on its own best. Vectors of another dimension, without length or with parts that
    aren't finite match nothing.
    """
    size = queries.agg(F.sum(F.size("embedding"))).first()[0] or 0
    blocks = max(1, -(-int(size) * 5 // (NUMBERS_AT_ONCE * 4)))  # blocks by hash are uneven: a quarter more of them
    block_of = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    parts = [_cosine_block(queries.where(block_of == b) if blocks > 1 else queries, index, top_k, least) for b in range(blocks)]
    return top(reduce(DataFrame.unionByName, parts), top_k, "vec_id")


def _cosine_block(queries: DataFrame, index: DataFrame, top_k: int, least: float) -> DataFrame:
    asked = [(r[0], r[1]) for r in queries.select("query_id", "embedding").orderBy("query_id").collect()]
    shared = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, tuple[list, list]] = {}
        for q, v in shared.value:
            v = np.array(v or (), np.float64)
            if len(v) and np.isfinite(v).all() and (n := np.linalg.norm(v)):
                ids, rows = groups.setdefault(len(v), ([], []))
                ids.append(q)
                rows.append(v / n)
        known = {dim: (np.array(q), np.array(rows)) for dim, (q, rows) in groups.items()}
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for dim, (asked_ids, rows) in known.items():
                here = np.flatnonzero(sizes == dim)
                own = vectors.take(pa.array(here)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                length = np.sqrt((own * own).sum(axis=1))
                for a in range(0, len(asked_ids), step := max(1, CELLS // max(1, len(here)))):
                    with np.errstate(all="ignore"):
                        score = np.floor((own @ rows[a : a + step].T) / length[:, None] * 1e4 + 0.5) / 1e4
                    score[~np.isfinite(score)] = -2
                    good = score >= least
                    if len(here) > top_k:
                        good &= score >= -np.partition(-score, top_k - 1, axis=0)[top_k - 1]
                    k, q = np.nonzero(good)
                    out.append((asked_ids[a + q], ids[here[k]], score[k, q]))
            q, v, score = (np.concatenate(x) for x in zip(*out))
            order = np.lexsort((v, -score, q))
            q, v, score = q[order], v[order], score[order]
            new = np.append(True, q[1:] != q[:-1])[: len(q)]
            place = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
            keep = place < top_k
            yield pa.RecordBatch.from_arrays([pa.array(q[keep], pa.int64()), pa.array(v[keep], pa.int64()), pa.array(score[keep], pa.float64())], names=["query_id", "vec_id", "score"])

    return index.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double")


def fuse(keyword: DataFrame, vector: DataFrame, limit: int = 20, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: (query_id, chunk_id, path, rrf_score, keyword_score, embedding_score, source, rank0).

    Each list adds 1/(k + rank0). Ties keep the order of first sight: the keyword list, then the other.
    """
    parts = [d.select("query_id", "chunk_id", "path", "rank0", F.lit(n).alias("list"), F.col("score").alias(f"{name}_score"), F.lit(name).alias("source")) for n, (name, d) in enumerate((("keyword", keyword), ("embedding", vector)))]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True)
    merged = both.groupBy("query_id", "chunk_id", "path").agg(
        F.round(F.sum(1.0 / (F.col("rank0") + k)), 6).alias("rrf_score"),
        F.max("keyword_score").alias("keyword_score"),
        F.max("embedding_score").alias("embedding_score"),
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"),
        F.min(F.struct("list", "rank0")).alias("seen"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "seen")
    return merged.withColumn("rank0", (F.row_number().over(order) - 1).cast("long")).where(F.col("rank0") < limit).drop("seen")


def relative_floor(ranked: DataFrame, share: float = 0.3) -> DataFrame:
    """Rows of a question that reach `share` of its best score; a lone row or a best of zero stays."""
    own = Window.partitionBy("query_id")
    marked = ranked.withColumn("_top", F.max("rrf_score").over(own)).withColumn("_n", F.count("*").over(own))
    return marked.where((F.col("_n") <= 1) | (F.col("_top") <= 0) | (F.col("rrf_score") >= share * F.col("_top"))).drop("_top", "_n")


def per_file(ranked: DataFrame, most: int = 2) -> DataFrame:
    order = Window.partitionBy("query_id", "path").orderBy("rank0")
    return ranked.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")


def order_by_document(ranked: DataFrame, k: int = 60) -> DataFrame:
    """Documents by the sum over lists of their best 1/(k + rank1), candidates inside by their own sum; ranked: topic, query_id, chunk_id, path, rank0."""
    weight = 1.0 / (F.lit(float(k)) + F.col("rank0") + 1)
    best = ranked.groupBy("topic", "path", "query_id").agg(F.max(weight).alias("w"), F.min(F.struct("query_id", "rank0")).alias("seen"))
    documents = best.groupBy("topic", "path").agg(F.round(F.sum("w"), 8).alias("document_score"), F.min("seen").alias("document_seen"))
    own = ranked.groupBy("topic", "path", "chunk_id").agg(F.round(F.sum(weight), 8).alias("chunk_score"), F.min(F.struct("query_id", "rank0")).alias("chunk_seen"))
    order = Window.partitionBy("topic").orderBy(F.desc("document_score"), "document_seen", F.desc("chunk_score"), "chunk_seen")
    return own.join(documents, ["topic", "path"]).withColumn("place", F.row_number().over(order).cast("long")).drop("document_seen", "chunk_seen")


def rerank(ranked: DataFrame, questions: DataFrame, texts: DataFrame, keep: int = 8) -> DataFrame:
    """Lexical rerank of fused rows: 1 a term in snippet, heading or name, 2 more in the heading, 0.75 in the name, and 1/(rank0 + 100)."""
    met = ranked.join(texts.select("chunk_id", "heading", "snippet"), "chunk_id").join(F.broadcast(questions), "query_id")
    heading, stem = F.lower("heading"), F.lower(path_stem(F.col("path")))
    hay = F.concat_ws(" ", F.lower("snippet"), heading, stem)
    terms = F.array_distinct(F.filter(F.transform(F.split(F.lower("query"), r"[\s,、。・/\\]+"), F.trim), lambda t: F.length(t) >= 2))
    gain = F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.when(F.contains(hay, t), 1.0).otherwise(0.0) + F.when(F.contains(heading, t), 2.0).otherwise(0.0) + F.when(F.contains(stem, t), 0.75).otherwise(0.0))
    scored = met.withColumn("rerank_score", F.round(F.col("rrf_score") + gain + 1.0 / (F.col("rank0") + 100), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank0")
    out = scored.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= keep)
    return out.select("query_id", "chunk_id", "rerank_score", "place", F.array_join(F.array_sort(F.array_union(F.split("source", r"\+"), F.array(F.lit("rerank")))), "+").alias("source"))


def select_candidates(ranked: DataFrame, per_path: int = 8, total: int = 40) -> DataFrame:
    """Every row with its fate: selected, per_file_limit or total_limit. Both limits follow rank order, so two windows are exact."""
    path = Window.partitionBy("query_id", "path").orderBy("rank0")
    marked = ranked.withColumn("_k", F.row_number().over(path))
    kept = F.sum(F.when(F.col("_k") <= per_path, 1).otherwise(0)).over(Window.partitionBy("query_id").orderBy("rank0").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_n", kept).withColumn("fate", F.when(F.col("_k") > per_path, "per_file_limit").when(F.col("_n") > total, "total_limit").otherwise("selected")).drop("_k", "_n")
