"""SimHash fingerprints linked within a Hamming radius by vantage-point trees.

A node of the tree holds a vantage point and one block of bits and splits its points by their exact distance to the
vantage point in that block. For fingerprints within radius r the distances to the vantage point differ, summed over
disjoint blocks, by at most r (the triangle inequality in each block), so a query that has used up its r on the way down
leaves a branch. The first levels of the tree, over blocks of 16 bits, are the shards of a Spark job: every point lives in
the shard of its distances and visits the later shards that its triangle bound reaches. In a shard, the same tree over
single bytes prunes further, and the pairs that remain are compared exactly. A shard sends on a spanning forest of its
links, never the pairs of a group; components come from repeated large-star and small-star steps with checkpoints.

Equal fingerprints collapse before the search, so a group of copies is one point. Null texts count as empty: no words,
fingerprint zero, linked like any other. Repeated rows share a class; rows without an id get the class of the others but
never name it (null if nobody else is in it). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, give_back, join_by_class, map_batches, materialize

SHINGLE, SEED, RADIUS = 3, 42, 3


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64 bits: each is 1 if over half of the hashes of word shingles have it."""
    words = text.lower().split()  # bytes: A-Z only, split at 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) < size:
        parts = [joined]
    else:
        starts = np.concatenate([[0], ends[:-size] + 1]).tolist()
        parts = [joined[a:b] for a, b in zip(starts, ends[size - 1 :].tolist())]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(p, SEED) for p in parts], ">u8"))


def majority(hashes: np.ndarray) -> int:
    """64 bits: each is 1 if over half of the hashes have it."""
    hashes, counts = hashes.astype(">u8", copy=False), np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the fingerprint's bits as a signed long."""

    def start():
        return lambda cols: [cols[0], [signed(fingerprint(t.encode("utf-8", "surrogatepass"))) for t in cols[1]]]

    return map_batches(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__t")), f"{id_col} {dict(docs.dtypes)[id_col]}, fp long", start, 256)


def block_distances(points: np.ndarray, vantage: int, bits: int) -> np.ndarray:
    """Distances to the vantage point in each block of `bits` bits (8 or 16): one row a point, high block first."""
    apart = points ^ np.uint64(vantage)
    kind = ">u1" if bits == 8 else ">u2"
    return np.bitwise_count(apart.astype(">u8").view(kind).reshape(len(points), 64 // bits)).astype(np.int64)


class Tree:
    """A vantage-point tree over bytes, kept as the sorted order of its points; node = range of points with one prefix."""

    def __init__(self, points: np.ndarray, vantage: int):
        self.vantage = vantage
        keys = self.keys(block_distances(points, vantage, 8))
        self.order = np.argsort(keys, kind="stable")
        self.sorted, self.points = keys[self.order], points[self.order]

    @staticmethod
    def keys(distances: np.ndarray) -> np.ndarray:
        key = np.zeros(len(distances), np.int64)
        for j in range(8):
            key = key * 9 + distances[:, j]
        return key

    def within(self, queries: np.ndarray, radius: int, few: int = 12):
        """Yields (query indices, point indices) of all pairs within the radius, some queries at a time."""
        far = block_distances(queries, self.vantage, 8)
        for at in range(0, len(queries), 1024):
            q = np.arange(at, min(at + 1024, len(queries)))
            prefix, left = np.zeros(len(q), np.int64), np.full(len(q), radius, np.int64)
            ready = []
            for level in range(8):
                grown = []
                for step in range(-radius, radius + 1):
                    child = far[q, level] + step
                    go = (left >= abs(step)) & (child >= 0) & (child <= 8)
                    grown.append((q[go], prefix[go] * 9 + child[go], left[go] - abs(step)))
                q, prefix, left = (np.concatenate(x) for x in zip(*grown))
                span = 9 ** (7 - level)
                lo, hi = np.searchsorted(self.sorted, prefix * span), np.searchsorted(self.sorted, (prefix + 1) * span)
                small = (hi > lo) & ((hi - lo <= few) | (level == 7))
                ready.append((q[small], lo[small], hi[small]))
                on = (hi > lo) & ~small
                q, prefix, left = q[on], prefix[on], left[on]
            q, lo, hi = (np.concatenate(x) for x in zip(*ready))
            size = hi - lo
            for a in range(0, len(q), 65536):  # a node may hold many points: pairs are made in blocks
                yield from self._compare(queries, q[a : a + 65536], lo[a : a + 65536], size[a : a + 65536], radius)

    def _compare(self, queries, q, lo, size, radius, most: int = 4_000_000):
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1).tolist(), len(q)]
        for a, b in zip(cuts, cuts[1:]):
            n = size[a:b]
            if not len(n):
                continue
            who = np.repeat(q[a:b], n)
            point = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[a:b], n)
            near = np.bitwise_count(queries[who] ^ self.points[point]) <= radius
            yield who[near], self.order[point[near]]


def shard_links(home: np.ndarray, visitors: np.ndarray, radius: int = RADIUS, direct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among home points, and of those to visitors: every point with its root or, if `direct`, links themselves."""
    queries = np.concatenate([home, visitors])
    n = len(queries)
    if n < 2 or not len(home):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    root = np.arange(n)
    tree, used = Tree(home, int(home[len(home) // 2])), [np.zeros((2, 0), np.int64)]
    for a, b in tree.within(queries, radius):
        root = _join(root, a, b, used if direct else None)
    if direct:
        a, b = np.concatenate(used, axis=1)
        return queries[a], queries[b]
    other = np.flatnonzero(root != np.arange(n))
    return queries[other], queries[root[other]]


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray, used: list[np.ndarray] | None = None) -> np.ndarray:
    """Union of pairs by hooking larger roots to smaller ones and halving paths; `used` takes the pair behind every hook."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        if used is not None:
            hooks = np.flatnonzero(root[np.maximum(x, y)] == np.minimum(x, y))
            hooks = hooks[np.unique(np.maximum(x, y)[hooks], return_index=True)[1]]
            used.append(np.stack([a[hooks], b[hooks]]))
        while not np.array_equal(root, up := root[root]):
            root = up


def links(points: DataFrame, radius: int = RADIUS, shard_points: int = 60_000, direct: bool = False) -> DataFrame:
    """(a long, b long): links between distinct fingerprints whose components are those of all pairs within the radius; such pairs themselves if `direct`.

    points: distinct fp long. The number of shard levels grows until no shard is home to over `shard_points` points:
    four levels of 17 distances to a vantage point, then four to a second one, each vantage point with a triangle bound of its own.
    """
    spark = points.sparkSession
    first = [r[0] for r in points.orderBy(F.xxhash64("fp"), "fp").limit(2).collect()]  # the vantage points of the top levels
    if len(first) < 2:
        return spark.createDataFrame([], "a long, b long")
    apart = [F.col("fp").bitwiseXOR(F.lit(v)) for v in first]
    far = [F.bit_count(F.shiftrightunsigned(x, 48 - 16 * j).bitwiseAND(F.lit(0xFFFF).cast("long"))).cast("int") for x in apart for j in range(4)]
    for levels in range(1, 9):
        home = points.select("fp", *(d.alias(f"d{j}") for j, d in enumerate(far[:levels])))
        keys = [f"d{j}" for j in range(levels)]
        most = home.groupBy(keys).count().agg(F.max("count")).first()[0]
        if most <= shard_points:
            break
    steps = [()]
    for _ in range(levels):
        steps = [(*s, d) for s in steps for d in range(-radius, radius + 1) if sum(map(abs, (*s, d)[4 * (len(s) // 4) :])) <= radius]
    steps = [s for s in steps if s > (0,) * levels]  # a pair in two shards meets in the later one only
    move = F.explode(F.array(*(F.struct(*(F.lit(d).alias(k) for k, d in zip(keys, s))) for s in steps)))
    visits = home.select("fp", *keys, move.alias("m")).select("fp", *((F.col(k) + F.col(f"m.{k}")).alias(k) for k in keys), F.lit(False).alias("home"))
    visits = visits.where(" and ".join(f"{k} between 0 and 16" for k in keys))
    lives = home.groupBy(keys).count().select(*keys)  # visits to shards nobody lives in are not sent
    rows = home.withColumn("home", F.lit(True)).unionByName(visits.join(lives, keys, "left_semi"))

    def search(table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy().astype(np.int64).view(np.uint64)
        here = table["home"].to_numpy()
        a, b = shard_links(fp[here], fp[~here], radius, direct)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return rows.groupBy(keys).applyInArrow(search, "a long, b long")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): the least node of each component, by alternating large-star and small-star steps."""
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(most):
        sides = both(now)
        low = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sides.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = materialize(small.select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        stars = now.agg(F.count("*"), F.countDistinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if stars == seen or not stars[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = stars
    raise RuntimeError(f"components did not settle in {most} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row a document: id, fp, component_id (the least id reachable by links within the radius)."""
    marked = materialize(simhash(docs, id_col, text_col), "simhash")
    classes = marked.groupBy("fp").agg(F.min(id_col).alias("__least"), F.count("*").alias("n"))
    roots = components(links(classes.select("fp"), radius))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "n", "__least", F.coalesce("root", "fp").alias("__root"))
    groups = named.groupBy("__root").agg(F.min("__least").alias("component_id"))
    joined = materialize(named.join(groups, "__root").select("fp", "n", "component_id"), "classes")
    return join_by_class(marked, joined, "fp", marked.count()).select(id_col, "fp", "component_id")


# ---- word-shingle similarity: links of the tree, an exact prefix join for what lies outside its radius, all checked, components


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """The set of shingles as ascending 64-bit hashes."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + size]), SEED) for i in range(max(1, len(words) - size + 1))] if words else [], np.uint64))


SKETCH = 256


def sketch(hashes: np.ndarray) -> bytes:
    """How many members of a set fall into each of 256 parts of the hashes' range. Two sets share no more members than the lesser counts add up to."""
    return np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=SKETCH).astype("<u4").tobytes()


def may_be_similar(x: list[bytes], y: list[bytes], similarity: float) -> np.ndarray:
    """Whether the sketches of two sets leave room for the similarity."""
    a, b = (np.frombuffer(b"".join(side), "<u4").reshape(-1, SKETCH).astype(np.int64) for side in (x, y))
    most = np.minimum(a, b).sum(1)
    return most >= similarity * (a.sum(1) + b.sum(1) - most) - 1e-9


def prefix_size(n: int, similarity: float) -> int:
    """Sets of the similarity share one of so many first members at least, in any order that holds for all sets."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def whole_lists(batches) -> Iterator[list[np.ndarray]]:
    """Columns of Arrow batches sorted by their first column, cut only where that column changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if held and held[0][0][0] == cols[0][-1]:
            held.append(cols)  # one list that goes on
            continue
        last = [c[cut:] for c in cols]
        held.append([c[:cut] for c in cols])
        yield [np.concatenate(c) for c in zip(*held)]
        held = [last]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def room(n, p, i, j, similarity: float) -> np.ndarray:
    """Whether sets i and j (i not larger) may have the similarity if the list's member is their first common one: the rest of the overlap lies behind it."""
    need = np.ceil(similarity / (1 + similarity) * (n[i] + n[j]) - 1e-9)
    return (n[i] >= similarity * n[j] - 1e-9) & (np.minimum(n[i] - p[i], n[j] - p[j]) >= need)


def with_partner(h, n, p, similarity: float, reach: int = 256) -> np.ndarray:
    """Rows of lists that have a partner with room; in lists of over `reach` rows all are taken."""
    keep = np.zeros(len(h), bool)
    for d in range(1, reach + 1):
        i = np.flatnonzero(h[:-d] == h[d:])
        if not len(i):
            return keep
        i = i[room(n, p, i, i + d, similarity)]
        keep[i] = keep[i + d] = True
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(starts, len(h)))
    return keep | np.repeat(size > reach, size)


def list_pairs(h, n, p, r, label, low: int, high: int, similarity: float) -> tuple[np.ndarray, bool]:
    """Pairs of different labels over `low` and at most `high` places apart in a list that may have the similarity; and whether some lie further apart.

    h: list, n: size of the set, p: place in the set's order, r: row. Lists are sorted by size. A pair's first common member leaves
    room for the rest of the overlap behind it in both sets, so every similar pair is found in that member's list.
    """
    out = [np.zeros((0, 2), np.int64)]
    for d in range(low + 1, high + 1):
        same = np.flatnonzero(h[:-d] == h[d:])
        if not len(same):
            return np.unique(np.concatenate(out), axis=0), False
        i = same[label[same] != label[same + d]]
        j = i + d
        ok = room(n, p, i, j, similarity)
        out.append(np.sort(np.column_stack([r[i[ok]], r[j[ok]]]), axis=1))
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    long = np.diff(np.append(starts, len(h))) > high + 1
    mixed = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
    return np.unique(np.concatenate(out), axis=0), bool((long & mixed).any())


def frequent_shingles(texts: DataFrame, words: int, sample: int = 20_000, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes and counts of shingles that are frequent in a sample. They only order the members of sets: results don't depend on them."""
    step = max(1, texts.count() // (sample + texts.count() // 64))

    def start():
        return lambda cols: [[shingle_hashes(t.encode("utf-8", "surrogatepass"), words).view(np.int64) for t in cols[0]]]

    some = texts.where(F.pmod(F.xxhash64("t"), F.lit(step)) == 0).select("t")
    found = map_batches(some, "h array<long>", start, 128).select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c >= 3")
    table = found.orderBy(F.desc("c"), "h").limit(most).toArrow()
    hot, count = table["h"].to_numpy().view(np.uint64), table["c"].to_numpy()
    order = np.argsort(hot)
    return hot[order], count[order]


def tree_pairs(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of classes with fingerprints within the radius, as many as keep the components of all such pairs; the lesser number first.

    classes: r, a number, and fp. Classes of one fingerprint are paired with the least of them, fingerprints that the tree links by their least classes.
    """
    points = materialize(classes.groupBy("fp").agg(F.min("r").alias("least"), F.count("*").alias("n")), "points")
    equal = join_by_class(classes.select("fp", "r"), points, "fp", classes.count()).where("r > least").select(F.col("least").alias("a"), F.col("r").alias("b"))
    near = links(points.select("fp"), radius, direct=True)
    for end in ("a", "b"):
        near = near.join(points.select(F.col("fp").alias(end), F.col("least").alias(f"of_{end}")), end)
    return equal.unionByName(near.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))).distinct()


def similar_rows(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """(i: id, th: MD5 of the text, row: a stored number, root: the same for all rows of a component), one row a row of docs.

    Rows of equal sets of shingles are one point. The vantage-point tree gives the pairs of points whose fingerprints (bits that over half of a set's
    hashes have) lie within RADIUS bits; those that hold on the whole sets unite points first. What lies outside the radius is found exactly:
    two sets of the similarity share one of their first members (prefix_size) in an order
    that holds for all sets: frequent shingles last, then by hash. Points therefore meet in the lists of those members. Pairs of
    a list that the tree left apart are checked on the whole sets too, and only links that hold unite points. Pairs a few places apart come first, then further ones, where
    their ends are still apart: every pair that a list holds has been checked or is connected in the end, and a group of copies is
    connected before its pairs are many.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = docs.select(F.col(id_col).alias("i"), F.md5(text.cast("binary")).alias("th"), text.alias("t"))
    shared = spark.sparkContext.broadcast(frequent_shingles(made, words))

    def start():
        hot, count = shared.value

        def work(cols):
            keys, sizes, firsts, sketches, bits = [], [], [], [], []
            for t in cols[2]:
                h = shingle_hashes(t.encode("utf-8", "surrogatepass"), words)
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                times = np.zeros(len(h), np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    times = np.where(hot[at] == h, count[at], 0)
                sizes.append(len(h))
                firsts.append(h[np.lexsort((h, times))[: prefix_size(len(h), similarity)]].view(np.int64))
                sketches.append(sketch(h))
                bits.append(signed(majority(h)))
            return [cols[0], cols[1], cols[3], keys, sizes, firsts, sketches, bits]

        return work

    numbered = made.withColumn("row", F.monotonically_increasing_id())
    marked = materialize(map_batches(numbered, f"i {kind}, th string, row long, key binary, n long, first array<long>, sketch binary, fp long", start, 128), "marked", "zstd")
    classes = materialize(marked.groupBy("key").agg(F.min("row").alias("r"), F.count("*").alias("n"), F.min("fp").alias("fp")), "keys")
    points = marked.join(classes.select(F.col("r").alias("row")), "row", "left_semi")
    postings = points.select(F.col("row").alias("r"), "n", F.posexplode("first").alias("p", "h")).select("h", "n", F.col("p").cast("long").alias("p"), "r")

    def met(batches):
        for h, *rest in whole_lists(batches):
            keep = with_partner(h, *rest[:2], similarity)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (h, *rest)], names=["h", "n", "p", "r"])
        give_back()

    listed = lambda df: df.repartition("h").sortWithinPartitions("h", "n", "r")
    lists = materialize(listed(postings).mapInArrow(met, "h long, n long, p long, r long"), "lists")

    def of_rows(table: DataFrame, key: Column, rows: DataFrame) -> DataFrame:
        """Rows of a table whose key is among the rows' k: what isn't needed isn't moved if they are few."""
        return table.join(F.broadcast(rows) if rows.count() <= 1_000_000 else rows.hint("shuffle_hash"), key == F.col("k"), "left_semi")

    def ends(links: DataFrame) -> DataFrame:
        return materialize(links.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "ends")

    def room_left(batches):
        for batch in batches:
            keep = may_be_similar(batch.column(2).to_pylist(), batch.column(3).to_pylist(), similarity) if batch.num_rows else np.zeros(0, bool)
            yield batch.select([0, 1]).filter(pa.array(keep))

    def close(links: DataFrame) -> DataFrame:
        """Links that the sketches of their ends allow."""
        own = of_rows(marked.select("row", "sketch"), F.col("row"), ends(links))
        both = links.join(own.select(F.col("row").alias("a"), F.col("sketch").alias("x")), "a").join(own.select(F.col("row").alias("b"), F.col("sketch").alias("y")), "b")
        return materialize(both.select("a", "b", "x", "y").mapInArrow(room_left, "a long, b long"), "close")

    def whole():
        return lambda cols: [cols[0], [shingle_hashes(t.encode("utf-8", "surrogatepass"), words).view(np.int64) for t in cols[1]]]

    def similar(links: DataFrame) -> DataFrame:
        """Links that hold on the whole sets of their ends, worked out anew from the texts."""
        members = materialize(of_rows(marked.select("row", "th"), F.col("row"), ends(links)), "members")
        some = of_rows(made, F.xxhash64("th"), members.select(F.xxhash64("th").alias("k")).distinct())
        texts = some.join(members.select("th").distinct().hint("shuffle_hash"), "th", "left_semi").groupBy("th").agg(F.min("t").alias("t"))
        sets = materialize(map_batches(texts.join(members, "th").select("row", "t"), "r long, s array<long>", whole, 64), "sets")
        both = links.join(sets.select(F.col("r").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("r").alias("b"), F.col("s").alias("y")), "b")
        shared_by = F.size(F.array_intersect("x", "y"))
        return materialize(both.where(shared_by >= similarity * (F.size("x") + F.size("y") - shared_by) - 1e-9).select("a", "b"), "sure")

    roots = spark.createDataFrame([], "node long, root long")
    tried, low, high, more = materialize(tree_pairs(classes), "tree"), 0, 4, True
    sure = similar(close(tried))
    if sure.limit(1).count():
        roots = components(sure)
    while more:

        def pairs(batches, low=low, high=high):
            for columns in whole_lists(batches):
                found, rest = list_pairs(*columns, low, high, similarity)
                found = np.concatenate([found, [[-1, -1]]]) if rest else found  # the mark of pairs further apart
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])
            give_back()

        now = lists.join(roots, lists.r == roots.node, "left").select("h", "n", "p", "r", F.coalesce("root", "r").alias("label"))
        found = listed(now).mapInArrow(pairs, "a long, b long").distinct()
        found = materialize(found.join(tried, ["a", "b"], "left_anti"), "pairs")
        more = bool(found.where("a < 0").limit(1).count())
        found = found.where("a >= 0")
        sure = similar(close(found))
        if sure.limit(1).count():
            roots = components(sure.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        tried, low, high = tried.unionByName(found), high, 8 * high
    named = classes.join(roots, classes.r == roots.node, "left").select("key", "n", F.coalesce("root", "r").alias("root"))
    return join_by_class(marked.select("i", "th", "row", "key"), materialize(named, "named"), "key", marked.count()).select("i", "th", "row", "root")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id): documents linked where the sets of word shingles have a Jaccard similarity of `similarity` or more, exactly.

    component_id is the least id of the component, null if nobody in it has one.
    """
    rows = materialize(similar_rows(docs, id_col, text_col, words, similarity), "classes")
    least = materialize(rows.groupBy("root").agg(F.min("i").alias("component_id"), F.count("*").alias("n")), "least")
    return join_by_class(rows, least, "root", rows.count()).select(F.col("i").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The document of least id of every component of similar_documents, with all its columns.

    Rows are told apart by id and text. Of a component without ids one row stays; of rows equal in id and text, one.
    """
    rows = materialize(similar_rows(docs, id_col, text_col, words, similarity), "classes")
    own = F.struct(F.col("i").isNull().alias("none"), "i", "th")
    least = materialize(rows.groupBy("root").agg(F.min(own).alias("kept"), F.count("*").alias("n")), "least")
    key, th = fresh_names(docs.columns, 2)
    out = join_by_class(rows, least, "root", rows.count()).where(~own.eqNullSafe(F.col("kept"))).select(F.col("i").alias(key), F.col("th").alias(th)).distinct()
    of_text = F.md5(F.coalesce(docs[f"`{text_col}`"], F.lit("")).cast("binary"))
    kept = docs.join(out.hint("shuffle_hash"), (of_text == out[th]) & docs[f"`{id_col}`"].eqNullSafe(out[key]), "left_anti")  # keys are small beside texts
    repeated = rows.groupBy("i", "th").count().where("count > 1").limit(1).count()
    return kept.withColumn(th, F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))).dropDuplicates([id_col, th]).drop(th) if repeated else kept
