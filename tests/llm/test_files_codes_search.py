"""Token files, vector codes and lexical search against brute force, on rows that hold every awkward case."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lexical, queries, tokenfile, vectors

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402

SMALL = "/root/testdata/sf0.001"
WORDS = P.path("word_bpe_49k.json")
TEXTS = [
    "The quick brown Fox don't JUMP over the lazy dog",
    None,
    "",
    " \n\t ",
    "The quick brown Fox don't JUMP over the lazy dog",
    "non breaking blank \u001cseparated é é 漢字 🙂 ²③ <|endoftext|> ΑΣ ǅ 1234",
    "thing of a long text with words. " * 6000,
    "x" * 5000,
    "... !!! ---",
    "dog dog dog fox",
]
COLUMNS = "doc_id long, text string, key string, number long, ids string, part long, terms string, score long, rank int, id long, item string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "k", 1, "x", 2, "t", 3, 4, 5, "i") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (3, "another text of id three", "k", 1, "x", 2, "t", 3, 4, 5, "i"), (None, "no id here", "k", 1, "x", 2, "t", 3, 4, 5, "i"), (None, None, *rows[0][2:])], COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


# ---- token files


def test_variable_length_coding():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = tokenfile.pack(values)
        assert len(control) == -(-n // 4) and len(data) == sum(max(1, -(-int(v).bit_length() // 8)) for v in values)
        for step in (1, 7, 1 << 20):
            assert (tokenfile.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n, step) == values).all()


def slow_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(slow_ids, "t"):
        slow_ids.t = Tokenizer.from_file(WORDS)
    return [*slow_ids.t.encode(text or "", add_special_tokens=False).ids, 1]


def files_brute(rows):
    """Rows as (id, text): ids ascending, missing ones first, equal ids by the digest of their token ids."""
    made = [(i, slow_ids(t)) for i, t in rows]
    made.sort(key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(np.array(x[1], "<u2").tobytes())))
    out, start = [], 0
    for i, ids in made:
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, docs, none, tmp_path):
    want = files_brute([(r.doc_id, r.text) for r in docs.collect()])
    got = tokenfile.token_files(docs, WORDS)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and dict(got.dtypes)["doc_id"] == "bigint"
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert tokenfile.token_files(none, WORDS).collect() == []
    folder = f"file://{tmp_path}/small"
    tokenfile.write_ids(tokenfile.encode(docs, WORDS, 1), folder, ids_a_file=40, partitions=3)  # many files of many parts
    back = tokenfile.read_ids(spark, folder, "long").orderBy("start").collect()
    assert [tuple(r)[:4] for r in back] == want
    assert back[-1].ids[-1] == 1 and sum(len(r.ids) for r in back) == sum(r[2] for r in want)
    assert Counter(tuple(r.ids) for r in back) == Counter(tuple(slow_ids(r.text)) for r in docs.collect())


def test_token_files_rank_ids_by_frequency(docs):
    table, total = tokenfile.frequency_ranks(tokenfile.encode(docs, WORDS, 1))
    count = Counter(x for r in docs.collect() for x in slow_ids(r.text))
    assert table.tolist() == sorted(count, key=lambda i: (-count[i], i)) and total == sum(count.values())


def test_token_files_copies_of_one_id_spread(spark, tmp_path):
    rows = spark.range(4000).selectExpr("cast(null as long) as doc_id", "'the same text' as text")
    folder = f"file://{tmp_path}/copies"
    tokenfile.write_ids(tokenfile.encode(rows, WORDS, 1), folder, partitions=4)
    parts = spark.read.parquet(f"{folder}/parts").collect()
    assert len(parts) == 4 and max(p.ids for p in parts) < 0.5 * sum(p.ids for p in parts)
    assert tokenfile.read_ids(spark, folder).count() == 4000


def test_token_files_damage_is_seen():
    whole = tokenfile.file_bytes(0, 0, [b"1", None], [2, 1], np.array([5, 300, 70000]))
    part, base, keys, sizes, ranks = tokenfile.parse_file(memoryview(whole))
    assert (keys, sizes.tolist(), ranks.tolist()) == (["1", None], [2, 1], [5, 300, 70000])
    for bad in (whole[:-1], whole[:-1] + b"\xff", b"x" * 100, b""):
        with pytest.raises(ValueError):
            tokenfile.parse_file(memoryview(bad))


def test_encoder_forgets_and_stays_right():
    few = tokenfile.Encoder(WORDS, most=5, longest=6)
    for t in TEXTS:
        assert np.frombuffer(few([t])[0], few.kind).tolist() == slow_ids(t)[:-1]


def test_encoder_is_the_librarys_on_random_strings():
    import random

    rng, own = random.Random(2), tokenfile.Encoder(WORDS, most=2000)
    letters = "abcIİéE\u0301ßΣς' .,;:!?\n\u00a0\u001c<|>12²漢字🙂-)ſK"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|> A.b <|ENDOFTEXT|>", "THE Cat's, isn't.) we'LL!?"]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        assert [np.frombuffer(x, own.kind).tolist() for x in own(part)] == [slow_ids(t)[:-1] for t in part]


# ---- vector codes


def codes_brute(rows, parts=4, entries=256, rounds=4):
    """Rows as (id, vector, label); plain Python integers."""
    ok = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) and abs(x) < 2**52 for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    if not ok:
        return [], []
    w = len(ok[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in ok]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for c in cut:
                own[near(c[p], books[p])[0]].append(c[p])
            books[p] = [[sum(col) // len(o) for col in zip(*o)] if o else e for o, e in zip(own, books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for _, d in f) for f in found]
    by = Counter()
    for r, e in zip(ok, errors):
        by[r[2]] += e
    big = lambda e: e if e < 2**63 else None
    return [(r[0], "".join(f"{c:02x}" for c, _ in f), big(e), big(by[r[2]]), vectors.digest(books)) for r, f, e in zip(ok, found, errors)], books


def vector_rows(n=400, width=8, scale=1.0):
    rng = np.random.default_rng(3)
    return [(int(i), [float(x) for x in np.float32(rng.normal(0, scale, width))], int(rng.integers(0, 5)) if i % 7 else None) for i in rng.permutation(n)]


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e9])  # one limb, several, and beyond what int64 distances hold
def test_vector_codes(spark, scale):
    rows = vector_rows(scale=scale)
    rows += [rows[0], (5, [0.5] * 8, 1), (None, [0.25] * 8, 1), (600, None, 1), (601, [], 1), (602, [1.0] * 7, 1), (603, [1.0] * 7 + [None], 1), (604, [1.0] * 7 + [float("nan")], 1), (605, [1.0] * 7 + [float("inf")], 1), (606, [1.0] * 12, 1), (607, [0.0] * 7 + [1e30], 1)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, v long")
    got, books = vectors.compress(table)
    want, slow_books = codes_brute(rows)
    assert Counter(map(tuple, got.collect())) == Counter(want) and books == slow_books
    assert len(vectors.decode(got.first().code, books)) == 8


def test_vector_codes_few_and_none(spark):
    kind = "vec_id long, embedding array<double>, label string"
    rows = [(2, [1.0, 2.0, 3.0, 4.0], "a"), (1, [1.0, 2.0, 3.5, -4.0], None), (3, [1.0, 2.0, 3.5, -4.0], None)]
    got, books = vectors.compress(spark.createDataFrame(rows, kind))
    assert Counter(map(tuple, got.collect())) == Counter(codes_brute(rows)[0])
    assert vectors.compress(spark.createDataFrame([], kind))[0].collect() == []
    assert vectors.compress(spark.createDataFrame([(1, None, "a")], kind))[0].collect() == []


def test_limb_products_are_exact():
    rng = np.random.default_rng(5)
    for width in (1, 16, 1000):
        bits = vectors.limb_bits(width)
        assert width << (2 * bits) < 1 << 53
        for size in (10, bits, bits + 1, 30, 50, 62):
            a, b = rng.integers(-(1 << size), 1 << size, (7, width)), rng.integers(-(1 << size), 1 << size, (width, 5))
            got = vectors.dots(vectors.limbs(a, bits), vectors.limbs(b, bits), bits)
            exact = a.astype(object) @ b.astype(object)
            assert all(int(g) % 2**64 == e % 2**64 for g, e in zip(got.ravel(), exact.ravel()))
            assert all(abs(x).max() <= 1 << bits for x in vectors.limbs(a, bits))


# ---- lexical search


def search_brute(docs, items, k=10):
    cut = lambda t: [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    words = [(i, cut(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(cut(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, w in words:
            tf = Counter(w)
            m = 10 + 90 * len(w) * n_docs // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


def test_lexical_search(spark, docs, none):
    items = [(1, "the lazy dog"), (2, "fox FOX"), (3, None), (4, ""), (5, "absent words"), (6, "é 漢字 text"), (6, "long"), (None, "no id"), (7, "... !"), (1, "the lazy dog")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, terms string")
    want = Counter(search_brute([(r.doc_id, r.text) for r in docs.collect()], items))
    for size in ({}, {"block": 3}):
        index = lexical.build_index(docs, **size)
        for chars in (4_000_000, 20):
            assert Counter(map(tuple, lexical.search(index, bench, block_chars=chars).collect())) == want
    assert lexical.search(lexical.build_index(none), bench).collect() == []
    assert lexical.search(index, bench.limit(0)).collect() == []


def test_lexical_search_with_ties_and_skew(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(int(i), " ".join(rng.choice(vocabulary, int(rng.integers(1, 40)), p=np.arange(60, 0, -1) / 1830))) for i in range(700)]
    rows += [(1000 + i, "w5 w6 w50") for i in range(400)] + [(5, "w5 w6 w50")]
    items = [(i, " ".join(rng.choice(vocabulary, 6))) for i in range(20)] + [(50, "w5 w6 w50"), (51, "w0")]
    index = lexical.build_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=300)
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), k=7)
    assert Counter(map(tuple, got.collect())) == Counter(search_brute(rows, items, 7))


def test_best_positions_stop_early():
    """A list whose first place alone matters is not read to its end, and the bound is the sum at the best positions."""
    n = 4000
    docs, counts = np.tile(np.arange(n, dtype=np.int32), 2), np.concatenate([np.arange(n, 0, -1), np.arange(n, 0, -1)]).astype(np.int32)
    lists = lexical.Lists(np.array([3, 5]), np.array([0, 1]), np.array([0, n, 2 * n]), docs, counts, np.full(n, 800))
    top, scores, read = lists.best(np.array([0, 1]), 10)
    assert top.tolist() == list(range(10)) and read < 200
    assert scores.tolist() == [8 * (10**9 * (n - i) // (1000 * (n - i) + 800)) for i in range(10)]


def test_registered_queries_run(spark, same):
    for name in ("op12_vector_codes", "op13_best_position"):
        same(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name])
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op11_token_files(spark, SMALL).collect())) == files_brute(rows)


def test_large_rows_lie_in_blocks_of_their_own(spark):
    """Segments are rows of some MB: a hundred of them in one block of a file would have to fit into a task's memory."""
    from urllib.parse import unquote, urlparse

    import pyarrow.parquet as pq

    from tessera.llm import decontaminate

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(120_000)), lambda k: F.hex(k * 7919 + F.col("id") * 104_729)), " ")
    docs = spark.range(0, 24, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    for index in (decontaminate.build_index(docs, size=900_000), lexical.build_index(docs, size=900_000)):
        groups = [g for f in index.inputFiles() for m in [pq.ParquetFile(unquote(urlparse(f).path)).metadata] for g in (m.row_group(i) for i in range(m.num_row_groups))]
        assert index.count() == sum(g.num_rows for g in groups) == 24
        assert max(g.total_byte_size for g in groups) < 24 << 20 and len(groups) > 1
