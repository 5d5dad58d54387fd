"""The stages of corpus_pipeline against brute force, on rows that hold every awkward case."""

import hashlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tessera.llm import quality  # noqa: E402
from tests.llm.test_operators import LONG, jaccard, reference, slow_hits, slow_spread  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, held_out string, n_lines string, n_dropped string, th string, row string, key string, id string"


@pytest.fixture(scope="module")
def docs(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    own = lambda k: " ".join(f"{k}word{i}" for i in range(30))
    texts = [own("a"), own("a"), own("a") + " more", None, "", "  \n", LONG, item, own("b") + "\nshared line\n" + own("c"), *(f"{own(f'd{k}')}\nshared line" for k in range(6)), item + " " + own("e")]
    rows = [(i, t, "en", f"s{i}") for i, t in enumerate(texts)] + [(None, own("n"), "de", "s1"), (None, own("a"), "de", "s2"), (None, item, "de", "s3"), (4, own("other"), None, None), (0, texts[0], "en", "s0")]
    frame = spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * 9) for r in rows], COLUMNS)
    return frame.repartition(3).cache()


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables_stay_empty(spark, docs, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_are_passed_on(spark, docs, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert out.dtypes == docs.dtypes
    assert {r.score for r in out.collect()} <= {"x"}


def test_quality_stage(spark, docs):
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(table, marks, metadata=["n_chars"])
    want = quality.score(table, model, metadata=["n_chars"]).where("score >= 0.3").select("doc_id").collect()
    got = corpus_pipeline.keep_quality(spark, table, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want)
    seen = quality.train(docs, marks, metadata=["n_chars"])
    kept = quality.score(docs.select("doc_id", "text", "n_chars"), seen, metadata=["n_chars"], keep=["text"]).where("predicted = 1")
    assert rows_of(corpus_pipeline.keep_quality(spark, docs, SF)) == rows_of(kept)


def test_line_stage(spark, docs):
    apart = docs.withColumn("doc_id", F.monotonically_increasing_id())
    want = slow_spread([(r.doc_id, r.text, r.source) for r in apart.collect()], 5)
    got = corpus_pipeline.drop_boilerplate(spark, apart, SF).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text or "") for r in got) and all(r.n_lines == r.n_dropped == "x" for r in got)
    assert corpus_pipeline.drop_boilerplate(spark, docs, SF).count() == docs.count()


def test_near_copy_stage(spark, docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    root = list(range(len(rows)))
    blank = lambda t: not t.split()
    for b in range(len(rows)):
        for a in range(b):
            x, y = rows[a][1], rows[b][1]
            if (blank(x) and blank(y)) or (not blank(x) and not blank(y) and jaccard(x, y) >= 0.8):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    groups = {}
    for k, r in enumerate(root):
        groups.setdefault(r, []).append((rows[k][0] is None, rows[k][0] or 0, hashlib.md5(rows[k][1].encode()).hexdigest()))
    want = sorted(min(g) for g in groups.values())
    got = sorted((r.doc_id is None, r.doc_id or 0, hashlib.md5((r.text or "").encode()).hexdigest()) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
    assert got == want


def test_contamination_stage(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = lambda t: (lambda n, h, *_: h > 0 and 20 * h >= n)(*slow_hits(t, items))
    want = sorted(((r.doc_id, r.text) for r in docs.collect() if r.text == LONG or not bad(r.text)), key=str)
    assert rows_of(corpus_pipeline.drop_contaminated(spark, docs, SF)) == want


def test_encoding_stage(spark, docs):
    ref = reference()
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.encode(spark, docs, SF).collect()}
    assert got == {(r.doc_id, len(ref.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()}


def test_run(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SF)
    want = {r.doc_id for r in table.collect()}
    got = corpus_pipeline.run(spark, SF)
    assert got.count() == len(want) and {r.doc_id for r in got.collect()} == want
