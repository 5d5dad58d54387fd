"""Operators on literal cases whose results follow from their rules."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import claims, evidence, index, rank, state, structure
from tessera.operators.chunk import fold_lines
from tessera.sources import corpus
from tessera.streaming import jobs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


def test_terms_of_scripts_without_spaces(spark):
    assert one(spark, T.split_terms(F.col("a")), a="出張旅費の精算/VPN 接続") == ["出張旅費の精算", "出張旅費", "精算", "vpn", "接続"]
    assert one(spark, T.coverage_terms(F.col("a")), a="日当表 ab") == ["日当", "当表", "ab"]
    assert one(spark, T.content_terms(F.col("a")), a="何名で申請 手順 VPN2") == ["申請", "vpn2"]


def test_splitlines(spark):
    assert one(spark, corpus.split_lines(F.col("a")), a="a\r\nb\x0bc d\n") == ["a", "b", "c", "d"]
    assert one(spark, corpus.split_lines(F.col("a")), a="") == []


def test_bigrams_of_short_needles(spark):
    assert one(spark, T.bigram_coverage(F.col("h"), F.col("n")), h="abc", n="b") == 1.0
    assert one(spark, T.bigram_coverage(F.col("h"), F.col("n")), h="abc", n="") == 0.0
    assert one(spark, T.bigram_coverage(F.col("h"), F.col("n")), h="abcd", n="abx") == 0.5


def test_anchor_has_four_to_twelve_characters(spark):
    assert one(spark, T.lexical_anchor(F.col("a"), F.col("b")), a="xyztravelpolicyxyz", b="thetravelpolicy") == 12
    assert one(spark, T.lexical_anchor(F.col("a"), F.col("b")), a="abc", b="abc") == 0


def test_truncation_splits_no_character(spark):
    assert one(spark, T.truncate_utf8(F.col("a"), 4), a="あいう") == "あ"
    assert one(spark, T.truncate_utf8(F.col("a"), 9), a="あいう") == "あいう"


def test_fold_carries_an_overlap():
    long = "x" * 1999
    got = fold_lines(["# A", long, "tail", "# B", "end"])
    assert [g[:3] for g in got] == [("A", 1, 2), ("A", 2, 3), ("B", 4, 5)]
    assert got[1][3].startswith("x" * 200 + "\n") is True
    assert fold_lines([]) == [] and fold_lines(["", " "]) == []


def test_headings_in_fences_are_text(spark):
    lines = ["# A", "```", "# not", "~~~", "```", "## B ##", "~~~~", "# not", "~~~", "# not"]
    rows = spark.createDataFrame([("p", i, x) for i, x in enumerate(lines, 1)], "path string, line_no long, line string")
    got = structure.headings(rows).orderBy("line_no").collect()
    assert [(r.line_no, r.level, r.heading) for r in got] == [(1, 1, "A"), (6, 2, "B")]


def test_intervals(spark):
    frame = lambda rows: spark.createDataFrame(rows, "path string, start_line long, end_line long")
    rows = lambda d: sorted((r.start_line, r.end_line) for r in d.collect())
    given = frame([("p", 1, 3), ("p", 4, 6), ("p", 9, 12)])
    assert rows(structure.merge_ranges(given)) == [(1, 6), (9, 12)]
    assert rows(structure.subtract_ranges(given, frame([("p", 2, 2), ("p", 6, 9), ("p", 12, 20)]))) == [(1, 1), (3, 5), (10, 11)]
    assert rows(structure.subtract_ranges(given, frame([]))) == [(1, 6), (9, 12)]
    assert [r.covered for r in structure.covered(frame([("p", 2, 5), ("p", 6, 9)]), given).orderBy("start_line").collect()] == [True, False]


def test_conflict_needs_the_condition_itself(spark):
    asked = evidence.conflicts(F.col("q"), F.col("e"))
    assert one(spark, asked, q="海外出張の日当", e="海外出張の日当は支給しない。") is True
    assert one(spark, asked, q="海外出張の日当", e="本規程の日当は支給しない。") is False


def test_fusion_keeps_first_sight_on_ties(spark):
    lists = lambda rows: spark.createDataFrame(rows, "query_id long, chunk_id string, path string, score double, rank0 long")
    got = rank.fuse(lists([(1, "a", "a", 9.0, 0), (1, "b", "b", 5.0, 1)]), lists([(1, "c", "c", 0.9, 0), (1, "b", "b", 0.8, 1)])).orderBy("rank0").collect()
    assert [(r.chunk_id, r.source) for r in got] == [("b", "embedding+keyword"), ("a", "keyword"), ("c", "embedding")]


def test_vectors_that_match_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0]), (5, [3.0, 0.0]), (6, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = rank.cosine_scores(spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, embedding array<float>"), vectors).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1.0), (5, 1.0)]
    assert {r.vec_id: r.usable for r in rank.norms(vectors).collect()} == {1: True, 2: False, 3: False, 4: True, 5: True, 6: False}


def test_slots_go_to_groups_first(spark):
    rows = [(1, f"d{i}", i, None, i) for i in range(8)] + [(1, f"g{i}", 10 + i, "g", i) for i in range(6)]
    got = evidence.allocate_slots(spark.createDataFrame(rows, "query_id long, chunk_id string, rank0 long, group_id string, group_order long"), 8).collect()
    # one slot for the group, then direct rows by rank; a group without a parent comes after them, when no slot is left
    assert sorted(r.chunk_id for r in got) == ["d0", "d1", "d2", "d3", "d4", "d5", "d6", "g0"]


def test_quotes_over_lines(spark):
    lines = spark.createDataFrame([("p", 1, "Alpha, beta"), ("p", 2, "gamma delta"), ("p", 3, "end")], "path string, line_no long, line string")
    quotes = spark.createDataFrame([(1, "p", "beta gamma"), (2, "p", "delta"), (3, "p", "nowhere near")], "quote_id long, path string, quote string")
    assert [(r.quote_id, r.start_line, r.end_line) for r in claims.locate_quotes(lines, quotes).collect()] == [(1, 1, 2)]


def test_full_width_forms(spark):
    assert one(spark, claims.nfkc(F.col("a")), a="ＡＢ１㈱") == "AB1(株)"


def test_embedding_hook_checks_its_answers(spark):
    texts = spark.createDataFrame([(f"c{i}", f"word{i} other") for i in range(40)], "chunk_id string, text string")
    assert index.embed(texts, index.hashed_embedding).where("size(embedding) = 16").count() == 40
    with pytest.raises(Exception, match="fit its batch"):
        index.embed(texts, lambda part: [[1.0]]).collect()


def test_transitions(spark):
    allowed = state.transition_allowed(F.col("a"), F.col("b"))
    assert [one(spark, allowed, a=a, b=b) for a, b in [("cancelling", "building"), ("cancelling", "cancelled"), ("ready", "failed"), ("ready", "building"), ("building", "failed")]] == [False, True, False, True, True]


def test_model_stream_lines(spark):
    lines = ['{"message": {"thinking": "hm"}}', '{"message": {"content": "a"}}', '{"done": true}', "noise"]
    got = jobs.model_events(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.kind, r.text) for r in got] == [("thinking", "hm"), ("content", "a"), ("done", None)]


def test_folder_scan_follows_the_policy(spark, tmp_path):
    for name in ("a.md", ".env", "node_modules/x.md", "sub/b.TXT", "key.pem", "c.exe"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"caf\xff\n")
    got = corpus.read_folder(spark, str(tmp_path)).select("path", corpus.decode(F.col("content")).alias("t")).collect()
    assert sorted((r.path, r.t) for r in got) == [("a.md", "caf�\n"), ("sub/b.TXT", "caf�\n")]


def test_keyword_and_idf_scores_against_plain_counting(spark):
    import math

    chunks = [(f"c{i:02d}", f"x/doc-{i}.md", h, t) for i, (h, t) in enumerate([("alpha", "beta beta gamma"), ("", "Beta delta"), (None, "nothing at all"), ("gamma", ""), ("", "abcdefghijk lmnop")] * 3)]
    asked = [(1, "beta gamma"), (2, "alpha  doc-3"), (3, "abcdefghijk"), (4, "zz"), (5, "")]
    frame = spark.createDataFrame(chunks, "chunk_id string, path string, heading string, text string")
    questions = spark.createDataFrame(asked, "query_id long, query string")
    hay = {c: " ".join(x for x in (p, h, t) if x is not None).lower() for c, p, h, t in chunks}
    terms = {q: list(dict.fromkeys(w for w in t.split() if len(w) >= 2)) or [t] for q, t in asked if t}
    df = {t: sum(t in y for y in hay.values()) for own in terms.values() for t in own}
    want = {}
    for q, own in terms.items():
        bare = "".join(dict(asked)[q].split())
        grams = {bare[i : i + n] for n in range(3, 9) for i in range(len(bare) - n + 1)}
        for c, p, h, _ in chunks:
            n = {t: hay[c].count(t) for t in own if t in hay[c]}
            s = sum(2 * k / (k + 1) * (math.log((len(chunks) + 1) / (df[t] + 1)) + 1) + 3 * (t in (h or "")) + 2 * (t in p[2:-3]) for t, k in n.items()) + 0.1 * min(10, sum(g in hay[c] for g in grams))
            if s > 0:
                want[q, c] = round(s, 4)
    got = rank.keyword_scores(questions, frame, 100).collect()
    assert {(r.query_id, r.chunk_id): r.score for r in got} == pytest.approx(want)
    two = rank.keyword_scores(questions, frame, 2).collect()
    assert {(r.query_id, r.rank0): r.chunk_id for r in two} == {(r.query_id, r.rank0): r.chunk_id for r in got if r.rank0 < 2}
    idf = {(r.query_id, r.chunk_id): (r.score, r.hits) for r in rank.idf_scores(questions, frame, 100).collect()}
    plain = {c: f"{p} {t}".lower() for c, p, _, t in chunks}
    seen = {t: sum(t in y for y in plain.values()) for t in df}
    for q, own in terms.items():
        for c, p, _, _ in chunks:
            met = [t for t in own if t in plain[c]]
            s = sum(math.log(len(chunks) / seen[t]) * (4 if t in p[2:-3] else 1) for t in met)
            assert idf.get((q, c), (0, 0)) == (pytest.approx(s, abs=1e-4), len(met)) if s > 1e-4 else (q, c) not in idf


def test_cosine_in_blocks_is_cosine_at_once(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(60)], "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id % 5 = 0").selectExpr("vec_id AS query_id", "embedding")
    ask = lambda: sorted(map(tuple, rank.cosine_scores(asked, vectors, 4, -1.0).collect()))
    once = ask()
    monkeypatch.setattr(rank, "NUMBERS_AT_ONCE", 20)
    assert ask() == once and len(once) == 48
    assert all(v == q and s == 1.0 for q, v, s, place in once if place == 0)
