"""The pipeline's near copies are linked by the vantage-point tree; what lies outside its radius isn't lost."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tessera.llm import simhash  # noqa: E402
from tests.llm.test_operators import jaccard  # noqa: E402

SF = "/root/testdata/sf0.001"


def texts():
    rng = np.random.default_rng(4)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 400)] for _ in range(6)]
    out = []
    for words in base:
        out.append(" ".join(words))
        for k in (1, 1, 2, 4, 12):  # from copies with one other word to such as share too little
            own = list(words)
            for at in rng.integers(0, len(own), k):
                own[at] = f"new{rng.integers(0, 10**6)}"
            out.append(" ".join(own))
    return [*out, "few words here to see today", "few words here to see today again", "", "of none"]


def groups(n, linked):
    root = list(range(n))
    for b in range(n):
        for a in range(b):
            if linked(a, b):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def test_tree_pairs_give_the_components_of_all_pairs(spark):
    rng = np.random.default_rng(9)
    points = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    points = np.concatenate([points, points[:20] ^ np.uint64(5), points[:5] ^ np.uint64(5 | 1 << 40 | 1 << 50), points[30:34]])
    frame = spark.createDataFrame([(int(k), int(x)) for k, x in enumerate(points.view(np.int64))], "r long, fp long")
    pairs = {(r.a, r.b) for r in simhash.tree_pairs(frame).collect()}
    near = lambda a, b: int(points[a] ^ points[b]).bit_count() <= simhash.RADIUS
    assert all(a < b for a, b in pairs) and all(near(a, b) for a, b in pairs)
    assert groups(len(points), lambda a, b: (a, b) in pairs) == groups(len(points), near)


def test_stage_links_by_the_tree_and_loses_nothing(spark, monkeypatch):
    own = texts()
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    searched, made = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda points, radius, **more: searched.append({r.fp for r in points.collect()}) or made(points, radius, **more))
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    sets = [simhash.shingle_hashes(t.encode(), 5) for t in own]
    assert searched == [{simhash.signed(simhash.majority(h)) for h in sets}]
    root = groups(len(own), lambda a, b: bool(own[a]) == bool(own[b]) and jaccard(own[a], own[b]) >= 0.8)
    assert got == set(root) and 6 < len(got) < len(own)
