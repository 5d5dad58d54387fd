"""Rows without ids, ids with several texts, and columns that carry the operators' own names."""

import numpy as np

from tessera.llm import simhash, spread
from tessera.llm.common import fresh_names

OWN = ["__own0", "__own1", "__k", "__t", "__id", "__gone", "__cut", "__at", "k", "row", "key", "th", "kept", "root", "pos", "h1", "id", "site", "n"]
COLUMNS = ", ".join(["doc_id long", "text string", "source string", *(f"{c} string" for c in OWN)])


def frame(spark, rows):
    return spark.createDataFrame([(*r, *(f"{c}!" for c in OWN)) for r in rows], COLUMNS)


def test_names_are_free_of_the_inputs():
    assert not set(fresh_names(["__own0", "__OWN_1", "x"], 3)) & {"__own0", "__own_1"} and len(set(fresh_names([], 4))) == 4


def test_lines_of_rows_without_ids(spark):
    shared = "a line that eight sites share"
    for ids in ([None] * 8, [5] * 8, list(range(8))):
        rows = [(i, f"{shared}\nown line {n}", f"s{n}") for n, i in enumerate(ids)]
        out = spread.drop_spread_lines(frame(spark, rows), min_sites=5)
        got = out.collect()
        assert sum(r.n_dropped for r in got) == 7 and sorted(r.text for r in got if r.n_dropped) == sorted(r.text for r in got if "share" not in r.text)
        assert all(r[c] == f"{c}!" for r in got for c in OWN) and set(out.columns) == {"doc_id", "text", "source", *OWN, "n_lines", "n_dropped"}


def test_rows_equal_in_id_site_and_text_share_their_lines(spark):
    rows = [(None, "shared\nmine", "s0")] * 2 + [(None, "shared\nmine", f"s{n}") for n in range(1, 6)]
    got = spread.drop_spread_lines(frame(spark, rows), min_sites=5).collect()
    # Both lines are on six sites; their first places are in one row, or in the two that can't be told apart.
    assert sorted({r.source for r in got if r.n_dropped == 0}) == sorted({r.source for r in got if r.text == "shared\nmine"}) and len({r.source for r in got if r.n_dropped == 0}) == 1


def test_near_copies_keep_all_columns(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(1, base, "s"), (1, base, "s"), (2, base, "s"), (3, "something else altogether in this row here", "s"), (None, base + " more", "s")]
    got = simhash.keep_one(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, base), (3, rows[3][1])] and all(r[c] == f"{c}!" for r in got for c in OWN)


def test_sketches_never_rule_out_similar_sets():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(0, 400))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.choice([0.7, 0.85, 0.95])], rng.integers(0, 1 << 63, int(rng.integers(0, 60))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        similar = both >= 0.8 * (len(x) + len(y) - both) - 1e-9
        assert not similar or simhash.may_be_similar([simhash.sketch(x)], [simhash.sketch(y)], 0.8)[0]
    a, b = (np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64) << np.uint64(1)) for _ in range(2))
    assert not simhash.may_be_similar([simhash.sketch(a)], [simhash.sketch(b)], 0.8)[0]


def test_labelled_samples_are_bounded_whatever_repeats(spark):
    from tessera.llm.common import labelled_sample

    docs = spark.createDataFrame([(1, f"text {n}", n) for n in range(50)] + [(2, "same", 7)] * 50 + [(i, f"t{i}", i) for i in range(3, 40)], "doc_id long, text string, m long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", "doc_id", "text", 3).collect()
    assert all(len([r for r in got if r["__y"] == y]) <= 3 for y in (0, 1)) and len({(r["__id"], r["__text"]) for r in got}) == len(got)
    wide = labelled_sample(docs, labels, "quality", "doc_id", "text", 1000, ["m"]).collect()
    assert len({(r["__id"], r["__text"], r["m"]) for r in wide}) == len(wide) and {r["__y"] for r in wide} == {0, 1}
    assert len([r for r in wide if r["__id"] == 2]) <= 1


def test_quotations_of_any_length():
    from tessera.llm import toxicity

    for n in (3, 60, 70, 5000):
        words = ["“he"] + ["stone"] * n + ["end”", "after"]
        assert toxicity.quoted_at(words, [1, n // 2, len(words) - 1]) == [True, True, False]
    assert toxicity.quoted_at(["“open"] + ["stone"] * 5, [2]) == [False]


def test_slack_stays_within_a_document():
    import pytest
    from tessera.llm import decontaminate

    class Index:
        pass

    with pytest.raises(ValueError, match="slack"):
        decontaminate.search_index(Index(), decontaminate.Queries([("a", "one two three")]), 60)
