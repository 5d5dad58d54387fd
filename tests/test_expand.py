"""Headings replaced by what stands below them, budgets, and the grade of what is kept."""

import random

from pyspark.sql import functions as F

from tessera.operators import expand, structure

DOC = ["# 復旧手順", "", "## 初動", "障害を確認する。", "記録を残す。", "", "## 連絡", "連絡網で知らせる。", "## 復元", "控えを戻す。", "結果を確かめる。"]


def lines_of(spark, **texts):
    return spark.createDataFrame([(p, i + 1, x) for p, t in texts.items() for i, x in enumerate(t)], "path string, line_no long, line string")


def outline(rows):
    return structure.sections(structure.headings(rows), rows.groupBy("path").agg(F.count("*").alias("n_lines")))


def chunks_of(spark, **spans):
    return spark.createDataFrame([(p, f"{p}#{i}", a, b, "h") for p, s in spans.items() for i, (a, b) in enumerate(s)], "path string, chunk_id string, start_line long, end_line long, file_sha256 string")


def hits(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, chunk_id string, path string, start_line long, rank0 int, file_sha256 string")


def files(spark, *paths):
    return spark.createDataFrame([(p, "h") for p in paths], "path string, file_sha256 string")


WHOLE = [(3, 6), (7, 8), (9, 11)]


def test_a_heading_stands_for_its_sections(spark):
    rows = lines_of(spark, a=DOC)
    made, required = expand.expand(hits(spark, (1, "p", "a", 1, 0, "H")), rows, outline(rows), chunks_of(spark, a=WHOLE), files(spark, "a"))
    got = made.collect()
    # Sections that follow each other make one range.
    assert [(r.start_line, r.end_line, r.group_order, r.group_partial, r.expanded_from) for r in got] == [(3, 11, 1, False, "p")]
    assert got[0].snippet == "\n".join(DOC[2:]) and got[0].chunk_id == got[0].group_id + "#r01"
    assert sorted((r.start_line, r.end_line) for r in required.collect()) == [(3, 5), (7, 11)]


def test_what_isnt_expanded(spark):
    rows = lines_of(spark, a=DOC, b=["# 題", "本文", "## 節", "本文"], c=DOC)
    asked = hits(spark, (1, "p1", "b", 1, 0, "h"), (1, "p2", "a", 3, 1, "h"), (1, "p3", "c", 1, 2, "other"), (1, "p4", "c", 1, 3, None))
    chunks = chunks_of(spark, a=WHOLE, b=[(3, 4)], c=WHOLE).withColumn("file_sha256", F.when(F.col("path") == "c", "old").otherwise("h"))
    assert expand.expand(asked, rows, outline(rows), chunks, files(spark, "a", "b", "c"))[0].count() == 0


def test_near_sections_come_first_within_the_limits(spark):
    rows = lines_of(spark, a=DOC)
    scores = spark.createDataFrame([(1, "a#0", 0.1, 0.0), (1, "a#1", 0.9, 0.0), (1, "a#2", 0.1, 5.0)], "query_id long, chunk_id string, similarity double, keyword_score double")
    made = expand.expand(hits(spark, (1, "p", "a", 1, 0, "h")), rows, outline(rows), chunks_of(spark, a=WHOLE), files(spark, "a"), scores, each=2)[0].collect()
    assert [(r.start_line, r.end_line, list(r.group_partial_reasons)) for r in made] == [(7, 11, ["range_limit", "uncovered_lines"])]
    split = [(3, 4), (7, 8), (10, 11)]
    made = expand.expand(hits(spark, (1, "p", "a", 1, 0, "h")), rows, outline(rows), chunks_of(spark, a=split), files(spark, "a"), scores)[0].orderBy("group_order").collect()
    assert [(r.start_line, r.end_line, r.group_priority) for r in made] == [(3, 4, 3), (7, 8, 1), (10, 11, 2)]


def test_budget_cuts_at_whole_lines(spark):
    rows = lines_of(spark, a=DOC)
    made = expand.expand(hits(spark, (1, "p", "a", 1, 0, "h")), rows, outline(rows), chunks_of(spark, a=[(3, 5)]), files(spark, "a"), budget=2 * (len(DOC[2]) + 1 + len(DOC[3]) + 3))[0].collect()
    assert [(r.start_line, r.end_line, r.snippet, list(r.group_partial_reasons)) for r in made] == [(3, 4, "\n".join(DOC[2:4]), ["char_budget", "uncovered_lines"])]
    assert expand.expand(hits(spark, (1, "p", "a", 1, 0, "h")), rows, outline(rows), chunks_of(spark, a=[(3, 5)]), files(spark, "a"), budget=2)[0].count() == 0


def brute(found, docs, budget, chunk):
    """Parents in order of rank; the sections of DOC-like texts in order, chunks of `chunk` lines."""
    out, taken, total = [], 0, 0
    for path in found:
        text = docs[path]
        heads = [(i + 1, len(x) - len(x.lstrip("#"))) for i, x in enumerate(text) if x.startswith("#")]
        if not heads or heads[0][0] != 1:
            continue
        level = heads[0][1]
        below = [h for h in heads[1:]]
        end = next((h[0] - 1 for h in below if h[1] <= level), len(text))
        inside = [h for h in below if h[0] <= end]
        if not inside or any(x.strip() for x in text[1 : inside[0][0] - 1]) or taken == 2 or total >= 4:
            continue
        kids, last = [], None
        for h in inside:
            if last is None or h[1] <= last:
                kids.append(h[0])
                last = h[1]
        spans = [(k, (kids[i + 1] - 1 if i + 1 < len(kids) else end)) for i, k in enumerate(kids)]
        limit = min(4, 4 - total)
        chosen = spans[:limit]
        pieces = []
        for place, (a, b) in enumerate(chosen):
            for c in range(1, len(text) + 1, chunk):
                d = min(c + chunk - 1, len(text))
                if a <= c and d <= b:
                    if pieces and pieces[-1][1] + 1 == c:
                        pieces[-1][1] = d
                    else:
                        pieces.append([c, d, place])
        left, kept, reasons = budget // 2, [], ["range_limit"] if len(spans) > limit else []
        for c, d, _ in pieces:
            if left <= 0:
                reasons = list(dict.fromkeys([*reasons, "char_budget"]))
                break
            n = max((k for k in range(0, d - c + 2) if len("\n".join(text[c - 1 : c - 1 + k])) <= left), default=0)
            if n < d - c + 1:
                reasons = list(dict.fromkeys([*reasons, "char_budget"]))
                if n == 0:
                    continue
            left -= len("\n".join(text[c - 1 : c - 1 + n]))
            kept.append((c, c + n - 1))
        if not kept:
            continue
        shown = {x for a, b in kept for x in range(a, b + 1)}
        if any(text[x - 1].strip() and x not in shown for x in range(inside[0][0], end + 1)):
            reasons = [*reasons, "uncovered_lines"]
        taken, total = taken + 1, total + len(kept)
        out += [(path, a, b, tuple(reasons)) for a, b in sorted(kept)]
    return out


def test_random_documents_against_brute_force(spark):
    rng = random.Random(9)
    docs, spans = {}, {}
    for n in range(40):
        text = ["# " + "t" * rng.randint(0, 5)] + [rng.choice(["", "", "## s", "### u", "word " * rng.randint(0, 4), "# x"]) for _ in range(rng.randint(0, 25))]
        docs[f"d{n:02d}"] = [x.rstrip() for x in text]
    rows = lines_of(spark, **docs)
    for size in (1, 3):
        for p, t in docs.items():
            spans[p] = [(a, min(a + size - 1, len(t))) for a in range(1, len(t) + 1, size)]
        asked, want = [], {}
        for q in range(25):
            found = rng.sample(sorted(docs), 6)
            asked += [(q, f"{p}#0", p, 1, r, "h") for r, p in enumerate(found)]
            want[q] = brute(found, docs, 60, size)
        made = expand.expand(hits(spark, *asked), rows, outline(rows), chunks_of(spark, **spans), files(spark, *docs), budget=60)[0].collect()
        got = {q: sorted((r.path, r.start_line, r.end_line, tuple(r.group_partial_reasons)) for r in made if r.query_id == q) for q in want}
        assert got == {q: sorted(v) for q, v in want.items()}
        for r in made:
            assert r.snippet == "\n".join(docs[r.path][r.start_line - 1 : r.end_line])


def test_lines_of_direct_hits_are_shown_once(spark):
    rows = lines_of(spark, a=DOC)
    made = expand.expand(hits(spark, (1, "p", "a", 1, 0, "h")), rows, outline(rows), chunks_of(spark, a=WHOLE), files(spark, "a"))[0]
    direct = spark.createDataFrame([(1, "a", 1, 1), (1, "a", 5, 8), (2, "a", 9, 9), (1, "b", 9, 9)], "query_id long, path string, start_line long, end_line long")
    got = expand.apart_from_hits(made, direct, rows).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.group_order, r.chunk_id[-4:], r.snippet) for r in got] == [(3, 4, 1, "#r01", "## 初動\n障害を確認する。"), (9, 11, 2, "#r02", "\n".join(DOC[8:]))]


ROW = "query_id long, query string, chunk_id string, path string, heading string, start_line long, end_line long, snippet string, source string, group_id string, expanded_from string, group_order int, group_priority int, group_partial boolean, rank0 int, rrf_score double, embedding_score double, conflict boolean"


def structural(conflict=False, first="復旧手順の初動", second="連絡網で知らせる", q="復旧手順"):
    parent = (1, q, "p", "doc.md", "復旧手順", 1, 2, "復旧手順", "keyword", None, None, None, None, None, 0, 0.05, None, conflict)
    part = lambda n, a, b, text: (1, q, f"g#r{n:02d}", "doc.md", "復旧手順", a, b, text, "expanded", "g", "p", n, n, False, n, 0.0, None, False)
    return [parent, part(1, 10, 12, first), part(2, 20, 22, second)]


def graded(spark, rows, limit=5, chars=None, terms=("連絡網",), required=((10, 12), (20, 22))):
    need = spark.createDataFrame([("g", a, b) for a, b in required], "group_id string, start_line long, end_line long")
    asked = spark.createDataFrame([(1, list(terms))], "query_id long, terms array<string>")
    kept, status = expand.select_final(spark.createDataFrame(rows, ROW), need, asked, limit, chars)
    return kept.orderBy("place").collect(), status.first()


def test_a_whole_structure_is_sufficient_and_loses_that_with_its_parts(spark):
    kept, status = graded(spark, structural())
    assert len(kept) == 3 and status.status == "sufficient"
    kept, status = graded(spark, structural(), limit=2)
    assert len(kept) == 2 and status.status != "sufficient" and all(r.group_partial for r in kept if r.group_id)
    rows = structural()
    kept, status = graded(spark, rows, chars=len(rows[0][7]) + len(rows[1][7]) + 2)
    assert status.status != "sufficient" and all(r.group_partial for r in kept if r.group_id)
    assert graded(spark, structural(), terms=())[1].status != "sufficient"
    assert graded(spark, structural(), terms=("別の語",))[1].status != "sufficient"
    assert graded(spark, structural(), required=((10, 12), (15, 16), (20, 22)))[1].status != "sufficient"
    assert graded(spark, structural(q="無関係の質問"))[1].status != "sufficient"


def test_a_conflict_found_before_the_limits_holds_after_them(spark):
    rows = structural()
    far = (1, "復旧手順", "z", "z.md", "", 1, 1, "別の文", "keyword", None, None, None, None, None, 9, 0.01, None, True)
    kept, status = graded(spark, [*rows, far], limit=1)
    assert {r.chunk_id for r in kept} == {"p"} and status.status != "sufficient"
    assert graded(spark, rows)[1].status == "sufficient" and graded(spark, [*rows, far])[1].status == "partial"


def test_budget_cuts_direct_rows_anywhere_and_expanded_ones_at_lines(spark):
    text = [f"行{i}の本文です" for i in range(1, 21)]
    made = [(1, 1, "a", "expanded", "g", 1, 3, "\n".join(text[:3])), (1, 2, "b", "expanded", "g", 5, 8, "\n".join(text[4:8])), (1, 3, "c", "keyword", None, 1, 9, "長い本文" * 9)]
    rows = spark.createDataFrame(made, "query_id long, place int, chunk_id string, source string, group_id string, start_line long, end_line long, snippet string")
    got = {r.chunk_id: r for r in expand.fit_budget(rows, len(made[0][7]) + len("\n".join(text[4:6])) + 3).collect()}
    assert (got["b"].end_line, got["b"].snippet) == (6, "\n".join(text[4:6])) and got["a"].shortened and got["b"].shortened
    assert got["c"].snippet == "長い本" and got["c"].snippet_truncated and got["c"].end_line == 9
    tight = {r.chunk_id: r for r in expand.fit_budget(rows, len(made[0][7]) + 2).collect()}
    assert set(tight) == {"a", "c"} and tight["a"].shortened and tight["c"].snippet == "長い"


def test_expansion_of_whole_tables(spark):
    from tests.conftest import SMALL
    from tessera.plans import evidence as plans

    got = plans.parent_expansion(spark, SMALL).collect()
    assert got and all(len({r.path for r in got if r.query_id == q}) <= 2 and len([r for r in got if r.query_id == q]) <= 4 for q in {r.query_id for r in got})
