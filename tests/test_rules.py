"""Rules held against values worked out by hand."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import claims, evidence, guidance, matching
from tessera.plans.answers import ROLES
from tessera.sources import corpus


@pytest.mark.parametrize(
    ("path", "allowed"),
    [
        ("rules/travel.md", True),
        ("hr/secretary-rules.md", True),
        ("hr/credentials-policy.txt", True),
        ("id_rsa_guide.md", True),
        ("notes/.notes.md", True),
        ("secrets.yaml", False),
        ("conf/app.secret.json", False),
        (".env", False),
        (".env.md", False),
        ("Node_Modules/x.md", False),
        (".git/x.md", False),
        ("a/key.pem", False),
        ("guide.md.metadata.json", False),
        ("A.HTML", True),
        ("x.exe", False),
    ],
)
def test_path_policy(spark, path, allowed):
    assert spark.createDataFrame([(path,)], "p string").select(corpus.allowed(F.col("p"))).first()[0] is allowed


def test_layouts():
    assert {"reference", "equation"} <= set(corpus.LAYOUTS) and not {"list", "formula"} & set(corpus.LAYOUTS)


def test_numbers_of_files_are_not_cut(spark):
    docs = spark.createDataFrame([(7, "t", "en", "s"), (1234567, "t", "en", "s")], "doc_id long, text string, lang string, source string")
    assert [r.path for r in corpus.files(docs).orderBy("doc_id").collect()] == ["s/en/doc-000007.md", "s/en/doc-1234567.md"]


def test_blocks(spark):
    text = ["", " ", "# One", "# Two", "body", "## Three"]
    rows = spark.createDataFrame([("a/x.md", i + 1, t) for i, t in enumerate(text)], "path string, line_no long, line string")
    got = [tuple(r)[1:] for r in corpus.line_blocks(rows).orderBy("start_line").collect()]
    assert got == [("x.md#b0001", "title", 3, 3), ("x.md#b0002", "text", 4, 5), ("x.md#b0003", "title", 6, 6)]


def test_roles(spark):
    table = "| item | done |\n| a | yes |"
    rows = [("checklist table", table, "点検チェックリスト"), ("exception", "ただし、この規定は適用しない。", "例外"), ("background", "今般、経緯を踏まえ定める。", "背景"), ("plain", "text", "title")]
    got = {r.name: (r.role, r.confidence) for r in guidance.classify_role(spark.createDataFrame(rows, "name string, text string, heading string")).collect()}
    assert got == {"checklist table": ("practical_detail", 1.0), "exception": ("qualifier_reference", 0.95), "background": ("background", 1.0), "plain": ("unclassified", 0.0)}
    assert ROLES == ["direct_answer", "qualifier_reference", "unclassified", "background", "practical_detail"]


def test_confidence_of_groups_has_no_scores(spark):
    columns = "query_id long, query string, rank0 long, chunk_id string, path string, heading string, snippet string, source string, rrf_score double, embedding_score double, group_id string"
    rows = lambda group: [(1, "alpha rules", 0, "c0", "a.md", "alpha", "alpha rules text", "keyword+embedding", 0.035, 0.9, group)]
    alone, grouped = (evidence.confidence(spark.createDataFrame(rows(g), columns)).first() for g in (None, "g"))
    assert round(alone.confidence - grouped.confidence, 3) == 0.2
    assert alone.status == "sufficient" and grouped.status == "partial"


def slots(spark, rows, limit=8):
    columns = "query_id long, chunk_id string, rank0 long, group_id string, group_order long, group_priority long, expanded_from string"
    frame = spark.createDataFrame([(1, *r) for r in rows], columns)
    return [r.chunk_id for r in evidence.allocate_slots(frame, limit).orderBy("place").collect()]


def test_every_group_gets_a_slot_first(spark):
    rows = [(f"d{i}", i, None, None, None, None) for i in range(8)] + [(f"g{g}r{k}", 8 + 2 * g + k, f"g{g}", k + 1, None, None) for g in range(5) for k in range(2)]
    assert slots(spark, rows) == ["d0", "d1", "d2", "g0r0", "g1r0", "g2r0", "g3r0", "g4r0"]


def test_groups_follow_their_parents_and_ranges_their_priority(spark):
    rows = [(f"d{i}", i, None, None, None, None) for i in range(6)] + [("a1", 6, "a", 1, 2, "d0"), ("a2", 7, "a", 2, 1, "d0"), ("a3", 8, "a", 3, 3, "d0")]
    assert slots(spark, rows, 4) == ["d0", "a1", "a2", "d1"]
    assert slots(spark, rows, 1) == ["d0"]
    assert slots(spark, rows[6:], 2) == ["a1", "a2"]
    assert slots(spark, rows[:2] + rows[6:], 8) == ["d0", "a1", "a2", "a3", "d1"]


def test_batches_that_run_again_replace_themselves(spark, tmp_path):
    pd.DataFrame({"x": [1]}).to_parquet(tmp_path / "a.parquet")
    out = spark.read.parquet(str(tmp_path / "a.parquet"))
    for _ in range(2):
        out.write.mode("overwrite").parquet(f"{tmp_path}/out/batch=0")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_compatibility_forms(spark):
    rows = spark.createDataFrame([("規程（別添）　Ａ-１", "あ［E3］い [E3]。ｱ"), ("Schöne Straße", None), (None, "")], "a string, b string")
    got = rows.select(matching.normalize_title(F.col("a")).alias("a"), matching.normalize_line(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("規程別添a1", "あE3いア"), ("schönestraße", None), ("", "")]


@pytest.mark.parametrize(
    ("given", "number"),
    [("12", 12), ("一二", 12), ("十", 10), ("十二", 12), ("二十", 20), ("百三", 103), ("三百四十五", 345), ("千二百", 1200), ("二千〇三", 2003), ("零", 0), ("2十3", 3 + 20)],
)
def test_numerals(spark, given, number):
    assert spark.range(1).select(matching.numeral(F.lit(given))).first()[0] == number


def test_provisions_in_order_of_naming(spark):
    text = "第二十一条第３項及び第 4 号、第21条、第百二款"
    assert spark.range(1).select(matching.provisions(claims.nfkc(F.lit(text)))).first()[0] == ["第21条", "第3項", "第4号", "第102款"]


@pytest.mark.parametrize(
    ("text", "dated"),
    [
        ("本通知は、令和６年４月１日から適用する。", True),
        ("この要綱は令和元年 5月1日より施行する。", True),
        ("令和6年4月1日から適用する", False),
        ("なお、令和6年4月1日から適用する。", False),
        ("令和6年4月から適用する。", False),
    ],
)
def test_operative_dates(spark, text, dated):
    assert spark.range(1).select(matching.operative_date(F.lit(text))).first()[0] is dated


def test_follow_through_needs_exactly_one_sentence(spark):
    duty = "申請の真正性を確認したうえで、迅速かつ適切に処理する。"
    cases = [["前文。" + duty, "次。"], [duty, duty], ["# " + duty], ["> " + duty, "x"], []]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i long, ls array<string>")
    got = rows.select("i", matching.follow_through(F.col("ls"))).orderBy("i").collect()
    assert [r[1] for r in got] == [duty, "", "", "", ""]


@pytest.mark.parametrize(
    ("given", "path"),
    [
        ("rules/travel.md", "rules/travel.md"),
        (" rules\\travel.md ", "rules/travel.md"),
        ("/rules/travel.md", None),
        ("//host/x.md", None),
        ("c:/x.md", None),
        ("x.md:stream", None),
        ("a/../x.md", None),
        ("./x.md", None),
        ("a//x.md", None),
        ("", None),
        (".git/x.md", None),
        ("NODE_MODULES/x.md", None),
        ("a/secrets.yaml", None),
        ("x.exe", None),
    ],
)
def test_reference_paths(spark, given, path):
    assert spark.range(1).select(matching.reference_path(F.lit(given))).first()[0] == path


@pytest.mark.parametrize(
    ("content", "valid"),
    [
        ('{"schemaVersion": 1, "sourcePath": "a", "pages": []}', True),
        ('{"schemaVersion": 1, "sourcePath": "a", "pages": [{}, {"blocks": []}], "warnings": []}', True),
        ('{"schemaVersion": 1, "sourcePath": "a", "pages": [{"blocks": [{"lineStart": 1, "lineEnd": null}]}], "warnings": ["w"]}', True),
        ('{"schemaVersion": 1, "sourcePath": "a", "pages": [{"blocks": [{"lineStart": true}]}]}', False),
        ('{"schemaVersion": 1, "sourcePath": "a", "pages": [{"blocks": [{"lineStart": "1"}]}]}', False),
        ('{"schemaVersion": 1, "sourcePath": "a", "pages": [{"blocks": [{"lineEnd": 1.5}]}]}', False),
        ('{"schemaVersion": 1, "sourcePath": "a", "pages": [{"blocks": ["x"]}]}', False),
        ('{"schemaVersion": 1, "sourcePath": "a", "pages": [{"blocks": {}}]}', False),
        ('{"schemaVersion": 1, "sourcePath": "a", "pages": ["x"]}', False),
        ('{"schemaVersion": 1, "sourcePath": "a", "pages": {}}', False),
        ('{"schemaVersion": 1, "sourcePath": "a"}', False),
        ('{"schemaVersion": 1, "sourcePath": "a", "pages": [], "warnings": [1]}', False),
        ('{"schemaVersion": 1, "sourcePath": "a", "pages": [], "warnings": "w"}', False),
        ('{"schemaVersion": 1, "sourcePath": "", "pages": []}', False),
        ('{"schemaVersion": 2, "sourcePath": "a", "pages": []}', False),
        ('{"schemaVersion": "1", "sourcePath": "a", "pages": []}', False),
        ('["x"]', False),
        ("no json", False),
    ],
)
def test_sidecar_rules(spark, content, valid):
    assert spark.createDataFrame([(content,)], "c string").select(corpus.valid_metadata(F.col("c"))).first()[0] is valid


@pytest.mark.parametrize(
    ("kind", "gates", "still", "removed", "corrected", "state"),
    [
        ("answer", ["passed"] * 4, [], 0, 0, "passed"),
        ("fallback", ["passed"] * 4, [], 0, 0, "failed"),
        ("answer", ["passed"] * 4, [""], 0, 0, "passed"),
        ("answer", ["passed"] * 4, ["期限"], 0, 0, "partial"),
        ("answer", ["failed", "passed", "passed", "passed"], ["期限"], 1, 0, "partial"),
        ("answer", ["passed", "passed", "passed", "failed"], ["期限"], 0, 0, "needs_review"),
        ("answer", ["passed"] * 4, [], 1, 0, "needs_review"),
        ("answer", ["passed"] * 4, [], 0, 1, "needs_review"),
        ("answer", ["passed", None, "passed", "passed"], [], 0, 0, "needs_review"),
    ],
)
def test_quality_states(spark, kind, gates, still, removed, corrected, state):
    rows = spark.createDataFrame([(kind, *gates, still, removed, corrected)], "k string, a string, b string, c string, d string, s array<string>, r int, x int")
    assert rows.select(claims.quality_state(F.col("k"), [F.col(c) for c in "abcd"], F.col("s"), F.col("r"), F.col("x"))).first()[0] == state


def test_pinned_documents_are_whole_or_nothing(spark):
    rows = spark.createDataFrame([(1, "a", "a1"), (1, "b", "b1"), (1, "c", "c1"), (2, "a", "a1"), (3, "d", "d1"), (4, "a", "a1")], "query_id long, path string, chunk_id string")
    members = spark.createDataFrame([(1, "a", "A"), (1, "b", "B"), (2, "a", "A"), (2, "b", "old"), (3, "d", "D")], "query_id long, path string, sha256 string")
    present = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "path string, sha256 string")
    got = matching.restrict_to_documents(rows, members, present).collect()
    assert sorted((r.query_id, r.path) for r in got) == [(1, "a"), (1, "b")]
