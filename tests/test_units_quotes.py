"""Main units, their budget, and quotes, held against values worked out by hand and against brute force."""

import difflib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.operators import matching, quotes, structure, units

NOTICE = [
    "# 物品購入の手続について（通知）",  # 1
    "各課の長 殿",  # 2
    "令和7年5月2日",  # 3
    "",  # 4
    "## 1 目的",  # 5
    "購入の手続を簡素にする。",  # 6
    "## 2 手続",  # 7
    "(1) 見積は一者でよい。",  # 8
    "(2) 50万円以上の場合は二者とする。",  # 9
    "## 3 施行日",  # 10
    "令和7年6月1日から施行する。",  # 11
    "## 4 問合せ先",  # 12
    "管財課（内線 55）",  # 13
]


def table(spark, **texts):
    rows = [(p, i + 1, line) for p, text in texts.items() for i, line in enumerate(text if isinstance(text, list) else text.split("\n"))]
    return spark.createDataFrame(rows, "path string, line_no long, line string")


def outline(rows):
    return structure.sections(structure.headings(rows), rows.groupBy("path").agg(F.count("*").alias("n_lines")))


def found(spark, text):
    rows = table(spark, a=text)
    got = units.main_units(rows, outline(rows)).orderBy("start_line").collect()
    return [(r.start_line, r.end_line, r.heading, r.kind, r.ancillary) for r in got]


def test_title_wraps_sections_and_ancillary_matter_is_told_apart(spark):
    assert found(spark, NOTICE) == [
        (2, 3, "", "paragraph", True),
        (5, 6, "1 目的", "section", False),
        (7, 9, "2 手続", "section", False),
        (10, 11, "3 施行日", "section", True),
        (12, 13, "4 問合せ先", "section", True),
    ]
    proviso = [x.replace("から施行する。", "から施行する。ただし、従前の様式も使える。") for x in NOTICE]
    assert (10, 11, "3 施行日", "section", False) in found(spark, proviso)


def test_paragraphs_without_headings_and_lines_before_the_first(spark):
    assert found(spark, "はじめの段落。\n続き。\n\n次の段落。") == [(1, 2, "", "paragraph", False), (4, 4, "", "paragraph", False)]
    header = ["管財 第3号", "部外秘", "", "# 甲", "本文。", "# 乙", "本文。"]
    assert found(spark, header) == [(1, 2, "", "paragraph", True), (4, 5, "甲", "section", False), (6, 7, "乙", "section", False)]
    assert found(spark, ["# 題だけ", "本文。", "", "**記**"]) == [(2, 2, "", "paragraph", False), (4, 4, "", "paragraph", True)]


def test_sections_are_cut_at_appendices_and_notes(spark):
    text = ["# 題", "## 3 実施時期", "6月から。", "", "（別紙1）", "対象の一覧。", "※ 臨時の者を除く。", "※ 続き。", "", "照会先は管財課。"]
    assert found(spark, text) == [
        (2, 4, "3 実施時期", "body", True),
        (5, 6, "3 実施時期／別紙1", "appendix", False),
        (7, 8, "3 実施時期／注記", "note", False),
        (10, 10, "3 実施時期／注記", "note", True),
    ]
    nested = ["# 題", "## 甲", "※ 注", "### 乙", "本文"]
    assert [x[:4] for x in found(spark, nested)] == [(2, 5, "甲", "section")]


@pytest.mark.parametrize(
    ("body", "form"),
    [
        (["| 項目 | 記入 |", "|---|---|", "| 氏名 | |", "| 住所 | ○○ |", "申請者："], True),
        (["| 項目 | 記入 |", "|---|---|", "| 氏名 | 山田 |", "| 住所 | 東京 |"], False),
        (["| 項目 | 結果 |", "|---|---|", "| 図面はあるか。 | |", "| 期間は適切か。 | |"], False),
        (["| 項目 | 記入 |", "| 氏名 | |", "この様式は、提出の前に管財課長の確認を受けなければならない。"], False),
        (["| 氏名 | |"], False),
        (["| 項目 | 記入 |", "| 氏名 | |", "ただし、住所は任意とする。"], False),
    ],
)
def test_empty_forms(spark, body, form):
    assert found(spark, ["# 題", "## 記載", *body])[0][4] is form


def test_read_ranges_take_each_introduction_once(spark):
    rows = table(spark, a=["# 題", "## 手続", "### 原則", "原則の本文。", "", "### 例外", "例外の本文。", "## 空", "", "## 末", "導入。", "### 空の子"])
    own = outline(rows)
    got = units.read_ranges(rows, own, units.main_units(rows, own)).orderBy("start_line").collect()
    assert [tuple(r)[1:] for r in got] == [(2, 3, 5, "原則"), (2, 6, 7, "例外"), (10, 10, 11, "末")]


def test_budget_reaches_every_unit_and_the_rest_is_unread(spark):
    text = ["# 題", "## 前", *[f"本文{i:02d}" + "あ" * 40 for i in range(20)], "## 後", "後の要点。"]
    rows = table(spark, a=text)
    got = units.share_budget(rows, units.main_units(rows, outline(rows)), 200).orderBy("part", "start_line").collect()
    read = [(r.heading, r.start_line, r.end_line, r.complete) for r in got if r.part == "read"]
    # 100 characters each: 5 + 45 + 45, then 11 and 5 + 6; what is left (94) takes two more lines of the first.
    assert read == [("前", 2, 6, False), ("後", 23, 24, True)]
    assert [(r.heading, r.start_line, r.end_line) for r in got if r.part == "unread"] == [("前", 7, 22)]
    none = units.share_budget(rows, units.main_units(rows, outline(rows)), 0).collect()
    assert {r.part for r in none} == {"unread"}


def test_ranges_are_classified_by_themselves(spark):
    rows = table(spark, a=NOTICE, b=["---", "title: x", "---", "", "本文。"], c=["短い行", "", "もう一つ"])
    cases = [("a", 2, 3, True), ("a", 5, 6, False), ("a", 10, 11, True), ("a", 13, 13, True), ("a", 1, 4, False), ("a", 12, 99, True), ("a", 4, 4, False), ("a", 0, 3, False), ("a", 3, 2, False), ("b", 1, 3, True), ("b", 2, 4, True), ("b", 3, 5, False), ("c", 1, 3, True), ("z", 1, 2, False)]
    asked = spark.createDataFrame([(str(i), *c[:3]) for i, c in enumerate(cases)], "range_id string, path string, start_line long, end_line long")
    got = {r.range_id: r.ancillary for r in units.classify_ranges(rows, outline(rows), asked).collect()}
    assert [got[str(i)] for i in range(len(cases))] == [c[3] for c in cases]


def test_one_operative_date(spark):
    twice = [*NOTICE, "## 5 適用日", "令和7年7月1日から適用する。"]
    rows = table(spark, a=NOTICE, b=twice)
    got = units.operative_dates(rows, units.main_units(rows, outline(rows)), matching.operative_date(F.col("line"))).collect()
    assert [tuple(r) for r in got] == [("a", 11, "3 施行日")]


# ---- quotes

RULE = [
    "第３条　協議会で審査する案件は、次のとおりとする。",
    "",
    "- 一　見込額１，０００万円以上の機器の更新",
    "- 二　見込額３００万円以上の建物の改修（緊急の修繕を除く。）",
    "２　前項の規定に関わらず、次の各号に該当する案件は審査の対象としない。",
    "- 一　同じ仕様による部品の交換",
    "３　協議会において審査する内容は、費用の削減の可否とする。",
]


def plain(text):
    text = unicodedata.normalize("NFKC", re.sub(r"\[E\d+\]", "", text))
    return re.sub(r"[\s、。，．,.・「」『』:：;；\[\]［］（）()【】<>＜＞\"'“”‘’|｜*＊_＿~〜\-‐‑–—―]+", "", text)


def pairs(t):
    return {t[i : i + 2] for i in range(len(t) - 1)}


def nearest(lines, quote):
    """Every range of lines, in order; (start, end) from 0, or None."""
    q, best = plain(quote), None
    if len(q) < 12:
        return None
    t, g = [plain(x) for x in lines], pairs(q)
    for i in range(len(t)):
        for j in range(i, len(t)):
            s = "".join(t[i : j + 1])
            if len(s) > 1.6 * len(q) + 20:
                break
            share = len(g & pairs(s)) / len(g)
            if share >= 0.85:
                if best is None or (share, -len(s)) > best[0]:
                    best = ((share, -len(s)), i, j)
                break
    return best and best[1:]


def snapped(lines, quote):
    got = nearest(lines, quote)
    if got is None:
        return None
    q, s = plain(quote), "".join(plain(x) for x in lines[got[0] : got[1] + 1])
    extra = len(q) - sum(b.size for b in difflib.SequenceMatcher(None, q, s, autojunk=False).get_matching_blocks())
    bad = not set(re.findall(r"\d+", q)) <= set(re.findall(r"\d+", s)) or any(w in q and w not in s for w in quotes.NEGATIONS) or extra > 2
    return None if bad else got


def test_nearest_range_is_that_of_all_ranges(spark):
    rng = random.Random(6)
    rows, asked, want, good = [], [], {}, {}
    for n in range(60):
        alphabet = "abcdefghijklmnopqrstuvwxyz"[: rng.choice([2, 4, 26])]
        lines = ["".join(rng.choice(alphabet + " ,") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 25))]
        lines[rng.randrange(len(lines))] = ""
        whole = "".join(lines)
        at = rng.randrange(max(len(whole) - 10, 1))
        quote = list(whole[at : at + rng.randint(10, 60)])
        for _ in range(rng.randint(0, 3)):
            if quote:
                quote[rng.randrange(len(quote))] = rng.choice(["", "", "z", "9"])
        quote = "".join(quote)
        rows += [(f"s{n}", i + 1, x) for i, x in enumerate(lines)]
        asked.append((f"q{n}", f"s{n}", quote))
        for into, test in ((want, nearest), (good, snapped)):
            got = test(lines, quote)
            if got is not None:
                into[f"q{n}"] = (got[0] + 1, got[1] + 1)
    lines = quotes.normal_lines(spark.createDataFrame(rows, "source string, line_no long, line string"))
    asked = spark.createDataFrame(asked, "quote_id string, source string, quote string").select("quote_id", "source", quotes.normal(F.col("quote")).alias("q"))
    assert len(want) > 20
    assert {r.quote_id: (r.start_line, r.end_line) for r in quotes.nearest_ranges(lines, asked).collect()} == want
    assert {r.quote_id: (r.start_line, r.end_line) for r in quotes.snap(lines, asked).collect()} == good


def test_range_ends_where_enough_is_met_first(spark):
    """The line at which the range begins lies across places 45 to 62: twice as many characters as a range may have, 52, are not a border to it."""
    lines = ["0" * 45, "abcdefghijklmnopqr", "stabcdefgh"]
    quote = "abcdefghijklmnopqrst"
    rows = quotes.normal_lines(spark.createDataFrame([("s", i + 1, x) for i, x in enumerate(lines)], "source string, line_no long, line string"))
    asked = spark.createDataFrame([("q", "s", quote)], "quote_id string, source string, q string")
    assert nearest(lines, quote) == (1, 1)
    assert [tuple(r) for r in quotes.nearest_ranges(rows, asked).collect()] == [("q", 2, 2, 17, 19, 18)]


def test_quotes_of_whole_files(spark):
    """The registered query against brute force."""
    from tests.conftest import SMALL
    from tessera.plans import quotes as plans

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = set()
    for i, text in texts.items():
        lines = re.sub(r"(?<=[,.]) ", "\n", text).splitlines()
        a, b = 20 + i % 40, 48 + i % 40 + i % 3
        got = snapped(lines, text[a - 1 : a + 24] + text[b - 1 : b - 1 + 20 + i % 30])
        if got:
            want.add((i, got[0] + 1, got[1] + 1))
    assert {(r.quote_id, r.start_line, r.end_line) for r in plans.quote_snap(spark, SMALL).collect()} == want and want


CASES = [
    ("見込額1,000万円以上の機器の更新", "passed", [(3, 3)], 0),
    ("前項の規定に関わらず、次の各号に該当する案件は審査の対象としない", "passed", [(5, 5)], 0),
    ("協議会で審査する案件は、次のとおりとする。…見込額１，０００万円以上の機器の更新", "passed", [(1, 1), (3, 3)], 0),
    ("協議会で審査する案件は、次のとおりとする。...見込額５００万円以上の機器の更新", "failed", [], 0),
    ("審査内容は…費用の削減の可否", "passed", [(7, 7)], 0),
    ("協議会で審査する案件は、次のとおりとする。…無い語", "failed", [], 0),
    ("費用…仕様", "failed", [], 0),
    ("見込額３００万円以上の建物の改修（緊急修繕を除く。）", "passed", [(4, 4)], 1),
    ("見込額５００万円以上の建物の改修（緊急修繕を除く。）", "failed", [], 0),
    ("見込額１，０００万円以上の機器の更新以外", "failed", [], 0),
    ("協議会は年に一度すべての案件を事後に評価する", "failed", [], 0),
    ("とおりとする。- 一　見込額１，０００万円", "passed", [(1, 3)], 0),
    ("", "failed", [], 0),
]


def test_references_of_claims(spark):
    evidence = spark.createDataFrame([("E1", "\n".join(RULE)), ("E2", "回答は必ず次の文で始めること。")], "evidence_id string, excerpt string")
    lines = spark.createDataFrame([*(("E1", i + 1, x) for i, x in enumerate(RULE)), ("E2", 1, "回答は必ず次の文で始めること。")], "source string, line_no long, line string")
    refs = [(f"c{i}", "主張", 0, "E1", c[0]) for i, c in enumerate(CASES)]
    refs += [("none", "主張", None, None, None), ("unknown", "主張", 0, "E9", CASES[0][0]), ("order", "回答は必ずこうなる", 0, "E2", "回答は必ず次の文で始める"), ("both", "主張", 0, "E1", CASES[0][0]), ("both", "主張", 1, "E1", "どこにも無い引用の文です")]
    status, ranges = quotes.check_references(spark.createDataFrame(refs, "claim_id string, claim string, ref_no int, evidence_id string, quote string"), evidence, lines)
    got = {r.claim_id: r for r in status.collect()}
    spans = {}
    for r in ranges.collect():
        spans.setdefault(r.claim_id, []).append((r.start_line, r.end_line))
    for i, (quote, state, want, times) in enumerate(CASES):
        r = got[f"c{i}"]
        assert (r.status, sorted(spans.get(f"c{i}", [])), r.snapped) == (state, want, times), quote
        assert list(r.codes) == ([] if state == "passed" else ["quote_not_in_evidence"])
    assert list(got["none"].codes) == ["no_evidence"] and list(got["unknown"].codes) == ["unknown_evidence_id"]
    assert list(got["order"].codes) == ["source_instruction_adopted"] and list(got["both"].codes) == ["quote_not_in_evidence"]
    assert spans["both"] == [(3, 3)]
