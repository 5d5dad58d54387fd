"""Main units of a document: its sections, their appendices and notes, and its paragraphs, each told apart from ancillary matter.

Everything is windows over (path, line_no) and one aggregation of line features a grouping: units are neither joined to their lines
nor gathered as texts, since every rule is a count or a quantifier over lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import structure

# Headings, lines and wordings by which ancillary matter is known; marks of appendices, notes and empty forms.
ANCILLARY_HEADING = r"宛先|宛て|発出|発信|照会|問い?合わ?せ|連絡先|担当|様式|適用日|適用期日|施行日|施行期日|附則|付則|実施時期|施行時期|適用時期"
ANCILLARY_LINE = (
    r"殿[\s　]*$|様[\s　]*$|^[\s　]*(?:令和|平成|昭和)?[\s　]*[0-9０-９元]+[\s　]*年[\s　]*[0-9０-９]+[\s　]*月[\s　]*[0-9０-９]+[\s　]*日[\s　]*(?:付)?[\s　]*$"
    r"|(?:課長|部長|局長|室長|所長|係長|担当|の長)[\s　]*(?:[（(][^）)]*[）)])?[\s　]*$|内線|電話|TEL|E-?mail|メール"
    r"|第[\s　]*[0-9０-９]+[\s　]*号[\s　]*$|^[\s　]*事務連絡[\s　]*$|^[\s　]*【[^】]*】[\s　]*$|^[\s　]*(?:記|以上)[\s　]*$"
)
LINE_MARKUP = r"^[\s　>＞*＊_]+|[\s　*＊_]+$"
SHORT_LINE = 40
QUALIFYING = r"経過措置|ただし|但し|例外|除く|除き|条件|要件|限り|適用しない|適用除外|場合"
CONTACT = r"照会(?:されたい|ください|願います|先)|問い?合わ?せ(?:先|ください|願います)|連絡先"
STRONG_QUALIFIER = r"経過措置|ただし|但し|例外|除く|除き|適用しない|適用除外|この限りでない"
APPENDIX = r"^[（(]?(?:別紙|別表|別添)[0-9０-９一二三四五六七八九十]*[）)]?$"
NOTE = r"^(?:※|＊注|注）|（注）)"
PLACEHOLDER = r"^[○●□◯〇・\s　（）()\-－―]*$"
TABLE_RULE = r"^\|[\s　|:\-]+\|?$"
BLANK = r"^[\s　]*$"
FRONT_MATTER_LINES = 200


def line_features(rows: DataFrame) -> DataFrame:
    """Adds what the rules ask of a single line; rows: path, line_no, line."""
    bare, kept = F.regexp_replace("line", r"^[\s　]+|[\s　]+$", ""), F.regexp_replace("line", LINE_MARKUP, "")
    marked = rows.withColumn("bare", bare).withColumn("s", kept)
    s, of = F.col("s"), F.col("bare")
    table = of.startswith("|") & ~of.rlike(TABLE_RULE)
    cells = F.transform(F.split(F.regexp_replace(of, r"^\|+|\|+$", ""), r"\|"), lambda c: F.regexp_replace(c, r"^[\s　]+|[\s　]+$", ""))
    count = lambda test: F.when(table, F.size(F.filter(cells, test)).cast("long"))
    empty = lambda c: c.rlike(PLACEHOLDER)
    answer = F.when(table, F.struct(count(lambda c: F.lit(True)).alias("cells"), count(lambda c: empty(c) | c.contains("○○") | c.contains("●●")).alias("blank"), count(lambda c: ~empty(c)).alias("filled"), count(lambda c: ~empty(c) & c.rlike(r"[。？?][\s　]*$|か[\s　]*$")).alias("asked")))
    prose = (of != "") & ~of.startswith("#") & ~of.startswith("|")
    plain = ~s.contains("。")
    return marked.select(
        *rows.columns,
        "s",
        (of != "").alias("full"),
        of.startswith("※").alias("starred"),
        answer.alias("row"),
        F.when(prose, s.rlike("(：|:)$") | s.rlike("^(※|（注|注)") | (plain & (F.length(s) <= 20))).alias("form_line"),
        F.when(s != "", s.rlike("^(記|以上)$")).alias("closing"),
        F.when(s != "", plain & (F.length(s) <= SHORT_LINE)).alias("short"),
        F.when(s != "", s.rlike(ANCILLARY_LINE)).alias("ancillary_line"),
        F.col("line").rlike(CONTACT).alias("contact"),
        F.col("line").rlike(STRONG_QUALIFIER).alias("strong"),
        F.col("line").rlike(QUALIFYING).alias("qualifying"),
    )


def _facts() -> list[Column]:
    """Aggregates of a group's body lines (column `body`), from which judge() decides."""
    own = lambda c: F.when(F.col("body"), F.col(c))
    whole = lambda c: F.coalesce(F.sum(F.when(F.col("body"), F.col(f"row.{c}"))) - F.min_by(own("row")[c], F.when(F.col("body") & F.col("row").isNotNull(), F.col("line_no"))), F.lit(0))
    every = lambda c: F.coalesce(F.bool_and(own(c)), F.lit(True))
    some = lambda c: F.coalesce(F.bool_or(own(c)), F.lit(False))
    parts = [F.count(own("row")).alias("rows"), *(whole(c).alias(c) for c in ("cells", "blank", "filled", "asked")), *(every(c).alias(c) for c in ("form_line", "closing", "short", "ancillary_line")), *(some(c).alias(c) for c in ("contact", "strong", "qualifying")), F.count(F.when(F.col("body") & (F.col("s") != ""), 1)).alias("content")]
    return [F.struct(*parts).alias("facts"), some("full").alias("any_full")]


def blank_form(f: Column) -> Column:
    """Whether facts are those of an empty form: a table whose cells below its head are open, and short lines besides."""
    asked = (f["filled"] > 0) & (f["asked"] >= 0.3 * f["filled"])
    return (f["rows"] >= 2) & (f["cells"] > 0) & (f["blank"] >= 0.3 * f["cells"]) & ~asked & f["form_line"]


def judge(f: Column, heading: Column, header: Column) -> Column:
    """Whether a range is ancillary, from the facts of its body, its heading (empty without one), and whether it stands before the first heading."""
    headed, some = heading != "", f["content"] > 0
    return (
        F.when(~headed & some & f["closing"], True)
        .when(blank_form(f) & ~f["strong"], True)
        .when(~headed & f["contact"] & ~f["strong"], True)
        .when(header & ~headed & some & f["short"], True)
        .when(f["qualifying"], False)
        .when(headed, heading.rlike(ANCILLARY_HEADING))
        .otherwise(some & f["ancillary_line"])
    )


def _placed(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """Lines with the unit section they lie in (null outside), and what a file's outline says of them.

    A title that wraps the whole file makes its direct sections the units, else the outermost sections are units; a lone heading without sections makes none.
    """
    whole = Window.partitionBy("path")
    roots = F.count_if(F.col("parent_line").isNull()).over(whole)
    first = F.min(F.when(F.col("parent_line").isNull(), F.col("line_no"))).over(whole)
    nested = F.coalesce(F.lead("line_no").over(structure.by_line()) <= F.col("section_end"), F.lit(False))
    marks = sections.select("path", "line_no", "heading", nested.alias("nested"), F.when(roots > 1, F.col("parent_line").isNull()).otherwise(F.coalesce(F.col("parent_line") == first, F.lit(False))).alias("unit"), ((roots == 1) & (F.col("line_no") == first)).alias("title"))
    upto = structure.by_line().rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(marks, ["path", "line_no"], "left")
    at = F.last(F.when(F.col("unit"), F.struct(F.col("line_no").alias("start"), F.col("heading").alias("heading"), F.col("nested").alias("nested"))), ignorenulls=True).over(upto)
    headed = F.max(F.col("title").isNotNull()).over(whole) & (F.count("title").over(upto) == 0)
    return met.withColumn("at", at).withColumn("header", headed).withColumn("title", F.coalesce("title", F.lit(False)))


def _pieces(placed: DataFrame) -> DataFrame:
    """Lines with piece (kind, number, paragraph): where a section without sections of its own is cut at appendices and notes."""
    inside = F.col("at").isNotNull() & (F.col("line_no") > F.col("at.start")) & ~F.col("at.nested")
    appendix = inside & F.col("s").rlike(APPENDIX)
    starred = F.coalesce(F.lag("starred").over(structure.by_line()), F.lit(False))
    note = inside & ~appendix & F.col("s").rlike(NOTE) & ~starred
    cut = placed.withColumn("mark", F.when(appendix, F.struct(F.lit("appendix").alias("kind"), F.regexp_replace("s", "^[（）()]+|[（）()]+$", "").alias("label"))).when(note, F.struct(F.lit("note").alias("kind"), F.lit("注記").alias("label"))))
    upto = Window.partitionBy("path", "at.start").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = cut.withColumn("number", F.count("mark").over(upto)).withColumn("mark", F.last("mark", ignorenulls=True).over(upto))
    gaps = F.count_if(~F.col("full")).over(structure.by_line().rowsBetween(Window.unboundedPreceding, 0))
    kind = F.when(F.col("at").isNull(), "paragraph").when(F.col("mark").isNull(), "body").otherwise(F.col("mark.kind"))
    split = numbered.withColumn("kind", kind).withColumn("gaps", gaps)
    return split.withColumn("paragraph", F.when(F.col("kind").isin("paragraph", "note"), F.col("gaps")).otherwise(-1))


def main_units(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """(path, start_line, end_line, heading, kind, ancillary) of every unit; rows: path, line_no, line; sections as structure.sections gives them.

    Kinds: section, paragraph (outside sections), and body, appendix and note, which replace a section that has several of them. Their
    headings are the section's, followed by the label of the piece.
    """
    placed = _placed(line_features(rows.select("path", "line_no", "line")), sections)
    lines = _pieces(placed).withColumn("start", F.col("at.start")).withColumn("section", F.col("at.heading")).withColumn("body", F.coalesce(F.col("line_no") > F.col("at.start"), F.lit(True)))
    of_piece = lines.where(~((F.col("kind") == "paragraph") & (F.col("title") | ~F.col("full"))) & ~((F.col("kind") == "note") & ~F.col("full")))
    pieces = of_piece.groupBy("path", "start", "section", "kind", "number", "paragraph", "header").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.max("mark.label").alias("label"), *_facts())
    pieces = pieces.where((F.col("kind") != "body") | F.col("any_full"))
    several = F.when(F.col("start").isNull(), 2).otherwise(F.count("*").over(Window.partitionBy("path", "start")))
    pieces = pieces.withColumn("several", several).where("several > 1")
    own = F.when(F.col("kind") == "body", F.col("section")).otherwise("")
    label = F.when(F.col("start").isNull(), "").when(F.col("kind") == "body", F.col("section")).otherwise(F.concat("section", F.lit("／"), "label"))
    cut = pieces.select("path", "start", "start_line", "end_line", label.alias("heading"), "kind", judge(F.col("facts"), own, F.col("header") & F.col("start").isNull()).alias("ancillary"))
    wholes = lines.where("start is not null").groupBy("path", "start", "section").agg(F.max("line_no").alias("end_line"), *_facts())
    whole = wholes.select("path", "start", F.col("start").alias("start_line"), "end_line", F.col("section").alias("heading"), F.lit("section").alias("kind"), judge(F.col("facts"), F.col("section"), F.lit(False)).alias("ancillary"))
    uncut = whole.join(cut.where("start is not null").select("path", "start").distinct(), ["path", "start"], "left_anti")
    columns = ["path", "start_line", "end_line", "heading", "kind", "ancillary"]
    return cut.select(columns).unionByName(uncut.select(columns))


def read_ranges(rows: DataFrame, sections: DataFrame, units: DataFrame) -> DataFrame:
    """(path, unit_line, start_line, end_line, heading): what is read of each unit, section by section.

    A unit that is a section is read as the introductions of all its sections, those without text left out; the others are read whole.
    """
    marks = sections.select("path", "line_no", F.col("heading").alias("title"))
    upto = structure.by_line().rowsBetween(Window.unboundedPreceding, 0)
    met = rows.select("path", "line_no", "line").join(marks, ["path", "line_no"], "left")
    inner = met.withColumn("at", F.last(F.when(F.col("title").isNotNull(), F.struct(F.col("line_no").alias("line"), F.col("title").alias("title"))), ignorenulls=True).over(upto)).where("at is not null")
    text = inner.groupBy("path", "at").agg(F.max("line_no").alias("end_line"), F.bool_or((F.col("line_no") > F.col("at.line")) & ~F.col("line").rlike(BLANK)).alias("full")).where("full")
    intro = text.select("path", F.col("at.line").alias("start_line"), "end_line", F.col("at.title").alias("heading"))
    # An introduction belongs to the last section unit that begins at or before it.
    starts = units.where("kind = 'section'").select("path", F.col("start_line").alias("at"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("long").alias("to"), F.col("end_line").alias("unit_end"))
    both = starts.unionByName(intro.select("path", F.col("start_line").alias("at"), "heading", F.col("end_line").alias("to"), F.lit(None).cast("long").alias("unit_end")))
    order = Window.partitionBy("path").orderBy("at", F.col("unit_end").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("unit_end").isNotNull(), F.struct(F.col("at").alias("line"), F.col("unit_end").alias("end"))), ignorenulls=True).over(order)
    owned = both.withColumn("unit", owner).where("unit_end is null and at <= unit.end").select("path", F.col("unit.line").alias("unit_line"), F.col("at").alias("start_line"), F.col("to").alias("end_line"), "heading")
    return owned.unionByName(units.where("kind <> 'section'").select("path", F.col("start_line").alias("unit_line"), "start_line", "end_line", "heading"))


def classify_ranges(rows: DataFrame, sections: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (range_id, path, start_line, end_line) with ancillary: whether a range holds ancillary matter only.

    Ranges are taken apart into lines, which meet the file's lines by (path, line_no).
    """
    lines = line_features(rows.select("path", "line_no", "line"))
    front = structure.by_line().rowsBetween(Window.unboundedPreceding, 0)
    ruled = F.regexp_replace("line", r"^[\s　]+|[\s　]+$", "") == "---"
    opened = F.first(ruled).over(front)
    closed = F.min(F.when(ruled & F.col("line_no").between(2, FRONT_MATTER_LINES), F.col("line_no"))).over(Window.partitionBy("path"))
    first = sections.groupBy("path").agg(F.min("line_no").alias("first_heading"))
    marked = lines.withColumn("closing_line", F.when(opened, closed)).join(sections.select("path", "line_no", "heading"), ["path", "line_no"], "left").join(first, "path", "left")
    asked = ranges.where("start_line >= 1 and end_line >= start_line").select("range_id", "path", "start_line", "end_line", F.explode(F.sequence("start_line", "end_line")).alias("line_no"))
    met = asked.join(marked, ["path", "line_no"])
    own = Window.partitionBy("range_id")
    headed = F.max(F.when(F.col("line_no") == F.col("start_line"), F.col("heading"))).over(own)
    last = F.max("line_no").over(own)
    placed = met.withColumn("own", headed).withColumn("body", ~((F.col("line_no") == F.col("start_line")) & F.col("heading").isNotNull())).withColumn("header", F.coalesce(last < F.col("first_heading"), F.lit(True)))
    placed = placed.withColumn("gap", F.count_if(~F.col("full")).over(Window.partitionBy("range_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    whole = placed.groupBy("range_id").agg(*_facts(), F.max("own").alias("own"), F.bool_and(~F.col("full") | F.coalesce(F.col("line_no") <= F.col("closing_line"), F.lit(False))).alias("in_front"), F.max("closing_line").isNotNull().alias("fronted"))
    paragraphs = placed.where("full and body").groupBy("range_id", "gap", "header").agg(*_facts())
    every = paragraphs.groupBy("range_id").agg(F.bool_and(judge(F.col("facts"), F.lit(""), F.col("header"))).alias("all_paragraphs"))
    heading = F.coalesce("own", F.lit(""))
    loose = F.col("all_paragraphs") | (F.col("all_paragraphs").isNotNull() & blank_form(F.col("facts")) & ~F.col("facts.strong"))
    done = whole.join(every, "range_id", "left").select("range_id", F.when(F.col("fronted") & F.col("in_front"), True).when(heading != "", judge(F.col("facts"), heading, F.lit(False))).otherwise(F.coalesce(loose, F.lit(False))).alias("ancillary"))
    return ranges.join(done, "range_id", "left").select(*ranges.columns, F.coalesce("ancillary", F.lit(False)).alias("ancillary"))


def operative_dates(rows: DataFrame, units: DataFrame, operative: Column) -> DataFrame:
    """(path, line_no, heading): the one ancillary unit of a file whose only line of text states from when a rule holds; operative: that test of a line."""
    text = rows.where(~F.col("line").rlike(BLANK) & ~F.ltrim("line").startswith("#")).select("path", "line_no", "line")
    starts = units.select("path", F.col("start_line").alias("at"), F.struct("start_line", "end_line", "heading", "ancillary").alias("unit"))
    both = text.select("path", F.col("line_no").alias("at"), "line", F.lit(None).cast(starts.schema["unit"].dataType).alias("unit")).unionByName(starts.withColumn("line", F.lit(None).cast("string")))
    order = Window.partitionBy("path").orderBy("at", F.col("unit").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("of", F.last("unit", ignorenulls=True).over(order)).where("line is not null and of.ancillary and at <= of.end_line")
    alone = inside.groupBy("path", "of").agg(F.count("*").alias("n"), F.min("at").alias("line_no"), F.min("line").alias("line")).where("n = 1").where(operative)
    return alone.groupBy("path").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"), F.min("of.heading").alias("heading")).where("n = 1").select("path", "line_no", "heading")


def share_budget(rows: DataFrame, units: DataFrame, budget: int) -> DataFrame:
    """(path, part, start_line, end_line, heading, complete): what of each file's main units is read within `budget` characters, what isn't, and what is ancillary.

    Every main unit first gets an equal share, then what is left goes to the units in order; lines are read whole. A line that is read ends
    within the budget, so the fold in order sees no lines beyond that.
    """
    cost = rows.select("path", F.col("line_no").alias("at"), (F.length("line") + 1).cast("long").alias("cost"), F.lit(None).cast("struct<start_line:bigint,end_line:bigint,heading:string>").alias("unit"))
    main = units.where("not ancillary").select("path", F.col("start_line").alias("at"), F.lit(None).cast("long").alias("cost"), F.struct("start_line", "end_line", "heading").alias("unit"))
    order = Window.partitionBy("path").orderBy("at", F.col("unit").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = main.unionByName(cost).withColumn("of", F.last("unit", ignorenulls=True).over(order)).where("cost is not null and at <= of.end_line")
    upto = Window.partitionBy("path", "of.start_line").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    near = inside.withColumn("c", F.sum("cost").over(upto)).withColumn("c", F.when(F.col("c") <= budget, F.col("c")))
    each = near.groupBy("path", "of").agg(F.array_sort(F.collect_list("c")).alias("c"))  # costs are at least 1: in the order of lines
    files = each.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.col("of.start_line").alias("start_line"), F.col("of.end_line").alias("end_line"), F.col("of.heading").alias("heading"), "c"))).alias("u"))
    at = lambda c, k: F.coalesce(F.get(c, k - 1), F.lit(0).cast("long"))
    fit = lambda c, most: F.size(F.filter(c, lambda x: x <= most))
    share = F.floor(F.lit(budget) / F.size("u"))
    first = files.withColumn("k", F.transform("u", lambda u: fit(u["c"], share)))
    used = F.aggregate(F.zip_with("u", "k", lambda u, k: at(u["c"], k)), F.lit(0).cast("long"), lambda a, x: a + x)
    state = F.struct((F.lit(budget).cast("long") - used).alias("left"), F.array().cast("array<int>").alias("k"))

    def step(acc: Column, x: Column) -> Column:
        base = at(x["u"]["c"], x["k"])
        k = F.greatest(fit(x["u"]["c"], base + acc["left"]), x["k"])
        return F.struct((acc["left"] - at(x["u"]["c"], k) + base).alias("left"), F.concat(acc["k"], F.array(k)).alias("k"))

    done = first.withColumn("s", F.aggregate(F.arrays_zip("u", "k"), state, step))
    each = done.select("path", F.explode(F.arrays_zip("u", F.col("s.k").alias("k"))).alias("x")).select("path", "x.u.start_line", "x.u.end_line", "x.u.heading", (F.col("x.u.start_line") + F.col("x.k") - 1).alias("to"))
    whole = (F.col("to") >= F.col("end_line")).alias("complete")
    read = each.where("to >= start_line").select("path", F.lit("read").alias("part"), "start_line", F.col("to").alias("end_line"), "heading", whole)
    unread = each.where("to < end_line").select("path", F.lit("unread").alias("part"), F.greatest("start_line", F.col("to") + 1).alias("start_line"), "end_line", "heading", F.lit(False).alias("complete"))
    aside = units.where("ancillary").select("path", F.lit("ancillary").alias("part"), "start_line", "end_line", "heading", F.lit(False).alias("complete"))
    return read.unionByName(unread).unionByName(aside)
