"""Scalar text functions over query and evidence strings. Each normalisation is its own; they are not interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators, script runs and stop terms that the ranking rules name.
SEPARATORS = r"[\s,、。・/\\]+"
CJK_RUNS = r"[\x{3400}-\x{9fff}々]{2,}|[ァ-ヶー]{2,}"
CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}]"
CONTENT = r"[一-龥々ァ-ヴー]{2,}|[A-Za-z0-9]{2,}"
STOP_TERMS = ["場合", "手順", "方法", "手続", "必要", "内容", "詳細", "具体的", "一覧", "概要"]
POLITE = ["教えてください", "教えて下さい", "何ですか", "いくらですか", "どうすればよいですか"]
CONFLICT = ["対象外", "適用しない", "適用されない", "含まない", "定めない", "支給しない", "記載がない", "記載なし"]
DOCUMENT_NUMBER = r"([一-龥ァ-ヶA-Za-z]{0,4}[0-9]*)第([0-9]+)号"


def windows(text: Column, size: int | Column) -> Column:
    """All substrings of `size` characters, in order; none if the text is shorter."""
    n = F.length(text)
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(text, i, size))).otherwise(F.array().cast("array<string>"))


def split_terms(text: Column) -> Column:
    """Lower-cased terms of two characters or more, each followed by its Han and Katakana runs, first occurrences in order."""
    terms = F.transform(F.split(text, SEPARATORS), lambda t: F.lower(F.trim(t)))
    each = F.transform(terms, lambda t: F.concat(F.when(F.length(t) >= 2, F.array(t)).otherwise(F.array().cast("array<string>")), F.regexp_extract_all(t, F.lit(CJK_RUNS), F.lit(0))))
    return F.array_distinct(F.flatten(each))


def query_ngrams(text: Column) -> Column:
    """Distinct lower-cased 3- to 8-grams of the text without white space."""
    compact = F.regexp_replace(text, r"\s+", "")
    return F.array_distinct(F.transform(F.flatten(F.array(*(windows(compact, n) for n in range(3, 9)))), F.lower))


def compact_raw(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def compact(text: Column) -> Column:
    """Letters and digits only, without polite phrases."""
    out = compact_raw(text)
    for phrase in POLITE:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    return out


def coverage_terms(text: Column, must: Column | None = None) -> Column:
    """Terms that evidence should contain: terms with CJK become their 2-grams, terms of the plan stay as they are."""
    pieces = F.transform(split_terms(text), lambda t: F.when(t.rlike(CJK) & (F.length(t) > 2), windows(t, 2)).otherwise(F.array(t)))
    out = F.flatten(pieces)
    return F.array_distinct(F.concat(out, F.transform(must, F.lower)) if must is not None else out)


def content_terms(text: Column) -> Column:
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CONTENT), F.lit(0)), F.lower))
    return F.filter(found, lambda t: ~t.isin(STOP_TERMS) & ~t.startswith("何"))


def bigrams(text: Column) -> Column:
    return F.array_distinct(windows(text, 2))


def bigram_coverage(haystack: Column, needle: Column) -> Column:
    """Share of the needle's 2-grams that the haystack has; a needle of one character counts if contained."""
    grams = bigrams(needle)
    alone = F.when((needle != "") & haystack.contains(needle), 1.0).otherwise(0.0)
    return F.when(F.size(grams) == 0, alone).otherwise(F.size(F.array_intersect(grams, bigrams(haystack))) / F.size(grams))


def lexical_anchor(needle: Column, haystack: Column, least: int = 4, most: int = 12) -> Column:
    """Length of the longest substring of `least` to `most` characters that compact needle and haystack share, else 0."""
    # A run of a length holds runs of all lesser ones: the first length that isn't shared ends the search.
    shared = lambda n: F.exists(windows(needle, n), lambda g: haystack.contains(g))
    ladder = F.when(~F.coalesce(shared(least), F.lit(False)), 0)
    for n in range(least + 1, most + 1):
        ladder = ladder.when(~F.coalesce(shared(n), F.lit(False)), n - 1)
    return ladder.otherwise(most)


def occurrences(haystack: Column, term: Column) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(haystack) - F.length(F.replace(haystack, term, F.lit("")))) / F.length(term)).cast("long")


def path_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def document_numbers(text: Column) -> Column:
    """`prefix|number` of every document number, without blanks and leading zeros."""
    bare = F.regexp_replace(text, "[ 　\t]+", "")
    prefix, number = (F.regexp_extract_all(bare, F.lit(DOCUMENT_NUMBER), F.lit(g)) for g in (1, 2))
    return F.array_sort(F.array_distinct(F.zip_with(prefix, number, lambda p, n: F.concat(F.lower(p), F.lit("|"), F.regexp_replace(n, "^0+(?=.)", "")))))


def truncate_utf8(text: Column, most: int) -> Column:
    """Longest prefix of at most `most` bytes that splits no character: a character has at most four bytes."""
    raw = text.cast("binary")
    starts = F.array(*(F.when(~F.hex(F.substring(raw, most + 1 - k, 1)).rlike("^[89AB]"), F.lit(most - k)) for k in range(4)))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(raw, F.lit(1), F.array_max(starts)).cast("string"))
