"""Span classes and the font size check: boundaries and graded outcomes."""

import pytest
from pyspark.sql import functions as F

from docketlens.functions.text import is_all_uppercase
from docketlens.operators import fonts
from tests.helpers import check, doc, page, span, spans_df

# name: (size, y, chars, flags, text, predominant) -> class
CLASS_CASES = {
    "body": (10.0, 400.0, 30, 0, "plain words", None, "body"),
    "top zone": (10.0, 50.0, 30, 0, "plain words", None, "header_footer"),
    "bottom zone": (10.0, 750.0, 30, 0, "plain words", None, "header_footer"),
    "exactly a tenth": (10.0, 79.2, 10, 0, "plain words", None, "header_footer"),
    "just inside": (10.0, 80.0, 10, 0, "plain words", None, "body"),
    "superscript flag": (8.0, 400.0, 20, 1, "plain words", None, "superscript"),
    "short and small": (8.0, 400.0, 2, 0, "ab", None, "superscript"),
    "short and large": (12.0, 400.0, 2, 0, "ab", None, "body"),
    "footer before superscript": (8.0, 760.0, 2, 1, "ab", None, "header_footer"),
    "small caps": (8.5, 400.0, 10, 0, "STATEMENT", 13.0, "small_caps"),
    "mixed case": (8.5, 400.0, 10, 0, "Statement", 13.0, "body"),
    "ratio too low": (6.0, 400.0, 10, 0, "ABC", 13.0, "body"),
    "ratio too high": (11.0, 400.0, 10, 0, "ABC", 12.0, "body"),
    "lowest ratio": (11.0, 400.0, 10, 0, "ABC", 20.0, "small_caps"),
    "highest ratio": (8.5, 400.0, 10, 0, "ABC", 10.0, "small_caps"),
    "no body size": (8.5, 400.0, 10, 0, "STATEMENT", None, "body"),
    "no text": (8.5, 400.0, 10, 0, "", 13.0, "body"),
    "caps in footer": (8.5, 750.0, 10, 0, "COURT", 13.0, "header_footer"),
    "caps with flag": (8.0, 400.0, 2, 1, "ST", 13.0, "superscript"),
    "short caps": (8.0, 400.0, 2, 0, "ND", 13.0, "superscript"),
    "citation": (8.5, 400.0, 5, 0, "V.", 13.0, "small_caps"),
    "digits": (8.5, 400.0, 10, 0, "2023", 13.0, "body"),
}


def test_span_classes(spark):
    rows = [(name, *case) for name, case in CLASS_CASES.items()]
    df = spark.createDataFrame(
        rows, "name string, size double, origin_y double, chars int, flags int, text string, "
              "predominant_font_size double, expected string").withColumn("height_pt", F.lit(792.0))
    df = df.withColumn("capitals", is_all_uppercase(F.col("text")))
    got = df.withColumn("position_class", fonts.span_position_class()).select(
        "name", "expected", fonts.final_class().alias("got")).collect()
    assert {r["name"]: r["got"] for r in got} == {r["name"]: r["expected"] for r in got}


@pytest.mark.parametrize("text,expected", [
    ("SMITH,", True), ("V.", True), ("IN RE", True), ("ÉTAT", True),
    ("Smith", False), ("123", False), ("", False), ("...", False)])
def test_all_uppercase(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(is_all_uppercase(F.col("t"))).first()[0] is expected


def words(n):
    """Lower-case text of exactly n characters."""
    return ("abcdefghi " * (n // 10 + 1))[:n - 1] + "z"


def caps(n):
    return words(n).upper()


# doc -> (spans beside a 12 pt majority, passed, severity, pages)
def _font_docs():
    body = [span(no=i, text=words(100)) for i in range(5)]

    def build(*extra, page_no=1):
        return body + [span(no=10 + i, page=page_no, **e) for i, e in enumerate(extra)]

    return {
        "clean": (build(), True, "reject"),
        "15 body chars": (build(dict(text=words(15), size=10.0)), False, "reject"),
        "5 body chars": (build(dict(text=words(5), size=10.0)), False, "note"),
        "exactly 10": (build(dict(text=words(10), size=10.0)), False, "reject"),
        "9 chars": (build(dict(text=words(9), size=10.0)), False, "note"),
        "footer only": (build(dict(text=words(20), size=10.0, y=760.0)), True, "reject"),
        "superscript only": (build(dict(text=words(20), size=8.0, flags=1)), True, "reject"),
        "11.7 accepted": (build(dict(text=words(20), size=11.7)), True, "reject"),
        "11.6 refused": (build(dict(text=words(20), size=11.6)), False, "reject"),
        "few small caps": (build(dict(text=caps(50), size=8.5)), True, "reject"),
        "many small caps": (build(dict(text=caps(200), size=8.5)), False, "reject"),
        "many on the cover": (build(dict(text=caps(200), size=8.5), page_no=0), True, "reject"),
        "small caps and body": (
            build(dict(text=caps(50), size=8.5), dict(text=words(5), size=10.0)), False, "note"),
    }


def test_font_size_outcomes(spark):
    cases = _font_docs()
    spans, pages, docs = [], [], []
    for i, (rows, _, _) in enumerate(cases.values()):
        spans += [(i, *row[1:]) for row in rows]
        pages += [page(i, 0), page(i, 1)]
        docs.append(doc(i))
    got = check(spark, spans, pages, docs, "FMT-006")
    assert {n: (got[i].passed, got[i].severity) for i, n in enumerate(cases)} == {
        n: (c[1], c[2]) for n, c in cases.items()}
    by_name = {n: got[i] for i, n in enumerate(cases)}
    assert by_name["footer only"].details.endswith("headers/footers on pages 2.")
    assert "small caps on pages 1." in by_name["many on the cover"].details
    assert by_name["15 body chars"].message == (
        "Font size 10.0pt found on page 2; minimum is 12.0pt.")
    assert "15 of 515 chars (2.9%) noncompliant — 15 body" in by_name["15 body chars"].details
    assert by_name["15 body chars"].pages == [2]


def test_predominant_size_tie_goes_to_first(spark):
    rows = [span(no=0, size=11.0, font="B"), span(no=1, size=12.0, font="A"),
            span(no=2, size=12.0, font="A"), span(no=3, size=11.0, font="B")]
    stats = fonts.doc_font_stats(fonts.font_histogram(spans_df(spark, rows))).first()
    assert (stats.predominant_font_size, stats.predominant_font, stats.min_font_size) == (
        11.0, "B", 11.0)


def test_style_check(spark):
    spans = [span(doc=1, no=i, flags=2 if i < 6 else 0) for i in range(10)]
    spans += [span(doc=2, no=i, flags=2 if i < 5 else 0) for i in range(10)]
    spans += [span(doc=3, page=0, no=i, flags=18) for i in range(10)]
    got = check(spark, spans, [page(d, p) for d in (1, 2, 3) for p in (0, 1)],
                [doc(d) for d in (1, 2, 3)], "FMT-008")
    assert {d: r.passed for d, r in got.items()} == {1: False, 2: True, 3: True}
    assert "Only 40% of text spans are plain roman. Most common style: italic (6/10" in got[1].details


def test_small_spans_that_begin_with_a_blank(spark):
    """F2, F3, F6 to F15: results count the characters of the trimmed text; four of them are a superscript, fifteen in a hundred a share."""
    spans = [span(doc=1, no=0, text="x" * 100), span(doc=1, no=1, text=" abcd", size=9.0),
             span(doc=2, no=0, text="x" * 85), span(doc=2, no=1, text=" " + "A" * 15, size=8.5)]
    got = check(spark, spans, [page(d, p) for d in (1, 2) for p in (0, 1)], [doc(1), doc(2)], "FMT-006")
    assert {d: (r.passed, r.severity) for d, r in got.items()} == {1: (True, "reject"), 2: (True, "reject")}
    assert got[1].items == ["superscripts on page 2"] and got[2].items == ["small caps on page 2"]
