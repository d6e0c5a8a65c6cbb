"""Baseline gaps, margins, page numbers, counts of pages."""

import json
import random
import re
from statistics import median

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conformance import views as V
from docketlens import schema as S
from docketlens.operators import documents, layout
from docketlens.sources import readers
from tests.helpers import check, doc, page, pages_df, span, spans_df


def spacing(spark, rows):
    got = layout.page_line_spacing(spans_df(spark, rows)).collect()
    return got[0].line_spacing if got else None


def lines(ys, per_block=100, **kw):
    return [span(block=i // per_block, line=i % per_block, y=y, **kw) for i, y in enumerate(ys)]


@pytest.mark.parametrize("gap", [14.4, 16.56, 21.6, 24.0, 28.8, 12.0, 20.0, 19.0])
def test_gap_is_recovered(spark, gap):
    ys = [100 + i * gap for i in range(8)]
    assert spacing(spark, lines(ys)) == pytest.approx(gap)
    assert spacing(spark, lines(ys, per_block=1)) == pytest.approx(gap)


@pytest.mark.parametrize("rows", [
    [], lines([100.0]), lines([100.0, 105.0]), lines([100.0, 165.0]),
    lines([100.0, 108.0]), lines([100.0, 160.0]),
    [span(block=i, y=100.0 + 24 * i, kind=1) for i in range(4)]])
def test_no_gap(spark, rows):
    assert spacing(spark, rows) is None


def test_median_and_outliers(spark):
    assert spacing(spark, lines([0, 24, 48, 72, 96, 146])) == 24
    assert spacing(spark, lines([0, 14, 28, 42, 66, 90, 114, 138, 162])) == 24
    assert spacing(spark, lines([0, 20, 44])) == 22  # mean of the middle two


def test_blank_line_breaks_the_chain(spark):
    rows = [span(line=0, y=100.0), span(line=1, y=124.0, text="   "), span(line=2, y=148.0)]
    assert spacing(spark, rows) is None
    rows = [span(line=0, y=100.0), span(line=0, no=1, y=90.0, text=" "), span(line=1, y=124.0)]
    assert spacing(spark, rows) == 24.0


def test_image_between_blocks_is_ignored(spark):
    rows = [span(block=0, y=100.0), span(block=1, y=110.0, kind=1), span(block=2, y=124.0)]
    assert spacing(spark, rows) == 24.0


@pytest.mark.parametrize("values,passed", [
    ([None, 24, 24, 24], True), ([None, 20, 20], True), ([None, 19.9, 19.9], False),
    ([14.4, 24, 24], True), ([None, None], True),
    ([None, 14, 14, 14, 24, 14, 24, 14], False)])
def test_double_spacing(spark, values, passed):
    spans = []
    for no, gap in enumerate(values):
        ys = [100.0] if gap is None else [100.0, 100.0 + gap]
        spans += lines(ys, page=no)
    pages = [page(no=n) for n in range(len(values))]
    assert check(spark, spans, pages, [doc()], "FMT-009")[1].passed is passed


def number(text, block=9, doc_=1, page_=0, top=740.0):
    return span(doc=doc_, page=page_, block=block, text=text, y=750.0,
                box=(300.0, top, 312.0, top + 15))


def test_page_numbers(spark):
    texts = ["1", "- 2 -", "iv", "— 3 —", "12a", "Page 4", "civic", "--5"]
    rows = [number(t, doc_=i) for i, t in enumerate(texts)]
    rows += [number("7", doc_=20, top=700.0)]  # above the bottom zone
    rows += [number("9", block=8, doc_=21), number("3", block=7, doc_=21)]
    got = {r.doc_id: r.page_number_text
           for r in layout.page_number_blocks(spans_df(spark, rows)).collect()}
    assert got == {0: "1", 1: "- 2 -", 2: "iv", 3: "— 3 —", 6: "civic", 21: "3"}


def test_page_number_over_several_spans(spark):
    rows = [span(page=0, block=5, no=i, text=t, y=750.0, box=(300.0, 740.0, 312.0, 755.0))
            for i, t in enumerate(["- ", "1", "2", " -"])]
    assert layout.page_number_blocks(spans_df(spark, rows)).first().page_number_text == "- 12 -"
    rows[1] = span(page=0, block=5, no=1, text="x y", y=750.0, box=(300.0, 740.0, 312.0, 755.0))
    assert layout.page_number_blocks(spans_df(spark, rows)).count() == 0


def test_margins_leave_page_numbers_out(spark):
    body = span(page=0, box=(108.0, 72.0, 540.0, 720.0))
    rows = [body, span(doc=2, page=0, box=(108.0, 72.0, 540.0, 720.0)),
            number("7", doc_=2), span(doc=3, page=0, block=9, text="draft", y=760.0,
                                      box=(20.0, 750.0, 600.0, 780.0)), (3, *body[1:])]
    got = {r.doc_id: [round(v, 4) for v in r[2:]] for r in layout.page_margins(
        spans_df(spark, rows), pages_df(spark, [page(d) for d in (1, 2, 3, 4)])).collect()}
    assert got[1] == got[2] == [1.5, 1.0, 1.0, 1.0]
    assert got[3] == [round(20 / 72, 4), round(12 / 72, 4), 1.0, round(12 / 72, 4)]
    assert got[4] == [8.5, 8.5, 11.0, 11.0]


def test_margin_tolerance(spark):
    spans = [span(doc=1, page=0, box=(104.4, 72.0, 540.0, 720.0)),
             span(doc=2, page=0, box=(104.3, 72.0, 540.0, 720.0))]
    got = check(spark, spans, [page(1), page(2)], [doc(1), doc(2)], "FMT-002")
    assert got[1].passed and not got[2].passed
    assert got[2].pages == [1] and got[2].message == 'Left Margin < 1.5" on 1.'


def test_addendum_and_page_limit(spark):
    pages = [page(1, n, "Addendum" if n == 39 else "x") for n in range(45)]
    pages += [page(2, n, "see addendum A") for n in range(39)]
    pages += [page(3, n, "text\n  ADDENDUM  \nmore" if n == 2 else "x") for n in range(60)]
    counts = {r.doc_id: (r.total_pages, r.addendum_start, r.body_pages)
              for r in documents.doc_page_counts(pages_df(spark, pages)).collect()}
    assert counts == {1: (45, 39, 39), 2: (39, None, 39), 3: (60, 2, 2)}
    got = check(spark, [], pages, [doc(1), doc(2, "unknown"), doc(3)], "PG-001")
    assert (got[1].passed, got[2].passed, got[3].passed) == (False, True, True)
    assert not got[2].applicable
    assert got[1].details == ("Body pages (excluding addendum): 39. "
                              "Addendum starts at page 40.")


def test_result_rows_per_document(spark):
    from docketlens.plans.mechanical import mechanical_checks
    from tests.helpers import docs_df
    rows = mechanical_checks(
        docs_df(spark, [doc(1), doc(2)]), pages_df(spark, [page(1)]),
        spans_df(spark, [span(page=0)])).collect()
    by_doc = {d: [r for r in rows if r.doc_id == d] for d in (1, 2)}
    assert len(by_doc[1]) == 19 and len(by_doc[2]) == 18
    none = {r.check_id: r for r in by_doc[2]}
    assert "FMT-012" not in none and not none["FMT-001"].passed
    assert none["FMT-001"].message == "No pages found in PDF."


def test_cover_number(spark):
    rows = [number("1", doc_=1), number("- 1 -", doc_=2), number("2", doc_=3)]
    got = check(spark, rows, [page(d) for d in (1, 2, 3, 4)], [doc(d) for d in (1, 2, 3, 4)],
                "FMT-012")
    assert {d: r.passed for d, r in got.items()} == {1: True, 2: True, 3: False, 4: False}


def test_layout_json_round_trip(spark, tmp_path):
    nested = {"doc_id": 5, "path": "x.pdf", "pages": [{
        "page_no": 0, "width_pt": 612.0, "height_pt": 792.0, "text": "a\nb", "blocks": [
            {"type": 0, "bbox": [1.0, 2.0, 3.0, 4.0], "lines": [
                {"spans": [{"text": "a", "font": "F", "size": 12.0, "flags": 0,
                            "origin": [1.0, 20.0]}]},
                {"spans": []}]},
            {"type": 0, "bbox": [1.0, 2.0, 3.0, 4.0], "lines": []},
            {"type": 1, "bbox": [0.0, 0.0, 9.0, 9.0]}]}]}
    (tmp_path / "one.json").write_text(json.dumps(nested) + "\n{broken\n")
    frame = readers.read_layout(spark, str(tmp_path)).filter("doc_id is not null")
    rows = layout.flatten_layout(frame).orderBy("block_no", "line_no").collect()
    assert [(r.block_no, r.block_type, r.line_no, r.span_no, r.text) for r in rows] == [
        (0, 0, 0, 0, "a"), (0, 0, 1, None, ""), (1, 0, None, None, ""), (2, 1, None, None, "")]
    assert rows[0].origin_y == 20.0 and rows[0].by1 == 4.0


def _odd_layout(spark):
    """Several lines a block, images, blank lines, blocks without lines, missing fields, two page numbers."""
    draw = random.Random(5)

    def span_(y):
        return (draw.choice(["word", " ", "", None, "Ü 1"]), "F", 12.0, 0, draw.choice([[0.0, y], [0.0, y], [], None]))

    def block_(i):
        y = 60.0 + i * draw.choice([20.0, 45.0, 90.0])
        lines = draw.choice([None, [], [(None,)], [([],)], *[[([span_(y + 14.5 * k) for _ in range(draw.randint(1, 3))],)
                                                       for k in range(draw.randint(1, 4))]] * 6])
        return (draw.choice([0, 0, 0, 1]), draw.choice([[100.0 - i, y - 10, 500.0 + i, y + 40], [90.0, y - 10, 520.0, y + 40]]), lines)

    def number_(text, kind=0, top=750.0):
        return (kind, [300.0, top, 310.0, 760.0], [([(text[:1], "F", 9.0, 0, [0.0, 755.0])],), ([(text[1:], "F", 9.0, 0, [0.0, 757.0])],)])

    docs = []
    for d in range(40):
        pages = [(p, 612.0, 792.0, "text\nof page", [block_(i) for i in range(draw.randint(0, 6))]
                  + draw.choice([[], [number_("12")], [number_("- iv -"), number_("13")], [number_("12 a")], [number_("7", 1)]]))
                 for p in range(3)]
        docs.append((d, "p", None, pages + draw.choice([[], [(3, 612.0, 792.0, None, None)]])))
    schema = T.StructType(S.LAYOUT.fields[:4])
    return spark.createDataFrame(docs, schema)


def test_nested_rows_give_what_flattened_spans_give(spark, tmp_path):
    nested = _odd_layout(spark)
    spans, pages = layout.flatten_layout(nested), layout.layout_pages(nested)

    def same(a, b):
        assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
        assert b.count() > 20

    same(layout.nested_baseline_gaps(nested), layout.baseline_gaps(spans))
    same(layout.nested_page_numbers(nested), layout.page_number_blocks(spans))
    same(layout.nested_page_margins(nested), layout.page_margins(spans, pages))
    same(layout.nested_line_spacing(nested), layout.page_line_spacing(spans))
    same(layout.nested_page_facts(nested), layout.page_facts(spans, pages))
    nested.write.json(str(tmp_path / "layout"))
    plan = layout.nested_page_facts(spark.read.schema(S.LAYOUT).json(str(tmp_path / "layout")))
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Generate explode") == 1


def test_medians_and_bitmaps_against_plain_lists(spark):
    draw = random.Random(8)
    rows = [(d, p, draw.choice([None, 12.0, 14.4, 24.0, draw.random() * 50]), draw.random() < 0.3)
            for d in range(30) for p in draw.sample(range(400), draw.randint(1, 200))]
    rows += [(99, 0, 20.0, True), (98, 5, None, False), (97, 0, None, False)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, line_spacing double, bad boolean").repartition(7)
    got = {r.doc_id: (r.median_spacing, r.body_spacing) for r in documents.spacing_medians(df).collect()}
    for d in {r[0] for r in rows}:
        every = [r[2] for r in rows if r[0] == d and r[2] is not None]
        body = [r[2] for r in rows if r[0] == d and r[2] is not None and r[1] > 0]
        assert got.get(d, (None, None)) == (median(every) if every else None, median(body) if body else None)
    plan = documents.spacing_medians(df)._jdf.queryExecution().executedPlan().toString()
    assert "median" not in plan.replace("median_spacing", "") and "percentile" not in plan and "collect" not in plan
    pages = {r.doc_id: (r.pages, r.min_value) for r in documents.bad_pages(df, F.col("bad"), F.col("page_no")).collect()}
    for d in {r[0] for r in rows}:
        bad = sorted(r[1] for r in rows if r[0] == d and r[3])
        assert pages[d] == ([p + 1 for p in bad], bad[0] if bad else None)


@pytest.mark.parametrize("n,block", [(1, 1), (3, 2), (10, 1000), (7, 3), (1000, 2)])
def test_text_parts_of_pages(spark, n, block):
    draw = random.Random(n)
    rows = [(d, p, draw.choice(["", None, "é", "two\nlines", "x" * 23])) for d in range(25) for p in range(draw.randint(1, 9))]
    rows += [(50, 0, None), (51, 0, ""), (52, 0, ""), (52, 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, text string").repartition(5)
    wanted = []
    for d in {r[0] for r in rows}:
        whole = "\n\n".join(t for _, _, t in sorted((r for r in rows if r[0] == d), key=lambda r: r[1]) if t is not None)
        cut = [whole[i:i + n] for i in range(0, len(whole), n)] or [""]
        wanted += [(d, i + 1, len(cut), t) for i, t in enumerate(cut)]
    got = sorted(tuple(r) for r in documents.text_parts(df, n, block).collect())
    assert got == sorted(wanted)


def test_nested_views_are_built_and_read_without_a_shuffle(spark, sf_dir):
    nested = V.fx_layout(spark, sf_dir)
    for df in (nested, layout.nested_baseline_gaps(nested), layout.nested_page_margins(nested), layout.nested_page_numbers(nested)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    flat = layout.flatten_layout(nested).filter("block_type = 0").groupBy("doc_id", "page_no").agg(F.count("*"), F.sum("size"), F.max("text"))
    spans = V.fx_spans(spark, sf_dir).filter("block_type = 0").groupBy("doc_id", "page_no").agg(F.count("*"), F.sum("size"), F.max("text"))
    assert sorted(flat.collect()) == sorted(spans.collect())


def test_pages_with_a_value_are_chosen_without_repeating_its_expression(spark, sf_dir):
    """A filter on the value would be pushed below its steps and repeat them, once for each use."""
    df = layout.nested_line_spacing(V.fx_layout(spark, sf_dir))
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in text.splitlines() if "Filter " in line.split("[")[0] and "blocks" in line]
    assert df.filter("line_spacing is null").count() == 0


def test_spans_combine_before_lists_are_made(spark, sf_dir):
    """lists are made of lines and numerals, not of every span; repeated spans stay repeated."""
    text = layout.line_rows(V.fx_spans(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"(?<!Object)HashAggregate\(keys=\[[^\]]*piece", text) and text.count("Exchange") == 1
    low = (300.0, 748.0, 312.0, 763.0)
    rows = [span(page=0, block=9, line=i // 2, no=i % 2, y=760.0, text=t, box=low) for i, t in enumerate(["-", " 1", "2 ", "-"])]
    rows += [span(page=0, block=0, line=i, y=100.0 + 24 * i) for i in range(3)]
    # A block that is a number but for one span, and one of which only a line stands in the bottom zone.
    rows += [span(page=1, block=8, no=i, y=750.0, text=t, box=low) for i, t in enumerate("3x")]
    rows += [span(page=2, block=8, y=750.0, text="4", box=low), span(page=2, block=8, line=1, y=100.0, text="x")]
    rows += [span(page=3, block=8, y=750.0, text="5", box=low)] * 2
    got = {(r.page_no, r.block_no): (r.page_number_text, sorted(r.gaps)) for r in layout.block_rows(spans_df(spark, rows)).collect()}
    assert got == {(0, 9): ("- 12 -", []), (0, 0): (None, [24.0, 24.0]), (1, 8): (None, []), (2, 8): ("4", []), (3, 8): ("55", [])}
