"""Plan shape, skew and partitioning: results must not depend on either."""

import pytest
from pyspark.sql import functions as F

from conformance import views as V
from docketlens.operators import fonts, layout, verdict
from docketlens.plans import mechanical
from tests.helpers import doc, docs_df, page, pages_df, span, spans_df

COLS = ["doc_id", "check_id", "passed", "severity", "applicable", "message", "details"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def expected(spark, sf_dir):
    return sorted(map(str, mechanical.mechanical_checks(
        V.fx_docs(spark, sf_dir), V.fx_pages(spark, sf_dir),
        V.fx_spans(spark, sf_dir)).select(*COLS).collect()))


@pytest.mark.parametrize("partitions,broadcast", [(1, "-1"), (64, "-1"), (8, "10MB")])
def test_partitioning_does_not_matter(spark, sf_dir, expected, partitions, broadcast):
    before = {k: spark.conf.get(k) for k in (
        "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        spans = V.fx_spans(spark, sf_dir).orderBy(F.rand(7))
        got = mechanical.mechanical_checks(
            V.fx_docs(spark, sf_dir), V.fx_pages(spark, sf_dir), spans).select(*COLS).collect()
        assert sorted(map(str, got)) == expected
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_one_document_with_most_pages(spark):
    """A hot document keeps whole results; its pages meet their facts on several keys."""
    n = 600
    spans = [span(doc=1, page=p, text="words of the body", size=10.0 if p == 599 else 12.0)
             for p in range(n)]
    spans += [span(doc=d, page=0) for d in (2, 3, 4)]
    pages = [page(1, p, "x") for p in range(n)] + [page(d) for d in (2, 3, 4)]
    rows = mechanical.mechanical_checks(
        docs_df(spark, [doc(d) for d in (1, 2, 3, 4)]), pages_df(spark, pages),
        spans_df(spark, spans)).collect()
    font = {r.doc_id: r for r in rows if r.check_id == "FMT-006"}
    assert font[1].pages == [600] and font[2].passed
    numbered = next(r for r in rows if r.doc_id == 1 and r.check_id == "FMT-011")
    assert len(numbered.pages) == n and numbered.message.endswith("(and 590 more).")
    assert len(rows) == 4 * 19


def test_no_cross_joins_and_narrow_shuffles(spark, sf_dir, tmp_path):
    V.fx_spans(spark, sf_dir).write.parquet(str(tmp_path / "spans"))
    V.fx_pages(spark, sf_dir).write.parquet(str(tmp_path / "pages"))
    V.fx_docs(spark, sf_dir).write.parquet(str(tmp_path / "docs"))
    layout.span_features(spark.read.parquet(str(tmp_path / "spans"))).write.parquet(
        str(tmp_path / "features"))
    features = spark.read.parquet(str(tmp_path / "features"))
    df = verdict.hard_recommendation(mechanical.mechanical_checks(
        spark.read.parquet(str(tmp_path / "docs")), spark.read.parquet(str(tmp_path / "pages")),
        features))
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert text.count("Exchange hashpartitioning") <= 10
    assert text.count("BatchEvalPython") == 0 and text.count("ArrowEvalPython") <= 1
    margins = plan(layout.page_line_spacing(features))
    assert "numeral" not in margins.split("ReadSchema")[1] and "font" not in margins.split("ReadSchema")[1]


def test_histogram_combines_before_the_shuffle(spark, sf_dir):
    text = plan(fonts.font_histogram(V.fx_spans(spark, sf_dir)))
    assert "partial_sum" in text and "SortAggregate" not in text


def test_filters_reach_the_scan(spark, sf_dir):
    df = fonts.style_mix(fonts.font_histogram(V.fx_spans(spark, sf_dir))).filter("doc_id = 7")
    assert plan(df).count("EqualTo(doc_id,7)") == 2  # text and footer branch


def test_large_ordinals(spark):
    """Ordinals have no limit, and the histogram still aggregates by hash."""
    rows = spans_df(spark, [span(block=2_000_000_000, size=9.0), span(block=1 << 21, size=10.0)])
    got = fonts.font_histogram(rows)
    assert [r["size"] for r in got.orderBy("place").collect()] == [10.0, 9.0]
    assert "SortAggregate" not in plan(got)


def test_single_checks_read_only_what_they_need(spark, sf_dir, expected):
    def run(only):
        return mechanical.mechanical_checks(
            V.fx_docs(spark, sf_dir), V.fx_pages(spark, sf_dir), V.fx_spans(spark, sf_dir),
            only=only)

    certificate = run({"SEC-013"})
    assert plan(certificate).count("FileScan") == 1
    assert "Exchange hashpartitioning" not in plan(certificate)
    assert "flags" not in plan(run({"FMT-002"}))
    ids = {"SEC-013", "FMT-009", "PG-002"}
    got = sorted(map(str, run(ids).select(*COLS).collect()))
    assert got == [r for r in expected if any(f"'{i}'" in r.split("name")[0] for i in ids)]


def test_reports_are_made_in_the_row(spark, sf_dir):
    """Reports of results in their document's row are those of result rows, without a second search or a shuffle."""
    from docketlens.plans.reports import report_rows
    from docketlens.sources import writers
    facts = mechanical.document_facts(V.fx_docs(spark, sf_dir), V.fx_pages(spark, sf_dir), V.fx_spans(spark, sf_dir))
    facts = facts.localCheckpoint()
    rows, listed = mechanical.results_of(facts), mechanical.with_results(facts)
    for apart, within in ((report_rows(facts, rows, "r"), report_rows(listed, None, "r")),
                          (writers.document_rows(facts, rows), writers.document_rows(listed, None))):
        assert "Exchange" not in plan(within)
        text = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*sorted(apart.columns)))).collect())
        assert sorted(within.columns) == sorted(apart.columns) and text(within) == text(apart)


def test_ordering_carries_only_what_is_asked_for(spark):
    rows = spark.createDataFrame([(1, "B", "n", True, "note", True, "m", "d"), (1, "A", "n", False, "note", True, "m", "d")],
                                 "doc_id long, check_id string, name string, passed boolean, severity string, applicable boolean, message string, details string")
    df = verdict.order_results(rows).select("doc_id", "check_id", "position")
    assert "collect_list" not in plan(df) and "details" not in plan(df).split("Exchange")[0]
    assert sorted(map(tuple, df.collect())) == [(1, "A", 1), (1, "B", 2)]


def test_results_make_only_the_columns_asked_for(spark, sf_dir):
    """messages and page lists are not written where only verdicts are read; rows and values stay."""
    facts = mechanical.document_facts(V.fx_docs(spark, sf_dir), V.fx_pages(spark, sf_dir), V.fx_spans(spark, sf_dir)).localCheckpoint()
    columns = ["doc_id", "check_id", "passed", "severity", "applicable"]
    narrow, wide = mechanical.results_of(facts, columns=columns), mechanical.results_of(facts)
    assert narrow.columns == columns
    done = plan(narrow).split("== Physical Plan ==")[-1]
    assert "format_string" not in done and "numbering starts" not in done
    rows = sorted(map(tuple, narrow.collect()))
    assert len(rows) > 0 and rows == sorted(map(tuple, wide.select(*columns).collect()))
    few = mechanical.results_of(facts, only={"FMT-012", "SEC-013"}, columns=["doc_id", "passed"])
    assert sorted(map(tuple, few.collect())) == sorted((r[0], r[2]) for r in rows if r[1] in ("FMT-012", "SEC-013"))
