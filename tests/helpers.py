"""Small layouts for tests: spans, pages and documents as inline rows."""

from __future__ import annotations

SPAN_SCHEMA = (
    "doc_id long, page_no int, width_pt double, height_pt double, block_no int, block_type int, "
    "bx0 double, by0 double, bx1 double, by1 double, line_no int, span_no int, text string, "
    "font string, size double, flags int, origin_y double")
PAGE_SCHEMA = "doc_id long, page_no int, width_pt double, height_pt double, text string"
DOC_SCHEMA = "doc_id long, path string, brief_type string, cover_text string, full_text string"


def span(doc=1, page=1, block=0, line=0, no=0, text="some body text here", size=12.0, flags=0,
         y=400.0, font="Times", kind=0, box=(108.0, 100.0, 540.0, 700.0), width=612.0,
         height=792.0):
    return (doc, page, width, height, block, kind, *box, line, no, text, font, size, flags, float(y))


def page(doc=1, no=0, text="", width=612.0, height=792.0):
    return (doc, no, width, height, text)


def doc(doc_id=1, kind="appellant", cover="ORAL ARGUMENT", text="", path="a.pdf"):
    return (doc_id, path, kind, cover, text)


def spans_df(spark, rows):
    return spark.createDataFrame(rows, SPAN_SCHEMA)


def pages_df(spark, rows):
    return spark.createDataFrame(rows, PAGE_SCHEMA)


def docs_df(spark, rows):
    return spark.createDataFrame(rows, DOC_SCHEMA)


def check(spark, spans, pages, docs, check_id):
    """Result row of one check per document."""
    from docketlens.plans.mechanical import mechanical_checks
    rows = mechanical_checks(docs_df(spark, docs), pages_df(spark, pages), spans_df(spark, spans))
    return {r.doc_id: r for r in rows.filter(f"check_id = '{check_id}'").collect()}
