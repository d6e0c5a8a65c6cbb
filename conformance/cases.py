"""One registered query per operator of the inventory, with its SQL twin.

Keys are the operator ids.  Every query runs over whole tables; an operator
that plain SQL cannot state has no SQL and is covered by ``tests`` instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conformance import views as V
from conformance.oracle_views import (
    VIEWS, WS, collapse, count, extract, hit, hits, q, with_views, words)
from docketlens import rules as R
from docketlens import schema as S
from docketlens.functions import text as X
from docketlens.operators import (
    catalog, citations, documents, evidence, fonts, governance, layout, sensitive, verdict)
from docketlens.plans import mechanical
from docketlens.plans.full import Corpus, analyse
from docketlens.plans.reports import report_rows
from docketlens.plans.stages import parquet_stage
from docketlens.sources import readers, writers
from docketlens.streaming import intake

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
RUN = "run-1"


def case(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql if sql in ORACLES.values() else with_views(sql)
        return fn
    return register


def joined(col: str):
    return F.array_join(F.transform(F.col(col), lambda x: x.cast("string")), ",")


def hist(spark, sf):
    return fonts.font_histogram(V.fx_spans(spark, sf))


def typed_docs(spark, sf):
    return documents.classify(V.fx_docs(spark, sf))


def page_facts(spark, sf):
    return layout.page_facts(V.fx_spans(spark, sf), V.fx_pages(spark, sf))


def doc_facts(spark, sf, keep_text=False):
    return mechanical.document_facts(
        V.fx_docs(spark, sf), V.fx_pages(spark, sf), V.fx_spans(spark, sf), stage=parquet_stage(V.work_folder(spark)),
        keep_text=keep_text)


def doc_results(spark, sf, keep_text=False):
    """Facts of each document with its results in its own row; texts are searched once and results not shuffled."""
    return mechanical.with_results(doc_facts(spark, sf, keep_text))


def results(spark, sf, columns=None):
    return mechanical.results_of(doc_facts(spark, sf), columns=columns)


def all_results(spark, sf, columns=None):
    columns = columns or S.RESULT_COLUMNS
    applicable = catalog.applicable_checks(typed_docs(spark, sf), R.check_catalog(spark))
    judged = catalog.merge_judgements(applicable, V.fx_judged(spark, sf))
    semantic = catalog.all_results(judged, catalog.inapplicable_results(applicable))
    return catalog.all_results(results(spark, sf, columns), semantic.select(*columns))


# ---------------------------------------------------------------- sources ---

@case("SRC-1", """SELECT doc_id, file_name, 'sha256:' || sha256(text) AS content_hash,
    CASE WHEN strlen(text) <= 20000 THEN 'ok' ELSE 'oversized' END AS status FROM (
    SELECT doc_id, text, 'doc-' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF'
      WHEN 2 THEN '.docx' ELSE '.Pdf' END AS file_name FROM documents)
    WHERE regexp_matches(file_name, '(?i)\\.pdf$')""")
def src_1(spark, sf):
    files = V.table(spark, sf, "documents").selectExpr(
        "doc_id", "concat('in/doc-', doc_id, case doc_id % 4 when 0 then '.pdf' when 1 then '.PDF' "
                  "when 2 then '.docx' else '.Pdf' end) path",
        "cast(text as binary) content", "cast(octet_length(text) as bigint) length")
    small = R.Thresholds(max_filing_bytes=20000)
    return readers.candidate_filings(files, small).select("doc_id", "file_name", "content_hash", "status")


@case("manifest_of_files", """SELECT doc_id, cast(65 * (1 + doc_id % 3) AS bigint) AS length,
    'sha256:' || sha256(repeat(sha256(text) || chr(10), cast(1 + doc_id % 3 AS int))) AS content_hash,
    CASE WHEN doc_id % 3 = 0 THEN 'ok' ELSE 'oversized' END AS status FROM documents WHERE doc_id % 4 <> 2""")
def manifest_of_files(spark, sf):
    """SRC-1 over files: one for each document, of four endings, written and listed again.

    The name of a file tells its document.  A folder for each document would cost more than its file.
    """
    folder, tasks = V.work_folder(spark) + "/filings", int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines, ending = 1 + F.col("doc_id") % 3, F.element_at(F.array(*map(F.lit, ("pdf", "PDF", "doc", "Pdf"))), (F.col("doc_id") % 4 + 1).cast("int"))
    # With the row's place, because ids that repeat are documents of their own.
    V.write_files(V.table(spark, sf, "documents").filter("doc_id is not null").select(
        F.concat(F.col("doc_id") % 4, F.lit("-"), lines, F.lit("/part-"), "doc_id", F.lit("-"), F.monotonically_increasing_id(), F.lit("."), ending).alias("path"),
        F.repeat(F.concat(F.coalesce(F.sha2("text", 256), F.lit("")), F.lit("\n")), lines.cast("int")).alias("content")), folder)
    small = R.Thresholds(max_filing_bytes=100)
    return readers.read_manifest(spark, folder, small, tasks).select(
        F.regexp_extract("path", r"/part-(-?\d+)-\d+\.[^/]*$", 1).cast("long").alias("doc_id"), "length", "content_hash", "status")


@case("SRC-2", """SELECT doc_id, page_no,
    dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY block_no) - 1 AS block_no, line_no, span_no, text, font, size, flags,
    origin_y, bx0, by1 FROM fx_spans""")
def src_2(spark, sf):
    folder = V.work_folder(spark) + "/layout"
    V.fx_layout(spark, sf).write.json(folder)
    return layout.flatten_layout(readers.read_layout(spark, folder)).select(
        "doc_id", "page_no", "block_no", "line_no", "span_no", "text", "font", "size", "flags",
        "origin_y", "bx0", "by1")


def _result_json(spark, sf) -> DataFrame:
    """Interchange documents as text, with fields left out as producers do."""
    item = F.struct(
        F.concat(F.lit("C-"), F.col("doc_id") % 7).alias("check_id"), F.lit("n").alias("name"),
        F.lit("r").alias("rule"), (F.col("doc_id") % 3 == 0).alias("passed"),
        F.lit("note").alias("severity"),
        F.when(F.col("doc_id") % 2 == 0, 'Top Margin < 1" on 2, 3, 4.')
        .otherwise("Nothing to see.").alias("message"),
        F.when(F.col("doc_id") % 5 == 0, "See Pages: 7, 8 there").alias("details"),
        F.when(F.col("doc_id") % 4 == 1, F.lit(False)).alias("applicable"),
        F.when(F.col("doc_id") % 11 == 0, F.array(F.lit(9))).alias("pages"))
    arrays = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(
        "doc_id", F.array(item).alias("mechanical_results")))).otherwise(F.to_json(F.struct(
            "doc_id", F.array(item).alias("semantic_results"))))
    return V.table(spark, sf, "documents").select(arrays.alias("json"))


_SRC_3 = """SELECT doc_id, 'C-' || (doc_id % 7) AS check_id, doc_id % 3 = 0 AS passed,
    NOT (doc_id % 4 = 1) AS applicable, CASE WHEN doc_id % 11 = 0 THEN '9' WHEN doc_id % 3 = 0 THEN NULL
    WHEN doc_id % 2 = 0 THEN '2,3,4' WHEN doc_id % 5 = 0 THEN '7,8' END AS pages FROM documents"""


@case("SRC-3", _SRC_3)
def src_3(spark, sf):
    folder = V.work_folder(spark) + "/results"
    _result_json(spark, sf).write.text(folder)
    return readers.read_results(spark, folder).select(
        "doc_id", "check_id", "passed", "applicable", joined("pages").alias("pages"))


def _rule_texts(spark, sf) -> DataFrame:
    names = F.array(*[F.lit(n) for n in R.REQUIRED_RULES[:9] + ["other.md"]])
    return V.table(spark, sf, "documents").groupBy(
        F.element_at(names, (F.col("doc_id") % 10 + 1).cast("int")).alias("file_name")
    ).agg(F.max("text").alias("text"))


_CORPUS = f"""SELECT string_agg(coalesce(t.text, '[Rule ' || regexp_extract(w.f, '^rule-(.*)\\.md$', 1)
      || ' text not available. Expected at ' || w.f || ']'), {q(R.RULE_SEPARATOR)} ORDER BY w.i) AS rules_text
    FROM (SELECT unnest({R.REQUIRED_RULES}) AS f, unnest(range(0, 10)) AS i) w LEFT JOIN (
      SELECT ({R.REQUIRED_RULES[:9] + ["other.md"]})[doc_id % 10 + 1] AS f, max(text) AS text
      FROM documents GROUP BY 1) t ON w.f = t.f"""


@case("SRC-4", _CORPUS)
def src_4(spark, sf):
    return catalog.rule_corpus(_rule_texts(spark, sf))


@case("SRC-5", """SELECT page_id, rule, cast(CASE WHEN page_id % 4 = 0 THEN
    make_date(2020 + page_id % 6, 1 + page_id % 12, 1) END AS varchar) AS effective_date FROM fx_html""")
def src_5(spark, sf):
    return governance.effective_dates(V.fx_html(spark, sf)).withColumn(
        "effective_date", F.col("effective_date").cast("string"))


# ------------------------------------------------------------------ sinks ---

@case("SNK-1", f"""SELECT t.doc_id, t.brief_type, c.total_pages, c.body_pages, r.n_results, r.failed_ids, d.path AS pdf_path,
    {words('d.full_text')} AS word_count, d.cover_text, 'sha256:' || sha256(d.full_text) AS text_hash, l.listed_pages
    FROM v_types t JOIN v_pagecounts c ON t.doc_id = c.doc_id JOIN (
      SELECT doc_id, total_checks AS n_results, failed_ids FROM v_verdict) r ON t.doc_id = r.doc_id
    JOIN fx_docs d ON t.doc_id = d.doc_id JOIN (SELECT doc_id, coalesce(string_agg(check_id || ':' || pages, ';' ORDER BY check_id)
      FILTER (pages <> ''), '') AS listed_pages FROM v_results GROUP BY 1) l ON t.doc_id = l.doc_id""")
def snk_1(spark, sf):
    """Whole documents written and read back: texts, counts and results with all their pages."""
    folder = V.work_folder(spark) + "/documents"
    writers.write_documents(doc_results(spark, sf, keep_text=True), None, folder, compression="gzip")
    paged = F.array_sort(F.filter("mechanical_results", lambda r: F.size(r["pages"]) > 0))
    bad = F.filter("mechanical_results", lambda r: ~r["passed"] & r["applicable"])
    return readers.read_documents(spark, folder).select(
        "doc_id", "brief_type", "total_pages", "body_pages",
        F.size("mechanical_results").alias("n_results"),
        F.array_join(F.array_sort(F.transform(bad, lambda r: r["check_id"])), ",")
        .alias("failed_ids"),
        "pdf_path", "word_count", "cover_text", X.content_hash(F.col("full_text")).alias("text_hash"),
        F.array_join(F.transform(paged, lambda r: F.concat(
            r["check_id"], F.lit(":"), F.array_join(r["pages"].cast("array<string>"), ","))), ";").alias("listed_pages"))


@case("SNK-2", f"""SELECT doc_id, substring(sha256(doc_id || ':{RUN}'), 1, 12) AS report_id, recommendation,
    total_checks, failed_checks, passed_checks, failed_ids FROM v_verdict""")
def snk_2(spark, sf):
    return writers.summaries(results(spark, sf), V.fx_docs(spark, sf), RUN).select(
        "doc_id", "report_id", "recommendation", "total_checks", "failed_checks",
        "passed_checks", F.array_join(F.transform("failures", lambda f: f["check_id"]), ",")
        .alias("failed_ids"))


_SHOWN = "string_agg(check_id, ',' ORDER BY check_id)"


@case("SNK-3", f"""SELECT v.doc_id, substring(sha256(v.doc_id || ':{RUN}'), 1, 12) AS report_id,
    CASE recommendation WHEN 'reject' THEN 'REJECT' WHEN 'accept' THEN 'ACCEPT' ELSE 'CORRECTION LETTER' END AS banner,
    failed_checks AS failed, concat_ws(',', c.r, c.k, c.n) AS cards, passed_checks AS passed,
    total_checks - failed_checks - passed_checks AS inapplicable, concat_ws(',', c.p, c.i) AS listed,
    c.pages AS pages
    FROM v_verdict v JOIN (SELECT doc_id,
      {_SHOWN} FILTER (bad AND severity = 'reject') AS r, {_SHOWN} FILTER (bad AND severity = 'correction') AS k,
      {_SHOWN} FILTER (bad AND severity = 'note') AS n, {_SHOWN} FILTER (passed AND applicable) AS p,
      {_SHOWN} FILTER (NOT applicable) AS i,
      cast(sum(CASE WHEN bad AND pages <> '' THEN len(string_split(pages, ',')) ELSE 0 END) AS bigint) AS pages
      FROM (SELECT *, NOT passed AND applicable AS bad FROM v_results) GROUP BY 1) c ON v.doc_id = c.doc_id""")
def snk_3(spark, sf):
    """What the rendered pages show: banner, counts, cards and table rows in their order."""
    html = writers.render_reports(report_rows(doc_results(spark, sf), None, RUN))
    shown = lambda p: F.array_join(F.regexp_extract_all("html", F.lit(p), F.lit(1)), ",")
    number = lambda p: F.coalesce(F.regexp_extract("html", p, 1).try_cast("long"), F.lit(0))
    return html.select(
        "doc_id", F.regexp_extract("html", "<td>Report ID</td><td>([0-9a-f]+)</td>", 1).alias("report_id"),
        F.regexp_extract("html", "Recommended Action: <b>([^<]+)</b>", 1).alias("banner"),
        number(r"Failed Checks \((\d+)\)").alias("failed"),
        shown('class="card"[^>]*><code>([^<]+)</code>').alias("cards"),
        number(r"Passed Checks \((\d+)\)").alias("passed"), number(r"Not Applicable \((\d+)\)").alias("inapplicable"),
        shown(r"<tr><td>([A-Z]+-\d+)</td>").alias("listed"),
        F.size(F.regexp_extract_all("html", F.lit('<span class="page">'), F.lit(0))).cast("long").alias("pages"))


@case("report_provenance", """SELECT doc_id, 'March 0' || (1 + doc_id % 9) || ', 2026 01:05 PM' AS date,
    'Made by rules &lt;v2&gt; using judge' AS footer, CASE WHEN doc_id % 3 = 0 THEN 'because ' || doc_id || ' &amp; so'
      ELSE CASE recommendation WHEN 'accept' THEN 'All' WHEN 'reject' THEN 'REJECT' ELSE 'Correction' END END AS reasoning FROM v_verdict""")
def report_provenance(spark, sf):
    """SNK-3: date, version and judge on the page, and a caller's reasoning in place of the rules'."""
    words = V.table(spark, sf, "documents").selectExpr(
        "doc_id", "case doc_id % 3 when 0 then concat('because ', doc_id, ' & so') when 1 then '' end reasoning")
    reports = report_rows(doc_results(spark, sf), None, RUN, reasonings=words)
    at = F.expr("timestamp_seconds(unix_seconds(timestamp'2026-03-01 13:05:00') + doc_id % 9 * 86400)")
    html = writers.render_reports(reports, "Made by rules", at, "<v2>", "judge")
    found = lambda p: F.regexp_extract("html", p, 1)
    words = found("</table><p>([^<]*)</p>")
    return html.select("doc_id", found("<td>Date</td><td>([^<]*)</td>").alias("date"), found("<footer>([^<]*)</footer>").alias("footer"),
                       F.when(F.col("doc_id") % 3 == 0, words).otherwise(F.regexp_extract(words, "^(\\w+)", 1)).alias("reasoning"))


@case("SNK-4", f"""SELECT v.doc_id, substring(sha256(v.doc_id || ':{RUN}'), 1, 12) AS report_id, recommendation
    FROM v_verdict v WHERE v.doc_id IN (SELECT doc_id FROM labels)""")
def snk_4(spark, sf):
    """Stored twice, as a rerun would, and read back from the store."""
    reports = writers.summaries(results(spark, sf), V.fx_docs(spark, sf), RUN).select(
        "doc_id", "report_id", "recommendation")
    folder = V.work_folder(spark)
    reports, store = parquet_stage(folder)("rows", reports), folder + "/reports"
    for _ in range(2):
        writers.write_reports(reports, store, RUN)
    asked = V.table(spark, sf, "labels").select(
        X.report_id(F.col("doc_id"), RUN).alias("report_id")).unionByName(
        V.table(spark, sf, "labels").select(F.concat(F.lit("none-"), "doc_id").alias("report_id")))
    return writers.reports_by_id(spark.read.parquet(store), asked).select(
        "doc_id", "report_id", "recommendation")


@case("report_by_id", f"""SELECT doc_id, substring(sha256(doc_id || ':{RUN}'), 1, 12) AS report_id, recommendation
    FROM v_verdict WHERE doc_id = (SELECT max(doc_id) FROM documents)""")
def report_by_id(spark, sf):
    """SNK-4: one report out of the store."""
    reports = writers.summaries(results(spark, sf), V.fx_docs(spark, sf), RUN).select("doc_id", "report_id", "recommendation")
    store = V.work_folder(spark) + "/reports"
    writers.write_reports(reports, store, RUN)
    newest = V.table(spark, sf, "documents").agg(F.max("doc_id").alias("doc_id")).select(X.report_id(F.col("doc_id"), RUN)).first()[0]
    return writers.report_by_id(spark, store, newest).select("doc_id", "report_id", "recommendation")


# ------------------------------------------------------------ projections ---

@case("PRJ-1", "SELECT doc_id, page_no, width_pt / 72 AS width_in, height_pt / 72 AS height_in FROM fx_pages")
def prj_1(spark, sf):
    return layout.page_geometry(V.fx_pages(spark, sf)).select(
        "doc_id", "page_no", "width_in", "height_in")


@case("PRJ-2", "SELECT doc_id, page_no, block_no, span_no, text, chars FROM v_vis")
def prj_2(spark, sf):
    return layout.visible_spans(V.fx_spans(spark, sf)).select(
        "doc_id", "page_no", "block_no", "span_no", "text", "chars")


@case("PRJ-3", """SELECT doc_id, page_no, style, cast(sum(spans) AS bigint) AS n FROM v_hist GROUP BY 1, 2, 3""")
def prj_3(spark, sf):
    return layout.visible_spans(V.fx_spans(spark, sf)).withColumn(
        "style", fonts.style_class(F.col("flags"))).groupBy("doc_id", "page_no", "style").agg(
        F.count(F.lit(1)).alias("n"))


@case("PRJ-4", """SELECT doc_id, page_no, block_no, span_no, regexp_matches(text, '\\p{L}') AND NOT
    regexp_matches(text, '[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]') AS all_upper FROM fx_spans""")
def prj_4(spark, sf):
    return V.fx_spans(spark, sf).select(
        "doc_id", "page_no", "block_no", "span_no", X.is_all_uppercase(F.col("text")).alias("all_upper"))


@case("PRJ-5", """SELECT v.doc_id, page_no, block_no, span_no, CASE
    WHEN origin_y <= height_pt * cast(0.1 AS double) OR origin_y >= height_pt * cast(0.9 AS double) THEN 'header_footer'
    WHEN flags & 1 <> 0 OR chars <= 4 THEN 'superscript'
    WHEN regexp_matches(text, '\\p{L}') AND NOT regexp_matches(text, '[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]')
      AND size / predominant_font_size BETWEEN cast(0.55 AS double) AND cast(0.85 AS double) THEN 'small_caps'
    ELSE 'body' END AS span_class FROM v_vis v JOIN v_fontstats f ON v.doc_id = f.doc_id
    WHERE size < cast(11.7 AS double)""")
def prj_5(spark, sf):
    spans = V.fx_spans(spark, sf)
    return fonts.classify_small_spans(spans, fonts.doc_font_stats(fonts.font_histogram(spans))).select(
        "doc_id", "page_no", "block_no", "span_no", "span_class")


@case("PRJ-6", """SELECT doc_id, page_no, block_no, span_no, size FROM fx_spans WHERE size < cast(11.7 AS double)""")
def prj_6(spark, sf):
    return V.fx_spans(spark, sf).filter(fonts.undersized(F.col("size"))).select(
        "doc_id", "page_no", "block_no", "span_no", "size")


@case("PRJ-7", f"""SELECT doc_id, page_no, page_no = 0 OR {hits('text', R.SMALL_CAPS_PAGE_PATTERNS, 'i')}
    AS conventional FROM fx_dpages""")
def prj_7(spark, sf):
    return V.fx_dpages(spark, sf).select(
        "doc_id", "page_no", layout.conventional_page().alias("conventional"))


@case("PRJ-8", "SELECT doc_id, page_no, page_number_text FROM v_pn")
def prj_8(spark, sf):
    return layout.nested_page_numbers(V.fx_layout(spark, sf)).select(
        "doc_id", "page_no", "page_number_text")


@case("PRJ-9", "SELECT doc_id, text AS cover_text FROM fx_pages WHERE page_no = 0")
def prj_9(spark, sf):
    return documents.cover_text(V.fx_pages(spark, sf))


@case("PRJ-10", "SELECT doc_id, page_no FROM fx_pages WHERE page_no > 0")
def prj_10(spark, sf):
    return documents.body_pages_only(V.fx_pages(spark, sf)).select("doc_id", "page_no")


@case("PRJ-11", """SELECT doc_id, check_id, CASE WHEN NOT applicable THEN 'inapplicable' WHEN passed THEN 'passed'
    ELSE severity END AS subset FROM v_results""")
def prj_11(spark, sf):
    return results(spark, sf, ["doc_id", "check_id", "passed", "severity", "applicable"]).select(
        "doc_id", "check_id", verdict.result_subset().alias("subset"))


@case("PRJ-12", "SELECT doc_id, check_id, applicable FROM v_asked")
def prj_12(spark, sf):
    return catalog.applicable_checks(typed_docs(spark, sf), R.check_catalog(spark)).select(
        "doc_id", "check_id", "applicable")


def _parts_sql(n: int) -> str:
    return (f"SELECT *, greatest(1, cast(ceil(length(full_text) / {n}.0) AS int)) AS part_count, "
            f"unnest(range(1, greatest(1, cast(ceil(length(full_text) / {n}.0) AS int)) + 1)) AS part_no FROM fx_docs")


@case("PRJ-13", f"""SELECT doc_id, cast(part_no AS int) AS part_no, part_count,
    substring(full_text, 2000 * (part_no - 1) + 1, 2000) AS text FROM ({_parts_sql(2000)})""")
def prj_13(spark, sf):
    parts = X.text_parts(F.col("full_text"), 2000)
    return V.fx_docs(spark, sf).select(
        "doc_id", F.size(parts).alias("part_count"), F.posexplode(parts).alias("part", "text")).select(
        "doc_id", (F.col("part") + 1).alias("part_no"), "part_count", "text")


@case("PRJ-14", f"""SELECT a.doc_id, a.brief_type, c.total_pages, {words('d.full_text')} AS word_count, a.n AS asked_checks,
    a.ids, 'sha256:' || sha256(k.rules_text) AS rules_key, d.part_count, cast(d.part_no AS int) AS part_no,
    substring(d.full_text, 60000 * (d.part_no - 1) + 1, 60000) AS brief_text FROM (SELECT doc_id, any_value(brief_type) AS brief_type, count(*) AS n,
      string_agg(check_id, ',' ORDER BY check_no) AS ids FROM v_asked WHERE applicable GROUP BY 1) a
    JOIN v_pagecounts c ON a.doc_id = c.doc_id JOIN ({_parts_sql(60000)}) d ON a.doc_id = d.doc_id CROSS JOIN ({_CORPUS}) k""")
def prj_14(spark, sf):
    docs = typed_docs(spark, sf).join(
        documents.doc_page_counts(V.fx_pages(spark, sf)), "doc_id").withColumn(
        "word_count", X.word_count(F.col("full_text")))
    key = catalog.rules_key(catalog.rule_corpus(_rule_texts(spark, sf)))
    asked = F.from_json("checks_json", "array<struct<id:string>>")
    return catalog.judge_requests(docs, R.check_catalog(spark), key).select(
        "doc_id", "brief_type", "total_pages", "word_count", "asked_checks",
        F.array_join(F.transform(asked, lambda a: a["id"]), ",").alias("ids"),
        "rules_key", "part_count", "part_no", "brief_text")


@case("text_parts_of_pages", """SELECT doc_id, cast(part_no AS int) AS part_no, cast(part_count AS int) AS part_count,
    substring(full_text, (part_no - 1) * 700 + 1, 700) AS text FROM (SELECT *, unnest(range(1, part_count + 1)) AS part_no FROM (
      SELECT *, greatest(1, cast(ceil(length(full_text) / 700.0) AS bigint)) AS part_count FROM (
        SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS full_text FROM fx_pages GROUP BY 1)))""")
def text_parts_of_pages(spark, sf):
    """PRJ-13 from pages, by parts and blocks of a size that most documents exceed."""
    return documents.text_parts(V.fx_pages(spark, sf), 700, block_pages=4)


# ------------------------------------------------------------------ joins ---

@case("JN-1", """SELECT t.doc_id, t.brief_type, page_limit, limit_check_id, limit_rule FROM v_types t
    LEFT JOIN dim_limits l ON t.brief_type = l.brief_type""")
def jn_1(spark, sf):
    return documents.with_page_limit(typed_docs(spark, sf)).select(
        "doc_id", "brief_type", "page_limit", "limit_check_id", "limit_rule")


@case("JN-2", """SELECT t.doc_id, t.brief_type, cover_color FROM v_types t
    LEFT JOIN dim_colors l ON t.brief_type = l.brief_type""")
def jn_2(spark, sf):
    return documents.with_cover_color(typed_docs(spark, sf)).select(
        "doc_id", "brief_type", "cover_color")


@case("JN-3", "SELECT d.doc_id, c.check_id, c.severity FROM documents d CROSS JOIN dim_catalog c")
def jn_3(spark, sf):
    return catalog.docs_by_checks(
        typed_docs(spark, sf).select("doc_id", "brief_type"), R.check_catalog(spark)).select(
        "doc_id", "check_id", "severity")


@case("JN-4", """SELECT s.doc_id, page_no, block_no, span_no, size, predominant_font_size FROM fx_spans s
    LEFT JOIN v_fontstats f ON s.doc_id = f.doc_id""")
def jn_4(spark, sf):
    spans = V.fx_spans(spark, sf)
    return fonts.spans_with_doc_stats(spans, fonts.doc_font_stats(fonts.font_histogram(spans))).select(
        "doc_id", "page_no", "block_no", "span_no", "size", "predominant_font_size")


_POSITIONS = """SELECT doc_id, start, start + length(hit) AS stop FROM (
    SELECT doc_id, hit, coalesce(list_sum(list_transform(pieces[1:pos], lambda x: length(x))), 0)
      + coalesce(list_sum(list_transform(found[1:pos - 1], lambda x: length(x))), 0) AS start FROM (
      SELECT doc_id, found, pieces, unnest(found) AS hit, unnest(range(1, len(found) + 1)) AS pos FROM (
        SELECT doc_id, regexp_extract_all(full_text, {p}) AS found,
          string_split_regex(full_text, {p}) AS pieces FROM fx_docs)))"""


@case("JN-5", f"""SELECT a.doc_id, cast(a.start AS int) AS start FROM ({_POSITIONS.replace('{p}', q(R.REPORTER_CITE))}) a
    WHERE NOT EXISTS (SELECT 1 FROM ({_POSITIONS.replace('{p}', q(R.NEUTRAL_CITE))}) b WHERE a.doc_id = b.doc_id
      AND b.start >= a.start - 200 AND b.stop <= a.stop + 200)""")
def jn_5(spark, sf):
    docs = V.fx_docs(spark, sf)
    return citations.nearby_citation_anti(
        citations.citation_positions(docs, R.REPORTER_CITE),
        citations.citation_positions(docs, R.NEUTRAL_CITE)).select("doc_id", "start")


@case("JN-6", """SELECT 'doc-' || doc_id AS file_name, CASE WHEN doc_id % 15 = 7 THEN 'missing' ELSE 'modified' END AS status
    FROM documents WHERE doc_id % 15 = 7 OR doc_id % 10 = 0""")
def jn_6(spark, sf):
    return governance.verify_manifest(V.fx_manifest(spark, sf), V.fx_files(spark, sf))


@case("JN-7", """SELECT h.page_id, h.rule, '2021-02-01' AS bundled_date,
    cast(make_date(2020 + page_id % 6, 1 + page_id % 12, 1) AS varchar) AS live_date FROM fx_html h
    WHERE page_id % 4 = 0 AND h.rule <> 'rule-4' AND NOT (page_id % 6 = 1 AND page_id % 12 = 1)""")
def jn_7(spark, sf):
    live = governance.effective_dates(V.fx_html(spark, sf)).select(
        "page_id", "rule", F.col("effective_date").cast("string").alias("live_date"))
    bundled = spark.createDataFrame(
        [(f"rule-{i}", None if i == 4 else "2021-02-01") for i in range(9)],
        "rule string, bundled_date string")
    return governance.stale_rules(bundled, live).select("page_id", "rule", "bundled_date", "live_date")


@case("JN-8", "SELECT doc_id, check_id, name, severity, rule, passed, message, evaluated FROM v_merged")
def jn_8(spark, sf):
    applicable = catalog.applicable_checks(typed_docs(spark, sf), R.check_catalog(spark))
    return catalog.merge_judgements(applicable, V.fx_judged(spark, sf)).select(
        "doc_id", "check_id", "name", "severity", "rule", "passed", "message", "evaluated")


@case("merge_parts", "SELECT doc_id, check_id, severity, rule, passed, message, evaluated FROM v_merged_parts")
def merge_parts(spark, sf):
    """JN-8 over raw answers about parts of a text, joined as each check asks."""
    checks = R.check_catalog(spark)
    joined_ = parquet_stage(V.work_folder(spark))("judged", catalog.join_parts(
        catalog.judged_rows(V.fx_part_answers(spark, sf)), checks))
    return catalog.merge_judgements(catalog.applicable_checks(typed_docs(spark, sf), checks), joined_).select(
        "doc_id", "check_id", "severity", "rule", "passed", "message", "evaluated")


@case("JN-9", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'reply' ELSE brief_type END AS brief_type FROM v_types""")
def jn_9(spark, sf):
    return documents.override_type(typed_docs(spark, sf), V.fx_overrides(spark, sf)).select(
        "doc_id", "brief_type")


@case("rule_warnings", """SELECT page_id, rule, CASE WHEN page_id % 3 = 0 OR date_diff('day',
    DATE '2024-01-01' + CAST(page_id % 200 AS int), DATE '2024-06-01') >= 90
    THEN CASE WHEN page_id % 2 = 0 THEN 'new ' || page_id END ELSE 'old ' || page_id END AS warning FROM fx_html""")
def rule_warnings(spark, sf):
    rules = V.fx_html(spark, sf).select("page_id", F.concat(F.lit("r"), "page_id").alias("rule"), F.col("rule").alias("shown"))
    log = rules.select("*", F.expr("if(page_id % 3 = 0, 'junk', string(date_add(date'2024-01-01', int(page_id % 200))))")
                       .alias("last_checked"), F.expr("concat('old ', page_id)").alias("warning"))
    fresh = rules.filter("page_id % 2 = 0").select("rule", F.expr("concat('new ', page_id)").alias("warning"))
    found = governance.rule_warnings(log, fresh, F.lit("2024-06-01").cast("date"))
    return rules.join(found, "rule").select("page_id", F.col("shown").alias("rule"), "warning")


# ----------------------------------------------------------- aggregations ---

@case("AGG-1", """SELECT doc_id, page_no, round(left_in, 6) AS left_in, round(right_in, 6) AS right_in,
    round(top_in, 6) AS top_in, round(bottom_in, 6) AS bottom_in FROM v_margins""")
def agg_1(spark, sf):
    sides = ("left_in", "right_in", "top_in", "bottom_in")
    return layout.nested_page_margins(V.fx_layout(spark, sf)).select(
        "doc_id", "page_no", *[F.round(c, 6).alias(c) for c in sides])


@case("page_margins_of_spans", ORACLES["AGG-1"])
def page_margins_of_spans(spark, sf):
    """AGG-1 from flattened spans."""
    sides = ("left_in", "right_in", "top_in", "bottom_in")
    return layout.page_margins(V.fx_spans(spark, sf), V.fx_pages(spark, sf)).select(
        "doc_id", "page_no", *[F.round(c, 6).alias(c) for c in sides])


@case("AGG-2", "SELECT doc_id, page_no, round(line_spacing, 6) AS line_spacing FROM v_spacing")
def agg_2(spark, sf):
    return layout.nested_line_spacing(V.fx_layout(spark, sf)).select(
        "doc_id", "page_no", F.round("line_spacing", 6).alias("line_spacing"))


@case("AGG-3", "SELECT doc_id, predominant_font_size, predominant_font, min_font_size FROM v_fontstats")
def agg_3(spark, sf):
    return fonts.doc_font_stats(hist(spark, sf))


@case("AGG-4", """SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS full_text FROM fx_pages GROUP BY 1""")
def agg_4(spark, sf):
    return documents.doc_text(V.fx_pages(spark, sf))


@case("AGG-5", f"SELECT doc_id, {words('full_text')} AS word_count FROM fx_docs")
def agg_5(spark, sf):
    return documents.word_count(V.fx_docs(spark, sf))


@case("AGG-6", "SELECT doc_id, total_pages, addendum_start, body_pages FROM v_pagecounts")
def agg_6(spark, sf):
    return documents.doc_page_counts(V.fx_pages(spark, sf))


@case("AGG-7", """SELECT doc_id, round(median(line_spacing), 6) AS median_spacing,
    coalesce(median(line_spacing) >= 20, true) AS has_double_spacing FROM v_pagerows GROUP BY 1""")
def agg_7(spark, sf):
    return documents.doc_double_spacing(page_facts(spark, sf)).withColumn(
        "median_spacing", F.round("median_spacing", 6))


_COUNTS = """SELECT doc_id, page_no, cast(total_chars AS bigint) AS total_chars, cast(body_chars AS bigint) AS body_chars,
    cast(header_footer_chars AS bigint) AS header_footer_chars, cast(superscript_chars AS bigint) AS superscript_chars,
    cast(small_caps_chars AS bigint) AS small_caps_chars, min_small_size FROM """


@case("AGG-8", _COUNTS + "v_counts")
def agg_8(spark, sf):
    histogram = hist(spark, sf)
    return fonts.page_font_counts(histogram, fonts.doc_font_stats(histogram))


@case("AGG-9", _COUNTS + "v_moved")
def agg_9(spark, sf):
    return fonts.reclassify_small_caps(agg_8(spark, sf), layout.page_text_facts(V.fx_pages(spark, sf)))


@case("AGG-10", """SELECT doc_id, page_no, round(cpi, 6) AS chars_per_inch, coalesce(cpi > 16, false) AS dense FROM (
    SELECT doc_id, page_no, CASE WHEN width_in - left_in - right_in > 0
      THEN max_line_chars / (width_in - left_in - right_in) END AS cpi FROM v_pagerows WHERE page_no > 0)""")
def agg_10(spark, sf):
    return documents.page_density(page_facts(spark, sf)).withColumn(
        "chars_per_inch", F.round("chars_per_inch", 6))


@case("AGG-11", """SELECT doc_id, cast(style_spans AS bigint) AS style_spans, cast(roman_spans AS bigint) AS roman_spans,
    dominant_style, round(roman_share, 6) AS roman_share FROM v_style""")
def agg_11(spark, sf):
    return fonts.style_mix(hist(spark, sf)).select(
        "doc_id", "style_spans", "roman_spans", "dominant_style",
        F.round("roman_share", 6).alias("roman_share"))


@case("AGG-12", """SELECT doc_id, coalesce(string_agg(cast(page_no + 1 AS varchar), ',' ORDER BY page_no)
      FILTER (left_in < cast(1.45 AS double)), '') AS pages,
    round(min(left_in) FILTER (left_in < cast(1.45 AS double)), 6) AS min_value FROM v_margins GROUP BY 1""")
def agg_12(spark, sf):
    margins = layout.page_margins(V.fx_spans(spark, sf), V.fx_pages(spark, sf))
    return documents.bad_pages(margins, F.col("left_in") < 1.45, F.col("left_in")).select(
        "doc_id", joined("pages").alias("pages"), F.round("min_value", 6).alias("min_value"))


@case("AGG-13", """SELECT v.doc_id, v.recommendation, v.total_checks, v.failed_checks, v.passed_checks, v.failed_ids,
    CASE v.recommendation WHEN 'accept' THEN 'All checks passed.'
      WHEN 'reject' THEN 'REJECT due to ' || r.n || ' critical failure(s): ' || r.listed
      ELSE 'Correction letter recommended due to ' || r.n || ' issue(s): ' || r.listed END AS reasoning
    FROM v_verdict v LEFT JOIN (SELECT r.doc_id, r.severity, count(*) AS n,
      string_agg(r.check_id || ' (' || n.name || ')', '; ' ORDER BY r.check_id) AS listed FROM v_results r
      JOIN v_names n ON r.check_id = n.check_id WHERE NOT passed AND applicable GROUP BY 1, 2) r
    ON v.doc_id = r.doc_id AND r.severity = CASE v.recommendation WHEN 'reject' THEN 'reject' ELSE 'correction' END""")
def agg_13(spark, sf):
    return verdict.hard_recommendation(results(spark, sf))


_ADVICE = "CASE doc_id % 5 WHEN 0 THEN 'accept' WHEN 1 THEN 'correction_letter' WHEN 2 THEN 'reject' WHEN 3 THEN 'maybe' END"
_RANK = "CASE {} WHEN 'reject' THEN 2 WHEN 'correction_letter' THEN 1 WHEN 'accept' THEN 0 END"


@case("AGG-14", f"""SELECT doc_id, hard AS hard_recommendation, CASE WHEN hard = 'reject' OR failed_checks = 0 OR advised IS NULL
      OR coalesce(ar, hr) <= hr THEN hard ELSE advised END AS recommendation,
      NOT (hard = 'reject' OR failed_checks = 0) AND coalesce(ar < hr, false) AS overridden FROM (
      SELECT *, {_RANK.format('hard')} AS hr, {_RANK.format('advised')} AS ar FROM (
        SELECT doc_id, recommendation AS hard, failed_checks, {_ADVICE} AS advised FROM v_verdict))""")
def agg_14(spark, sf):
    hard = verdict.hard_recommendation(results(spark, sf))
    advised = V.table(spark, sf, "documents").selectExpr(
        "doc_id", f"{_ADVICE} recommendation", "'advice' reasoning").filter("recommendation is not null")
    return verdict.escalate(hard, advised).select(
        "doc_id", "hard_recommendation", "recommendation",
        F.col("reasoning").contains("overridden").alias("overridden"))


_ANALYSED = with_views(f"""SELECT v.doc_id, substring(sha256(v.doc_id || ':{RUN}'), 1, 12) AS report_id, t.brief_type,
      total_checks, failed_checks, passed_checks, CASE WHEN hard = 'reject' OR failed_checks = 0 OR advised IS NULL
      OR coalesce(ar, hr) <= hr THEN hard ELSE advised END AS recommendation FROM (
      SELECT *, {_RANK.format('hard')} AS hr, {_RANK.format('advised')} AS ar FROM (
        SELECT *, recommendation AS hard, {_ADVICE} AS advised FROM v_verdict)) v JOIN v_types t ON v.doc_id = t.doc_id""", {
    # Overridden types, answers of which some are unreadable, verdicts over all results.
    "v_types": f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'reply' ELSE brief_type END AS brief_type
        FROM ({VIEWS['v_types']})""",
    "v_merged": VIEWS["v_merged_parts"],
    "v_verdict": VIEWS["v_verdict"].replace("FROM v_results", "FROM v_all")})


@case("analyse")
def analysed(spark, sf):
    """The whole run: overrides, checks, answers, advice, report rows."""
    advised = V.table(spark, sf, "documents").selectExpr(
        "doc_id", f"{_ADVICE} recommendation", "'advice' reasoning").filter("recommendation is not null")
    corpus = Corpus(V.fx_docs(spark, sf), V.fx_pages(spark, sf), V.fx_spans(spark, sf))
    run = analyse(corpus, RUN, V.fx_overrides(spark, sf), V.fx_part_answers(spark, sf), advised,
                  stage=parquet_stage(V.work_folder(spark)))
    return run.reports.select("doc_id", "report_id", "brief_type", "total_checks", "failed_checks",
                              "passed_checks", "recommendation")


ORACLES["analyse"] = _ANALYSED


@case("AGG-15", "SELECT doc_id, total_checks, failed_checks, passed_checks FROM v_verdict")
def agg_15(spark, sf):
    return verdict.report_counts(results(spark, sf))


_DOCKETS = f"""SELECT doc_id, 'supreme' AS kind, unnest(regexp_extract_all(full_text, {q(R.DOCKET_PATTERN)})) AS hit FROM fx_docs
    UNION ALL SELECT doc_id, 'district', unnest(regexp_extract_all(full_text, {q(R.DISTRICT_DOCKET_PATTERN)})) FROM fx_docs"""


@case("AGG-16", f"SELECT DISTINCT kind, hit FROM ({_DOCKETS})")
def agg_16(spark, sf):
    return sensitive.distinct_hits(sensitive.docket_hits(V.fx_docs(spark, sf)))


# ---------------------------------------------------------------- windows ---

@case("WIN-1", "SELECT doc_id, page_no, block_no, line_no, round(gap, 6) AS gap FROM v_gaps")
def win_1(spark, sf):
    return layout.nested_baseline_gaps(V.fx_layout(spark, sf)).withColumn("gap", F.round("gap", 6))


@case("baseline_gaps_of_spans", ORACLES["WIN-1"])
def baseline_gaps_of_spans(spark, sf):
    """WIN-1 from flattened spans."""
    return layout.baseline_gaps(V.fx_spans(spark, sf)).withColumn("gap", F.round("gap", 6))


@case("WIN-2", """SELECT doc_id, page_no, arg_min(style, (-n, first_pos)) AS style FROM (
    SELECT doc_id, page_no, style, sum(spans) AS n, min(first_pos) AS first_pos FROM v_hist GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def win_2(spark, sf):
    return fonts.first_seen_mode(hist(spark, sf), ["doc_id", "page_no"], "style")


@case("WIN-3", """SELECT doc_id, string_agg(hit, '; ' ORDER BY pos) FILTER (pos <= 1)
    || CASE WHEN count(*) > 1 THEN ' (and ' || (count(*) - 1) || ' more)' ELSE '' END AS examples
    FROM (SELECT doc_id, hit, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos FROM v_missing) GROUP BY 1""")
def win_3(spark, sf):
    missing = citations.with_missing_citations(V.fx_docs(spark, sf).select("doc_id", "full_text"))
    return missing.filter(F.size("missing_cites") > 0).select(
        "doc_id", X.first_examples(F.col("missing_cites"), 1).alias("examples"))


@case("WIN-4", "SELECT doc_id, cast(start AS int) AS start, cast(start + length(hit) AS int) AS stop, hit FROM v_reporter")
def win_4(spark, sf):
    return citations.citation_positions(V.fx_docs(spark, sf), R.REPORTER_CITE).select(
        "doc_id", "start", F.col("end").alias("stop"), "hit")


@case("citations_of_parts", """SELECT d.doc_id, cast(c.reporter_cites AS bigint) AS reporter_cites,
    coalesce(m.missing, '') AS missing FROM fx_docs d JOIN v_cites c ON d.doc_id = c.doc_id
    LEFT JOIN (SELECT doc_id, string_agg(hit, '; ' ORDER BY pos) AS missing FROM v_missing GROUP BY 1) m ON d.doc_id = m.doc_id""")
def citations_of_parts(spark, sf):
    """CIT-001's facts with every text cut into parts of 300 characters."""
    return citations.missing_citations_by_part(V.fx_docs(spark, sf), part_chars=300).select(
        "doc_id", "reporter_cites", F.array_join("missing_cites", "; ").alias("missing"))


@case("positions_of_parts", ORACLES["WIN-4"])
def positions_of_parts(spark, sf):
    """WIN-4 with every text cut into parts of 100 characters."""
    return citations.citation_positions(V.fx_docs(spark, sf), R.REPORTER_CITE, part_chars=100).select(
        "doc_id", "start", F.col("end").alias("stop"), "hit")


# ----------------------------------------------------- sort and set -----------

@case("SRT-1", """SELECT doc_id, check_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN NOT applicable THEN 4
    WHEN passed THEN 3 WHEN severity = 'reject' THEN 0 WHEN severity = 'correction' THEN 1 ELSE 2 END, check_id) AS position
    FROM v_results""")
def srt_1(spark, sf):
    return verdict.order_results(results(spark, sf)).select("doc_id", "check_id", "position")


@case("SRT-2", """SELECT doc_id, string_agg(cast(page_no + 1 AS varchar), ', ' ORDER BY page_no) FILTER (page_no < 10)
    || CASE WHEN count(*) > 10 THEN ' (and ' || (count(*) - 10) || ' more)' ELSE '' END AS shown
    FROM fx_pages GROUP BY 1""")
def srt_2(spark, sf):
    return documents.bad_pages(V.fx_pages(spark, sf), F.lit(True), F.col("page_no")).select(
        "doc_id", X.page_list(F.col("pages")).alias("shown"))


_CAPTIONS = f"""SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(range(0, len(a))) AS line_no, unnest(a) AS line
    FROM (SELECT doc_id, string_split(full_text, chr(10)) AS a FROM fx_docs))
    WHERE {hit('line', R.CAPTION_PATTERN, 'i')} AND NOT {hit('line', R.CAPTION_PLACEHOLDERS)}"""


@case("SRT-3", f"""SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r
    FROM ({_CAPTIONS})) WHERE r <= 5""")
def srt_3(spark, sf):
    return sensitive.top_k_hits(sensitive.caption_hits(V.fx_docs(spark, sf))).select(
        "doc_id", "line_no", "line")


@case("SET-1", "SELECT doc_id, check_id, passed, severity, applicable FROM v_all")
def set_1(spark, sf):
    return all_results(spark, sf, ["doc_id", "check_id", "passed", "severity", "applicable"])


@case("SET-2", f"""SELECT doc_id, kind, hit FROM ({_DOCKETS})
    WHERE hit NOT IN ({', '.join(q(h) for h in R.PLACEHOLDER_DOCKETS + R.PLACEHOLDER_DISTRICT_DOCKETS)})""")
def set_2(spark, sf):
    return sensitive.allowlist_except(
        sensitive.docket_hits(V.fx_docs(spark, sf)), sensitive.placeholder_hits(spark)).select(
        "doc_id", "kind", "hit")


@case("SET-3", "SELECT doc_id, check_id FROM v_merged WHERE NOT evaluated")
def set_3(spark, sf):
    applicable = catalog.applicable_checks(typed_docs(spark, sf), R.check_catalog(spark))
    return catalog.requested_minus_judged(applicable, V.fx_judged(spark, sf))


# ----------------------------------------------------------------- checks ---

def _check(check_id: str):
    def run(spark, sf):
        rows = mechanical.mechanical_checks(
            V.fx_docs(spark, sf), V.fx_pages(spark, sf), V.fx_spans(spark, sf), only={check_id})
        return rows.select(
            "doc_id", "check_id", "rule", "passed", "severity", "applicable",
            F.coalesce(joined("pages"), F.lit("")).alias("pages"))
    return run


for _id in [r[0] for r in R.MECHANICAL_CHECKS] + ["PG-002", "PG-003", "PG-005"]:
    case(_id, f"""SELECT doc_id, check_id, rule, passed, severity, applicable, pages FROM v_results
        WHERE check_id = '{_id}'""")(_check(_id))


@case("PG-004", f"""SELECT t.doc_id, 'PG-004' AS check_id, t.brief_type <> 'petition_rehearing'
      OR {words('d.full_text')} <= 300 AS passed, t.brief_type = 'petition_rehearing' AS applicable
    FROM v_types t JOIN fx_docs d ON t.doc_id = d.doc_id""")
def pg_004(spark, sf):
    short = R.Thresholds(amicus_rehearing_words=300)
    return mechanical.mechanical_checks(
        V.fx_docs(spark, sf), V.fx_pages(spark, sf), V.fx_spans(spark, sf), short,
        word_limit=True, only={"PG-004"}).select("doc_id", "check_id", "passed", "applicable")


@case("mechanical_checks", "SELECT doc_id, check_id, rule, passed, severity, applicable, pages FROM v_results")
def all_checks(spark, sf):
    return results(spark, sf).select(
        "doc_id", "check_id", "rule", "passed", "severity", "applicable",
        F.coalesce(joined("pages"), F.lit("")).alias("pages"))


# --------------------------------------------------------------- evidence ---

def _flag_sql(patterns: dict) -> str:
    return ", ".join(f"{hit('full_text', p, 'i')} AS {n}" for n, p in patterns.items())


def _count_sql(patterns: dict, col: str = "full_text") -> str:
    return ", ".join(f"{count(col, p, 'i')} AS {n}" for n, p in patterns.items())


def _evidence(key: str, fn, sql: str, view=V.fx_docs):
    case(key, sql)(lambda spark, sf: fn(view(spark, sf)))


_SECTION = R.SECTION_PATTERNS
_evidence("EVD-1", evidence.section_presence,
          f"SELECT doc_id, {_flag_sql(_SECTION)} FROM fx_docs")
_MARKS = f"cast(coalesce(sum({count('line', R.BRACKET_MARK)} + {count('line', R.PARAGRAPH_MARK)}) FILTER (heading IS NULL), 0) AS bigint)"
_evidence("EVD-2", evidence.toc_reference_style,
          f"""SELECT doc_id, count(DISTINCT page_no) AS toc_pages, {_MARKS} AS paragraph_refs,
          cast(coalesce(sum({count('line', '[^0-9][ .' + chr(9) + ']\\d+[ ' + chr(9) + ']*$')}) FILTER (heading IS NULL), 0) AS bigint) AS page_refs
          FROM v_section_lines WHERE section = 'contents' GROUP BY 1""", V.fx_dpages)
_evidence("EVD-3", evidence.authorities_sorted,
          f"""SELECT doc_id, cast(len(whole) AS bigint) AS case_lines, whole = list_sort(whole) AS in_order, paragraph_refs
          FROM (SELECT doc_id, coalesce(list(trim(line, {WS}) ORDER BY line_seq) FILTER (contains(line, ' v. ')), []) AS whole,
            {_MARKS} AS paragraph_refs FROM v_section_lines WHERE section = 'authorities' GROUP BY 1)""", V.fx_dpages)
_NUMBERS = ("list_distinct(list_transform(regexp_extract_all({}, {}, 1), lambda x: regexp_replace(x, '(^|-)0+([0-9])', '\\1\\2', 'g')))")


@case("statutes_set_out", f"""SELECT d.doc_id, coalesce(cited, '') AS cited, coalesce(set_out, '') AS set_out, coalesce(missing, '') AS missing
    FROM documents d LEFT JOIN (SELECT doc_id, string_agg(number, ',' ORDER BY number) FILTER (c) AS cited,
      string_agg(number, ',' ORDER BY number) FILTER (s) AS set_out, string_agg(number, ',' ORDER BY number) FILTER (c AND NOT s) AS missing
      FROM (SELECT doc_id, number, bool_or(how = 'cited') AS c, bool_or(how = 'set_out') AS s FROM (
        SELECT doc_id, 'cited' AS how, unnest({_NUMBERS.format('line', q(evidence.SECTION_CITED))}) AS number
          FROM v_section_lines WHERE section <> 'addendum'
        UNION ALL SELECT doc_id, 'set_out', unnest({_NUMBERS.format(f'trim(line, {WS})', q(evidence.SECTION_SET_OUT))})
          FROM v_section_lines WHERE section = 'addendum') GROUP BY 1, 2) GROUP BY 1) n ON d.doc_id = n.doc_id""")
def statutes_set_out(spark, sf):
    """EVD-14 with CNT-003: cited sections against those that the addendum sets out."""
    return evidence.statutes_set_out(V.fx_dpages(spark, sf)).select(
        "doc_id", *[joined(c).alias(c) for c in ("cited", "set_out", "missing")])


_evidence("EVD-4", evidence.record_cite_mix,
          f"""SELECT *, CASE WHEN record_cites + other_cites > 0 THEN
          round(record_cites / (record_cites + other_cites), 6) END AS compliant_share FROM (SELECT doc_id,
          {count('full_text', evidence.RECORD_STYLE)} AS record_cites,
          {count('full_text', evidence.OTHER_RECORD_STYLE)} AS other_cites FROM fx_docs)""")
_evidence("EVD-5", evidence.review_standard_terms,
          f"SELECT doc_id, {_count_sql(evidence.REVIEW_TERMS)} FROM fx_docs")
_evidence("EVD-6", evidence.relief_terms,
          f"""SELECT doc_id, {_count_sql(evidence.RELIEF_TERMS, 'tail')} FROM (SELECT doc_id,
          {extract('full_text', evidence.AFTER_CONCLUSION, 1, 'ims')} AS tail FROM fx_docs)""")
_evidence("EVD-7", evidence.party_label_ratio,
          f"""SELECT doc_id, labels, CASE WHEN words > 0 THEN round(labels * 1000 / words, 6) END AS labels_per_1000
          FROM (SELECT doc_id, {count('full_text', evidence.PARTY_LABELS, 'i')} AS labels,
          {words('full_text')} AS words FROM fx_docs)""")
_evidence("EVD-8", evidence.case_triggers, f"SELECT doc_id, {_flag_sql(R.CASE_TRIGGERS)} FROM fx_docs")
_evidence("EVD-9", evidence.writ_trigger,
          f"""SELECT doc_id, {hit('full_text', R.WRIT_TERMS, 'i')} AS is_writ,
          {count('full_text', evidence.EXHIBIT_CITE)} AS exhibit_cites, {_flag_sql(evidence.WRIT_ELEMENTS)} FROM fx_docs""")
_evidence("EVD-10", evidence.rehearing_points,
          f"""SELECT doc_id, {count('full_text', '\\boverlooked\\b', 'i')} AS overlooked,
          {count('full_text', '\\bmisapprehended\\b', 'i')} AS misapprehended,
          {hit('full_text', _SECTION['table_of_contents'], 'i')} AS has_contents,
          {hit('full_text', _SECTION['table_of_authorities'], 'i')} AS has_authorities FROM fx_docs""")
_evidence("EVD-11", evidence.neutral_cite_years,
          f"""SELECT y.doc_id, len(list_filter(y.a, lambda x: cast(x AS int) < 1997)) AS before_1997,
          len(list_filter(y.a, lambda x: cast(x AS int) >= 1997)) AS since_1997, c.missing_cites AS reporter_only
          FROM (SELECT doc_id, regexp_extract_all(full_text, {q(evidence.NEUTRAL_YEAR)}, 1) AS a FROM fx_docs) y
          JOIN v_cites c ON y.doc_id = c.doc_id""")
_evidence("EVD-12", evidence.amicus_statements,
          f"SELECT doc_id, {_flag_sql(evidence.AMICUS_STATEMENTS)} FROM fx_docs")
def _redacted_sql(col: str) -> str:
    for pattern, flags, shortened in evidence.REDACTIONS:
        col = f"regexp_replace({col}, {q((f'(?{flags})' if flags else '') + pattern)}, {q(shortened.replace('$', chr(92)))}, 'g')"
    return col


_evidence("EVD-13", evidence.personal_identifiers,
          f"SELECT doc_id, {_count_sql(evidence.IDENTIFIERS)}, {_redacted_sql('full_text')} AS redacted_text FROM fx_docs")
_LINES = f"list_filter(list_transform(string_split(full_text, chr(10)), lambda x: trim(x, {WS})), lambda x: x <> '')"
_evidence("EVD-14", evidence.statute_quotes,
          f"""SELECT doc_id, {count('full_text', evidence.CODE_CITE)} AS code_cites,
          {hit('full_text', R.ADDENDUM_LINE, 'im')} AS has_addendum,
          CASE WHEN len({_LINES}) > 0 THEN round(1 - len(list_distinct({_LINES})) / len({_LINES}), 6) END AS repeated_lines
          FROM fx_docs""")

_ALLOWED = "7$"  # a user's allow-list: whatever ends in a seven
_NAMED = "'doc-' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.DOCX' WHEN 1 THEN '.md' ELSE '.xlsx7' END"


@case("EVD-15", f"""SELECT d.doc_id, coalesce(h.dockets, 0) AS dockets, coalesce(h.district_dockets, 0) AS district_dockets,
    coalesce(c.n, 0) AS captions, {hit(_NAMED.replace('doc_id', 'd.doc_id'), R.BINARY_NAME_PATTERN, 'i')}
      AND NOT {hit(_NAMED.replace('doc_id', 'd.doc_id'), _ALLOWED)} AS binary_name
    FROM fx_docs d LEFT JOIN (SELECT doc_id, count(*) FILTER (kind = 'supreme') AS dockets,
      count(*) FILTER (kind = 'district') AS district_dockets FROM ({_DOCKETS}) WHERE hit NOT IN
      ({', '.join(q(x) for x in R.PLACEHOLDER_DOCKETS + R.PLACEHOLDER_DISTRICT_DOCKETS)})
      AND NOT {hit('hit', _ALLOWED)} GROUP BY 1) h ON d.doc_id = h.doc_id
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_CAPTIONS}) WHERE NOT {hit('line', _ALLOWED)} GROUP BY 1) c
    ON d.doc_id = c.doc_id""")
def evd_15(spark, sf):
    named = V.fx_docs(spark, sf).withColumn("file_name", F.expr(
        "concat('doc-', doc_id, case doc_id % 3 when 0 then '.DOCX' when 1 then '.md' else '.xlsx7' end)"))
    return sensitive.sensitive_counts(named, _ALLOWED)


# ---------------------------------------------------------------- scalars ---

_SPACED = "array_to_string(string_split(cover_text, ''), ' ')"


@case("SCL-1", f"""SELECT doc_id, trim(regexp_replace({collapse("plain")}, '\\s+', ' ', 'g')) AS normal FROM (
    SELECT doc_id, trim(lower(regexp_replace(regexp_replace(strip_accents(text),
      '[''"`‘’‚‛´′‵“”„‟«»″‶]', '', 'g'), '[‐‑‒–—―−]', '-', 'g')), {WS}) AS plain
    FROM fx_pages WHERE page_no = 0)""")
def scl_1(spark, sf):
    return V.fx_pages(spark, sf).filter("page_no = 0").select(
        "doc_id", X.normalize_cover(F.col("text")).alias("normal"))


@case("SCL-2", f"SELECT doc_id, {collapse('spaced')} AS collapsed FROM (SELECT doc_id, {_SPACED} AS spaced FROM fx_docs)")
def scl_2(spark, sf):
    spaced = F.array_join(F.split("cover_text", ""), " ")
    return V.fx_docs(spark, sf).select("doc_id", X.collapse_letter_spacing(spaced).alias("collapsed"))


@case("SCL-3", "SELECT doc_id, brief_type FROM v_types")
def scl_3(spark, sf):
    return typed_docs(spark, sf).select("doc_id", "brief_type")


@case("SCL-4", f"SELECT doc_id, {extract('cover_text', R.CASE_NUMBER, 1, 'i')} AS case_number FROM fx_captions")
def scl_4(spark, sf):
    return V.fx_captions(spark, sf).select("doc_id", X.case_number(F.col("cover_text")).alias("case_number"))


@case("SCL-5", """SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN '' ELSE CASE WHEN doc_id % 5 = 0 THEN 'Amended ' ELSE '' END
    || CASE WHEN doc_id % 7 = 0 THEN 'Reply ' ELSE '' END || 'Brief Of Defendant-Appellant' END AS brief_label FROM fx_captions""")
def scl_5(spark, sf):
    return V.fx_captions(spark, sf).select("doc_id", X.brief_label(F.col("cover_text")).alias("brief_label"))


@case("SCL-6", """SELECT doc_id, CASE WHEN doc_id % 3 <> 2 THEN 'Jane Roe v. John Q. Doe'
    ELSE 'Roe v. Doe ' || doc_id END AS case_title FROM fx_captions""")
def scl_6(spark, sf):
    return V.fx_captions(spark, sf).select(
        "doc_id", X.case_title(F.col("cover_text"), F.col("path")).alias("case_title"))


@case("SCL-7", """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
    '"', '&quot;') AS escaped FROM pages""")
def scl_7(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", X.html_escape(F.col("html")).alias("escaped"))


_RULE_CASES = ["32(a)(4)", "28(h)/34(a)(1)(C)", "N.D.R.Ct. 11.6(b)", "3.4(b)", "see text"]
_A = '" target="_blank" class="rule-link">'
_RULE_LINKS = [
    f'<a href="{R.APPELLATE_RULES_URL}/32{_A}Rule 32(a)(4)</a>',
    f'<a href="{R.APPELLATE_RULES_URL}/28{_A}Rule 28(h)</a> / '
    f'<a href="{R.APPELLATE_RULES_URL}/34{_A}Rule 34(a)(1)(C)</a>',
    f'<a href="{R.COURT_RULES_URL}/11-6{_A}N.D.R.Ct. 11.6(b)</a>',
    f'<a href="{R.COURT_RULES_URL}/3-4{_A}Rule 3.4(b)</a>',
    "Rule see text",
]


@case("SCL-8", f"SELECT doc_id, ({'[' + ', '.join(q(x) for x in _RULE_LINKS) + ']'})[doc_id % 5 + 1] AS links FROM documents")
def scl_8(spark, sf):
    rule = F.element_at(F.array(*[F.lit(r) for r in _RULE_CASES]), (F.col("doc_id") % 5 + 1).cast("int"))
    return V.table(spark, sf, "documents").select("doc_id", X.rule_links(rule).alias("links"))


@case("SCL-9", """SELECT doc_id, array_to_string(list_transform(string_split(brief_type, '_'),
    lambda x: upper(x[1]) || x[2:]), ' ') AS label FROM v_types""")
def scl_9(spark, sf):
    return typed_docs(spark, sf).select("doc_id", X.type_label(F.col("brief_type")).alias("label"))


@case("SCL-10", "SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents")
def scl_10(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@case("SCL-11", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN true
    ELSE date_diff('day', cast(ts AS date), DATE '2024-04-10') >= 90 END AS due FROM events""")
def scl_11(spark, sf):
    checked = F.when(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 2 == 0, "not a date")).otherwise(
        F.date_format("ts", "yyyy-MM-dd"))
    return V.table(spark, sf, "events").select(
        "event_id", governance.needs_refresh(checked, F.lit("2024-04-10").cast("date")).alias("due"))


@case("SCL-12", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN doc_id || ',' || (doc_id + 1)
    WHEN doc_id % 5 = 1 THEN '4,' || doc_id WHEN doc_id % 5 = 2 THEN '7' END AS pages FROM documents""")
def scl_12(spark, sf):
    message = F.expr("case doc_id % 5 when 0 then concat('Margin < 1\" on ', doc_id, ', ', doc_id + 1, '.') "
                     "when 1 then concat('Found on pages 4, ', doc_id) else 'nothing' end")
    details = F.expr("case doc_id % 5 when 2 then 'High density on Pages: 7.' when 3 then 'none' end")
    return V.table(spark, sf, "documents").select("doc_id", F.array_join(X.pages_from_message(
        message, details, F.col("doc_id") % 2 == 0).cast("array<string>"), ",").alias("pages"))


@case("SCL-13", """SELECT j.doc_id, check_id, passed, rule, message FROM fx_judged j WHERE j.doc_id % 50 <> 2
    UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 50 = 2""")
def scl_13(spark, sf):
    return catalog.judged_rows(V.fx_answers(spark, sf)).select(
        "doc_id", "check_id", "passed", "rule", "message")


@case("SCL-14", f"SELECT doc_id, substring(sha256(doc_id || ':{RUN}'), 1, 12) AS report_id FROM documents")
def scl_14(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", X.report_id(F.col("doc_id"), RUN).alias("report_id"))


# -------------------------------------------------------------- streaming ---

@case("STR-1", "SELECT doc_id, recommendation, total_checks, failed_ids FROM v_verdict")
def str_1(spark, sf):
    return intake.run_available(
        spark, f"{sf}/documents.parquet", V.table(spark, sf, "documents").schema,
        lambda batch: intake.check_batch(*_batch_inputs(batch)), V.work_folder(spark)).select(
        "doc_id", "recommendation", "total_checks", "failed_ids")


def _batch_inputs(batch):
    return (V.fx_docs_of(batch), V.fx_pages_of(batch), V.fx_spans_of(batch))


@case("STR-2", "SELECT DISTINCT 'sha256:' || sha256(text) AS content_hash FROM documents")
def str_2(spark, sf):
    return intake.run_uploads(
        spark, f"{sf}/documents.parquet", V.table(spark, sf, "documents").schema,
        lambda uploads: uploads.select(
            X.content_hash(F.col("text")).alias("content_hash"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 86400).alias("received_at")),
        V.work_folder(spark)).select("content_hash")


@case("STR-3", """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
    event_type AS recommendation, count(*) AS n FROM events GROUP BY 1, 2""")
def str_3(spark, sf):
    verdicts = V.table(spark, sf, "events").select("ts", F.col("event_type").alias("recommendation"))
    return intake.intake_counts(verdicts, "1 hour").select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "recommendation", "n")


@case("intake_with_late", """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
    event_type AS recommendation, count(*) AS n FROM events GROUP BY 1, 2""")
def intake_with_late(spark, sf):
    """STR-3 as a stream: what was on time and what came late make up all rows."""
    on_time, late = intake.run_counts(
        spark, f"{sf}/events.parquet", V.table(spark, sf, "events").schema,
        lambda events: events.select("ts", F.col("event_type").alias("recommendation")), V.work_folder(spark))
    late = late.groupBy("window_start", "window_end", "recommendation").agg(F.count(F.lit(1)).alias("n"))
    return intake.counted(on_time.unionByName(late)).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "recommendation", "n")
