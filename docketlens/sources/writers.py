"""Writers: interchange JSON, summaries, HTML reports, report store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlens import schema as S
from docketlens.functions import text as X
from docketlens.operators import verdict

_JSON_FIELDS = ["check_id", "name", "rule", "passed", "severity", "message", "details", "applicable", "pages", "items"]
_DOC_FIELDS = ["path", "brief_type", "total_pages", "body_pages", "word_count", "cover_text",
               "full_text"]


def document_rows(docs: DataFrame, results: DataFrame | None,
                  field: str = "mechanical_results") -> DataFrame:
    """Documents with their results as one array; without ``results`` each brings its own (``mechanical.with_results``)."""
    if results is None:
        own = F.array_sort(F.transform("results", lambda r: F.struct(*[r[c].alias(c) for c in _JSON_FIELDS])))
        rows = docs.filter(F.size("results") > 0).select(
            "doc_id", *[c for c in _DOC_FIELDS if c in docs.columns], own.alias(field))
        return rows.withColumnRenamed("path", "pdf_path")
    listed = results.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct(*_JSON_FIELDS))).alias(field))
    kept = [c for c in _DOC_FIELDS if c in docs.columns]
    rows = docs.select("doc_id", *kept).join(listed, "doc_id")
    return rows.withColumnRenamed("path", "pdf_path")


def document_json(docs: DataFrame, results: DataFrame,
                  field: str = "mechanical_results") -> DataFrame:
    rows = document_rows(docs, results, field)
    return rows.select("doc_id", F.to_json(F.struct(*rows.columns)).alias("json"))


def write_documents(docs: DataFrame, results: DataFrame | None, path: str,
                    field: str = "mechanical_results", compression: str = "none") -> None:
    """SNK-1: one interchange object per document, many per file; ``compression`` as Spark's JSON writer names it."""
    document_rows(docs, results, field).write.mode("overwrite").json(path, compression=compression)


def summaries(results: DataFrame, docs: DataFrame, run_id: str, details: bool = False) -> DataFrame:
    """SNK-2: verdict, counts and failed checks of each document."""
    fields = ["check_id", "name", "rule", "severity", "message"] + (["details"] if details else [])
    failures = F.array_sort(F.collect_list(F.when(verdict.failed(), F.struct(*fields))))
    kept = [c for c in ("path", "brief_type") if c in docs.columns]
    return (
        verdict.decide(results, failures.alias("failures")).drop("failed_ids")
        .join(docs.select("doc_id", *kept), "doc_id")
        .withColumn("report_id", X.report_id(F.col("doc_id"), run_id))
    )


def write_reports(reports: DataFrame, path: str, run_id: str, files: int = 1, block_bytes: int = 16 << 20) -> None:
    """SNK-4: keep the reports of a run, clustered by the first digit pair of their id.

    Report ids are spread evenly over the prefixes; ``files`` salts a prefix of a
    large run over more files.  A rerun overwrites its own run's folders only.
    """
    keyed = reports.withColumns({"run_id": F.lit(run_id), "id_prefix": F.substring("report_id", 1, 2)})
    salt = F.pmod(F.xxhash64("report_id"), F.lit(files))
    # Sorted ids and a Bloom filter in each row group: one report is found without reading the others.
    (keyed.repartition("id_prefix", salt).sortWithinPartitions("id_prefix", "report_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#report_id", "true")
     .option("parquet.block.size", block_bytes).partitionBy("run_id", "id_prefix").parquet(path))


def report_by_id(spark: SparkSession, path: str, report_id: str) -> DataFrame:
    """One stored report; no row when the id is unknown.

    The prefix prunes to one folder, the id itself is pushed into the scan.
    """
    return spark.read.parquet(path).filter(
        (F.col("id_prefix") == report_id[:2]) & (F.col("report_id") == report_id)
    ).drop("id_prefix", "run_id")


def reports_by_id(reports: DataFrame, wanted: DataFrame) -> DataFrame:
    """Reports whose id is wanted; unknown ids give nothing."""
    return reports.join(wanted.select("report_id"), "report_id", "left_semi")


# ------------------------------------------------------------------- HTML ---

# label, text colour, background of the banner by verdict
_BANNERS = {
    "accept": ("ACCEPT", "#1a7f37", "#dafbe1"),
    "correction_letter": ("CORRECTION LETTER", "#9a6700", "#fff8c5"),
    "reject": ("REJECT", "#cf222e", "#ffebe9"),
}
_GROUPS = [("reject", "Critical — Reject", "#cf222e"),
           ("correction", "Correction Required", "#9a6700"),
           ("note", "Advisory Notes", "#57606a")]
_STYLE = (
    "body{font:15px/1.5 sans-serif;max-width:56rem;margin:2rem auto;color:#1f2328}"
    ".banner{padding:1rem;border-radius:6px;font-size:1.2rem}"
    "table{border-collapse:collapse;width:100%}td,th{padding:.3rem .6rem;text-align:left;"
    "border-bottom:1px solid #d0d7de}"
    ".card{border-left:4px solid;padding:.5rem 1rem;margin:.5rem 0}.detail{white-space:pre-line;"
    "color:#57606a}.page{font-family:monospace;margin-right:.4rem}"
)


def _tag(name: str, *content, attrs: str = "") -> Column:
    parts = [c if isinstance(c, Column) else F.lit(c) for c in content]
    return F.concat(F.lit(f"<{name}{' ' + attrs if attrs else ''}>"), *parts, F.lit(f"</{name}>"))


def _or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def _card(color: str):
    def card(r: Column) -> Column:
        pages = F.array_join(F.transform(r["pages"], lambda p: F.concat(
            F.lit('<span class="page">p.'), p.cast("string"), F.lit("</span>"))), "")
        return _tag(
            "div", _tag("code", r["check_id"]), " ", _tag("b", X.html_escape(r["name"])), " ",
            X.rule_links(r["rule"]), " ", F.upper(r["severity"]),
            _tag("p", X.html_escape(r["message"])),
            F.when(F.size(r["pages"]) > 0, _tag("p", "Pages: ", pages)).otherwise(""),
            _or_empty(_tag("div", X.html_escape(r["details"]), attrs='class="detail"')),
            attrs=f'class="card" style="border-color:{color}"')
    return card


def _line(r: Column) -> Column:
    return _tag("tr", _tag("td", r["check_id"]), _tag("td", X.html_escape(r["name"])),
                _tag("td", X.rule_links(r["rule"])), _tag("td", X.html_escape(r["message"])),
                _tag("td", _or_empty(F.array_join(r["pages"].cast("array<string>"), ", "))))


def _result_table(title: str, rows: Column) -> Column:
    head = "<tr><th>ID</th><th>Check</th><th>Rule</th><th>Result</th><th>Pages</th></tr>"
    table = _tag("table", head, F.array_join(F.transform(rows, _line), ""))
    return F.when(F.size(rows) > 0, _tag(
        "details", _tag("summary", F.format_string(f"{title} (%d)", F.size(rows))), table)
    ).otherwise("")


def report_html(footer: str = "", at: Column | None = None, version: str = "", model: str = "") -> Column:
    """A self-contained page from a report row of ``plans.reports``.

    ``at`` is the time of the analysis, ``version`` that of the rules and ``model`` the
    judge's name; each is shown where it is given.
    """
    banner = F.lit("")
    for value, (label, color, background) in _BANNERS.items():
        banner = F.when(F.col("recommendation") == value, F.lit(
            f'<div class="banner" style="color:{color};background:{background}">'
            f"Recommended Action: <b>{label}</b></div>")).otherwise(banner)

    results = F.col("results")

    def failed_with(severity: str) -> Column:
        return F.filter(results, lambda r: ~r["passed"] & r["applicable"]
                        & (r["severity"] == severity))

    cards = [F.when(F.size(failed_with(s)) > 0, F.concat(
        _tag("h3", title), F.array_join(F.transform(failed_with(s), _card(color)), "")))
        .otherwise("") for s, title, color in _GROUPS]
    failed = F.when(F.col("failed_checks") > 0, F.concat(*cards)).otherwise(
        "<p>No failed checks.</p>")
    kind = X.type_label(F.col("brief_type"))
    subtitle = F.concat_ws(" — ", *[
        F.when(F.col("case_number") != "", F.concat(F.lit("No. "), X.html_escape(F.col("case_number")))),
        F.when(F.col("brief_label") != "", X.html_escape(F.col("brief_label")))
        .when(F.col("brief_type") != "unknown", F.concat(kind, F.lit(" Brief")))])
    title = F.when(F.col("case_title") != "", X.html_escape(F.col("case_title"))).otherwise(
        "Appellate Brief Compliance Report")

    def fact(label: str, value: Column) -> Column:
        return _tag("tr", _tag("td", label), _tag("td", F.coalesce(value.cast("string"), F.lit("—"))))

    facts = _tag("table", fact("Report ID", F.col("report_id")), fact("Brief Type", kind),
                 fact("Pages (body)", F.col("body_pages")),
                 fact("Pages (total)", F.col("total_pages")),
                 fact("Word Count", F.col("word_count")),
                 *([] if at is None else [fact("Date", F.date_format(at, "MMMM dd, yyyy hh:mm a"))]))
    made = " ".join(x for x in (footer, version, f"using {model}" if model else "") if x)
    return F.concat(
        F.lit('<!DOCTYPE html><html lang="en"><head><meta charset="UTF-8"><title>'), title,
        F.lit(f"</title><style>{_STYLE}</style></head><body>"), _tag("h1", title),
        _tag("p", subtitle), banner, facts,
        F.when(F.col("reasoning") != "", _tag("p", X.html_escape(F.col("reasoning")))).otherwise(""),
        _tag("h2", F.format_string("Failed Checks (%d)", F.col("failed_checks"))), failed,
        _result_table("Passed Checks", F.filter(results, lambda r: r["passed"] & r["applicable"])),
        _result_table("Not Applicable", F.filter(results, lambda r: ~r["applicable"])),
        _tag("footer", X.html_escape(F.lit(made))), F.lit("</body></html>"))


def render_reports(reports: DataFrame, footer: str = "", at: Column | None = None, version: str = "",
                   model: str = "") -> DataFrame:
    """SNK-3: one HTML page per report, as rows (write as text or parquet)."""
    return reports.select("doc_id", "report_id", report_html(footer, at, version, model).alias("html"))
