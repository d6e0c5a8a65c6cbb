"""The deterministic checks of a corpus, fused into one row per document.

Checks sharing a grain share one aggregation: spans become page rows, page rows
become document rows, and only then is each document unfolded into its result
rows.  Wide text is reduced to facts where it is stored and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens import rules as R
from docketlens import schema as S
from docketlens.functions import text as X
from docketlens.operators import citations, documents, fonts, layout
from docketlens.operators.layout import PAGE
from docketlens.plans.stages import Stage, inline

# Page rows of one document meet its font facts in this many tasks at least.
SALTS = 8

_FONT_FACTS = ["predominant_font_size", "predominant_font", "min_font_size", "dominant_style",
               "style_spans", "roman_spans", "italic_spans", "bold_spans", "bold_italic_spans",
               "roman_share"]


def text_facts(docs: DataFrame, th: R.Thresholds = R.DEFAULTS, keep_text: bool = False) -> DataFrame:
    """Facts of the document text; one pass, no shuffle, text left behind unless it is to be kept."""
    text = F.col("full_text")
    passing = [F.col(c) for c in ("path", "brief_type", "cover_text") if c in docs.columns]
    if keep_text:
        passing.append(text.alias("whole_text"))
    facts = docs.select(
        "doc_id", *passing, "full_text",
        F.upper("cover_text").contains("ORAL ARGUMENT").alias("asks_oral_argument"),
        X.count_matches(text, R.BRACKET_MARK, needs="[").alias("bracket_marks"),
        X.count_matches(text, R.PARAGRAPH_MARK, needs="¶").alias("paragraph_marks"),
        (text.contains("Certificate of Compliance") | X.matches_with(
            text, F.lower(text), R.SECTION_PATTERNS["certificate_of_compliance"], "cert")).alias("has_certificate"),
        X.count_matches(text, R.RECORD_CITE, needs="(R").alias("record_cites"),
        X.word_count(text).alias("word_count"))
    return citations.with_missing_citations(facts, "full_text", th).withColumnRenamed("whole_text", "full_text")


# What a check reads, for runs of a few checks only.
TEXT_CHECKS = {"FMT-010", "COV-001", "COV-002", "CNT-004", "SEC-013", "REC-001", "CIT-001", "PG-004"}
FONT_CHECKS = {"FMT-006", "FMT-008"}


def page_rows(spans: DataFrame, pages: DataFrame, th: R.Thresholds = R.DEFAULTS,
              stage: Stage = inline, geometry: DataFrame | None = None) -> DataFrame:
    """One row per page: geometry, text and font facts.

    Whether small capitals are small depends on the document's body size, so
    page rows join the font facts of their document.  That join is salted: a
    document with very many pages is spread over ``SALTS`` keys.  ``geometry``
    brings page facts that nested pages gave in their own rows.
    """
    runs = stage("page_runs", fonts.page_runs(fonts.font_histogram(spans, th)))
    font_facts = fonts.doc_font_facts(fonts.unfold_runs(runs)).select(
        "doc_id", *_FONT_FACTS, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = (
        (layout.page_facts(spans, pages, th) if geometry is None else geometry).join(runs, PAGE, "left")
        .withColumn("salt", F.pmod("page_no", F.lit(SALTS)))
        .join(font_facts, ["doc_id", "salt"], "left")
        .withColumns(fonts.run_count_columns(th))
    )
    return fonts.move_small_caps(rows, th).drop("runs", "salt")


def _page_conditions(th: R.Thresholds) -> dict[str, str]:
    """Predicates on a page row: what makes the page count against a check."""
    tolerance = th.margin_tolerance_in
    width = "(width_in - left_in - right_in)"
    return {
        "FMT-001": f"abs(width_in - {th.paper_width_in}D) > {th.paper_tolerance_in}D "
                   f"or abs(height_in - {th.paper_height_in}D) > {th.paper_tolerance_in}D",
        "FMT-002": f"left_in < {th.min_left_in - tolerance!r}D",
        "FMT-003": f"right_in < {th.min_right_in - tolerance!r}D",
        "FMT-004": f"top_in < {th.min_top_in - tolerance!r}D",
        "FMT-005": f"bottom_in < {th.min_bottom_in - tolerance!r}D",
        "FMT-006": "body_chars + header_footer_chars + superscript_chars + small_caps_chars > 0",
        "FMT-007": f"page_no > 0 and {width} > 0 "
                   f"and max_line_chars / {width} > {th.max_chars_per_inch}",
        "FMT-011": "page_number_text is null and has_text",
    }


def _key(check_id: str) -> str:
    return check_id.lower().replace("-", "_")


def document_rows(page_rows_: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """One row per document with pages: every page-level fact the checks need.

    Page rows combine into one row per 63 pages, with a bitmap for each condition,
    and those into documents; a page number exists as such only in the lists that
    results show.  Font facts are added when the page rows carry them; of pages with
    small print the counts are listed, because results show them.
    """
    conditions = _page_conditions(th)
    lists = {f"bad_{_key(cid)}": F.expr(cond) for cid, cond in conditions.items() if cid not in FONT_CHECKS}
    # name: (aggregate over pages, how such aggregates merge)
    page = "int(page_no + 1)"
    columns = {
        "total_pages": ("count(1)", "sum"), "addendum_start": ("min(if(has_addendum_line, page_no, null))", "min"),
        "cover_size": ("max(if(page_no = 0, struct(width_in, height_in), null))", "max"),
        "cover_number": ("max(if(page_no = 0, page_number_text, null))", "max"),
        # At most 63 a row, ten bytes a page: a second branch over the page rows, as in
        # ``documents.spacing_medians``, would compute them twice.
        "spacings": ("collect_list(if(line_spacing is null, null, struct(line_spacing as gap, page_no > 0 as body)))", "collect_list"),
    }
    for side, cid in (("left", "FMT-002"), ("right", "FMT-003"), ("top", "FMT-004"),
                      ("bottom", "FMT-005")):
        columns[f"min_{side}"] = (f"min(if({conditions[cid]}, {side}_in, null))", "min")
    fonts_too = "body_chars" in page_rows_.columns
    if fonts_too:
        columns |= {
            "body_small_chars": ("sum(body_chars)", "sum"),
            "caps_small_chars": ("sum(small_caps_chars)", "sum"),
            "worst_page_body_chars": ("max(body_chars)", "max"),
            "smallest_pt": ("min(min_small_size)", "min"),
            "font_issues": (f"collect_list(if({conditions['FMT-006']}, struct({page} as page, "
                            "total_chars, body_chars, header_footer_chars, superscript_chars, "
                            "small_caps_chars), null))", "collect_list"),
        }
        columns |= {name: (f"max({name})", "max") for name in _FONT_FACTS}
    buckets = documents.page_bitmaps(page_rows_, lists, *[F.expr(f"{sql} as {name}") for name, (sql, _) in columns.items()])
    rows = buckets.groupBy("doc_id").agg(
        *[documents.merged_bitmaps(name).alias(name) for name in lists],
        *[F.expr(f"{merge}({name}) as {name}") for name, (_, merge) in columns.items()])
    rows = rows.withColumns({name: documents.bitmap_pages(F.col(name)) for name in lists})
    rows = rows.withColumn("body_pages", F.expr("coalesce(cast(addendum_start as bigint), total_pages)"))
    if fonts_too:
        rows = rows.withColumn("font_issues", F.array_sort(F.flatten("font_issues")))
    gaps = F.flatten("spacings")
    rows = rows.withColumns({
        "all_gaps": F.array_sort(F.transform(gaps, lambda s: s["gap"])),
        "body_gaps": F.array_sort(F.transform(F.filter(gaps, lambda s: s["body"]), lambda s: s["gap"]))})
    return rows.withColumns({"median_spacing": layout.middle_of("all_gaps"), "body_spacing": layout.middle_of("body_gaps")}).drop(
        "spacings", "all_gaps", "body_gaps")


def document_facts(docs: DataFrame, pages: DataFrame, spans: DataFrame,
                   th: R.Thresholds = R.DEFAULTS, stage: Stage = inline,
                   only: set[str] | None = None, geometry: DataFrame | None = None,
                   keep_text: bool = False) -> DataFrame:
    """All facts of each document; documents without pages keep nulls.

    ``keep_text`` keeps ``full_text`` beside them, for writers of whole documents; it is then
    shuffled once, with the facts.

    ``geometry`` is :func:`layout.nested_page_facts` where pages are nested; spans
    are then read for their fonts only.

    ``only`` names the checks wanted: text checks then leave the layout alone,
    and geometry checks leave the fonts alone.
    """
    if "brief_type" not in docs.columns:
        docs = documents.classify(docs)
    facts = text_facts(docs, th, keep_text)
    if only is None or only - TEXT_CHECKS:
        features = stage("span_features", layout.span_features(spans, th))
        if only is None or only & FONT_CHECKS:
            rows = page_rows(features, pages, th, stage, geometry)
        else:
            rows = layout.page_facts(features, pages, th) if geometry is None else geometry
        rows = stage("page_rows", rows)
        facts = facts.join(document_rows(rows, th), "doc_id", "left").withColumns({
            "has_double_spacing": F.expr(
                f"coalesce(median_spacing >= {th.min_double_space_pt}D, true)"),
            "total_pages": F.expr("coalesce(total_pages, 0L)"),
            "body_pages": F.expr("coalesce(body_pages, 0L)"),
        })
    return documents.with_cover_color(documents.with_page_limit(facts))


# --------------------------------------------------------------------------
# Result rows.  Each check is one SQL struct over the facts of a document.
# --------------------------------------------------------------------------

_NO_PAGES = "cast(array() as array<int>)"
_FIXED = {row[0]: row for row in R.MECHANICAL_CHECKS}


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _fill(template: str, *values: str) -> str:
    """``format_string`` over a literal template."""
    return f"format_string({_text(template)}, {', '.join(values)})"


def _pages(column: str, n: int = R.DEFAULTS.page_list_max) -> str:
    """A page list as shown to readers: the first ``n``, then how many more."""
    return (f"concat(array_join(slice({column}, 1, {n}), ', '), if(size({column}) > {n}, "
            f"concat(' (and ', size({column}) - {n}, ' more)'), ''))")


def _result(key: str, passed: str, message: str, details: str = "null", /,
            applicable: str = "true", pages: str = "null", items: str = "null", **fixed: str) -> str:
    """One result; id, name, rule and severity come from the table unless given."""
    _, name, rule, severity = _FIXED.get(key, (key, "", "", ""))
    head = {"check_id": _text(key), "name": _text(name), "rule": _text(rule),
            "severity": _text(severity)} | fixed
    return (
        f"named_struct('check_id', {head['check_id']}, 'name', {head['name']}, "
        f"'rule', {head['rule']}, 'passed', coalesce({passed}, true), "
        f"'severity', {head['severity']}, 'applicable', {applicable}, 'message', {message}, "
        f"'details', cast({details} as string), 'pages', cast({pages} as array<int>), "
        f"'items', cast({items} as array<string>))")


def _case(*branches: tuple[str, str], otherwise: str = "null") -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in branches) + f" else {otherwise} end"


def _paper(th: R.Thresholds) -> str:
    none, ok = "total_pages = 0", "total_pages > 0 and size(bad_fmt_001) = 0"
    bad = "total_pages > 0 and size(bad_fmt_001) > 0"
    return _result(
        "FMT-001", ok,
        _case((none, _text("No pages found in PDF.")), (ok, _text('All pages are 8.5" x 11".')),
              otherwise=_fill('Pages not 8.5" x 11": %s.', _pages("bad_fmt_001"))),
        _case((bad, _fill(
            f'Expected {th.paper_width_in}" x {th.paper_height_in}". '
            'Page 1 is %.2f" x %.2f".', "cover_size.width_in", "cover_size.height_in"))),
        pages=_case((bad, "bad_fmt_001")))


def _margin(check_id: str, side: str, required: str) -> str:
    name = _FIXED[check_id][1]
    bad = f"coalesce(bad_{_key(check_id)}, {_NO_PAGES})"
    ok = f"size({bad}) = 0"
    return _result(
        check_id, ok,
        _case((ok, _text(f"{name} meets the {required} requirement.")),
              otherwise=_fill(f"{name} < {required} on %s.", _pages(bad))),
        _case((f"not {ok}", _fill(
            f'Smallest {side} margin found: %.2f". Minimum required: {required}.',
            f"min_{side}"))),
        pages=_case((f"not {ok}", bad)))


def _font_size(th: R.Thresholds) -> str:
    clean = "(font_issues is null or size(font_issues) = 0)"
    harmless = "body_small_chars = 0"
    ok = f"({clean} or {harmless})"
    minimum = f"{th.min_font_pt}pt"
    pages = "transform(font_issues, i -> i.page)"
    kinds = (("small_caps_chars", "small caps"), ("header_footer_chars", "headers/footers"),
             ("superscript_chars", "superscripts"))

    def pages_with(field: str, label: str) -> str:
        hit = f"transform(filter(font_issues, i -> i.{field} > 0), i -> i.page)"
        return f"if(size({hit}) > 0, concat('{label} on pages ', {_pages(hit)}), null)"

    # Every page with small text, by kind: the texts name the first ten.
    listed = "concat(" + ", ".join(
        f"transform(filter(font_issues, i -> i.{field} > 0), i -> concat('{label} on page ', i.page))"
        for field, label in (("body_chars", "body"), *kinds)) + ")"
    counts = (("body_chars", "body"), ("small_caps_chars", "small caps"),
              ("header_footer_chars", "header/footer"), ("superscript_chars", "superscript"))
    parts = ", ".join(f"if(i.{f} > 0, concat(i.{f}, ' {label}'), null)" for f, label in counts)
    total = "(" + " + ".join(f"i.{f}" for f, _ in counts) + ")"
    line = _fill("  Page %d: %d of %,d chars (%.1f%%) noncompliant — %s", "i.page", total,
                 "i.total_chars", f"{total} / i.total_chars * 100D", f"concat_ws(', ', {parts})")
    breakdown = (
        "concat(" + _fill("Predominant font size: %spt. Smallest detected: %.1fpt.\n\n"
                          "Per-page breakdown:\n", "string(predominant_font_size)", "smallest_pt")
        + f", array_join(transform(font_issues, i -> {line}), '\\n'), "
        + _case(("caps_small_chars > 0", _fill(
            "\n\nNote: %d sub-12pt characters appear consistent with small-caps formatting and "
            "are excluded from the violation count.", "caps_small_chars")), otherwise="''") + ")")
    return _result(
        "FMT-006", ok,
        _case((clean, _text(f"Font size meets the {minimum} minimum.")),
              (harmless, _text(f"Font size meets the {minimum} minimum (sub-12pt characters are "
                               "small caps / superscripts / headers).")),
              otherwise=_fill(
                  f"Font size %.1fpt found on %s %s; minimum is {minimum}.", "smallest_pt",
                  "if(size(font_issues) = 1, 'page', 'pages')", _pages(pages))),
        _case((clean, "null"), (harmless, "concat(" + _text(
            "Sub-12pt characters detected; all appear consistent with conventional formatting "
            "(not undersized body text).\n") + ", concat_ws('; ', "
            + ", ".join(pages_with(*k) for k in kinds) + "), '.')"), otherwise=breakdown),
        pages=_case((f"not {ok}", "transform(filter(font_issues, i -> i.body_chars > 0), "
                                  "i -> i.page)")),
        items=_case((f"not {clean}", listed)),
        severity=f"if({ok} or worst_page_body_chars >= {th.serious_body_chars}, "
                 "'reject', 'note')")


def _page_check(check_id: str, passed_text: str, message: str, details: str) -> str:
    """A check that fails on listed pages."""
    bad = f"coalesce(bad_{_key(check_id)}, {_NO_PAGES})"
    ok = f"size({bad}) = 0"

    def shown(text: str) -> str:
        return _fill(text, _pages(bad)) if "%s" in text else _text(text)

    return _result(check_id, ok, _case((ok, _text(passed_text)), otherwise=shown(message)),
                   _case((f"not {ok}", shown(details))), pages=_case((f"not {ok}", bad)))


def _style(th: R.Thresholds) -> str:
    ok = f"coalesce(roman_share >= {th.min_roman_share}D, true)"
    return _result(
        "FMT-008", ok,
        _case((ok, _text("Font style appears to be plain roman.")),
              otherwise=_text("Primary body font may not be plain roman style.")),
        _case((f"not {ok}", _fill(
            "Only %.0f%% of text spans are plain roman. Most common style: %s (%d/%d spans).",
            "roman_share * 100D", "dominant_style",
            "case dominant_style when 'italic' then italic_spans when 'bold' then bold_spans "
            "when 'bold-italic' then bold_italic_spans else roman_spans end", "style_spans"))))


def _spacing(th: R.Thresholds) -> str:
    ok = f"coalesce(body_spacing >= {th.min_double_space_pt}D, true)"
    return _result(
        "FMT-009", ok,
        _case(("body_spacing is null",
               _text("Unable to measure line spacing; assumed compliant.")),
              (ok, _fill("Body text appears double-spaced (median: %.1fpt).", "body_spacing")),
              otherwise=_fill("Body text appears single-spaced (median spacing: %.1fpt).",
                              "body_spacing")),
        _case((f"not {ok}", _fill(
            "Double spacing requires ~24pt between baselines for 12pt text. "
            "Median detected: %.1fpt.", "body_spacing"))))


def _starts_at_one() -> str:
    """Left out for a document without pages."""
    space = _text(X.WHITESPACE)
    ok = (f"coalesce(btrim(btrim(btrim(cover_number, {space}), '-–—'), {space}) = '1', false)")
    return _result(
        "FMT-012", ok,
        _case((ok, _text('Page numbering starts with "1" on the cover.')),
              otherwise=_text('Cover page number is not "1" or not detected.')),
        _case((f"not {ok}", _fill("Detected cover page number: %s.",
                                  "coalesce(concat('\\'', cover_number, '\\''), 'None')"))))


def _page_limit() -> str:
    known, ok = "page_limit is not null", "coalesce(body_pages <= page_limit, true)"
    return _result(
        "PG-001", ok,
        _case(("page_limit is null", _text("Brief type unknown; page limit not checked.")),
              (ok, _fill("Brief is %d pages (limit: %d).", "body_pages", "page_limit")),
              otherwise=_fill("%s brief is %d pages; limit is %d.",
                              "replace(initcap(replace(brief_type, '_', ' ')), ' ', '_')",
                              "body_pages", "page_limit")),
        _case((f"not {ok}", _fill(
            "Body pages (excluding addendum): %d. Addendum starts at page %s.", "body_pages",
            "coalesce(string(addendum_start + 1), 'N/A')"))),
        applicable=known, check_id="coalesce(limit_check_id, 'PG-001')",
        rule="coalesce(limit_rule, '32(a)(8)')")


def _cover_color() -> str:
    rehearing = "brief_type = 'petition_rehearing'"
    known = f"({rehearing} or cover_color is not null)"
    return _result(
        "COV-001", "true",
        _case((rehearing, _text(
            "Petition for rehearing cover must be the same color as the petitioning party's "
            "principal brief. Cannot verify from PDF; manual check required.")),
            ("cover_color is not null", _fill(
                "Cover color should be %s for %s brief. Cannot verify from PDF; manual check "
                "required.", "cover_color", "brief_type")),
            otherwise=_text("Cover color check not applicable (unknown brief type).")),
        _case((known, _text("The physical cover color cannot be read from the layout."))),
        applicable=known)


def _oral_argument() -> str:
    rehearing = "brief_type = 'petition_rehearing'"
    ok = f"({rehearing} or asks_oral_argument)"
    return _result(
        "COV-002", ok,
        _case((rehearing, _text("Not applicable — oral argument is not permitted on petitions "
                                "for rehearing.")),
              (ok, _text("Cover includes oral argument request notation.")),
              otherwise=_text("No 'ORAL ARGUMENT REQUESTED' found on cover page.")),
        _case((f"not {ok}", _text(
            "Rule 28(h) requires 'ORAL ARGUMENT REQUESTED' on the cover; without a request "
            "under Rule 34(a)(1)(C) oral argument is generally not scheduled."))),
        applicable=f"not ({rehearing})",
        rule=f"if({rehearing}, '40(a)(2)', '28(h)/34(a)(1)(C)')")


def _paragraphs(th: R.Thresholds) -> str:
    least = th.min_paragraph_marks
    ok = f"(bracket_marks >= {least} or paragraph_marks >= {least})"
    return _result(
        "CNT-004", ok,
        _case((ok, _text("Paragraphs appear to use arabic numeral numbering.")),
              otherwise=_text("Paragraph numbering with arabic numerals not detected.")),
        _case((f"not {ok}", _fill(
            "Rule 32(a)(7) requires paragraphs to be numbered with arabic numerals. Found %d "
            "bracket-number patterns and %d paragraph-symbol patterns.", "bracket_marks",
            "paragraph_marks"))))


def _certificate() -> str:
    return _result(
        "SEC-013", "has_certificate",
        _case(("has_certificate", _text("Certificate of Compliance found.")),
              otherwise=_text("Certificate of Compliance not found.")),
        _case(("not has_certificate", _text("Rule 32(d) requires a Certificate of Compliance."))))


def _record_cites() -> str:
    asked = "brief_type in ('appellant', 'appellee', 'cross_appeal')"
    ok = f"(not {asked} or record_cites > 0)"
    return _result(
        "REC-001", ok,
        _case((f"not {asked}", _fill("Not applicable to %s briefs.", "brief_type")),
              (ok, _fill("Found %d record citation(s) in (R#:#) format.", "record_cites")),
              otherwise=_text("No record citations in (R#:#) format detected.")),
        _case((f"not {ok}", _text(
            "Rule 30(a) requires references to the record with register of actions index "
            "numbers, in the (R{index}:{page}) format of Rule 30(b)(1)."))),
        applicable=asked)


def _neutral_cites(th: R.Thresholds) -> str:
    ok, n = "size(missing_cites) = 0", th.citation_examples
    examples = (f"concat(array_join(slice(missing_cites, 1, {n}), '; '), "
                f"if(size(missing_cites) > {n}, concat(' (and ', size(missing_cites) - {n}, "
                "' more)'), ''))")
    return _result(
        "CIT-001", ok,
        _case(("reporter_cites = 0", _text("No N.W.2d citations found to check.")),
              (ok, _fill("All %d N.W.2d citation(s) have accompanying medium-neutral cites.",
                         "reporter_cites")),
              otherwise=_fill("%d of %d N.W.2d citation(s) lack a nearby medium-neutral cite.",
                              "size(missing_cites)", "reporter_cites")),
        _case((f"not {ok}", _fill(
            "N.D.R.Ct. 11.6(b) requires the medium-neutral citation (YYYY ND ##) for opinions "
            "since 1997. Citations without one nearby: %s. Earlier cases need none; verify "
            "manually.", examples))),
        items=_case((f"not {ok}", "missing_cites")))


def _rehearing_words(th: R.Thresholds) -> str:
    """PG-004, opt-in: declared by the rules but not part of parity results."""
    asked, limit = "brief_type = 'petition_rehearing'", th.amicus_rehearing_words
    return _result(
        "PG-004", f"(not ({asked}) or word_count <= {limit})",
        _fill(f"%d words (limit: {limit}).", "word_count"), applicable=asked,
        name="'Rehearing Word Limit'", rule="'29(b)(4)'", severity="'reject'")


def result_array(th: R.Thresholds = R.DEFAULTS, word_limit: bool = False,
                 only: set[str] | None = None, fields: list[str] | None = None) -> Column:
    """The results of a document as an array, in catalogue order.

    ``fields`` names those to make: of an array that is unfolded Spark would not leave out
    the others, so messages and page lists would be written for nobody.
    """
    rows = {
        "FMT-001": _paper(th),
        "FMT-002": _margin("FMT-002", "left", '1.5"'),
        "FMT-003": _margin("FMT-003", "right", '1"'),
        "FMT-004": _margin("FMT-004", "top", '1"'),
        "FMT-005": _margin("FMT-005", "bottom", '1"'),
        "FMT-006": _font_size(th),
        "FMT-007": _page_check("FMT-007", "Character density within 16 characters per inch.",
                               "Some lines may exceed 16 characters per inch.",
                               "High character density detected on pages: %s."),
        "FMT-008": _style(th),
        "FMT-009": _spacing(th),
        "FMT-010": _result("FMT-010", "true", _text(
            "Footnote spacing not automatically verified; manual review recommended."),
            _text("Layout extraction cannot reliably distinguish footnotes from body text.")),
        "FMT-011": _page_check("FMT-011", "All pages have bottom page numbers.",
                               "Pages without bottom page numbers: %s.",
                               "Rule 32(a)(4) requires pages to be numbered at the bottom."),
        "FMT-012": _starts_at_one(),
        "PG-001": _page_limit(),
        "COV-001": _cover_color(),
        "COV-002": _oral_argument(),
        "CNT-004": _paragraphs(th),
        "SEC-013": _certificate(),
        "REC-001": _record_cites(),
        "CIT-001": _neutral_cites(th),
    }
    if word_limit:
        rows["PG-004"] = _rehearing_words(th)
    # The page limit of a document goes by one of several ids.
    limits = {row[2] for row in R.PAGE_LIMITS}
    wanted = [key for key in rows if only is None or key in only
              or (key == "PG-001" and only & limits)]
    # Of documents without pages there is no cover that could be numbered.
    present = {"FMT-012": "total_pages > 0"}

    def made(key: str) -> Column:
        row = F.expr(rows[key])
        if fields is not None:
            row = F.struct(*[row[name].alias(name) for name in fields])
        return F.when(F.expr(present[key]), row) if key in present else row

    return F.filter(F.array(*[made(key) for key in wanted]), lambda r: r.isNotNull())


def results_of(facts: DataFrame, th: R.Thresholds = R.DEFAULTS, word_limit: bool = False,
               only: set[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Document facts to one row per document and check; of its columns all, or those of ``columns``, are made."""
    columns = columns or S.RESULT_COLUMNS
    fields = [c for c in S.RESULT_COLUMNS if c != "doc_id" and (c in columns or c == "check_id")]
    rows = facts.select("doc_id", F.explode(result_array(th, word_limit, only, fields)).alias("r")).select(
        "doc_id", *[f"r.{c}" for c in fields])
    return (rows if only is None else rows.filter(F.col("check_id").isin(sorted(only)))).select(*columns)


def with_results(facts: DataFrame, th: R.Thresholds = R.DEFAULTS, word_limit: bool = False) -> DataFrame:
    """Document facts with the results of each document in an array ``results``."""
    return facts.withColumn("results", result_array(th, word_limit))


def mechanical_checks(docs: DataFrame, pages: DataFrame, spans: DataFrame,
                      th: R.Thresholds = R.DEFAULTS, stage: Stage = inline,
                      word_limit: bool = False, only: set[str] | None = None) -> DataFrame:
    """All deterministic checks: 19 rows per document, 18 without pages.

    With ``only``, just the named ones, reading just what they need.
    """
    return results_of(document_facts(docs, pages, spans, th, stage, only), th, word_limit, only)
