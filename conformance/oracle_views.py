"""The derived views and operator results stated in SQL for DuckDB.

``with_views(sql)`` puts the views that a statement names in front of it.
"""

from __future__ import annotations

import re

from conformance import views as V
from docketlens import rules as R
from docketlens.operators import evidence as E

# The characters that count as white space at the ends of a text.
WS = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(133)||chr(160)"


def q(text: str) -> str:
    """A SQL string literal; line breaks become chr(10)."""
    return "||chr(10)||".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


def hit(col: str, pattern: str, options: str = "") -> str:
    flags = f"(?{options})" if options else ""
    return f"regexp_matches({col}, {q(flags + pattern)})"


def hits(col: str, patterns, options: str = "") -> str:
    return "(" + " OR ".join(hit(col, p, options) for p in patterns) + ")"


def count(col: str, pattern: str, options: str = "") -> str:
    flags = f"(?{options})" if options else ""
    return f"cast(len(regexp_extract_all({col}, {q(flags + pattern)})) as bigint)"


def extract(col: str, pattern: str, group: int, options: str = "") -> str:
    flags = f"(?{options})" if options else ""
    return f"regexp_extract({col}, {q(flags + pattern)}, {group})"


def words(col: str) -> str:
    return count(col, r"[^\s\x1c-\x1f]+")


def _values(rows, names: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        return str(v) if isinstance(v, (int, float)) else q(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def _size() -> str:
    def step(m):
        return (f"CASE (doc_id * 31 + line_seq * 7 + s) % {m} WHEN 0 THEN 9.5 WHEN 2 THEN 11.7 "
                f"WHEN 3 THEN 13.0 ELSE 12.0 END")
    return (f"cast(CASE WHEN doc_id % 29 = 4 THEN 0.0 WHEN hd THEN 8.5 WHEN doc_id % 3 = 0 THEN 12.0 WHEN doc_id % 3 = 1 "
            f"THEN {step(997)} ELSE {step(23)} END AS double)")


def _origin(lop: str) -> str:
    return f"""CASE WHEN {lop} = 0 AND doc_id % 8 = 0 THEN cast(50 AS double) ELSE
        cast(120 AS double) + {lop} * CASE doc_id % 4 WHEN 0 THEN cast(14.4 AS double)
          WHEN 1 THEN cast(24 AS double) WHEN 2 THEN cast(28.8 AS double) ELSE cast(16.56 AS double) END END"""


_WIDTH = "cast(CASE WHEN doc_id % 13 = 0 AND page_no = 1 THEN 595 ELSE 612 END AS double)"


def _decorated() -> str:
    parts = []
    for cond, lines in V.DECORATIONS:
        text = "||".join("chr(10)||" + q(line) for line in lines).replace(
            "{x}", "'||repeat('x', cast(doc_id % 400 as bigint))||'")
        parts.append(f"CASE WHEN {cond} THEN {text} ELSE '' END")
    return "text || " + " || ".join(parts)


def _paged(source: str, column: str) -> str:
    return f"""SELECT doc_id, cast(line_seq // 5 AS int) AS page_no,
        string_agg(line_text, chr(10) ORDER BY line_seq) AS text
        FROM (SELECT doc_id, unnest(range(0, len(a))) AS line_seq, unnest(a) AS line_text
              FROM (SELECT doc_id, string_split({column}, chr(10)) AS a FROM {source}))
        GROUP BY 1, 2"""


def _classify(t: str) -> str:
    after = extract(t, R.BRIEF_OF, 2)
    before = extract(t, r"(\S+)\s+br[il1!|f]ef", 1)
    return f"""CASE
        WHEN {hits(t, R.REHEARING_PATTERNS)} THEN 'petition_rehearing'
        WHEN {hits(t, R.AMICUS_BRIEF_PATTERNS)} THEN 'amicus'
        WHEN {hits(t, R.REPLY_BRIEF_PATTERNS)} THEN 'reply'
        WHEN {hit(after, R.CROSS_PARTY)} THEN 'cross_appeal'
        WHEN {hit(after, R.APPELLEE_WORDS)} THEN 'appellee'
        WHEN {hit(after, R.APPELLANT_WORDS)} THEN 'appellant'
        WHEN {hit(before, R.APPELLEE_WORDS)} THEN 'appellee'
        WHEN {hit(before, R.APPELLANT_WORDS)} THEN 'appellant'
        WHEN {hits(t, R.STANDALONE_AMICUS_PATTERNS)} THEN 'amicus'
        WHEN {hit(t, R.CROSS_PARTY)} THEN 'cross_appeal'
        ELSE 'unknown' END"""


_LETTER = "regexp_matches({}, '^[a-zA-Z]$')"


def collapse(col: str) -> str:
    """Letter-spacing collapse over the list of characters."""
    def ch(i):
        return f"c[{i}]"
    def letter(i):
        return f"(({i}) >= 1 AND coalesce(regexp_matches(c[{i}], '^[a-zA-Z]$'), false))"
    def blank(i):
        return f"(({i}) >= 1 AND coalesce(c[{i}] = ' ', false))"
    drop = (f"(x = ' ' AND {letter('i-1')} AND {letter('i+1')} AND "
            f"(({blank('i-2')} AND {letter('i-3')}) OR ({blank('i+2')} AND {letter('i+3')})))")
    return f"""(SELECT replace(array_to_string(list_filter(c, lambda x, i: NOT {drop}), ''), chr(1), ' ')
        FROM (SELECT string_split(regexp_replace({col}, ' {{2,}}|\\t|\\n', chr(1), 'g'), '') AS c))"""


PN = r"^[-–—]?\s*(\d+|[ivxlcdmIVXLCDM]+)\s*[-–—]?$"

VIEWS: dict[str, str] = {
    "fx_lines": """SELECT doc_id, unnest(range(0, len(a))) AS line_seq, unnest(a) AS line_text
        FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)""",
    "fx_chunks": """SELECT *, (doc_id + line_seq) % 6 = 0 AND s = 0 AS hd FROM (
        SELECT doc_id, line_seq, line_text, cast(line_seq // 5 AS int) AS page_no,
               line_seq % 5 AS lop, unnest(range(0, cast(ceil(length(line_text) / 40.0) AS bigint))) AS s
        FROM fx_lines WHERE length(line_text) > 0)""",
    "fx_spans": f"""SELECT doc_id, page_no, {_WIDTH} AS width_pt, cast(792 AS double) AS height_pt,
        block_no, block_type, bx0, by0, bx1, by1, line_no, span_no, text, font, size, flags, origin_y
      FROM (
        SELECT doc_id, page_no, cast(lop // 2 AS int) AS block_no,
          CASE WHEN lop // 2 = 1 AND (doc_id + page_no) % 6 = 2 THEN 1 ELSE 0 END AS block_type,
          cast(108 - CASE WHEN doc_id % 9 = 0 THEN 20 ELSE 0 END AS double) AS bx0,
          first_y - 12 AS by0,
          cast(540 + CASE WHEN doc_id % 10 = 0 THEN 15 ELSE 0 END AS double) AS bx1,
          second_y + 3 AS by1, cast(lop % 2 AS int) AS line_no, cast(s AS int) AS span_no,
          CASE WHEN (doc_id * 7 + line_seq) % 11 = 4 THEN '  ' WHEN hd THEN 'STATEMENT OF THE CASE' ELSE substring(line_text, 40 * s + 1, 40) END AS text,
          CASE WHEN doc_id % 5 <> 4 THEN 'Times' ELSE 'Arial' END AS font, {_size()} AS size,
          cast(CASE WHEN (doc_id + line_seq + s) % 17 = 0 THEN 1 ELSE 0 END
            + CASE WHEN doc_id % 7 = 0 OR s % 5 = 4 THEN 2 ELSE 0 END
            + CASE WHEN doc_id % 11 = 0 THEN 16 ELSE 0 END AS int) AS flags, origin_y
        FROM (SELECT *, {_origin('lop')} AS origin_y, {_origin('(lop // 2 * 2)')} AS first_y,
                {_origin('(lop // 2 * 2 + 1)')} AS second_y FROM fx_chunks)
        UNION ALL
        SELECT doc_id, page_no, 9, 0, 300, 748, 312, 763, 0, 0,
          CASE WHEN doc_id % 6 = 1 THEN '- ' || (page_no + 1) || ' -' ELSE cast(page_no + 1 AS varchar) END,
          'Times', 10, 0, 760
        FROM (SELECT DISTINCT doc_id, cast(line_seq // 5 AS int) AS page_no FROM fx_lines)
        WHERE doc_id % 5 <> 0)""",
    "fx_pages": f"""SELECT doc_id, page_no, {_WIDTH} AS width_pt, cast(792 AS double) AS height_pt,
        CASE WHEN doc_id % 20 = 0 AND page_no = 2 THEN 'Addendum' || chr(10) || text ELSE text END AS text
        FROM ({_paged('documents', 'text')})""",
    "fx_docs": f"""SELECT doc_id, 'doc-' || doc_id || '.pdf' AS path,
        ({"[" + ", ".join(q(c) for c in V.COVERS) + "]"})[doc_id % {len(V.COVERS)} + 1]
        || CASE WHEN doc_id % 3 = 0 THEN ' oral argument requested' ELSE '' END AS cover_text,
        {_decorated()} AS full_text FROM documents""",
    "fx_dpages": _paged("fx_docs", "full_text"),
    "fx_html": """SELECT page_id, 'rule-' || (page_id % 9) AS rule, html || CASE page_id % 4
        WHEN 0 THEN '<p>Effective Date: ' || (1 + page_id % 12) || '/1/' || (2020 + page_id % 6) || '</p>'
        WHEN 1 THEN '<p>Effective Date: 13/45/2020</p>' ELSE '' END AS html FROM pages""",
    "fx_captions": """SELECT doc_id, 'STATE COURT' || chr(10)
        || CASE WHEN doc_id % 4 <> 3 THEN 'Supreme Court No. ' || (20240000 + doc_id % 10000) || chr(10) ELSE '' END
        || CASE WHEN doc_id % 3 <> 2 THEN chr(10) || 'Jane Roe' || CASE WHEN doc_id % 2 = 0 THEN ',' ELSE '' END
             || chr(10) || 'Plaintiff and Appellee,' || chr(10) || 'vs.' || chr(10) || 'John Q. Doe,' || chr(10) ELSE '' END
        || CASE WHEN doc_id % 5 = 0 THEN 'AMENDED ' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN 'REPLY ' ELSE '' END
        || CASE WHEN doc_id % 6 <> 5 THEN 'BRIEF OF DEFENDANT-APPELLANT,' ELSE 'MOTION' END
        || chr(10) || 'Filed' AS cover_text,
        'in/' || (20990000 + doc_id) || '_Roe-v-Doe-' || doc_id || '_Apt-Br.pdf' AS path FROM documents""",
    "dim_catalog": _values(
        [(i, r[0], r[1], r[2], ",".join(r[3]) if r[3] else None, r[4], r[5])
         for i, r in enumerate(R.CHECK_CATALOG, start=1)],
        "check_no, check_id, name, rule, types, severity, description"),
    "dim_combine": _values(list(R.COMBINE_PARTS.items()), "check_id, combine"),
    "dim_limits": _values(R.PAGE_LIMITS, "brief_type, page_limit, limit_check_id, limit_rule"),
    "dim_colors": _values(R.COVER_COLORS, "brief_type, cover_color"),
    "fx_judged": """SELECT * FROM (
        SELECT d.doc_id, c.check_no, c.check_id, (d.doc_id + c.check_no) % 7 <> 0 AS passed,
          CASE WHEN (d.doc_id + c.check_no) % 11 = 0 THEN '28(z)' WHEN (d.doc_id + c.check_no) % 13 = 0 THEN ''
               ELSE c.rule END AS rule, 'seen ' || c.check_id AS message
        FROM documents d CROSS JOIN dim_catalog c WHERE (d.doc_id + c.check_no) % 5 <> 0
        UNION ALL SELECT doc_id, 99, 'ZZZ-999', false, '1', 'unknown' FROM documents)""",
    "fx_judged_parts": """SELECT doc_id, check_no, check_id, rule, part_no, (doc_id + check_no + part_no * 2) % 3 <> 0 AS passed,
        'seen ' || check_id || ' in ' || part_no AS message
        FROM (SELECT *, unnest([1, 2, 3]) AS part_no FROM fx_judged) WHERE (doc_id + check_no * 3 + part_no) % 4 <> 0""",
    # Every line of the decorated pages with the last heading line at or before it.
    "v_section_lines": f"""SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'none') AS section FROM (
        SELECT doc_id, line_seq, line_seq // 5 AS page_no, line, CASE {' '.join(
            f"WHEN {hit('trim(line, ' + WS + ')', f'^(?:{p})' + chr(92) + 's*:?$', 'i')} THEN '{n}'" for n, p in E.HEADING_LINES.items())} END AS heading
        FROM (SELECT doc_id, unnest(range(0, len(a))) AS line_seq, unnest(a) AS line
          FROM (SELECT doc_id, string_split(full_text, chr(10)) AS a FROM fx_docs)))""",
    # ---- operator results --------------------------------------------------
    "v_types": f"SELECT doc_id, {_classify('cover_text')} AS brief_type FROM fx_docs",
    "v_vis": f"""SELECT *, length(text) AS chars FROM (
        SELECT * REPLACE (trim(text, {WS}) AS text) FROM fx_spans WHERE block_type = 0) WHERE text <> ''""",
    "v_bottom": f"""SELECT doc_id, page_no, block_no, min(bx0) AS bx0, min(by0) AS by0, max(bx1) AS bx1,
        max(by1) AS by1, trim(string_agg(text, '' ORDER BY line_no, span_no), {WS}) AS label,
        {hit("trim(string_agg(text, '' ORDER BY line_no, span_no), " + WS + ")", PN)} AS is_pn
        FROM fx_spans WHERE block_type = 0 AND by0 >= height_pt * cast(0.9 AS double) GROUP BY 1, 2, 3""",
    "v_pn": """SELECT doc_id, page_no, arg_min(label, block_no) AS page_number_text
        FROM v_bottom WHERE is_pn GROUP BY 1, 2""",
    "v_box": """SELECT doc_id, page_no, min(bx0) AS x0, min(by0) AS y0, max(bx1) AS x1, max(by1) AS y1 FROM (
        SELECT s.* FROM fx_spans s LEFT JOIN (SELECT * FROM v_bottom WHERE is_pn) b
          ON s.doc_id = b.doc_id AND s.page_no = b.page_no AND s.block_no = b.block_no
        WHERE s.block_type = 0 AND b.doc_id IS NULL) GROUP BY 1, 2""",
    "v_margins": """SELECT p.doc_id, p.page_no,
        CASE WHEN x1 > x0 AND y1 > y0 THEN x0 ELSE width_pt END / 72 AS left_in,
        CASE WHEN x1 > x0 AND y1 > y0 THEN width_pt - x1 ELSE width_pt END / 72 AS right_in,
        CASE WHEN x1 > x0 AND y1 > y0 THEN y0 ELSE height_pt END / 72 AS top_in,
        CASE WHEN x1 > x0 AND y1 > y0 THEN height_pt - y1 ELSE height_pt END / 72 AS bottom_in
        FROM fx_pages p LEFT JOIN v_box b ON p.doc_id = b.doc_id AND p.page_no = b.page_no""",
    "v_gaps": f"""SELECT * FROM (
        SELECT doc_id, page_no, block_no, line_no,
          y - lag(y) OVER (PARTITION BY doc_id, page_no ORDER BY block_no, line_no) AS gap FROM (
          SELECT doc_id, page_no, block_no, line_no,
            min(origin_y) FILTER (trim(text, {WS}) <> '') AS y
          FROM fx_spans WHERE block_type = 0 GROUP BY 1, 2, 3, 4)) WHERE gap > 8 AND gap < 60""",
    "v_spacing": "SELECT doc_id, page_no, median(gap) AS line_spacing FROM v_gaps GROUP BY 1, 2",
    "v_hist": """SELECT doc_id, page_no, font, size, style, position_class, count(*) AS spans,
          sum(chars) AS chars, min(pos) AS first_pos FROM (
        SELECT *, CASE WHEN flags & 2 <> 0 AND flags & 16 <> 0 THEN 'bold-italic' WHEN flags & 2 <> 0 THEN 'italic'
            WHEN flags & 16 <> 0 THEN 'bold' ELSE 'roman' END AS style,
          CASE WHEN origin_y <= height_pt * cast(0.1 AS double) OR origin_y >= height_pt * cast(0.9 AS double)
                 THEN 'header_footer'
               WHEN flags & 1 <> 0 OR (chars <= 4 AND size < cast(11.7 AS double)) THEN 'superscript'
               WHEN regexp_matches(text, '\\p{L}') AND NOT regexp_matches(text, '[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]')
                 THEN 'capitals' ELSE 'body' END AS position_class,
          (page_no, block_no, line_no, span_no) AS pos FROM v_vis) GROUP BY 1, 2, 3, 4, 5, 6""",
    # A document without a positive size has no body size, yet has its fonts.
    "v_fontstats": """SELECT b.doc_id, a.predominant_font_size, b.predominant_font, c.min_font_size FROM (
          SELECT doc_id, arg_min(font, (-n, first_pos)) AS predominant_font FROM (
          SELECT doc_id, font, sum(spans) AS n, min(first_pos) AS first_pos FROM v_hist GROUP BY 1, 2)
          GROUP BY 1) b
        LEFT JOIN (SELECT doc_id, arg_min(size10, (-n, first_pos)) AS predominant_font_size FROM (
          SELECT doc_id, round(size, 1) AS size10, sum(spans) AS n, min(first_pos) AS first_pos
          FROM v_hist WHERE size > 0 GROUP BY 1, 2) GROUP BY 1) a ON a.doc_id = b.doc_id
        LEFT JOIN (SELECT doc_id, min(size) AS min_font_size FROM v_hist WHERE size > 0 GROUP BY 1) c
          ON b.doc_id = c.doc_id""",
    "v_counts": """SELECT * FROM (SELECT doc_id, page_no, sum(chars) AS total_chars,
          coalesce(sum(chars) FILTER (small AND kind = 'body'), 0) AS body_chars,
          coalesce(sum(chars) FILTER (small AND kind = 'header_footer'), 0) AS header_footer_chars,
          coalesce(sum(chars) FILTER (small AND kind = 'superscript'), 0) AS superscript_chars,
          coalesce(sum(chars) FILTER (small AND kind = 'small_caps'), 0) AS small_caps_chars,
          min(size) FILTER (small) AS min_small_size FROM (
        SELECT h.doc_id, page_no, size, chars, size < cast(11.7 AS double) AS small,
          CASE WHEN position_class <> 'capitals' THEN position_class
               WHEN predominant_font_size > 0 AND size / predominant_font_size >= cast(0.55 AS double)
                    AND size / predominant_font_size <= cast(0.85 AS double) THEN 'small_caps'
               ELSE 'body' END AS kind
        FROM v_hist h JOIN v_fontstats f ON h.doc_id = f.doc_id) GROUP BY 1, 2)
        WHERE body_chars + header_footer_chars + superscript_chars + small_caps_chars > 0""",
    "v_conv": f"""SELECT doc_id, page_no, page_no = 0 OR {hits('text', R.SMALL_CAPS_PAGE_PATTERNS, 'i')} AS conventional
        FROM fx_pages""",
    "v_moved": """SELECT c.* REPLACE (
          body_chars + CASE WHEN moved THEN small_caps_chars ELSE 0 END AS body_chars,
          CASE WHEN moved THEN 0 ELSE small_caps_chars END AS small_caps_chars) FROM (
        SELECT c.*, NOT v.conventional AND small_caps_chars > 0
            AND small_caps_chars / total_chars * 100 > 15 AS moved
        FROM v_counts c JOIN v_conv v ON c.doc_id = v.doc_id AND c.page_no = v.page_no) c""",
    "v_pagerows": f"""SELECT p.doc_id, p.page_no, p.width_pt / 72 AS width_in, p.height_pt / 72 AS height_in,
          m.left_in, m.right_in, m.top_in, m.bottom_in, s.line_spacing, n.page_number_text,
          trim(p.text, {WS}) <> '' AS has_text, {hit('p.text', R.ADDENDUM_LINE, 'im')} AS has_addendum,
          (SELECT max(length(trim(x, {WS}))) FROM unnest(string_split(p.text, chr(10))) AS u(x)
           WHERE length(trim(x, {WS})) >= 10) AS max_line_chars
        FROM fx_pages p JOIN v_margins m ON p.doc_id = m.doc_id AND p.page_no = m.page_no
        LEFT JOIN v_spacing s ON p.doc_id = s.doc_id AND p.page_no = s.page_no
        LEFT JOIN v_pn n ON p.doc_id = n.doc_id AND p.page_no = n.page_no""",
    "v_pagecounts": """SELECT doc_id, count(*) AS total_pages,
        min(page_no) FILTER (has_addendum) AS addendum_start,
        coalesce(min(page_no) FILTER (has_addendum), count(*)) AS body_pages
        FROM v_pagerows GROUP BY 1""",
    "v_style": """SELECT m.*, d.dominant_style, roman_spans / style_spans AS roman_share FROM (
        SELECT doc_id, sum(spans) AS style_spans,
          coalesce(sum(spans) FILTER (style = 'roman'), 0) AS roman_spans,
          coalesce(sum(spans) FILTER (style = 'italic'), 0) AS italic_spans,
          coalesce(sum(spans) FILTER (style = 'bold'), 0) AS bold_spans,
          coalesce(sum(spans) FILTER (style = 'bold-italic'), 0) AS bold_italic_spans
        FROM v_hist WHERE page_no > 0 GROUP BY 1) m JOIN (
        SELECT doc_id, arg_min(style, (-n, first_pos)) AS dominant_style FROM (
          SELECT doc_id, style, sum(spans) AS n, min(first_pos) AS first_pos FROM v_hist
          WHERE page_no > 0 GROUP BY 1, 2) GROUP BY 1) d ON m.doc_id = d.doc_id""",
    "v_reporter": f"""SELECT doc_id, full_text, hit, pos, len(pre) AS skipped,
          coalesce(list_sum(list_transform(pieces[1:pos], lambda x: length(x))), 0)
          + coalesce(list_sum(list_transform(found[1:pos - 1], lambda x: length(x))), 0) AS start
        FROM (SELECT doc_id, full_text, found, pieces, [] AS pre, unnest(found) AS hit,
                unnest(range(1, len(found) + 1)) AS pos
          FROM (SELECT doc_id, full_text, regexp_extract_all(full_text, {q(R.REPORTER_CITE)}) AS found,
                  string_split_regex(full_text, {q(R.REPORTER_CITE)}) AS pieces FROM fx_docs))""",
    "v_missing": f"""SELECT doc_id, pos, start, hit FROM v_reporter WHERE NOT {hit(
        "substring(full_text, cast(greatest(start - 200, 0) + 1 AS bigint), "
        "cast(start + length(hit) + 200 - greatest(start - 200, 0) AS bigint))", R.NEUTRAL_CITE)}""",
    "v_cites": """SELECT d.doc_id, coalesce(r.n, 0) AS reporter_cites, coalesce(m.n, 0) AS missing_cites FROM fx_docs d
        LEFT JOIN (SELECT doc_id, count(*) AS n FROM v_reporter GROUP BY 1) r ON d.doc_id = r.doc_id
        LEFT JOIN (SELECT doc_id, count(*) AS n FROM v_missing GROUP BY 1) m ON d.doc_id = m.doc_id""",
    "v_bad": """SELECT doc_id, check_id, string_agg(cast(page_no + 1 AS varchar), ',' ORDER BY page_no) AS pages FROM (
        SELECT doc_id, page_no, unnest([
          CASE WHEN abs(width_in - 8.5) > cast(0.1 AS double) OR abs(height_in - 11) > cast(0.1 AS double) THEN 'FMT-001' END,
          CASE WHEN left_in < cast(1.5 AS double) - cast(0.05 AS double) THEN 'FMT-002' END,
          CASE WHEN right_in < cast(1.0 AS double) - cast(0.05 AS double) THEN 'FMT-003' END,
          CASE WHEN top_in < cast(1.0 AS double) - cast(0.05 AS double) THEN 'FMT-004' END,
          CASE WHEN bottom_in < cast(1.0 AS double) - cast(0.05 AS double) THEN 'FMT-005' END,
          CASE WHEN page_no > 0 AND width_in - left_in - right_in > 0
               AND max_line_chars / (width_in - left_in - right_in) > 16 THEN 'FMT-007' END,
          CASE WHEN page_number_text IS NULL AND has_text THEN 'FMT-011' END]) AS check_id
        FROM v_pagerows) WHERE check_id IS NOT NULL GROUP BY 1, 2""",
    "v_fontdocs": """SELECT doc_id, sum(body_chars) AS body, max(body_chars) AS worst, sum(small_caps_chars) AS caps,
        string_agg(cast(page_no + 1 AS varchar), ',' ORDER BY page_no) FILTER (body_chars > 0) AS pages
        FROM v_moved GROUP BY 1""",
    "v_results": f"""SELECT doc_id, check_id, rule, passed, severity, applicable,
          CASE WHEN passed THEN '' ELSE coalesce(pages, '') END AS pages FROM (
        SELECT d.doc_id, c.check_id, c.rule, b.pages IS NULL AS passed, c.severity, true AS applicable, b.pages
        FROM fx_docs d CROSS JOIN ({_values(
            [(r[0], r[2], r[3]) for r in R.MECHANICAL_CHECKS
             if r[0] in ('FMT-001', 'FMT-002', 'FMT-003', 'FMT-004', 'FMT-005', 'FMT-007', 'FMT-011')],
            'check_id, rule, severity')}) c
        LEFT JOIN v_bad b ON d.doc_id = b.doc_id AND c.check_id = b.check_id
        UNION ALL SELECT d.doc_id, 'FMT-006', '32(a)(5)', coalesce(f.body, 0) = 0,
          CASE WHEN coalesce(f.body, 0) = 0 OR f.worst >= 10 THEN 'reject' ELSE 'note' END, true, f.pages
        FROM fx_docs d LEFT JOIN v_fontdocs f ON d.doc_id = f.doc_id
        UNION ALL SELECT d.doc_id, 'FMT-008', '32(a)(6)', coalesce(s.roman_share >= 0.5, true), 'note', true, NULL
        FROM fx_docs d LEFT JOIN v_style s ON d.doc_id = s.doc_id
        UNION ALL SELECT d.doc_id, 'FMT-009', '32(a)(5)', coalesce(s.m >= 20, true), 'correction', true, NULL
        FROM fx_docs d LEFT JOIN (SELECT doc_id, median(line_spacing) FILTER (page_no > 0) AS m
          FROM v_spacing GROUP BY 1) s ON d.doc_id = s.doc_id
        UNION ALL SELECT doc_id, 'FMT-010', '32(a)(5)', true, 'note', true, NULL FROM fx_docs
        UNION ALL SELECT p.doc_id, 'FMT-012', '32(a)(4)',
          coalesce(trim(trim(trim(page_number_text, {WS}), '-–—'), {WS}) = '1', false), 'note', true, NULL
        FROM v_pagerows p WHERE page_no = 0
        UNION ALL SELECT t.doc_id, coalesce(l.limit_check_id, 'PG-001'), coalesce(l.limit_rule, '32(a)(8)'),
          coalesce(c.body_pages <= l.page_limit, true), 'reject', l.page_limit IS NOT NULL, NULL
        FROM v_types t JOIN v_pagecounts c ON t.doc_id = c.doc_id LEFT JOIN dim_limits l ON t.brief_type = l.brief_type
        UNION ALL SELECT doc_id, 'COV-001', '32(a)(2)', true, 'correction', brief_type <> 'unknown', NULL FROM v_types
        UNION ALL SELECT t.doc_id, 'COV-002',
          CASE WHEN brief_type = 'petition_rehearing' THEN '40(a)(2)' ELSE '28(h)/34(a)(1)(C)' END,
          brief_type = 'petition_rehearing' OR contains(upper(cover_text), 'ORAL ARGUMENT'), 'note',
          brief_type <> 'petition_rehearing', NULL FROM v_types t JOIN fx_docs d ON t.doc_id = d.doc_id
        UNION ALL SELECT doc_id, 'CNT-004', '32(a)(7)', {count('full_text', R.BRACKET_MARK)} >= 3
          OR {count('full_text', R.PARAGRAPH_MARK)} >= 3, 'correction', true, NULL FROM fx_docs
        UNION ALL SELECT doc_id, 'SEC-013', '32(d)', {hit('full_text', 'certificate\\s+of\\s+compliance', 'i')},
          'correction', true, NULL FROM fx_docs
        UNION ALL SELECT t.doc_id, 'REC-001', '30(a)',
          brief_type NOT IN ('appellant', 'appellee', 'cross_appeal') OR {hit('full_text', R.RECORD_CITE)}, 'note',
          brief_type IN ('appellant', 'appellee', 'cross_appeal'), NULL FROM v_types t JOIN fx_docs d ON t.doc_id = d.doc_id
        UNION ALL SELECT doc_id, 'CIT-001', 'N.D.R.Ct. 11.6(b)', missing_cites = 0, 'correction', true, NULL FROM v_cites)""",
    "v_names": _values([(r[0], r[1]) for r in R.MECHANICAL_CHECKS]
                       + [(c, "Page Limit") for c in ("PG-002", "PG-003", "PG-005")],
                       "check_id, name"),
    "v_verdict": """SELECT doc_id, CASE w WHEN 2 THEN 'reject' WHEN 1 THEN 'correction_letter' ELSE 'accept' END AS recommendation,
          total_checks, failed_checks, passed_checks, coalesce(failed_ids, '') AS failed_ids FROM (
        SELECT doc_id, max(CASE severity WHEN 'reject' THEN 2 WHEN 'correction' THEN 1 ELSE 0 END)
            FILTER (NOT passed AND applicable) AS w,
          count(*) AS total_checks, count(*) FILTER (NOT passed AND applicable) AS failed_checks,
          count(*) FILTER (passed AND applicable) AS passed_checks,
          string_agg(check_id, ',' ORDER BY check_id) FILTER (NOT passed AND applicable) AS failed_ids
        FROM v_results GROUP BY 1)""",
    "v_asked": """SELECT t.doc_id, t.brief_type, c.check_no, c.check_id, c.name, c.rule, c.severity, c.types IS NULL
        OR list_contains(string_split(c.types, ','), t.brief_type) AS applicable FROM v_types t CROSS JOIN dim_catalog c""",
    "v_merged": """SELECT a.doc_id, a.check_id, a.name, a.severity,
        CASE WHEN coalesce(j.rule, '') = '' THEN a.rule ELSE j.rule END AS rule, coalesce(j.passed, true) AS passed,
        coalesce(j.message, 'Not evaluated by AI analysis; manual review recommended.') AS message,
        j.doc_id IS NOT NULL AS evaluated
        FROM v_asked a LEFT JOIN fx_judged j ON a.doc_id = j.doc_id AND a.check_id = j.check_id WHERE a.applicable""",
    "v_joined": """SELECT j.doc_id, j.check_id, c.combine,
        CASE WHEN c.combine = 'any' THEN bool_or(passed) ELSE bool_and(passed) END AS ok,
        CASE WHEN ok THEN arg_min(rule, part_no) FILTER (passed) ELSE arg_min(rule, part_no) FILTER (NOT passed) END AS rule,
        CASE WHEN ok THEN arg_min(message, part_no) FILTER (passed)
             WHEN c.combine = 'worst' AND count(*) FILTER (NOT passed) > 1
               THEN string_agg('part ' || part_no || ': ' || message, '; ' ORDER BY part_no) FILTER (NOT passed)
             ELSE arg_min(message, part_no) FILTER (NOT passed) END AS message
        FROM fx_judged_parts j LEFT JOIN dim_combine c ON j.check_id = c.check_id
        WHERE NOT (j.doc_id % 50 = 2 AND j.part_no = 2) GROUP BY 1, 2, 3""",
    "v_merged_parts": """SELECT a.doc_id, a.check_id, a.severity,
        CASE WHEN coalesce(j.rule, '') = '' THEN a.rule ELSE j.rule END AS rule, coalesce(j.ok, true) AS passed,
        coalesce(j.message, CASE WHEN a.doc_id % 50 = 2 THEN 'AI analysis unavailable: the answer holds no JSON array.'
          ELSE 'Not evaluated by AI analysis; manual review recommended.' END) AS message, j.doc_id IS NOT NULL AS evaluated
        FROM v_asked a LEFT JOIN v_joined j ON a.doc_id = j.doc_id AND a.check_id = j.check_id WHERE a.applicable""",
    "v_all": """SELECT doc_id, check_id, passed, severity, applicable FROM v_results
        UNION ALL SELECT doc_id, check_id, passed, severity, true FROM v_merged
        UNION ALL SELECT doc_id, check_id, true, severity, false FROM v_asked WHERE NOT applicable""",
}


def with_views(sql: str, changed: dict[str, str] | None = None) -> str:
    """The statement with every view it needs, in dependency order; ``changed`` replaces views."""
    order: list[str] = []
    known = VIEWS | (changed or {})

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b(?:fx|v|dim)_\w+", text)):
            if name in known and name not in order:
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    views = ",\n".join(f"{name} AS ({known[name]})" for name in order)
    return f"WITH {views}\n{sql}"
