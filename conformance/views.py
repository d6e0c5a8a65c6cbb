"""Input views derived from the given tables: layout, spans, pages, documents.

Each view is a formula over whole tables (no sampling, no row limits), and
``oracle_views`` states the same formulas for DuckDB.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlens import rules as R
from docketlens.operators.catalog import docs_by_checks

LINES_PER_PAGE = 5
CHUNK = 40


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared place the cluster names; one of its own in a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/conformance-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_files(files: DataFrame, folder: str) -> None:
    """A file for each row (path under ``folder``, text), written by the tasks that hold the rows.

    Spark's own writers would open one after the other, each with a writer, a checksum file, a
    committer's renames and, on a local disk, processes that set permissions.  A file takes its
    name when it is whole, so that a repeated task does no harm.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        made, unfinished, n = set(), f"_{uuid.uuid4().hex}", 0
        for batch in batches:
            for path, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                place = f"{root}/{path.rpartition('/')[0]}"
                if place not in made:
                    fs.create_dir(place, recursive=True)
                    made.add(place)
                with fs.open_output_stream(f"{place}/{unfinished}", compression=None) as out:
                    out.write(text.encode())
                fs.move(f"{place}/{unfinished}", f"{root}/{path}")
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"n": [n]})

    files.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def fx_lines(spark, sf) -> DataFrame:
    return fx_lines_of(table(spark, sf, "documents"))


def fx_lines_of(documents: DataFrame) -> DataFrame:
    return documents.select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_seq", "line_text"))


def _page_width(page_no: str) -> str:
    return f"cast(if(doc_id % 13 = 0 and {page_no} = 1, 595, 612) as double)"


def _size() -> str:
    def step(m: int) -> str:
        k = f"(doc_id * 31 + line_seq * 7 + s) % {m}"
        return f"case {k} when 0 then 9.5D when 2 then 11.7D when 3 then 13.0D else 12.0D end"
    return (f"case when doc_id % 29 = 4 then 0.0D when hd then 8.5D when doc_id % 3 = 0 then 12.0D "
            f"when doc_id % 3 = 1 then {step(997)} else {step(23)} end")


# Five lines of the text, with a heading on some pages.
_PAGE_TEXT = (f"concat(if(doc_id % 20 = 0 and page_no = 2, 'Addendum\\n', ''), "
              f"array_join(slice(lines, page_no * {LINES_PER_PAGE} + 1, {LINES_PER_PAGE}), '\\n'))")
_FLAGS = ("cast(if((doc_id + line_seq + s) % 17 = 0, 1, 0) "
          "+ if(doc_id % 7 = 0 or s % 5 = 4, 2, 0) + if(doc_id % 11 = 0, 16, 0) as int)")
_GAP = "case doc_id % 4 when 0 then 14.4D when 1 then 24.0D when 2 then 28.8D else 16.56D end"
# Two lines to a block; a block's box follows from its number.
_ORIGIN = f"if({{lop}} = 0 and doc_id % 8 = 0, 50.0D, 120.0D + {{lop}} * {_GAP})"
_BLOCK = "int(floor(lop / 2))"
# Middle blocks of some pages are images, and some lines are blank.
_TYPE = f"if({_BLOCK} = 1 and (doc_id + page_no) % 6 = 2, 1, 0)"
_BLANK = "(doc_id * 7 + line_seq) % 11 = 4"
_LEFT = "cast(108 - if(doc_id % 9 = 0, 20, 0) as double)"
_RIGHT = "cast(540 + if(doc_id % 10 = 0, 15, 0) as double)"
_HD = "((doc_id + line_seq) % 6 = 0 and s = 0)"
# Cut in one walk: a substring at each place would walk a long line from its start every time.
_CHUNKS = f"regexp_extract_all({{line}}, '(?s).{{{{1,{CHUNK}}}}}', 0)"
_TEXT = f"if({_BLANK}, '  ', if(hd, 'STATEMENT OF THE CASE', chunk))"
_FONT = "if(doc_id % 5 <> 4, 'Times', 'Arial')"
_NUMBER = "if(doc_id % 6 = 1, concat('- ', page_no + 1, ' -'), cast(page_no + 1 as string))"


def fx_spans(spark, sf) -> DataFrame:
    return fx_spans_of(table(spark, sf, "documents"))


def fx_spans_of(documents: DataFrame) -> DataFrame:
    """One row per 40 characters of a line, and one footer row per page.

    Blocks hold two lines, some blocks are images, some lines are blank.
    """
    lines = fx_lines_of(documents).selectExpr(
        "doc_id", "line_seq", "line_text", f"cast(floor(line_seq / {LINES_PER_PAGE}) as int) page_no",
        f"line_seq % {LINES_PER_PAGE} lop")
    chunks = lines.selectExpr("*", f"posexplode({_CHUNKS.format(line='line_text')}) as (s, chunk)").selectExpr(
        "*", f"{_HD} hd", f"{_ORIGIN.format(lop='lop')} origin_y")
    text_rows = chunks.selectExpr(
        "doc_id", "page_no", f"{_page_width('page_no')} width_pt", "792.0D height_pt",
        f"{_BLOCK} block_no", f"{_TYPE} block_type",
        f"{_LEFT} bx0", f"{_ORIGIN.format(lop=f'({_BLOCK} * 2)')} - 12 by0",
        f"{_RIGHT} bx1", f"{_ORIGIN.format(lop=f'({_BLOCK} * 2 + 1)')} + 3 by1",
        "int(lop % 2) line_no", "s span_no",
        f"{_TEXT} text", f"{_FONT} font", f"{_size()} size", f"{_FLAGS} flags",
        "origin_y")
    footers = page_numbers_of(documents).filter("doc_id % 5 <> 0").selectExpr(
        "doc_id", "page_no", f"{_page_width('page_no')} width_pt", "792.0D height_pt",
        "9 block_no", "0 block_type", "300.0D bx0", "748.0D by0", "312.0D bx1", "763.0D by1",
        "0 line_no", "0 span_no",
        f"{_NUMBER} text",
        "'Times' font", "10.0D size", "0 flags", "760.0D origin_y")
    return text_rows.unionByName(footers)


def page_numbers_of(documents: DataFrame) -> DataFrame:
    return documents.select(
        "doc_id", F.size(F.split("text", "\n", -1)).alias("n")).selectExpr(
        "doc_id", f"explode(sequence(0, cast(floor((n - 1) / {LINES_PER_PAGE}) as int))) page_no")


def _paged(df: DataFrame, text: str) -> DataFrame:
    """Five lines of ``text`` per page, cut inside the document's row."""
    n = LINES_PER_PAGE
    return df.select("doc_id", F.split(text, "\n", -1).alias("lines")).selectExpr(
        "doc_id", "lines",
        f"explode(sequence(0, cast(floor((size(lines) - 1) / {n}) as int))) page_no"
    ).selectExpr("doc_id", "page_no",
                 f"array_join(slice(lines, page_no * {n} + 1, {n}), '\\n') text")


def fx_pages(spark, sf) -> DataFrame:
    return fx_pages_of(table(spark, sf, "documents"))


def fx_pages_of(documents: DataFrame) -> DataFrame:
    return _paged(documents, "text").selectExpr(
        "doc_id", "page_no", f"{_page_width('page_no')} width_pt", "792.0D height_pt",
        "if(doc_id % 20 = 0 and page_no = 2, concat('Addendum\\n', text), text) text")


def fx_layout(spark, sf) -> DataFrame:
    """Nested documents whose flattened form is ``fx_spans`` and ``fx_pages``.

    Nested inside each document's own row, as a layout file would bring them: nothing is shuffled.
    """
    n = LINES_PER_PAGE

    def placed(sql: str) -> str:
        """A formula over a span of line ``lop`` of its page."""
        sql = re.sub(r"\bhd\b", _HD, sql)
        return re.sub(r"\bline_seq\b", f"(page_no * {n} + lop)", sql)

    span = ("named_struct('text', {text}, 'font', {font}, 'size', {size}, 'flags', {flags}, 'origin', array(0.0D, {y}))")
    spans = (f"transform({_CHUNKS.format(line=f'get(lines, page_no * {n} + lop)')}, (chunk, s) -> "
             + span.format(text=placed(_TEXT), font=_FONT, size=placed(_size()), flags=placed(_FLAGS), y=_ORIGIN.format(lop="lop")) + ")")
    # Lines that the text lacks, or that are empty, are no lines; blocks without lines are no blocks.
    def rows(b: int) -> str:
        return (f"filter(transform(sequence({2 * b}, {min(2 * b + 1, n - 1)}), lop -> named_struct('spans', {spans})), "
                "x -> size(x.spans) > 0)")

    blocks = ", ".join(
        f"named_struct('type', {_TYPE.replace('lop', str(2 * b))}, 'bbox', array({_LEFT}, {_ORIGIN.format(lop=2 * b)} - 12, "
        f"{_RIGHT}, {_ORIGIN.format(lop=2 * b + 1)} + 3), 'lines', {rows(b)})" for b in range((n + 1) // 2))
    foot = (f"named_struct('type', 0, 'bbox', array(300.0D, 748.0D, 312.0D, 763.0D), 'lines', array(named_struct('spans', array("
            + span.format(text=_NUMBER, font="'Times'", size="10.0D", flags="0", y="760.0D") + "))))")
    page = (f"named_struct('page_no', page_no, 'width_pt', {_page_width('page_no')}, 'height_pt', 792.0D, 'text', {_PAGE_TEXT}, "
            f"'blocks', filter(if(doc_id % 5 <> 0, array({blocks}, {foot}), array({blocks})), b -> size(b.lines) > 0))")
    return table(spark, sf, "documents").filter("text is not null").select(
        "doc_id", F.split("text", "\n", -1).alias("lines")).selectExpr(
        "doc_id", "concat('doc-', doc_id, '.pdf') path",
        f"transform(sequence(0, cast(floor((size(lines) - 1) / {n}) as int)), page_no -> {page}) pages")


COVERS = [
    "in the supreme court brief of appellant, jane roe",
    "brief of the plaintiff-appellee, john doe",
    "reply brief of appellant, jane roe",
    "brief of amicus curiae, bar group",
    "petition for rehearing",
    "brief of cross-appellant, john doe",
    "defendant-appel1ant br1ef",
    "respondents brief",
    "rehearing petition",
    "friend of the court",
    "cross-appeal no. 7",
    "appellant and appellee",
    "brief of appellant jane roe v. john doe and all other persons unknown",
    "brief in support of motion, x",
]

# (condition on doc_id, lines appended); conditions and lines suit both engines.
DECORATIONS = [
    ("doc_id % 2 = 0", ["[1] First. [2] Second. [3] Third."]),
    ("doc_id % 2 <> 0 and doc_id % 5 = 0", ["[1] Only one."]),
    ("doc_id % 3 <> 0", ["Certificate of Compliance"]),
    ("doc_id % 4 = 0", ["Facts appear at (R12:3) and (R156:12)."]),
    ("doc_id % 4 = 1", ["See App. 15, Doc. 23 and Tr. 45."]),
    ("doc_id % 6 = 0", ["Roe v. Doe, 2005 ND 123, 700 N.W.2d 15."]),
    ("doc_id % 6 = 1", ["Poe v. Moe, 311 N.W.2d 20 (1981)."]),
    ("doc_id % 6 = 2", ["Old, 99 N.W. 2d 7; {x} 1999 ND 8"]),
    ("doc_id % 9 = 0", ["Table of Contents", "Statement of the Issues .... 4", "Argument ¶ 7",
                        "Conclusion"]),
    ("doc_id % 10 = 3", ["This juvenile matter under N.D.C.C. ch. 27-20."]),
    ("doc_id % 10 = 4", ["A supervisory writ is sought (E6:12)."]),
    ("doc_id % 12 = 5", ["SSN 123-45-6789, born 01/02/1990, card 4111111111111111."]),
    ("doc_id % 18 = 4", ["Table of Authorities", "Abel v. Cain, ¶ 3", "Baker v. Dodd, ¶ 5"]),
    ("doc_id % 18 = 13", ["Table of Authorities", "Baker v. Dodd, ¶ 5", "Abel v. Cain, ¶ 3"]),
    # Tables that go on over pages without a heading, in order or with a late fault, and what ends them.
    ("doc_id % 18 = 7", ["TABLE OF AUTHORITIES:"] + [f"{a}bel v. Cain, ¶ {i}" for i, a in enumerate("ABCDEFGHIJKLM")]),
    ("doc_id % 18 = 16", ["  table of  authorities"] + [f"{a}bel v. Cain, ¶ {i}" for i, a in enumerate("ABCDEFGHIKJLM")]),
    ("doc_id % 9 = 7 and doc_id % 4 < 2", ["Statement of the Case", "Aaron v. Last, ¶ 9"]),
    ("doc_id % 9 = 3", ["Table of Contents"] + [f"Part {i} .... {i}" for i in range(7)] + ["Issue ¶ 8", "Argument"]),
    ("doc_id % 11 = 10 and doc_id % 2 = 0", ["See N.D.C.C. § 27-20.3-16 and N.D.C.C. § 1-01-49.", "Addendum", "N.D.C.C. § 14-9-06. Custody.",
                                             "words", "more words", "yet more", "§ 01-1-49 Words", "§ 12.1-20-03", "N.D.C.C. § 27-20.3-16"]),
    ("doc_id % 11 = 2", ["Review is de novo; findings stand unless clearly erroneous."]),
    ("doc_id % 11 = 3", ["Conclusion", "The judgment should be reversed and remanded."]),
    ("doc_id % 11 = 5", ["The Appellant and the appellees disagree."]),
    ("doc_id % 11 = 6", ["See No. 20240017 and 08-2024-CV-00123, not 20990001."]),
    ("doc_id % 11 = 7", ["Interest of A.B. was heard.", "Example: In re XYZ"]),
    ("doc_id % 11 = 8", ["Its identity and interest in the case; no party authored this brief."]),
    ("doc_id % 11 = 9", ["The court overlooked the statute and misapprehended the record."]),
    ("doc_id % 11 = 10", ["Under N.D.C.C. § 14-09-06 the statute controls."]),
]


def fx_docs(spark, sf) -> DataFrame:
    return fx_docs_of(table(spark, sf, "documents"))


def fx_docs_of(documents: DataFrame) -> DataFrame:
    cover = F.element_at(F.array(*[F.lit(c) for c in COVERS]),
                         (F.col("doc_id") % len(COVERS) + 1).cast("int"))
    cover = F.concat(cover, F.when(F.col("doc_id") % 3 == 0, " oral argument requested")
                     .otherwise(""))
    extra = [F.when(F.expr(cond), F.replace(
        F.lit("".join("\n" + line for line in lines)), F.lit("{x}"),
        F.expr("repeat('x', cast(doc_id % 400 as int))"))).otherwise("")
        for cond, lines in DECORATIONS]
    return documents.select(
        "doc_id", F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".pdf")).alias("path"),
        cover.alias("cover_text"), F.concat("text", *extra).alias("full_text"))


def fx_dpages(spark, sf) -> DataFrame:
    """Pages of the decorated text, five lines each."""
    return _paged(fx_docs(spark, sf), "full_text")


def fx_html(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").selectExpr(
        "page_id", "concat('rule-', page_id % 9) rule",
        "concat(html, case page_id % 4 "
        "when 0 then concat('<p>Effective Date: ', 1 + page_id % 12, '/1/', 2020 + page_id % 6, '</p>') "
        "when 1 then '<p>Effective Date: 13/45/2020</p>' else '' end) html")


def fx_captions(spark, sf) -> DataFrame:
    """Covers with case number, party lines and a label, in several shapes."""
    return table(spark, sf, "documents").selectExpr("doc_id", """
        concat('STATE COURT', chr(10),
          if(doc_id % 4 <> 3, concat('Supreme Court No. ', 20240000 + doc_id % 10000, chr(10)), ''),
          if(doc_id % 3 <> 2, concat(chr(10), 'Jane Roe', if(doc_id % 2 = 0, ',', ''), chr(10),
             'Plaintiff and Appellee,', chr(10), 'vs.', chr(10), 'John Q. Doe,', chr(10)), ''),
          if(doc_id % 5 = 0, 'AMENDED ', ''), if(doc_id % 7 = 0, 'REPLY ', ''),
          if(doc_id % 6 <> 5, 'BRIEF OF DEFENDANT-APPELLANT,', 'MOTION'), chr(10), 'Filed') cover_text
        """, "concat('in/', 20990000 + doc_id, '_Roe-v-Doe-', doc_id, '_Apt-Br.pdf') path")


def fx_judged(spark, sf) -> DataFrame:
    """Answers of an outside judge: most asked checks and one unknown id."""
    # Which checks apply does not matter here: all are answered.
    docs = table(spark, sf, "documents").select("doc_id", F.lit("unknown").alias("brief_type"))
    known = docs_by_checks(docs, R.check_catalog(spark)).filter("(doc_id + check_no) % 5 <> 0").selectExpr(
        "doc_id", "check_no", "check_id", "(doc_id + check_no) % 7 <> 0 passed",
        "if((doc_id + check_no) % 11 = 0, '28(z)', if((doc_id + check_no) % 13 = 0, '', rule)) rule",
        "concat('seen ', check_id) message", "cast(null as string) details")
    unknown = docs.selectExpr("doc_id", "99 check_no", "'ZZZ-999' check_id", "false passed",
                              "'1' rule", "'unknown' message", "cast(null as string) details")
    return known.unionByName(unknown)


def fx_judged_parts(spark, sf) -> DataFrame:
    """Answers about three parts of each text; not every part has an answer to every check."""
    return fx_judged(spark, sf).drop("passed", "message").selectExpr("*", "explode(array(1, 2, 3)) part_no").filter(
        "(doc_id + check_no * 3 + part_no) % 4 <> 0").selectExpr(
        "*", "(doc_id + check_no + part_no * 2) % 3 <> 0 passed", "concat('seen ', check_id, ' in ', part_no) message")


def _as_texts(judged: DataFrame, keys: list[str], unreadable: str) -> DataFrame:
    """The same answers as raw text: fenced, in prose, plain, or unreadable."""
    item = F.struct(F.col("check_id").alias("id"), "passed", "rule", "message")
    arrays = judged.groupBy(*keys).agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("check_no", item.alias("item")))),
        lambda r: r["item"])).alias("body"))
    return arrays.selectExpr(*keys, f"""
        case when {unreadable} then 'not json'
             when doc_id % 3 = 0 then concat('```json\\n', body, '\\n```')
             when doc_id % 3 = 1 then concat('Here it is: ', body, ' Done.')
             else body end answer""")


def fx_answers(spark, sf) -> DataFrame:
    return _as_texts(fx_judged(spark, sf), ["doc_id"], "doc_id % 50 = 2")


def fx_part_answers(spark, sf) -> DataFrame:
    return _as_texts(fx_judged_parts(spark, sf), ["doc_id", "part_no"], "doc_id % 50 = 2 and part_no = 2")


def fx_manifest(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "concat('doc-', doc_id) file_name",
        "concat('sha256:', if(doc_id % 10 = 0, 'changed', sha2(text, 256))) expected_hash")


def fx_files(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").filter("doc_id % 15 <> 7").selectExpr(
        "concat('doc-', doc_id) file_name", "concat('sha256:', sha2(text, 256)) content_hash")


def fx_overrides(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "doc_id", "case doc_id % 5 when 0 then 'reply' when 1 then 'auto' "
                  "when 2 then 'bogus' end brief_type")
