"""Evidence for the judged checks: plain text features, one row per document.

Each function is one projection over the documents: the text is read once, no
shuffle is needed, and the features never claim to be the judgement itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens import rules as R
from docketlens.functions import text as X
from docketlens.operators.citations import with_missing_citations

# --- Fixed values: phrases named by the check guidance ---------------------
REVIEW_TERMS = {
    "de_novo": r"\bde\s+novo\b",
    "clearly_erroneous": r"\bclearly\s+erroneous\b",
    "abuse_of_discretion": r"\babuse\s+of\s+discretion\b",
    "reasonable_doubt": r"\breasonable\s+doubt\b",
    "preservation": r"\bpreserved\b|\bfirst\s+time\s+on\s+appeal\b|\bobvious\s+error\b",
}
RELIEF_TERMS = {
    "affirm": r"\baffirm", "reverse": r"\brevers", "remand": r"\bremand", "dismiss": r"\bdismiss",
}
AFTER_CONCLUSION = r"^\s*conclusion\b(.*)"
PARTY_LABELS = r"\b(?:appellants?|appellees?|petitioners?|respondents?)\b"
RECORD_STYLE = r"[(\[]R\d+:\d+"
OTHER_RECORD_STYLE = r"\b(?:App|Doc|Tr)\.\s*\d+"
EXHIBIT_CITE = r"\(E\d+:\d+"
WRIT_ELEMENTS = {
    "states_relief": r"relief\s+sought|requests?\s+relief",
    "states_issues": R.SECTION_PATTERNS["statement_of_issues"],
    "states_facts": r"facts\s+necessary|statement\s+of\s+(the\s+)?facts",
    "states_reasons": r"reasons?\s+why",
}
AMICUS_STATEMENTS = {
    "identity": r"\bidentity\b",
    "interest": r"\binterest\s+in\s+the\s+case\b",
    "authorship": r"\bauthored\b",
    "funding": r"\bmonetary\s+contribution|\bcontributed\s+money",
}
IDENTIFIERS = {
    "tax_ids": r"\b\d{3}-\d{2}-\d{4}\b",
    "birth_dates": r"\b(?:born|birth|dob)\D{0,20}\d{1,2}/\d{1,2}/\d{4}\b",
    "account_numbers": r"\b\d{13,19}\b",
    "emails": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phones": r"\b\d{3}-\d{3}-\d{4}\b",
}
# What stays of an identifier: the last four digits of tax and account numbers, the year of birth.
REDACTIONS = [
    (r"\b\d{3}-\d{2}-(\d{4})\b", "", "xxx-xx-$1"),
    (r"\b(born|birth|dob)(\D{0,20})\d{1,2}/\d{1,2}/(\d{4})\b", "i", "$1$2xx/xx/$3"),
    (r"\b\d{9,15}(\d{4})\b", "", "x$1"),
    (IDENTIFIERS["emails"], "", "[e-mail address]"),
    (r"\b\d{3}-\d{3}-(\d{4})\b", "", "xxx-xxx-$1"),
]
# Lines that are nothing but one of these begin a section, which lasts until the next one.
HEADING_LINES = {
    "contents": r"table\s+of\s+contents",
    "authorities": r"table\s+of\s+authorities",
    "jurisdiction": r"jurisdictional\s+statement|statement\s+of\s+jurisdiction",
    "issues": r"statement\s+of\s+(?:the\s+)?issues?|issues?\s+presented",
    "case": r"statement\s+of\s+(?:the\s+)?case",
    "facts": r"statement\s+of\s+(?:the\s+)?facts",
    "review": r"standard\s+of\s+review",
    "argument": r"(?:law\s+and\s+)?argument",
    "conclusion": r"conclusion",
    "certificate": r"certificate\s+of\s+(?:compliance|service)",
    "addendum": r"addendum",
}
SECTION_NUMBER = r"\d+(?:\.\d+)?-\d+(?:\.\d+)?(?:-\d+(?:\.\d+)?)?"
SECTION_CITED = r"N\.D\.C\.C\.\s+§§?\s*(" + SECTION_NUMBER + ")"
SECTION_SET_OUT = r"^(?:N\.D\.C\.C\.\s+)?§\s*(" + SECTION_NUMBER + ")"
CODE_CITE = r"N\.D\.C\.C\.\s+(?:§|ch\.)\s*\d"
NEUTRAL_YEAR = r"\b((?:19|20)\d{2})\s+ND(?:\s+App)?\s+\d+"
NEUTRAL_SINCE = 1997


def _flags(text: Column, patterns: dict[str, str], flags: str = "i") -> list[Column]:
    return [X.matches(text, p, flags).alias(name) for name, p in patterns.items()]


def _counts(text: Column, patterns: dict[str, str], flags: str = "i") -> list[Column]:
    return [X.count_matches(text, p, flags).alias(name) for name, p in patterns.items()]


def section_presence(docs: DataFrame) -> DataFrame:
    """EVD-1: is each section heading there?"""
    return docs.select("doc_id", *_flags(F.col("full_text"), R.SECTION_PATTERNS))


def page_sections(pages: DataFrame, wanted: list[str], facts: dict[str, Callable[[Column], Column]],
                  before: str | None = None) -> DataFrame:
    """(doc_id, page_no, seg_no, section, n_lines, the facts): pages cut at their heading lines, sections carried on.

    The lines before a page's first heading belong to the section that the pages before
    it ended in, however many they are.  Pages become a few narrow rows inside their own
    task; only these meet per document, to be named by the last heading seen.  ``facts``
    are computed of the lines of ``wanted`` sections, and of lines not yet named;
    ``before`` names what stands before the first heading of a document.
    """
    def heading(line: Column) -> Column:
        bare, name = X.strip(line), None
        for section, pattern in HEADING_LINES.items():
            hit = X.matches(bare, rf"^(?:{pattern})\s*:?$", "i")
            name = F.when(hit, section) if name is None else name.when(hit, section)
        return name

    lines = pages.select("doc_id", "page_no", F.split("text", "\n", -1).alias("lines"))
    heads = lines.withColumn("heads", F.filter(F.transform("lines", lambda line, i: F.struct(
        i.alias("at"), heading(line).alias("section"))), lambda h: h["section"].isNotNull()))
    n = F.size("heads")

    def segment(k: Column) -> Column:
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get("heads", k - 1)["at"] + 1)
        until = F.when(k == n, F.size("lines")).otherwise(F.get("heads", k)["at"])
        return F.struct(k.alias("seg_no"), F.get("heads", k - 1)["section"].alias("section"),
                        F.slice("lines", begin + 1, until - begin).alias("lines"))

    cut = heads.select("doc_id", "page_no", F.explode(F.transform(F.sequence(F.lit(0), n), segment)).alias("s"))
    use = F.col("s.section").isNull() | F.col("s.section").isin(*wanted)
    rows = cut.select("doc_id", "page_no", "s.seg_no", "s.section", F.size("s.lines").alias("n_lines"),
                      *[F.when(use, fact(F.col("s.lines"))).alias(name) for name, fact in facts.items()])
    so_far = Window.partitionBy("doc_id").orderBy("page_no", "seg_no").rowsBetween(Window.unboundedPreceding, 0)
    named = rows.withColumn("section", F.coalesce(F.last("section", ignorenulls=True).over(so_far), F.lit(before)))
    # A segment without lines is there only if a heading begins it.
    return named.filter(F.col("section").isin(*wanted) & ((F.col("seg_no") > 0) | (F.col("n_lines") > 0)))


def _marks(lines: Column) -> Column:
    text = F.array_join(lines, "\n")
    return X.count_matches(text, R.BRACKET_MARK) + X.count_matches(text, R.PARAGRAPH_MARK)


def toc_reference_style(pages: DataFrame) -> DataFrame:
    """EVD-2: in the table of contents, over all its pages, paragraph marks against trailing page numbers."""
    toc = page_sections(pages, ["contents"], {
        "marks": _marks,
        "numbers": lambda lines: X.count_matches(F.array_join(lines, "\n"), r"[^\d\n][ .\t]\d+[ \t]*$", "m")})
    per_page = toc.groupBy("doc_id", "page_no").agg(F.sum("marks").alias("marks"), F.sum("numbers").alias("numbers"))
    return per_page.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("toc_pages"), F.sum("marks").alias("paragraph_refs"), F.sum("numbers").alias("page_refs"))


def authorities_sorted(pages: DataFrame) -> DataFrame:
    """EVD-3: are the case lines of the table of authorities in order, over all its pages, with marks?

    A page's share is reduced to its first and last case and whether it is in order
    itself; neighbours are then compared, a few rows per document.
    """
    def cases(lines: Column) -> Column:
        return F.filter(F.transform(lines, X.strip), lambda line: line.contains(" v. "))

    toa = page_sections(pages, ["authorities"], {"marks": _marks, "cases": cases}).select(
        "doc_id", "page_no", "seg_no", F.size("cases").alias("n"), "marks",
        F.get("cases", F.lit(0)).alias("first"), F.get("cases", F.size("cases") - 1).alias("last"),
        (F.col("cases") == F.array_sort("cases")).alias("sorted"))
    # Pages without a case line do not interrupt the order.
    before = Window.partitionBy("doc_id").orderBy("page_no", "seg_no")
    follows = F.coalesce(F.last("last", ignorenulls=True).over(
        before.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("first"), F.lit(True))
    return toa.withColumn("follows", follows).groupBy("doc_id").agg(
        F.sum("n").cast("long").alias("case_lines"),
        F.min(F.col("sorted") & F.col("follows")).alias("in_order"),
        F.sum("marks").alias("paragraph_refs"))


def normal_section(number: Column) -> Column:
    """A section number without leading zeros in its parts."""
    return F.regexp_replace(number, r"(^|-)0+(\d)", "$1$2")


def statutes_set_out(pages: DataFrame) -> DataFrame:
    """EVD-14, CNT-003: code sections cited, those the addendum sets out, and cited ones it does not.

    The addendum begins with its heading and may go on over any number of pages; a
    section is set out where a line begins with its number.  Citations are those
    outside the addendum.  Both sides meet on the normalised number.
    """
    def found(pattern: str):
        def numbers(lines: Column) -> Column:
            whole = F.array_join(F.transform(lines, X.strip), "\n")
            return F.array_distinct(F.transform(X.all_matches(whole, pattern, "m", 1), normal_section))
        return numbers

    sections = page_sections(pages.withColumn("text", F.coalesce("text", F.lit(""))), [*HEADING_LINES, "none"], {
        "cited": found(SECTION_CITED), "headed": found(SECTION_SET_OUT)}, before="none")
    inside = F.col("section") == "addendum"
    numbers = sections.select("doc_id", F.when(inside, "set_out").otherwise("cited").alias("how"),
                              F.explode(F.when(inside, F.col("headed")).otherwise(F.col("cited"))).alias("number"))
    met = numbers.groupBy("doc_id", "number").agg(
        F.bool_or(F.col("how") == "cited").alias("cited"), F.bool_or(F.col("how") == "set_out").alias("set_out"))
    # A list for each document, of the different sections it names.
    lists = met.groupBy("doc_id").agg(*[F.array_sort(F.collect_list(F.when(cond, F.col("number")))).alias(name) for name, cond in (
        ("cited", F.col("cited")), ("set_out", F.col("set_out")), ("missing", F.col("cited") & ~F.col("set_out")))])
    none = F.array().cast("array<string>")
    return pages.select("doc_id").distinct().join(lists, "doc_id", "left").select(
        "doc_id", *[F.coalesce(c, none).alias(c) for c in ("cited", "set_out", "missing")])


def record_cite_mix(docs: DataFrame) -> DataFrame:
    """EVD-4: record citations in the required form and in other forms."""
    text = F.col("full_text")
    good, other = X.count_matches(text, RECORD_STYLE), X.count_matches(text, OTHER_RECORD_STYLE)
    return docs.select("doc_id", good.alias("record_cites"), other.alias("other_cites")).select(
        "*", F.when(F.col("record_cites") + F.col("other_cites") > 0, F.round(
            F.col("record_cites") / (F.col("record_cites") + F.col("other_cites")), 6))
        .alias("compliant_share"))


def review_standard_terms(docs: DataFrame) -> DataFrame:
    """EVD-5: standard-of-review and preservation phrases."""
    return docs.select("doc_id", *_counts(F.col("full_text"), REVIEW_TERMS))


def relief_terms(docs: DataFrame) -> DataFrame:
    """EVD-6: relief verbs after the first line that starts with the heading."""
    tail = docs.select("doc_id", F.regexp_extract(
        "full_text", X.rx(AFTER_CONCLUSION, "ims"), 1).alias("tail"))
    return tail.select("doc_id", *_counts(F.col("tail"), RELIEF_TERMS))


def party_label_ratio(docs: DataFrame) -> DataFrame:
    """EVD-7: procedural party labels per thousand words."""
    text = F.col("full_text")
    return docs.select("doc_id", X.count_matches(text, PARTY_LABELS, "i").alias("labels"),
                       X.word_count(text).alias("words")).select(
        "doc_id", "labels", F.when(F.col("words") > 0, F.round(
            F.col("labels") * 1000 / F.col("words"), 6)).alias("labels_per_1000"))


def case_triggers(docs: DataFrame) -> DataFrame:
    """EVD-8: kinds of proceedings in which names are protected."""
    return docs.select("doc_id", *_flags(F.col("full_text"), R.CASE_TRIGGERS))


def writ_trigger(docs: DataFrame) -> DataFrame:
    """EVD-9: writ petition terms, exhibit citations, the four elements."""
    text = F.col("full_text")
    return docs.select(
        "doc_id", X.matches(text, R.WRIT_TERMS, "i").alias("is_writ"),
        X.count_matches(text, EXHIBIT_CITE).alias("exhibit_cites"),
        *_flags(text, WRIT_ELEMENTS))


def rehearing_points(docs: DataFrame) -> DataFrame:
    """EVD-10: points overlooked or misapprehended; contents and authorities."""
    text = F.col("full_text")
    return docs.select(
        "doc_id", X.count_matches(text, r"\boverlooked\b", "i").alias("overlooked"),
        X.count_matches(text, r"\bmisapprehended\b", "i").alias("misapprehended"),
        X.matches(text, R.SECTION_PATTERNS["table_of_contents"], "i").alias("has_contents"),
        X.matches(text, R.SECTION_PATTERNS["table_of_authorities"], "i").alias("has_authorities"))


def neutral_cite_years(docs: DataFrame) -> DataFrame:
    """EVD-11: neutral citations before and since 1997, lone reporter citations."""
    text = F.col("full_text")
    years = X.all_matches(text, NEUTRAL_YEAR, "", 1)
    facts = with_missing_citations(docs.select(
        "doc_id", "full_text", F.transform(years, lambda y: y.try_cast("int")).alias("years")))
    return facts.select(
        "doc_id",
        F.size(F.filter("years", lambda y: y < NEUTRAL_SINCE)).alias("before_1997"),
        F.size(F.filter("years", lambda y: y >= NEUTRAL_SINCE)).alias("since_1997"),
        F.size("missing_cites").alias("reporter_only"))


def amicus_statements(docs: DataFrame) -> DataFrame:
    """EVD-12: identity, interest, authorship and funding phrases."""
    return docs.select("doc_id", *_flags(F.col("full_text"), AMICUS_STATEMENTS))


# For each identifier: a literal that its matches contain, and a beginning that lets most places of a text fail at
# once, before the costly Unicode word boundary.  An address begins where its run of characters does, or where the
# match before ended: later places of a run without an at-sign need no look.
_RUN = "[A-Za-z0-9._%+-]"
_EARLY = [
    (r"\b\d", r"(?=\d)\b\d", "-"),
    (r"\b(", r"(?=[BbDd])\b(", "/"),
    (f"{_RUN}+@", rf"(?:(?<!{_RUN})|\G){_RUN}++@", "@"),
]


def _early(pattern: str) -> tuple[str, str | None]:
    """The same matches by a pattern that fails early, and a literal that texts with a match contain."""
    for start, quick, literal in _EARLY:
        if pattern.startswith(start):
            return quick + pattern[len(start):], literal if literal in pattern[len(start) - 1:] else None
    return pattern, None


def redacted(text: Column) -> Column:
    """The text with identifiers shortened as the privacy rule wants them."""
    for pattern, flags, shortened in REDACTIONS:
        quick, literal = _early(pattern)
        short = F.regexp_replace(text, X.rx(quick, flags), shortened)
        text = short if literal is None else F.when(text.contains(literal), short).otherwise(text)
    return text


def personal_identifiers(docs: DataFrame) -> DataFrame:
    """EVD-13: identifiers that the privacy rule wants shortened: counts, and the shortened text."""
    text = F.col("full_text")

    def counted(name: str, pattern: str) -> Column:
        quick, literal = _early(pattern)
        n = X.count_matches(text, quick, "i")
        return (n if literal is None else F.when(~text.contains(literal), F.lit(0).cast("long")).otherwise(n)).alias(name)

    return docs.select("doc_id", *[counted(*i) for i in IDENTIFIERS.items()], redacted(text).alias("redacted_text"))


def repeated_line_share(text: Column) -> Column:
    """Share of the lines with text that repeat another line of the document."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), X.strip), lambda line: line != "")
    return F.when(F.size(lines) > 0, F.round(1 - F.size(F.array_distinct(lines)) / F.size(lines), 6))


def statute_quotes(docs: DataFrame) -> DataFrame:
    """EVD-14: code citations, whether an addendum could hold their text, repeated lines."""
    text = F.col("full_text")
    return docs.select(
        "doc_id", X.count_matches(text, CODE_CITE).alias("code_cites"),
        X.matches(text, R.ADDENDUM_LINE, "im").alias("has_addendum"),
        repeated_line_share(text).alias("repeated_lines"))
