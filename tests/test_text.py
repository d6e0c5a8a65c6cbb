"""Cover normalisation, document types, case facts, links, page lists."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketlens import rules as R
from docketlens.functions import text as X
from docketlens.operators import evidence


def values(spark, column, texts, schema="t string"):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    return [r[1] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


TYPES = {
    "in the supreme court brief of appellant, jane roe": "appellant",
    "BRIEF OF THE PLAINTIFF-APPELLEE, John Doe": "appellee",
    "Reply Brief of Appellant": "reply",
    "BRIEF OF AMICUS CURIAE": "amicus",
    "Petition for Rehearing": "petition_rehearing",
    "Rehearing petition": "petition_rehearing",
    "brief of cross-appellant, john doe": "cross_appeal",
    "defendant-appel1ant br1ef": "appellant",
    "respondent’s brief": "appellee",
    "friend of the court": "amicus",
    "cross-appeal no. 7": "unknown",
    "appellant and appellee": "unknown",
    "brief of appellant jane roe v. john doe and all other persons unknown": "unknown",
    "brief in support of motion, x": "unknown",
    "B R I E F  of  A P P E L L E E": "appellee",
    "B R I E F  O F  A P P E L L E E": "unknown",
    "ﬁled: APPÉLLANT’S BRIEF": "appellant",
    "-------------------- ------------------------------------------ end": "unknown",
    "": "unknown",
}


def test_types(spark):
    got = values(spark, X.classify_brief(X.normalize_cover(F.col("t"))), list(TYPES))
    assert dict(zip(TYPES, got)) == TYPES


def test_type_fix_finds_cross_appeals(spark):
    texts = ["cross-appellee's brief", "cross-appeal no. 7"]
    normal = X.normalize_cover(F.col("t"))
    assert values(spark, X.classify_brief(normal, fix=True), texts) == ["cross_appeal"] * 2
    assert values(spark, X.classify_brief(normal), texts) == ["cross_appeal", "unknown"] \
        or values(spark, X.classify_brief(normal), texts) == ["appellee", "unknown"]


def collapse_by_hand(text):
    marked = re.sub(r" {2,}|\t|\n", "\x00", text)
    joined = re.sub(r"(?:[a-zA-Z] ){2,}[a-zA-Z]", lambda m: m.group(0).replace(" ", ""), marked)
    return joined.replace("\x00", " ")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab1 \t-", max_size=30), min_size=20, max_size=40))
def test_letter_spacing(spark, texts):
    got = values(spark, X.collapse_letter_spacing(F.col("t")), texts)
    assert got == [collapse_by_hand(t) for t in texts]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x1c\xa0 ", max_size=30), min_size=20, max_size=40))
def test_strip_and_words(spark, texts):
    assert values(spark, X.strip(F.col("t")), texts) == [t.strip() for t in texts]
    assert values(spark, X.word_count(F.col("t")), texts) == [len(t.split()) for t in texts]


def test_case_facts(spark):
    cover = ("STATE\nSupreme Court No. 20240017\n\nJane Roe, )\nPlaintiff and Appellee,\nvs. )\n"
             "John Q. Doe,\nDefendant\nAMENDED BRIEF OF DEFENDANT-APPELLANT,\nFiled")
    other = "20990001_Example-v-Case_Apt-Br.final.pdf"
    df = spark.createDataFrame([(cover, "a/b/x.pdf"), ("nothing", "in/" + other)], "c string, p string")
    rows = df.select(X.case_number(F.col("c")), X.brief_label(F.col("c")),
                     X.case_title(F.col("c"), F.col("p"))).collect()
    assert tuple(rows[0]) == ("20240017", "Amended Brief Of Defendant-Appellant",
                              "Jane Roe v. John Q. Doe")
    assert tuple(rows[1]) == ("", "", "Example v. Case")


def test_rule_links(spark):
    one, two, three, four = values(spark, X.rule_links(F.col("t")), [
        "28(h)/34(a)(1)(C)", "N.D.R.Ct. 11.6(b)", "3.4(b)", "a & b"])
    assert one.count("<a ") == 2 and f"{R.APPELLATE_RULES_URL}/34" in one and " / " in one
    assert f'"{R.COURT_RULES_URL}/11-6"' in two and ">N.D.R.Ct. 11.6(b)</a>" in two
    assert f'"{R.COURT_RULES_URL}/3-4"' in three and ">Rule 3.4(b)</a>" in three
    assert four == "Rule a &amp; b"


def test_page_list(spark):
    df = spark.createDataFrame([(list(range(1, 11)),), (list(range(1, 13)),), ([],)], "p array<int>")
    assert [r[0] for r in df.select(X.page_list(F.col("p"))).collect()] == [
        "1, 2, 3, 4, 5, 6, 7, 8, 9, 10", "1, 2, 3, 4, 5, 6, 7, 8, 9, 10 (and 2 more)", ""]


@pytest.mark.parametrize("message,details,passed,expected", [
    ('Top Margin < 1" on 2, 3, 4.', None, False, [2, 3, 4]),
    ("found on pages 5, 6", None, False, [5, 6]),
    ("nothing", "Pages: 7, 8", False, [7, 8]),
    ('Pages not 8.5" x 11": 3.', "Page 1 is 8.26", False, [1]),
    ("on 2", None, True, None), ("nothing", None, False, None)])
def test_pages_from_message(spark, message, details, passed, expected):
    df = spark.createDataFrame([(message, details, passed)], "m string, d string, p boolean")
    assert df.select(X.pages_from_message(F.col("m"), F.col("d"), F.col("p"))).first()[0] == expected


def test_parts_and_escape(spark):
    assert values(spark, X.text_parts(F.col("t"), 3), ["abc", "abcd", "", None, "a\nb😀c"]) == [
        ["abc"], ["abc", "d"], [""], [""], ["a\nb", "😀c"]]
    assert values(spark, X.html_escape(F.col("t")), ['<a href="x">&']) == [
        "&lt;a href=&quot;x&quot;&gt;&amp;"]


def test_identifiers_by_early_failing_patterns(spark):
    """The same counts and shortened texts as by the patterns as they are written."""
    draw = random.Random(3)
    pieces = ["a@b.com", "_x@y.org", "a@b.comx", "%", "@", ".", " ", "\n", "123-45-6789", "123-456-7890", "-", "/", "born ", "DOB: ",
              "1/2/1990", "01/12/2001", "4111111111111111", "12", "é", "٣", "Birth", "x", "a.b-c@d-e.fg.hi"]
    rows = [(i, "".join(draw.choice(pieces) for _ in range(draw.randint(0, 14)))) for i in range(3000)] + [(3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, full_text string")
    text = F.col("full_text")
    for pattern, flags, shortened in evidence.REDACTIONS:
        text = F.regexp_replace(text, X.rx(pattern, flags), shortened)
    plain = docs.select("doc_id", *[X.count_matches(F.col("full_text"), p, "i").alias(n) for n, p in evidence.IDENTIFIERS.items()],
                        text.alias("redacted_text"))
    assert all(evidence._early(p)[0] != p for p in evidence.IDENTIFIERS.values())
    assert sorted(evidence.personal_identifiers(docs).collect(), key=str) == sorted(plain.collect(), key=str)


def test_cheap_ways_give_what_the_patterns_give(spark):
    """Lengths and capitals of texts that skip the pattern, and of those that must not."""
    texts = ["", " ", "a", "A", "1", "ABC 12", "ABc", " AB ", "\x1fAB", "AB　", "\xa0\x85", "ÄÖ", "Äö", "AB\x7f", "~A~",
             "ǅA", "ⅰA", "ⓐA", "Aª", "ʰA", "AB 中", "中", "ßA", "İI", "Iͅ", "\tA", "A\n", "é", " é ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", X.strip_length(F.col("t")).alias("n"), X.is_all_uppercase(F.col("t")).alias("up"),
        F.length(X.strip(F.col("t"))).alias("plain_n"),
        (~F.col("t").rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]") & F.col("t").rlike(r"\p{L}")).alias("plain_up")).collect()
    for r in rows:
        assert (r.n, r.up) == (r.plain_n, r.plain_up), repr(r.t)
        assert r.t is None or r.n == len(r.t.strip())


def test_blanks_before_printable_text_are_no_characters(spark):
    """a text that begins with a blank is trimmed, whatever follows and wherever it ends."""
    ends = ["", " ", "  ", "\t", "\n", "\xa0", "\u3000", "\x1f", "\x7f", "!", "~", "a", "Ä"]
    texts = [a + middle + b for a in ends for middle in ("", "x", "a b") for b in ends]
    assert values(spark, X.strip_length(F.col("t")), texts) == [len(t.strip()) for t in texts]


def test_small_letters_go_before_the_pattern(spark):
    """No character but small letters folds to one of those looked for, and odd forms of others are found as before."""
    letters = "".join(sorted({c for n in [*["pectfully", "cert", "table"], "cert", "addendum"] for c in n}))
    every = spark.range(1, 0x110000).filter("id not between 55296 and 57343").select(
        F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    assert every.filter(X.matches(F.col("c"), f"^[{letters}]$", "i")).count() == 2 * len(letters)
    assert every.filter(X.matches(F.col("c"), f"^[{letters}]$", "i") & ~F.lower("c").isin(*letters)).count() == 0
    texts = ["Reſpectfully ſUBMITTED", "CERTıfİCATE of ſervice", "certificate  of compliance", "cert of service",
             "TABLE\n\nof contents", "tables of contents", "", None, "K certificate of mailing Ä", "respectfully"]
    for pattern, needs in zip(R.SMALL_CAPS_PAGE_PATTERNS, ["pectfully", "cert", "table"], strict=True):
        assert values(spark, X.matches_with(F.col("t"), F.lower("t"), pattern, needs), texts) == values(
            spark, X.matches(F.col("t"), pattern), texts)
