"""Text expressions shared by the operators.  All but one run in the JVM."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlens import rules as R

# The characters that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"[\s\x1c-\x1f]"


def rx(pattern: str, flags: str = "") -> str:
    """A Java pattern with Unicode classes and ``\\n`` as the only line end."""
    return f"(?{flags}Ud){pattern}"


def matches(col: Column, pattern: str, flags: str = "i") -> Column:
    return col.rlike(rx(pattern, flags))


def matches_with(col: Column, small: Column, pattern: str, needs: str, flags: str = "i") -> Column:
    """``matches`` where ``small``, the text in small letters, holds ``needs``; elsewhere the pattern is not tried.

    ``needs`` stands in every match.  It must be of ASCII letters other than i, k and s: without
    regard to case, dotless i, Kelvin sign and long s match these but keep their form as small letters.
    """
    return small.contains(needs) & matches(col, pattern, flags)


def matches_any(col: Column, patterns: list[str], flags: str = "") -> Column:
    hit = matches(col, patterns[0], flags)
    for pattern in patterns[1:]:
        hit = hit | matches(col, pattern, flags)
    return hit


def count_matches(col: Column, pattern: str, flags: str = "", needs: str | None = None) -> Column:
    """Number of matches.

    ``needs`` is a literal that every match contains: texts without it skip the
    pattern, which is several times cheaper.
    """
    n = F.regexp_count(col, F.lit(rx(pattern, flags))).cast("long")
    if needs is None:
        return n
    return F.when(col.contains(needs), n).otherwise(F.lit(0).cast("long"))


def all_matches(col: Column, pattern: str, flags: str = "", group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(rx(pattern, flags)), group)


def strip(col: Column) -> Column:
    """Trim every Unicode white space, not only blanks."""
    return F.btrim(col, F.lit(WHITESPACE))


def strip_length(col: Column) -> Column:
    """Length of the trimmed text; a text between two printable ASCII characters is not trimmed."""
    def plain(c: Column) -> Column:
        # By the first character: a text that goes on after a blank is more than a blank.
        return (c >= "!") & (c < "\x7f")

    return F.when(plain(col) & plain(F.right(col, F.lit(1))), F.length(col)).otherwise(F.length(strip(col)))


def is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.length(col)


def word_count(col: Column) -> Column:
    """Pieces between white space of the trimmed text."""
    bare = strip(col)
    return F.when(bare == "", F.lit(0).cast("long")).otherwise(
        F.size(F.split(bare, rx(SPACE_CLASS + "+"), -1)).cast("long"))


def is_all_uppercase(col: Column) -> Column:
    """At least one letter, and no letter that is not upper case.

    ASCII that capitals would change has a small letter; only the rest is searched.
    """
    small = is_ascii(col) & (F.upper(col) != col)
    return ~small & ~col.rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]") & col.rlike(r"\p{L}")


def _combining_marks() -> str:
    """A character class of every character that combines, as ranges."""
    ranges: list[list[int]] = []
    for c in filter(lambda c: unicodedata.combining(chr(c)), range(0x110000)):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


_MARKS = _combining_marks()


@F.arrow_udf(T.StringType())
def _decompose(text: pa.Array) -> pa.Array:
    """Compatibility decomposition without combining marks, on whole batches (no JVM built-in)."""
    return pc.replace_substring_regex(pc.utf8_normalize(text, "NFKD"), _MARKS, "")


def decompose(col: Column) -> Column:
    """Only rows with a non-ASCII character carry their text to Python."""
    return F.coalesce(_decompose(F.when(col.rlike(r"[^\x00-\x7F]"), col)), col)


def collapse_letter_spacing(col: Column) -> Column:
    """Join runs of three or more letters that single blanks separate.

    Wider gaps, tabs and line breaks separate words.  A blank goes when it sits
    between two letters and the neighbouring blank two places before or after
    does too, which is the same as "part of a run with two blanks or more".
    """
    marked = F.regexp_replace(col, " {2,}|\t|\n", "\x00")
    joined = F.regexp_replace(
        marked,
        r"(?<=[a-zA-Z] [a-zA-Z]) (?=[a-zA-Z])|(?<=[a-zA-Z]) (?=[a-zA-Z] [a-zA-Z])", "")
    return F.translate(joined, "\x00", " ")


def normalize_cover(col: Column) -> Column:
    """Cover text reduced to plain lower-case words for the type patterns."""
    t = decompose(col)
    t = F.regexp_replace(t, R.ZERO_WIDTH, "")
    for misread in R.MISREAD_BRIEF:
        t = F.regexp_replace(t, misread, "brief")
    t = F.regexp_replace(F.regexp_replace(t, R.QUOTE_MARKS, ""), R.DASHES, "-")
    t = collapse_letter_spacing(strip(F.lower(t)))
    return strip(F.regexp_replace(t, rx(SPACE_CLASS + "+"), " "))


def classify_brief(normal: Column, fix: bool = False) -> Column:
    """Document type from normalised cover text, most telling phrase first.

    ``fix`` adds the cross-appeal phrases that the rules intend but the parity
    patterns never match.
    """
    after = F.regexp_extract(normal, rx(R.BRIEF_OF), 2)
    before = F.regexp_extract(normal, rx(R.WORD_BEFORE_BRIEF), 1)
    cross = f"{R.CROSS_PARTY}|{R.CROSS_WORD}" if fix else R.CROSS_PARTY
    kind = F.when(matches_any(normal, R.REHEARING_PATTERNS), "petition_rehearing")
    kind = kind.when(matches_any(normal, R.AMICUS_BRIEF_PATTERNS), "amicus")
    kind = kind.when(matches_any(normal, R.REPLY_BRIEF_PATTERNS), "reply")
    if fix:
        kind = kind.when(matches_any(normal, R.CROSS_BRIEF_PATTERNS), "cross_appeal")
    return (
        kind.when(matches(after, cross, ""), "cross_appeal")
        .when(matches(after, R.APPELLEE_WORDS, ""), "appellee")
        .when(matches(after, R.APPELLANT_WORDS, ""), "appellant")
        .when(matches(before, R.APPELLEE_WORDS, ""), "appellee")
        .when(matches(before, R.APPELLANT_WORDS, ""), "appellant")
        .when(matches_any(normal, R.STANDALONE_AMICUS_PATTERNS), "amicus")
        .when(matches(normal, cross, ""), "cross_appeal")
        .otherwise("unknown")
    )


def title_case(col: Column) -> Column:
    """Capitalise after every character that is not a letter."""
    words = F.regexp_extract_all(col, F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(words, F.initcap), "")


def type_label(col: Column) -> Column:
    return title_case(F.replace(col, F.lit("_"), F.lit(" ")))


def case_number(cover: Column) -> Column:
    return F.regexp_extract(cover, rx(R.CASE_NUMBER, "i"), 1)


def brief_label(cover: Column) -> Column:
    label = strip(F.regexp_extract(cover, rx(R.BRIEF_LABEL), 1))
    return title_case(F.rtrim(label, F.lit(",")))


# Party lines around "Plaintiff" and "vs." on a cover.
_PLAINTIFF = (r"\n\s*([A-Z][a-zA-Z.\- ]+?)\s*,?\s*\)?\s*\n"
              r"(?:\s*\)?\s*\n)*\s*(?:\)?\s*\n\s*)*Plaintiff")
_DEFENDANT = (r"vs\.?\s*\)?\s*\n(?:\s*\)?\s*\n)*\s*"
              r"([A-Z][a-zA-Z.\- ]+?)\s*,?\s*\)?\s*\n")


def case_title(cover: Column, path: Column) -> Column:
    """"A v. B" from the party lines, else a title from the file name."""
    def party(pattern):
        return F.rtrim(strip(F.regexp_extract(cover, rx(pattern), 1)), F.lit(","))

    plaintiff, defendant = party(_PLAINTIFF), party(_DEFENDANT)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=[^.])\.[^.]*$", "")
    stem = F.regexp_replace(stem, rx(R.STEM_NUMBER), "")
    stem = F.regexp_replace(stem, rx(R.STEM_KIND, "i"), "")
    stem = F.regexp_replace(F.replace(stem, F.lit("-"), F.lit(" ")), rx(r"\bv\b"), "v.")
    return F.when((plaintiff != "") & (defendant != ""),
                  F.concat(plaintiff, F.lit(" v. "), defendant)).otherwise(strip(stem))


def html_escape(col: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(plain), F.lit(entity))
    return col


def rule_links(col: Column) -> Column:
    """A link for each part of a citation like ``28(h)/34(a)(1)(C)``."""
    def anchor(url, label):
        return F.concat(F.lit('<a href="'), url, F.lit('" target="_blank" class="rule-link">'),
                        label, F.lit("</a>"))

    def one(part):
        part = strip(part)
        court = F.regexp_extract(part, rx(r"^N\.D\.R\.Ct\.\s*([\d.]+)"), 1)
        tail = F.regexp_extract(part, rx(r"^N\.D\.R\.Ct\.\s*(\d.*|\..*)$", "s"), 1)
        number = F.regexp_extract(part, rx(r"^([\d.]+)"), 1)

        def hyphens(c):
            return F.replace(c, F.lit("."), F.lit("-"))

        return (
            F.when(court != "", anchor(F.concat(F.lit(R.COURT_RULES_URL + "/"), hyphens(court)),
                                       F.concat(F.lit("N.D.R.Ct. "), tail)))
            .when(number.contains("."),
                  anchor(F.concat(F.lit(R.COURT_RULES_URL + "/"), hyphens(number)),
                         F.concat(F.lit("Rule "), part)))
            .when(number != "",
                  anchor(F.concat(F.lit(R.APPELLATE_RULES_URL + "/"), number),
                         F.concat(F.lit("Rule "), part)))
            .otherwise(F.concat(F.lit("Rule "), html_escape(part)))
        )

    return F.array_join(F.transform(F.split(col, "/"), one), " / ")


def page_list(pages: Column, max_show: int = R.DEFAULTS.page_list_max) -> Column:
    """``1, 2, 3`` and, past ``max_show`` entries, ``(and N more)``."""
    shown = F.array_join(F.slice(pages, 1, max_show), ", ")
    return F.when(F.size(pages) > max_show,
                  F.format_string("%s (and %d more)", shown, F.size(pages) - max_show)
                  ).otherwise(shown)


def first_examples(items: Column, n: int = R.DEFAULTS.citation_examples) -> Column:
    shown = F.array_join(F.slice(items, 1, n), "; ")
    return F.when(F.size(items) > n,
                  F.format_string("%s (and %d more)", shown, F.size(items) - n)).otherwise(shown)


def pages_from_message(message: Column, details: Column, passed: Column) -> Column:
    """Page numbers named by a failed result's message, else by its details.

    Digits beyond an integer are no page number.
    """
    def found(text):
        on = F.regexp_extract(text, rx(r"\bon(?:\s+pages?)?\s+([\d,\s]+)"), 1)
        on_pages = all_matches(on, r"\d+")
        named = all_matches(F.regexp_extract(text, rx(r"pages?[:\s]+([\d,\s]+)", "i"), 1), r"\d+")
        picked = F.when(F.size(on_pages) > 0, on_pages).when(F.size(named) > 0, named)
        return F.filter(F.transform(picked, lambda n: n.try_cast("int")), lambda n: n.isNotNull())

    return F.when(~passed, F.coalesce(found(message), found(details)))


def text_parts(col: Column, n: int = R.DEFAULTS.judge_text_chars) -> Column:
    """The whole text in pieces of at most ``n`` characters; an empty text is one piece."""
    text = F.coalesce(col, F.lit(""))
    return F.when(text == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{n}}}"), F.lit(0)))


def content_hash(col: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col.cast("binary"), 256))


def report_id(doc_id: Column, run_id: str) -> Column:
    """Twelve hex digits, the same for the same document and run."""
    return F.substring(F.sha2(F.concat(doc_id.cast("string"), F.lit(":" + run_id)), 256), 1, 12)
