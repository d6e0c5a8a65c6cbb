"""Reporter and neutral citations: positions, context windows, band anti join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens import rules as R
from docketlens.functions import text as X

_REPORTER_LITERAL = "N.W."  # part of every reporter citation
_SHORTEST_REPORTER_CITE = 10  # characters of "1 N.W.2d 1"


#: Characters that citations consist of; a text may be cut before any other one.
_CITE_CHARS = r"[\d\sNWDAp.d]"
#: Characters of a text that one task searches, about.
PART_CHARS = 1 << 20


def search_parts(text: Column, n: int = PART_CHARS, inside: str = _CITE_CHARS) -> Column:
    """The text in parts of ``n`` characters or a little more, cut only where no match can lie across.

    A part goes on while its characters could belong to a match (``inside``), so every
    match lies in the one part that it starts in, whatever ``n`` is.
    """
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.length(whole) <= n, F.array(whole)).otherwise(
        F.regexp_extract_all(whole, F.lit(X.rx(f".{{1,{n}}}+{inside}*+", "s")), F.lit(0)))


def _spread(parts: DataFrame, many: Column) -> DataFrame:
    """Rows of texts that have several parts go to tasks of their own; the others stay where they are."""
    return parts.filter(~many).unionByName(parts.filter(many).repartition("doc_id", "part_no"))


def citation_positions(docs: DataFrame, pattern: str, flags: str = "", part_chars: int = PART_CHARS) -> DataFrame:
    """WIN-4: 0-based start and end offset of each match of ``pattern``.

    A long text is searched in parts by several tasks.  Each part is cut around its
    matches; only the lengths of the pieces go on, as one narrow row for each match and
    one for each part's end, and a running sum over them gives the offsets.
    """
    parts = docs.select("doc_id", F.posexplode(search_parts(F.col("full_text"), part_chars)).alias("part_no", "part"))
    parts = _spread(parts.withColumn("many", F.col("part_no") > 0), F.col("many"))
    text = F.col("part")
    cut = parts.select(
        "doc_id", "part_no", X.all_matches(text, pattern, flags).alias("hits"),
        F.transform(F.split(text, X.rx(pattern, flags), -1), F.length).alias("gaps"))
    steps = cut.select("doc_id", "part_no", F.posexplode(F.arrays_zip("gaps", "hits")).alias("hit_no", "s"))
    steps = steps.select("doc_id", "part_no", "hit_no", F.col("s.hits").alias("hit"),
                         (F.col("s.gaps") + F.coalesce(F.length("s.hits"), F.lit(0))).alias("step"))
    order = Window.partitionBy("doc_id").orderBy("part_no", "hit_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = steps.withColumn("end", F.sum("step").over(order).cast("int")).filter("hit is not null")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("part_no", "hit_no")) - 1
    return placed.select("doc_id", number.alias("hit_no"), "hit", (F.col("end") - F.length("hit")).alias("start"), "end")


def nearby_citation_anti(cites_a: DataFrame, cites_b: DataFrame,
                         distance: int = R.DEFAULTS.citation_window_chars) -> DataFrame:
    """JN-5: rows of ``cites_a`` with no row of ``cites_b`` close by.

    A band left anti join on ``(doc_id, position)``: ``b`` must lie wholly
    inside ``[a.start - distance, a.end + distance]``.  Positions are cut into
    buckets of the band's width, so the equi-join key is (document, bucket) and
    a document with very many citations spreads over many keys.  Each ``a`` row
    visits the few buckets its band touches and meets only partners in its band.
    """
    width = 2 * distance
    a = cites_a.select(
        "*", F.col("start").alias("a_start"), F.col("end").alias("a_end"),
        F.explode(F.sequence(
            F.floor(F.greatest(F.col("start") - distance, F.lit(0)) / width),
            F.floor((F.col("end") + distance) / width))).alias("bucket"))
    b = cites_b.select(
        "doc_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"),
        F.floor(F.col("start") / width).alias("bucket"))
    near = a.alias("a").join(
        b.distinct().alias("b"),
        (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.bucket") == F.col("b.bucket"))
        & (F.col("b.b_start") >= F.col("a.a_start") - distance)
        & (F.col("b.b_end") <= F.col("a.a_end") + distance), "left")
    # A band holds few citations, as each has a least length; every row of a is
    # flagged in the same pass and met once.
    kept = [F.first(f"a.{c}").alias(c) for c in cites_a.columns if c not in ("doc_id", "start")]
    return near.groupBy(F.col("a.doc_id"), F.col("a.a_start").alias("start")).agg(
        *kept, F.count("b.b_start").alias("near")).filter("near = 0").drop("near").select(*cites_a.columns)


def _with_sides(pieces: Column, end: Column | None, at_end: bool) -> Column:
    """Pieces of a part with the text beside the part joined to the outermost one."""
    if end is None:
        return pieces
    last = F.size(pieces) - 1
    return F.transform(pieces, lambda p, i: F.when(
        i == (last if at_end else 0), F.concat(p, end) if at_end else F.concat(end, p)).otherwise(p))


def with_citation_pieces(df: DataFrame, text: str, keep: list[str], th: R.Thresholds = R.DEFAULTS,
                         before: Column | None = None, after: Column | None = None) -> DataFrame:
    """``keep``, reporter citations of a text and what lies between them, edges only.

    ``before`` and ``after`` are the text on both sides when ``text`` is a part.

    ``tails`` and ``heads`` hold the end and the start of every piece between
    two citations, as long as the window.  They are columns of their own so that
    the text is searched once per document, not once per citation; and so are the
    pieces, because both ends are taken of them.
    """
    span = F.lit(th.citation_window_chars)
    raw = F.col(text)
    none = F.array().cast("array<string>")
    found = df.withColumn("hits", F.when(
        raw.contains(_REPORTER_LITERAL), X.all_matches(raw, R.REPORTER_CITE)).otherwise(none))
    cut = found.withColumn("pieces", F.when(
        F.size("hits") > 0, F.split(raw, X.rx(R.REPORTER_CITE), -1)).otherwise(none))
    pieces = F.col("pieces")
    return cut.select(
        *keep, "hits",
        F.transform(_with_sides(pieces, before, False), lambda p: F.right(p, span)).alias("tails"),
        F.transform(_with_sides(pieces, after, True), lambda p: F.left(p, span)).alias("heads"))


def missing_neutral(th: R.Thresholds = R.DEFAULTS) -> Column:
    """Citations of :func:`with_citation_pieces` without a neutral one around them.

    The surroundings are cut exactly at the window's edge on both sides.  As a
    citation has a least length, a bounded number of neighbouring pieces always
    covers the window, so the work grows linearly with the citations.
    """
    span = F.lit(th.citation_window_chars)
    reach = th.citation_window_chars // _SHORTEST_REPORTER_CITE + 1
    hits, tails, heads = F.col("hits"), F.col("tails"), F.col("heads")

    def joined(left: Column, right: Column) -> Column:
        return F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), "")

    def around(hit: Column, i: Column) -> Column:
        # i counts from 0; array positions count from 1: tail i+1 precedes hit i+1.
        first = F.greatest(i - reach, F.lit(0))
        before = F.concat(
            joined(F.slice(tails, first + 1, i - first), F.slice(hits, first + 1, i - first)),
            F.element_at(tails, i + 1))
        after = F.concat(
            F.element_at(heads, i + 2),
            joined(F.slice(hits, i + 2, F.lit(reach)), F.slice(heads, i + 3, F.lit(reach))))
        return F.concat(F.right(before, span), hit, F.left(after, span))

    judged = F.transform(hits, lambda h, i: F.struct(
        h.alias("hit"), X.matches(around(h, i), R.NEUTRAL_CITE, "").alias("near")))
    return F.transform(F.filter(judged, lambda j: ~j["near"]), lambda j: j["hit"])


def with_missing_citations(df: DataFrame, text: str = "full_text",
                           th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """Adds ``reporter_cites`` and ``missing_cites``; drops the text.

    CIT-001's facts: one projection per document, no shuffle, no positions.
    """
    others = [c for c in df.columns if c != text]
    return with_citation_pieces(df, text, others, th).select(
        *others, F.size("hits").cast("long").alias("reporter_cites"),
        missing_neutral(th).alias("missing_cites"))


def missing_citations_by_part(docs: DataFrame, text: str = "full_text", part_chars: int = PART_CHARS,
                              th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """CIT-001's facts of texts of any length: (doc_id, reporter_cites, missing_cites).

    Texts are cut like in :func:`citation_positions`; a part carries the window's width of
    its neighbours' text, and counts the citations that are its own.  So a giant text is
    searched by many tasks, and a window across a border is seen whole.
    """
    span = th.citation_window_chars
    parts = search_parts(F.col(text), max(part_chars, span))  # a neighbour is then as wide as the window
    rows = docs.select("doc_id", parts.alias("parts"))
    with_sides = F.transform("parts", lambda p, i: F.struct(
        p.alias("own"), F.coalesce(F.right(F.get("parts", i - 1), F.lit(span)), F.lit("")).alias("before"),
        F.coalesce(F.left(F.get("parts", i + 1), F.lit(span)), F.lit("")).alias("after")))
    # The last neighbour may be shorter than the window, but nothing follows it.
    rows = rows.select("doc_id", F.posexplode(with_sides).alias("part_no", "p")).select("doc_id", "part_no", "p.*")
    rows = _spread(rows.withColumn("many", (F.col("part_no") > 0) | (F.col("after") != "")), F.col("many"))
    found = with_citation_pieces(rows, "own", ["doc_id", "part_no"], th, F.col("before"), F.col("after")).select(
        "doc_id", "part_no", F.size("hits").cast("long").alias("n"), missing_neutral(th).alias("missing"))
    lists = F.array_sort(F.collect_list(F.when(F.size("missing") > 0, F.struct("part_no", "missing"))))
    return found.groupBy("doc_id").agg(
        F.sum("n").alias("reporter_cites"), F.flatten(F.transform(lists, lambda x: x["missing"])).alias("missing_cites"))
