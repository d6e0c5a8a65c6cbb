"""Document-level facts from pages and text, and the document type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens import rules as R
from docketlens.functions import text as X
from docketlens.operators.layout import PAGE


def cover_text(pages: DataFrame) -> DataFrame:
    """PRJ-9: text of the first page; documents without one get ''.

    Only first pages are read with their text; of the others only the id.
    """
    covers = pages.filter(F.col("page_no") == 0).groupBy("doc_id").agg(F.max("text").alias("cover_text"))
    return pages.select("doc_id").distinct().join(covers, "doc_id", "left").select(
        "doc_id", F.coalesce("cover_text", F.lit("")).alias("cover_text"))


def body_pages_only(pages: DataFrame) -> DataFrame:
    """PRJ-10: pages after the cover."""
    return pages.filter(F.col("page_no") > 0)


def doc_text(pages: DataFrame) -> DataFrame:
    """AGG-4: page texts in page order, a blank line between them.

    The result is one cell per document by definition; nothing caps its size.  For
    parts of bounded size use :func:`text_parts`; when documents are still nested,
    :func:`layout_text` needs no shuffle.
    """
    parts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("doc_id").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("full_text"))


#: Pages that are cut together: their text meets in one task.
BLOCK_PAGES = 1024


def text_parts(pages: DataFrame, n: int = R.DEFAULTS.judge_text_chars, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """AGG-4 and PRJ-13 in one: (doc_id, part_no, part_count, text), parts of ``n`` characters numbered from 1.

    The whole text of a document never stands in one cell.  Lengths alone are summed
    first, to where each block of pages begins; then page texts are shuffled once, by
    block, and cut where parts begin.  Parts within a block are joined where they are;
    only the pieces of parts that reach into another block meet in a second shuffle.
    A document without text is one empty part.
    """
    known = pages.filter(F.col("text").isNotNull()).select(
        "doc_id", "page_no", F.floor(F.col("page_no") / block_pages).cast("long").alias("block"), "text")
    # Every page counts with the blank line before it; the first one begins at -2.
    blocks = known.groupBy("doc_id", "block").agg(F.sum(F.length("text") + 2).alias("chars"))
    side = Window.partitionBy("doc_id")
    before = F.sum("chars").over(side.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("chars").over(side) - 2
    blocks = blocks.select("doc_id", "block", (F.coalesce(before, F.lit(0)) - 2).alias("begin"), "chars",
                           F.greatest(F.lit(1), F.ceil(total / n)).cast("int").alias("part_count"), total.alias("total"))
    in_block = Window.partitionBy("doc_id", "block").orderBy("page_no", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = known.join(blocks.withColumn("until", F.col("begin") + F.col("chars")), ["doc_id", "block"])
    placed = placed.withColumn("end", F.col("begin") + F.sum(F.length("text") + 2).over(in_block)).withColumn(
        "start", F.col("end") - F.length("text") - 2).filter("end > 0 and end > start")
    part = placed.withColumn("part", F.explode(F.expr(f"sequence(greatest(start, 0) div {n}, (end - 1) div {n})")))
    first, last = F.greatest(F.col("part") * n, "start", F.lit(0)), F.least((F.col("part") + 1) * n, "end")
    pieces = part.select(
        "doc_id", "block", "part", "part_count", "start", "total",
        ((F.col("part") * n >= F.greatest("begin", F.lit(0))) & (F.least((F.col("part") + 1) * n, "total") <= F.col("until"))).alias("whole"),
        F.substring(F.concat(F.lit("\n\n"), "text"), (first - F.col("start") + 1).cast("int"), (last - first).cast("int")).alias("piece"))

    def joined(rows: DataFrame, *keys: str) -> DataFrame:
        own = F.array_sort(F.collect_list(F.struct("start", "piece")))  # at most n characters
        return rows.groupBy("doc_id", *keys, "part").agg(
            F.max("part_count").alias("part_count"), F.array_join(F.transform(own, lambda p: p["piece"]), "").alias("text")
        ).select("doc_id", (F.col("part") + 1).cast("int").alias("part_no"), "part_count", "text")

    empty = pages.groupBy("doc_id").agg(F.sum(F.length("text") + 2).alias("chars")).filter("coalesce(chars, 0) <= 2").select(
        "doc_id", F.lit(1).alias("part_no"), F.lit(1).alias("part_count"), F.lit("").alias("text"))
    return joined(pieces.filter("whole"), "block").unionByName(joined(pieces.filter("not whole"))).unionByName(empty)


def layout_text(layout: DataFrame) -> DataFrame:
    """Cover and full text straight from nested documents, without a shuffle."""
    ordered = F.array_sort(F.transform(
        "pages", lambda p: F.struct(p["page_no"].alias("page_no"), p["text"].alias("text"))))
    first = F.get(F.filter(ordered, lambda p: p["page_no"] == 0), F.lit(0))["text"]
    return layout.select(
        "doc_id", "path", F.coalesce(first, F.lit("")).alias("cover_text"),
        F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("full_text"))


def word_count(docs: DataFrame) -> DataFrame:
    """AGG-5: number of words between white space."""
    return docs.select("doc_id", X.word_count(F.col("full_text")).alias("word_count"))


def page_counts(has_addendum_line: Column) -> list[Column]:
    """Aggregates behind AGG-6; pages are counted from zero."""
    start = F.min(F.when(has_addendum_line, F.col("page_no")))
    return [F.count(F.lit(1)).alias("total_pages"), start.alias("addendum_start"),
            F.coalesce(start.cast("long"), F.count(F.lit(1))).alias("body_pages")]


def doc_page_counts(pages: DataFrame) -> DataFrame:
    """AGG-6: page total, first addendum page, pages before it."""
    flagged = pages.select(
        *PAGE, X.matches(F.col("text"), R.ADDENDUM_LINE, "im").alias("has_addendum_line"))
    return flagged.groupBy("doc_id").agg(*page_counts(F.col("has_addendum_line")))


def spacing_medians(pages: DataFrame) -> DataFrame:
    """(doc_id, median_spacing, body_spacing): exact medians over all pages and over those after the cover.

    Equal spacings are counted first, so a document brings as many rows as it has
    different spacings; the middle ranks are found by running counts over these.
    Documents without a measured page have no row.
    """
    counts = pages.filter("line_spacing is not null").groupBy("doc_id", "line_spacing").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("page_no") > 0).alias("body_n"))
    side = Window.partitionBy("doc_id")
    so_far = side.orderBy("line_spacing").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({f"{c}_{name}": F.sum(c).over(window) for c in ("n", "body_n")
                                 for name, window in (("upto", so_far), ("all", side))})

    def middle(c: str) -> Column:
        lower = f"min(if({c}_upto > ({c}_all - 1) div 2 and {c}_all > 0, line_spacing, null))"
        upper = f"min(if({c}_upto > {c}_all div 2, line_spacing, null))"
        return F.expr(f"({lower} + {upper}) / 2")

    return ranked.groupBy("doc_id").agg(middle("n").alias("median_spacing"), middle("body_n").alias("body_spacing"))


def doc_double_spacing(pages: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """AGG-7: median page spacing, cover included; true when unmeasured."""
    return pages.select("doc_id").distinct().join(spacing_medians(pages), "doc_id", "left").select(
        "doc_id", "median_spacing",
        F.coalesce(F.col("median_spacing") >= th.min_double_space_pt, F.lit(True)).alias("has_double_spacing"))


def page_density(pages: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """AGG-10: characters per inch of the longest line of each body page."""
    width = F.col("width_in") - F.col("left_in") - F.col("right_in")
    per_inch = F.when(width > 0, F.col("max_line_chars") / width)
    return body_pages_only(pages).select(
        *PAGE, per_inch.alias("chars_per_inch"),
        F.coalesce(per_inch > th.max_chars_per_inch, F.lit(False)).alias("dense"))


#: Pages in one bitmap: the bits of a long but for the sign.
BITMAP_PAGES = 63


def page_bitmaps(pages: DataFrame, bad: dict[str, Column], *also: Column) -> DataFrame:
    """(doc_id, bucket, a long for each name of ``bad``): bit i stands for page ``bucket * 63 + i``.

    Bitmaps of a bucket merge before the shuffle into rows of fixed width; ``also``
    are further combining aggregates per bucket.
    """
    at = F.pmod(F.col("page_no"), F.lit(BITMAP_PAGES)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at)
    return pages.groupBy("doc_id", F.floor(F.col("page_no") / BITMAP_PAGES).cast("long").alias("bucket")).agg(
        *[F.bit_or(F.when(cond, bit).otherwise(F.lit(0).cast("long"))).alias(name) for name, cond in bad.items()], *also)


def merged_bitmaps(name: str) -> Column:
    """Aggregate over a document's buckets: its bitmaps that hold a page, in page order."""
    bits = F.col(name)
    return F.array_sort(F.collect_list(F.when(bits != 0, F.struct("bucket", bits.alias("bits")))))


def bitmap_pages(bitmaps: Column) -> Column:
    """1-based page numbers of merged bitmaps, ascending."""
    def numbers(b: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.lit(BITMAP_PAGES - 1)), lambda i: F.getbit(b["bits"], i) == 1)
        return F.transform(places, lambda i: (b["bucket"] * BITMAP_PAGES + i + 1).cast("int"))

    return F.flatten(F.transform(bitmaps, numbers))


def bad_pages(pages: DataFrame, bad: Column, value: Column) -> DataFrame:
    """AGG-12: ordered 1-based numbers of the offending pages, smallest value."""
    buckets = page_bitmaps(pages, {"bits": bad}, F.min(F.when(bad, value)).alias("least"))
    return buckets.groupBy("doc_id").agg(merged_bitmaps("bits").alias("bits"), F.min("least").alias("min_value")).select(
        "doc_id", bitmap_pages(F.col("bits")).alias("pages"), "min_value")


def classify(docs: DataFrame, fix: bool = False) -> DataFrame:
    """SCL-3 over raw cover text; adds ``brief_type``."""
    return docs.withColumn(
        "brief_type", X.classify_brief(X.normalize_cover(F.col("cover_text")), fix))


def override_type(docs: DataFrame, overrides: DataFrame) -> DataFrame:
    """JN-9: a valid type chosen by the user wins over the classifier."""
    chosen = overrides.select("doc_id", F.col("brief_type").alias("chosen"))
    valid = F.when(F.col("chosen").isin(*R.BRIEF_TYPES), F.col("chosen"))
    return docs.join(chosen, "doc_id", "left").withColumn(
        "brief_type", F.coalesce(valid, F.col("brief_type"))).drop("chosen")


def with_page_limit(docs: DataFrame) -> DataFrame:
    """JN-1: page limit, check id and rule by type; null for other types."""
    return docs.join(F.broadcast(R.page_limits(docs.sparkSession)), "brief_type", "left")


def with_cover_color(docs: DataFrame) -> DataFrame:
    """JN-2: expected cover colour by type."""
    return docs.join(F.broadcast(R.cover_colors(docs.sparkSession)), "brief_type", "left")
