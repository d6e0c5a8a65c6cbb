"""Page geometry from spans: margins, baseline gaps, printed page numbers.

A span row carries the size of its page (``width_pt``, ``height_pt``), so zone
tests need no join.  Aggregates are keyed by ``(doc_id, page_no)`` or finer and
combine on the map side: a document with very many spans spreads over as many
tasks as it has pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens import rules as R
from docketlens.functions import text as X

PAGE = ["doc_id", "page_no"]
# Length of the longest text whose block could still be a page number is not
# fixed, so candidates are chosen by character class, never by length.
_NUMERAL_CHARS = r"^[-–—\s\divxlcdm\x1c-\x1f]*$"


def page_geometry(pages: DataFrame) -> DataFrame:
    """PRJ-1: points to inches."""
    return pages.withColumn("width_in", F.col("width_pt") / 72.0).withColumn(
        "height_in", F.col("height_pt") / 72.0)


def flatten_layout(layout: DataFrame) -> DataFrame:
    """SRC-2: nested page layout to one row per span, with all ordinals.

    Blocks without lines and lines without spans stay as rows with null spans,
    because an empty line breaks the chain of baseline gaps.
    """
    pages = layout.select("doc_id", F.explode("pages").alias("p"))
    blocks = pages.select(
        "doc_id", F.col("p.page_no"), F.col("p.width_pt"), F.col("p.height_pt"),
        F.posexplode("p.blocks").alias("block_no", "b"))
    lines = blocks.select(
        "doc_id", "page_no", "width_pt", "height_pt", "block_no",
        F.col("b.type").alias("block_type"), F.col("b.bbox").alias("bbox"),
        F.posexplode_outer("b.lines").alias("line_no", "l"))
    spans = lines.select(
        "doc_id", "page_no", "width_pt", "height_pt", "block_no", "block_type", "bbox",
        "line_no", F.posexplode_outer("l.spans").alias("span_no", "s"))
    return spans.select(
        "doc_id", "page_no", "width_pt", "height_pt", "block_no", "block_type",
        F.get("bbox", F.lit(0)).alias("bx0"), F.get("bbox", F.lit(1)).alias("by0"),
        F.get("bbox", F.lit(2)).alias("bx1"), F.get("bbox", F.lit(3)).alias("by1"),
        "line_no", "span_no",
        F.coalesce("s.text", F.lit("")).alias("text"), F.col("s.font").alias("font"),
        F.col("s.size").alias("size"), F.coalesce("s.flags", F.lit(0)).alias("flags"),
        F.coalesce(F.get("s.origin", F.lit(1)), F.col("height_pt") / 2).alias("origin_y"))


def layout_pages(layout: DataFrame) -> DataFrame:
    """One row per page with its size and text."""
    return layout.select("doc_id", F.explode("pages").alias("p")).select(
        "doc_id", "p.page_no", "p.width_pt", "p.height_pt", "p.text")


def span_features(spans: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """Narrow form of the spans of text blocks: the text becomes four facts.

    ``visible`` and ``chars`` describe the trimmed text, ``capitals`` is PRJ-4,
    ``numeral`` keeps the raw text only where a page number could stand.
    Store this once (see ``plans.stages``): every later step reads a few
    fixed-width columns and never the text again.
    """
    if "capitals" in spans.columns:
        return spans
    raw = F.col("text")
    numeral = in_bottom_zone(th) & X.matches(raw, _NUMERAL_CHARS, "i")
    keyed = F.col("doc_id").isNotNull() & F.col("page_no").isNotNull()
    return spans.filter((F.col("block_type") == 0) & keyed).select(
        *[c for c in spans.columns if c not in ("text", "block_type")],
        X.strip_length(raw).alias("chars"), X.is_all_uppercase(raw).alias("capitals"),
        F.when(numeral, raw).alias("numeral")).withColumn("visible", F.col("chars") > 0)


def visible_spans(spans: DataFrame) -> DataFrame:
    """PRJ-2: spans of text blocks with visible text, trimmed and measured."""
    trimmed = X.strip(F.col("text"))
    return (
        spans.filter(F.col("block_type") == 0)
        .withColumn("text", trimmed).filter(F.col("text") != "")
        .withColumn("chars", F.length("text"))
    )


def in_bottom_zone(th: R.Thresholds = R.DEFAULTS) -> Column:
    return F.col("by0") >= F.col("height_pt") * th.bottom_zone_share


def line_rows(spans: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """One row per line of a text block, all lines of a page in one partition.

    ``y`` is the highest visible baseline, null if nothing is visible.  The
    shuffle key is the page, the finest grain that holds a chain of lines, and
    the rows are fixed-width but for the few numerals of the bottom zone: only
    there can a page number stand.
    """
    bottom = in_bottom_zone(th)
    numeral = F.when(bottom, F.struct("span_no", "numeral"))
    line = [*PAGE, "block_no", "line_no"]

    def extent(*also: Column) -> list[Column]:
        return [*[F.min(c).alias(c) for c in ("y", "bx0", "by0")], *[F.max(c).alias(c) for c in ("bx1", "by1", "bottom")], *also]

    # First by hashing, with the piece as a key: the list then sees a row for each line and
    # numeral.  Made of all spans, it would have every span sorted.
    combined = (
        span_features(spans, th)
        .select(*PAGE, "block_no", F.coalesce("line_no", F.lit(-1)).alias("line_no"),
                F.when(F.col("visible"), F.col("origin_y")).alias("y"),
                "bx0", "by0", "bx1", "by1", bottom.alias("bottom"), numeral.alias("piece"))
        .repartition(*PAGE)
        .groupBy(*line, "piece").agg(*extent(F.count(F.lit(1)).cast("int").alias("n")))
    )
    pieces = F.when(F.col("piece").isNotNull(), F.array_repeat("piece", F.col("n")))
    return combined.groupBy(*line).agg(*extent(F.array_sort(F.flatten(F.collect_list(pieces))).alias("pieces")))


def line_gap(th: R.Thresholds = R.DEFAULTS) -> Column:
    """Distance to the previous line's baseline if it is a plausible one."""
    order = Window.partitionBy(*PAGE).orderBy("block_no", "line_no")
    gap = F.col("y") - F.lag("y").over(order)
    return F.when((gap > th.gap_low_pt) & (gap < th.gap_high_pt), gap)


def baseline_gaps(spans: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """WIN-1: distance between consecutive baselines, plausible ones only.

    One lag over all lines of the page's text blocks covers gaps inside a block
    and between blocks.  A line without visible text, or a block without lines,
    is a null in the chain and ends it on both sides.
    """
    return line_rows(spans, th).withColumn("gap", line_gap(th)).filter(
        F.col("gap").isNotNull()).select(*PAGE, "block_no", "line_no", "gap")


def block_rows(spans: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """Text blocks with their box, their gaps and their page number, if they are one.

    A block of the bottom zone is a page number when its whole text reads as a
    number.  Pages stay where ``line_rows`` put them.
    """
    lines = line_rows(spans, th).withColumn("gap", line_gap(th))
    pieces = F.flatten(F.transform(
        F.array_sort(F.collect_list(F.when(F.col("bottom"), F.struct("line_no", "pieces")))),
        lambda line: line["pieces"]))
    blocks = lines.groupBy(*PAGE, "block_no").agg(
        F.min("bx0").alias("bx0"), F.min("by0").alias("by0"),
        F.max("bx1").alias("bx1"), F.max("by1").alias("by1"),
        F.collect_list("gap").alias("gaps"), pieces.alias("pieces"))
    whole = (F.size("pieces") > 0) & ~F.exists("pieces", lambda p: p["numeral"].isNull())
    label = F.when(whole, X.strip(F.array_join(
        F.transform("pieces", lambda p: p["numeral"]), "")))
    is_number = X.matches(F.col("label"), R.PAGE_NUMBER_DIGITS, "") | X.matches(
        F.col("label"), R.PAGE_NUMBER_ROMAN, "i")
    return blocks.withColumn("label", label).select(
        *PAGE, "block_no", "bx0", "by0", "bx1", "by1", "gaps",
        F.when(is_number, F.col("label")).alias("page_number_text"))


def page_number_blocks(spans: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """PRJ-8: the first page-number block of each page that has one."""
    numbers = block_rows(spans, th).filter(F.col("page_number_text").isNotNull())
    return numbers.groupBy(*PAGE).agg(
        F.min_by("page_number_text", "block_no").alias("page_number_text")
    ).withColumn("has_page_number", F.lit(True))


def box_columns() -> list[Column]:
    """Extent of the blocks of a page that are not page numbers."""
    def side(column: str) -> Column:
        return F.when(F.col("page_number_text").isNull(), F.col(column))

    return [F.min(side("bx0")).alias("min_x"), F.min(side("by0")).alias("min_y"),
            F.max(side("bx1")).alias("max_x"), F.max(side("by1")).alias("max_y")]


def margin_columns() -> list[Column]:
    """Margins in inches from the extent of the text; page size without text."""
    def margin(inner: str, full: str, name: str) -> Column:
        return F.expr(
            f"if(greatest(max_x, 0D) > least(min_x, width_pt) and "
            f"greatest(max_y, 0D) > least(min_y, height_pt), {inner}, {full}) / 72D").alias(name)

    return [
        margin("least(min_x, width_pt)", "width_pt", "left_in"),
        margin("width_pt - greatest(max_x, 0D)", "width_pt", "right_in"),
        margin("least(min_y, height_pt)", "height_pt", "top_in"),
        margin("height_pt - greatest(max_y, 0D)", "height_pt", "bottom_in"),
    ]


def page_margins(spans: DataFrame, pages: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """AGG-1: the four margins of every page; page numbers count for none of them."""
    boxes = block_rows(spans, th).groupBy(*PAGE).agg(*box_columns())
    return pages.select(*PAGE, "width_pt", "height_pt").join(boxes, PAGE, "left").select(
        *PAGE, *margin_columns())


def page_line_spacing(spans: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """AGG-2: exact median gap of each page that has one."""
    return baseline_gaps(spans, th).groupBy(*PAGE).agg(F.median("gap").alias("line_spacing"))


def page_block_facts(spans: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """Per page: extent, page number and median gap, from one pass over its lines."""
    gaps = F.array_sort(F.flatten(F.collect_list("gaps")))
    return block_rows(spans, th).groupBy(*PAGE).agg(
        *box_columns(), gaps.alias("gaps"),
        F.min_by("page_number_text", F.when(F.col("page_number_text").isNotNull(),
                                            F.col("block_no"))).alias("page_number_text")
    ).withColumn("line_spacing", middle_of("gaps")).drop("gaps")


# -- the same facts inside the row of a nested page --------------------------

def nested_pages(layout: DataFrame) -> DataFrame:
    """One row per page with its blocks still nested; nothing is shuffled."""
    return layout.select("doc_id", F.explode("pages").alias("p")).select(
        "doc_id", "p.page_no", "p.width_pt", "p.height_pt", "p.text", "p.blocks").filter(
        F.col("doc_id").isNotNull() & F.col("page_no").isNotNull())


def nested_blocks(pages: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """Adds ``text_blocks``: ordinal, box, baseline of each line, and the page number a block is.

    A baseline is that of the line's highest visible span, null if none is visible;
    a block without lines holds one null, which ends the chain of gaps like a blank
    line does.
    """
    def baseline(line: Column) -> Column:
        seen = F.filter(line["spans"], lambda s: X.strip(F.coalesce(s["text"], F.lit(""))) != "")
        return F.array_min(F.transform(seen, lambda s: F.coalesce(F.get(s["origin"], F.lit(1)), F.col("height_pt") / 2)))

    def label(block: Column) -> Column:
        texts = F.transform(block["lines"], lambda line: F.transform(line["spans"], lambda s: s["text"]))
        # Joining skips nulls, of spans and of lines.
        return X.strip(F.array_join(F.transform(texts, lambda t: F.array_join(t, "")), ""))

    def facts(block: Column, number: Column) -> Column:
        side = [F.get(block["bbox"], F.lit(i)) for i in range(4)]
        ys = F.transform(block["lines"], baseline)
        no_line = F.array(F.lit(None).cast("double"))
        return F.struct(
            number.alias("block_no"), *[c.alias(n) for c, n in zip(side, ("bx0", "by0", "bx1", "by1"), strict=True)],
            F.when(F.size(ys) > 0, ys).otherwise(no_line).alias("ys"),
            F.when(side[1] >= F.col("height_pt") * th.bottom_zone_share, label(block)).alias("label"))

    def number(block: Column) -> Column:
        is_number = X.matches(block["label"], R.PAGE_NUMBER_DIGITS, "") | X.matches(block["label"], R.PAGE_NUMBER_ROMAN, "i")
        return F.when(is_number, block["label"])

    # The ordinal counts all blocks, so it is given before those without text go.
    marked = F.transform("blocks", lambda b, i: F.struct((b["type"] == 0).alias("keep"), facts(b, i).alias("b")))
    kept = F.transform(F.filter(marked, lambda m: m["keep"]), lambda m: m["b"])
    return pages.withColumn("text_blocks", F.transform(kept, lambda b: b.withField("page_number_text", number(b))))


def _nested_gaps(th: R.Thresholds) -> Column:
    """Plausible distances between consecutive baselines of ``chain``, with the place of the lower line."""
    later = F.slice("chain", 2, F.greatest(F.size("chain"), F.lit(1)))
    steps = F.zip_with(later, "chain", lambda b, a: F.struct(
        b["block_no"].alias("block_no"), b["line_no"].alias("line_no"), (b["y"] - a["y"]).alias("gap")))
    return F.filter(steps, lambda g: (g["gap"] > th.gap_low_pt) & (g["gap"] < th.gap_high_pt))


def nested_lines(pages: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """Adds ``text_blocks`` and ``gaps``, the plausible baseline gaps in reading order."""
    chain = F.flatten(F.transform("text_blocks", lambda b: F.transform(b["ys"], lambda y, j: F.struct(
        b["block_no"].alias("block_no"), j.alias("line_no"), y.alias("y")))))
    return nested_blocks(pages, th).withColumn("chain", chain).withColumn("gaps", _nested_gaps(th)).drop("chain")


def nested_baseline_gaps(layout: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """WIN-1 inside each page's row."""
    return nested_lines(nested_pages(layout), th).select(*PAGE, F.inline("gaps"))


def nested_block_facts(layout: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """PRJ-8, AGG-1, AGG-2 inside each page's row: extent, page number, median gap, page size and text."""
    body = F.filter("text_blocks", lambda b: b["page_number_text"].isNull())
    numbers = F.filter("text_blocks", lambda b: b["page_number_text"].isNotNull())
    rows = nested_lines(nested_pages(layout), th).select(
        *PAGE, "width_pt", "height_pt", "text", body.alias("body"),
        F.get(numbers, F.lit(0))["page_number_text"].alias("page_number_text"),
        F.array_sort(F.transform("gaps", lambda g: g["gap"])).alias("gaps"))
    extent = {"min_x": (F.array_min, "bx0"), "min_y": (F.array_min, "by0"),
              "max_x": (F.array_max, "bx1"), "max_y": (F.array_max, "by1")}
    return rows.select(
        *PAGE, "width_pt", "height_pt", "text", "page_number_text",
        *[pick(F.col(f"body.{side}")).alias(name) for name, (pick, side) in extent.items()],
        middle_of("gaps").alias("line_spacing"))


def middle_of(gaps: str) -> Column:
    """Exact median of a sorted array."""
    return F.expr(f"if(size({gaps}) > 0, ({gaps}[int((size({gaps}) - 1) / 2)] + {gaps}[int(size({gaps}) / 2)]) / 2, null)")


def _where_found(rows: DataFrame, value: str) -> DataFrame:
    """Pages that have the value.

    An unfolded array, not a filter: a filter would be pushed below the steps that make
    the value, and with them written into one expression each would run many times over.
    """
    found = F.filter(F.array(value), lambda v: v.isNotNull())
    return rows.select(*PAGE, F.explode(found).alias(value))


def nested_page_numbers(layout: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """PRJ-8 from nested pages."""
    return _where_found(nested_block_facts(layout, th), "page_number_text").select(
        *PAGE, "page_number_text", F.lit(True).alias("has_page_number"))


def nested_page_margins(layout: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """AGG-1 from nested pages."""
    return nested_block_facts(layout, th).select(*PAGE, *margin_columns())


def nested_line_spacing(layout: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """AGG-2 from nested pages."""
    return _where_found(nested_block_facts(layout, th), "line_spacing")


def nested_page_facts(layout: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """``page_facts`` of nested documents: one projection, no join and no exchange."""
    rows = nested_block_facts(layout, th)
    return _page_fact_columns(page_text_facts(rows, th, keep=[
        "page_number_text", "line_spacing", "min_x", "min_y", "max_x", "max_y"]))


def page_text_facts(pages: DataFrame, th: R.Thresholds = R.DEFAULTS, keep: list[str] | None = None) -> DataFrame:
    """Narrow facts of the page text, so that the text itself is not shuffled; ``keep`` names further columns."""
    raw = F.col("text")
    widths = F.transform(F.split(raw, "\n", -1), lambda line: F.length(X.strip(line)))
    longest = F.array_max(F.filter(widths, lambda n: n >= th.density_min_line_chars))
    return pages.select(
        *PAGE, "width_pt", "height_pt", *(keep or []),
        (X.strip(raw) != "").alias("has_text"),
        longest.alias("max_line_chars"),
        conventional_page().alias("conventional"),
        X.matches(raw, R.ADDENDUM_LINE, "im").alias("has_addendum_line"))


def conventional_page() -> Column:
    """PRJ-7: cover, contents, certificate and signature pages."""
    return (F.col("page_no") == 0) | X.matches_any(
        F.col("text"), R.SMALL_CAPS_PAGE_PATTERNS, "i")


def page_facts(spans: DataFrame, pages: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """All geometry facts of a page in one row.

    Text facts and block facts meet on the page key, each shuffled once and
    already narrow.
    """
    return _page_fact_columns(page_text_facts(pages, th).join(page_block_facts(spans, th), PAGE, "left"))


def _page_fact_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        *PAGE, (F.col("width_pt") / 72.0).alias("width_in"),
        (F.col("height_pt") / 72.0).alias("height_in"), *margin_columns(),
        "line_spacing", "page_number_text", "has_text", "max_line_chars", "conventional",
        "has_addendum_line")
