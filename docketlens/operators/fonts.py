"""Font operators: span classes, font statistics, undersized text per page.

Spans are rolled up once to a page histogram (``font_histogram``): a few rows
per page whatever the number of spans, built with map-side combining.  Every
later font question reads the histogram, never the spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens import rules as R
from docketlens.functions import text as X
from docketlens.operators.layout import PAGE, span_features, visible_spans

# Spans of one document meet its facts on so many keys.
SALTS = 8


def style_class(flags: Column) -> Column:
    """PRJ-3: bit 1 is italic, bit 4 is bold."""
    italic, bold = flags.bitwiseAND(2) != 0, flags.bitwiseAND(16) != 0
    return (F.when(italic & bold, "bold-italic").when(italic, "italic")
            .when(bold, "bold").otherwise("roman"))


def edge_zone(th: R.Thresholds = R.DEFAULTS) -> Column:
    """Baseline in the top or bottom tenth of the page, both ends included."""
    height = F.col("height_pt") / 72.0 * 72.0
    return (F.col("origin_y") <= height * th.edge_zone_share) | (
        F.col("origin_y") >= height * 0.90)


def span_position_class(th: R.Thresholds = R.DEFAULTS) -> Column:
    """What a span is before its size is compared with the document's."""
    superscript = F.col("flags").bitwiseAND(1) != 0
    short = (F.col("chars") <= th.superscript_max_chars) & (F.col("size") < th.small_font_limit)
    return (
        F.when(edge_zone(th), "header_footer")
        .when(superscript | short, "superscript")
        .when(F.col("capitals"), "capitals")
        .otherwise("body")
    )


def final_class_sql(row: str = "", th: R.Thresholds = R.DEFAULTS) -> str:
    """Class of a span or run once the document's body size is known.

    Capitals whose size ratio lies in the band are small capitals; without a
    body size they are body text.  ``row`` prefixes the fields of the run.
    """
    ratio = f"{row}size / predominant_font_size"
    return (f"case when {row}position_class <> 'capitals' then {row}position_class "
            f"when predominant_font_size > 0 and {ratio} between {th.small_caps_ratio_low!r}D "
            f"and {th.small_caps_ratio_high!r}D then 'small_caps' else 'body' end")


def final_class(th: R.Thresholds = R.DEFAULTS) -> Column:
    return F.expr(final_class_sql("", th))


def undersized(size: Column, th: R.Thresholds = R.DEFAULTS) -> Column:
    """PRJ-6: strictly below the smallest accepted size."""
    return size < th.small_font_limit


def spans_with_doc_stats(spans: DataFrame, doc_stats: DataFrame) -> DataFrame:
    """JN-4: body size of the document on each of its spans.

    Page height already travels with the span.  The join is salted by page: a
    document with very many spans is spread over ``SALTS`` keys.
    """
    facts = doc_stats.select("doc_id", "predominant_font_size",
                             F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = spans.withColumn("salt", F.pmod(F.col("page_no"), F.lit(SALTS)))
    return salted.join(facts, ["doc_id", "salt"], "left").drop("salt")


def classify_small_spans(spans: DataFrame, doc_stats: DataFrame,
                         th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """PRJ-5: class of every visible undersized span."""
    small = visible_spans(spans).filter(undersized(F.col("size"), th)).withColumn(
        "capitals", X.is_all_uppercase(F.col("text"))).withColumn(
        "position_class", span_position_class(th))
    return spans_with_doc_stats(small, doc_stats).withColumn(
        "span_class", final_class(th)).drop("position_class", "capitals")


def place_in_page() -> Column:
    """Reading order inside a page as one number, so that hashing can take its minimum.

    Ten decimal digits for each ordinal hold every integer.
    """
    step = "10000000000"

    def part(name: str) -> str:
        return f"cast(coalesce({name}, 0) as decimal(10,0))"

    return F.expr(f"cast({part('block_no')} * {step}{step[1:]} + {part('line_no')} * {step} "
                  f"+ {part('span_no')} as decimal(38,0))")


def font_histogram(spans: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """Visible spans per page by font, size, style and position class.

    Rows without a page are left out here and not by a later join, so that all
    branches over the histogram share one plan and Spark reuses its exchange.
    """
    visible = F.expr("visible and doc_id is not null and page_no is not null")
    keyed = span_features(spans, th).filter(visible).select(
        *PAGE, "font", "size", style_class(F.col("flags")).alias("style"),
        span_position_class(th).alias("position_class"), "chars",
        place_in_page().alias("place"))
    return keyed.groupBy(*PAGE, "font", "size", "style", "position_class").agg(
        F.count(F.lit(1)).alias("spans"), F.sum("chars").alias("chars"),
        F.min("place").alias("place")).withColumn("first_seen", F.struct("page_no", "place"))


def first_seen_mode(df: DataFrame, keys: list[str], value: str, weight: str = "spans",
                    first: str = "first_seen", out: str | None = None) -> DataFrame:
    """WIN-2: most frequent value per key, ties to the one met first.

    Two combining aggregations instead of a ranking window, so no key's rows
    have to be sorted in one task.
    """
    counts = df.groupBy(*keys, value).agg(
        F.sum(weight).alias("n"), F.min(first).alias("first"))
    return counts.groupBy(*keys).agg(
        F.min_by(value, F.struct((-F.col("n")).alias("rank"), "first")).alias(out or value))


def doc_font_facts(histogram: DataFrame) -> DataFrame:
    """Font and style facts of each document, all from one pass.

    Each histogram row votes for its size, its font and, after the cover, its
    style.  The votes are counted together, ties going to the value met first.
    """
    votes = F.expr("""explode(array(
        struct('size' as kind, string(round(size, 1)) as value, size > 0 as counts),
        struct('font' as kind, font as value, font <> '' as counts),
        struct('style' as kind, style as value, page_no > 0 as counts))) as vote""")
    counted = histogram.select("doc_id", "size", "spans", "first_seen", votes).filter(
        "vote.counts").groupBy("doc_id", "vote.kind", "vote.value").agg(
        F.sum("spans").alias("n"), F.min("first_seen").alias("first"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"))
    winner = "min_by(value, struct(-n, first)) filter (where kind = '{}')"
    spans_of = "coalesce(sum(n) filter (where kind = 'style' and value = '{}'), 0L)"
    return counted.groupBy("doc_id").agg(
        F.expr(f"double({winner.format('size')})").alias("predominant_font_size"),
        F.expr(winner.format("font")).alias("predominant_font"),
        F.min("smallest").alias("min_font_size"),
        F.expr(winner.format("style")).alias("dominant_style"),
        F.expr("sum(n) filter (where kind = 'style')").alias("style_spans"),
        *[F.expr(spans_of.format(style)).alias(name) for style, name in (
            ("roman", "roman_spans"), ("italic", "italic_spans"), ("bold", "bold_spans"),
            ("bold-italic", "bold_italic_spans"))],
    ).withColumn("roman_share", F.col("roman_spans") / F.col("style_spans"))


def doc_font_stats(histogram: DataFrame) -> DataFrame:
    """AGG-3: predominant size and font (by number of spans) and smallest size."""
    return doc_font_facts(histogram).select(
        "doc_id", "predominant_font_size", "predominant_font", "min_font_size")


def style_mix(histogram: DataFrame) -> DataFrame:
    """AGG-11: spans per style on body pages and the most common style."""
    return doc_font_facts(histogram).filter("style_spans > 0").select(
        "doc_id", "style_spans", "roman_spans", "italic_spans", "bold_spans",
        "bold_italic_spans", "dominant_style", "roman_share")


def page_font_counts(histogram: DataFrame, doc_stats: DataFrame,
                     th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """AGG-8: characters per page, in all and undersized by class."""
    small = undersized(F.col("size"), th)
    kind = final_class(th)
    typed = spans_with_doc_stats(histogram, doc_stats).select(
        *PAGE, "size", "chars", small.alias("small"), kind.alias("kind"))

    def chars_of(name: str) -> Column:
        return F.sum(F.when(F.col("small") & (F.col("kind") == name), F.col("chars"))
                     .otherwise(0)).alias(f"{name}_chars")

    return typed.groupBy(*PAGE).agg(
        F.sum("chars").alias("total_chars"), chars_of("body"), chars_of("header_footer"),
        chars_of("superscript"), chars_of("small_caps"),
        F.min(F.when(F.col("small"), F.col("size"))).alias("min_small_size"),
    ).filter("body_chars + header_footer_chars + superscript_chars + small_caps_chars > 0")


def small_caps_moved(th: R.Thresholds = R.DEFAULTS) -> Column:
    """Small capitals above the page share, outside the customary pages."""
    share = F.col("small_caps_chars") / F.col("total_chars") * 100
    return F.coalesce(~F.col("conventional") & (F.col("small_caps_chars") > 0)
                      & (share > th.small_caps_page_pct), F.lit(False))


def move_small_caps(df: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    caps = F.col("small_caps_chars")
    return (
        df.withColumn("moved", small_caps_moved(th))
        .withColumn("body_chars", F.col("body_chars") + F.when(F.col("moved"), caps).otherwise(0))
        .withColumn("small_caps_chars", F.when(F.col("moved"), 0).otherwise(caps))
        .drop("moved")
    )


def reclassify_small_caps(counts: DataFrame, pages: DataFrame,
                          th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """AGG-9: many small capitals on an ordinary page count as body text.

    ``pages`` brings the ``conventional`` flag of PRJ-7.
    """
    joined = counts.join(pages.select(*PAGE, "conventional"), PAGE)
    return move_small_caps(joined, th).drop("conventional")


def page_runs(histogram: DataFrame) -> DataFrame:
    """The histogram as one row per page; a page has few distinct kinds of spans."""
    return histogram.groupBy(*PAGE).agg(F.collect_list(F.struct(
        "font", "size", "style", "position_class", "spans", "chars", "first_seen")).alias("runs"))


def unfold_runs(runs: DataFrame) -> DataFrame:
    return runs.select(*PAGE, F.inline("runs"))


def run_count_columns(th: R.Thresholds = R.DEFAULTS) -> dict[str, Column]:
    """AGG-8 over the ``runs`` of a page row that knows the document's body size."""
    small = f"r.size < {th.small_font_limit!r}D"
    kind = final_class_sql("r.", th)

    def chars(condition: str) -> Column:
        return F.expr(f"aggregate(filter(runs, r -> {condition}), 0L, (n, r) -> n + r.chars)")

    return {
        "total_chars": chars("true"),
        **{f"{name}_chars": chars(f"{small} and {kind} = '{name}'")
           for name in ("body", "header_footer", "superscript", "small_caps")},
        "min_small_size": F.expr(f"array_min(transform(filter(runs, r -> {small}), r -> r.size))"),
    }
