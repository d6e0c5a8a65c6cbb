"""Scan of texts for docket numbers, confidential captions and binary names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlens import rules as R
from docketlens.functions import text as X


def docket_hits(docs: DataFrame) -> DataFrame:
    """Docket numbers of both courts, one row per occurrence."""
    text = F.col("full_text")
    found = F.array(
        F.struct(F.lit("supreme").alias("kind"),
                 X.all_matches(text, R.DOCKET_PATTERN).alias("hits")),
        F.struct(F.lit("district").alias("kind"),
                 X.all_matches(text, R.DISTRICT_DOCKET_PATTERN).alias("hits")))
    return docs.select("doc_id", F.explode(found).alias("f")).select(
        "doc_id", "f.kind", F.explode("f.hits").alias("hit"))


def placeholder_hits(spark) -> DataFrame:
    """Identifiers used as examples; users may append rows."""
    return spark.createDataFrame(
        [("supreme", h) for h in R.PLACEHOLDER_DOCKETS]
        + [("district", h) for h in R.PLACEHOLDER_DISTRICT_DOCKETS], "kind string, hit string")


def allowlist_except(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    """SET-2: hits that are not on the list."""
    return hits.join(allowed, [c for c in ("kind", "hit") if c in allowed.columns], "left_anti")


def distinct_hits(hits: DataFrame) -> DataFrame:
    """AGG-16: each identifier once; sort where the result is shown."""
    return hits.select("kind", "hit").distinct()


def caption_hits(docs: DataFrame, allow_pattern: str | None = None) -> DataFrame:
    """Lines with a confidential caption, example lines dropped, in text order."""
    lines = docs.select("doc_id", F.posexplode(F.split("full_text", "\n", -1))
                        .alias("line_no", "line"))
    keep = X.matches(F.col("line"), R.CAPTION_PATTERN, "i") & ~F.col("line").rlike(
        R.CAPTION_PLACEHOLDERS)
    if allow_pattern:
        keep = keep & ~F.col("line").rlike(allow_pattern)
    return lines.filter(keep)


def top_k_hits(hits: DataFrame, k: int = 5) -> DataFrame:
    """SRT-3: the first ``k`` hits of each document.

    A small ranking per document; Spark cuts each group before the shuffle.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def binary_names(files: DataFrame) -> DataFrame:
    """File names with the extension of an office document."""
    return files.filter(X.matches(F.col("file_name"), R.BINARY_NAME_PATTERN, "i"))


def sensitive_counts(docs: DataFrame, allow_pattern: str | None = None) -> DataFrame:
    """EVD-15: identifiers, captions and binary names per document, placeholders removed.

    The user's ``allow_pattern`` applies to all four scans.  ``file_name`` is
    scanned where the documents have one.
    """
    text = F.col("full_text")

    def allowed(found):
        return found.rlike(allow_pattern) if allow_pattern else F.lit(False)

    def real(pattern: str, examples: list[str]):
        return F.size(F.filter(X.all_matches(text, pattern), lambda h: ~h.isin(examples) & ~allowed(h)))

    captions = F.size(F.filter(F.split(text, "\n", -1), lambda line: X.matches(
        line, R.CAPTION_PATTERN, "i") & ~line.rlike(R.CAPTION_PLACEHOLDERS) & ~allowed(line)))
    columns = [real(R.DOCKET_PATTERN, R.PLACEHOLDER_DOCKETS).alias("dockets"),
               real(R.DISTRICT_DOCKET_PATTERN, R.PLACEHOLDER_DISTRICT_DOCKETS).alias("district_dockets"),
               captions.alias("captions")]
    if "file_name" in docs.columns:
        name = F.col("file_name")
        columns.append((X.matches(name, R.BINARY_NAME_PATTERN, "i") & ~allowed(name)).alias("binary_name"))
    return docs.select("doc_id", *columns)
