"""Rule manifest, freshness of rule texts, effective dates of rule pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens import rules as R
from docketlens.functions import text as X


def effective_dates(pages: DataFrame) -> DataFrame:
    """SRC-5: the first effective date on each rule page, null if not a date."""
    found = F.regexp_extract("html", X.rx(R.EFFECTIVE_DATE), 1)
    return pages.select("page_id", "rule", F.try_to_date(
        F.nullif(found, F.lit("")), "M/d/yyyy").alias("effective_date"))


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """JN-6: manifest rows whose file is missing or has another hash."""
    actual = files.select("file_name", F.col("content_hash").alias("actual_hash"))
    status = F.when(F.col("actual_hash").isNull(), "missing").when(
        F.col("actual_hash") != F.col("expected_hash"), "modified")
    return manifest.join(actual, "file_name", "left").withColumn("status", status).filter(
        F.col("status").isNotNull()).select("file_name", "status")


def stale_rules(bundled: DataFrame, live: DataFrame) -> DataFrame:
    """JN-7: rules whose live effective date is known and differs."""
    return bundled.filter(F.col("bundled_date").isNotNull()).join(
        live.filter(F.col("live_date").isNotNull()), "rule").filter(
        F.col("live_date") != F.col("bundled_date"))


def needs_refresh(last_checked: Column, today: Column,
                  max_age_days: int = R.DEFAULTS.rule_log_max_age_days) -> Column:
    """SCL-11: due when the last check is too old, missing or not a date."""
    when = F.try_to_date(last_checked, "yyyy-MM-dd")
    return F.coalesce(F.date_diff(today, when) >= max_age_days, F.lit(True))


def rule_warnings(log: DataFrame, fresh: DataFrame, today: Column) -> DataFrame:
    """Cached warnings while they are recent, else the fresh ones."""
    return log.join(fresh.select("rule", F.col("warning").alias("fresh_warning")),
                    "rule", "left").select(
        "rule", F.when(needs_refresh(F.col("last_checked"), today), F.col("fresh_warning"))
        .otherwise(F.col("warning")).alias("warning"))
