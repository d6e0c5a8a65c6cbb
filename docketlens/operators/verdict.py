"""From result rows to one recommendation per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens import rules as R


def severity_rank(severity: Column) -> Column:
    return (F.when(severity == "reject", 2).when(severity == "correction", 1)
            .when(severity == "note", 0))


def recommendation_rank(value: Column) -> Column:
    return (F.when(value == "reject", 2).when(value == "correction_letter", 1)
            .when(value == "accept", 0))


def recommendation_of(rank: Column) -> Column:
    return (F.when(rank == 2, "reject").when(rank == 1, "correction_letter")
            .otherwise("accept"))


def failed(r: Column | None = None) -> Column:
    """Of a result row, or of ``r``, a result in a document's array."""
    passed, applicable = (F.col("passed"), F.col("applicable")) if r is None else (r["passed"], r["applicable"])
    return ~passed & applicable


def failed_results(results: DataFrame) -> DataFrame:
    """PRJ-11: applicable checks that did not pass."""
    return results.filter(failed())


def passed_results(results: DataFrame) -> DataFrame:
    return results.filter(F.col("passed") & F.col("applicable"))


def inapplicable_results(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("applicable"))


def result_subset() -> Column:
    """PRJ-11: which part of a report a result belongs to, as one label."""
    return (F.when(~F.col("applicable"), "inapplicable").when(F.col("passed"), "passed")
            .otherwise(F.col("severity")))


def failures_by_severity(results: DataFrame, severity: str) -> DataFrame:
    return results.filter(failed() & (F.col("severity") == severity))


def report_counts(results: DataFrame) -> DataFrame:
    """AGG-15: checks in all, failed and passed."""
    return results.groupBy("doc_id").agg(*count_columns())


def count_columns() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_checks"), F.count_if(failed()).alias("failed_checks"),
            F.count_if(F.col("passed") & F.col("applicable")).alias("passed_checks")]


def decide(results: DataFrame, *extra: Column) -> DataFrame:
    """Verdict, reasoning and counts per document in one combining aggregation.

    ``extra`` aggregates ride along, so that reports need no second pass.  Only
    failed checks, a few dozen at most per document, are collected.
    """
    rank = F.max(F.when(failed(), severity_rank(F.col("severity"))))
    failures = F.array_sort(F.collect_list(F.when(failed(), F.struct(
        "check_id", "name", "severity"))))
    summary = results.groupBy("doc_id").agg(
        rank.alias("worst"), failures.alias("failed_list"), *count_columns(), *extra)
    return _reasoned(summary)


def decide_listed(documents: DataFrame) -> DataFrame:
    """``decide`` where each row is a document with its ``results`` in an array; nothing is shuffled."""
    def count(condition) -> Column:
        return F.size(F.filter("results", condition)).cast("long")

    failures = F.array_sort(F.transform(F.filter("results", failed), lambda r: F.struct(
        *[r[c].alias(c) for c in ("check_id", "name", "severity")])))
    summary = documents.filter(F.size("results") > 0).withColumn("failed_list", failures).withColumns({
        "worst": F.array_max(F.transform("failed_list", lambda f: severity_rank(f["severity"]))),
        "total_checks": F.size("results").cast("long"), "failed_checks": F.size("failed_list").cast("long"),
        "passed_checks": count(lambda r: r["passed"] & r["applicable"])})
    return _reasoned(summary)


def _reasoned(summary: DataFrame) -> DataFrame:
    deciding = F.expr("filter(failed_list, f -> f.severity = if(worst = 2, 'reject', 'correction'))")
    listed = "array_join(transform(deciding, f -> concat(f.check_id, ' (', f.name, ')')), '; ')"
    reasoning = F.expr(f"""case
        when worst = 2 then concat('REJECT due to ', size(deciding), ' critical failure(s): ', {listed})
        when worst = 1 then concat('Correction letter recommended due to ', size(deciding),
                                   ' issue(s): ', {listed})
        else 'All checks passed.' end""")
    return summary.withColumn("deciding", deciding).withColumns({
        "recommendation": recommendation_of(F.col("worst")), "reasoning": reasoning,
        "failed_ids": F.expr("array_join(transform(failed_list, f -> f.check_id), ',')"),
    }).drop("worst", "deciding", "failed_list")


def hard_recommendation(results: DataFrame) -> DataFrame:
    """AGG-13: worst failed severity per document, with ids in the reasoning."""
    return decide(results).select(
        "doc_id", "recommendation", "reasoning", "total_checks", "failed_checks",
        "passed_checks", "failed_ids")


def escalate(hard: DataFrame, advised: DataFrame) -> DataFrame:
    """AGG-14: an outside opinion may raise the verdict, never lower it.

    ``advised`` has one row per document: ``recommendation`` and ``reasoning``.
    It is ignored after a rule-based reject and when nothing failed; an unknown
    value counts as the rule-based verdict.
    """
    advice = advised.select("doc_id", F.col("recommendation").alias("advised"),
                            F.col("reasoning").alias("advised_reasoning"))
    hard_rank = recommendation_rank(F.col("recommendation"))
    adv_rank = F.coalesce(recommendation_rank(F.col("advised")), hard_rank)
    asks = (F.col("recommendation") != "reject") & (F.col("failed_checks") > 0)
    heard = asks & F.col("has_advice")
    reason = F.when(adv_rank < hard_rank, F.concat(
        F.coalesce("advised_reasoning", F.lit("")),
        F.lit(" (Advice to lower the verdict was overridden by the rules.)"))
    ).otherwise(F.coalesce("advised_reasoning", F.lit("")))
    return (
        hard.join(advice.withColumn("has_advice", F.lit(True)), "doc_id", "left")
        .withColumn("has_advice", F.coalesce("has_advice", F.lit(False)))
        .select(
            "doc_id", F.col("recommendation").alias("hard_recommendation"),
            F.when(heard, recommendation_of(F.greatest(hard_rank, adv_rank)))
            .otherwise(F.col("recommendation")).alias("recommendation"),
            F.when(heard, reason).otherwise(F.col("reasoning")).alias("reasoning"))
    )


def order_results(results: DataFrame) -> DataFrame:
    """SRT-1: failed by falling severity, then passed, then not applicable.

    Adds a position per document instead of sorting the whole corpus.  A window, and no
    list of whole rows, so that only the columns asked for are shuffled and sorted.
    """
    order = Window.partitionBy("doc_id").orderBy(result_group(), "check_id", "name", "message")
    return results.select("doc_id", F.row_number().over(order).alias("position"),
                          *[c for c in results.columns if c != "doc_id"])


def result_group(r: Column | None = None) -> Column:
    """0 reject, 1 correction, 2 note, 3 passed, 4 not applicable."""
    applicable, passed, severity = (
        F.col(c) if r is None else r[c] for c in ("applicable", "passed", "severity"))
    return F.when(~applicable, 4).when(passed, 3).otherwise(2 - severity_rank(severity))
