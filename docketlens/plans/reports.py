"""One report row per document: verdict, counts, case facts, ordered results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens import schema as S
from docketlens.functions import text as X
from docketlens.operators import verdict

RESULT_FIELDS = [c for c in S.RESULT_COLUMNS if c != "doc_id"]


def report_rows(docs: DataFrame, results: DataFrame | None, run_id: str,
                advised: DataFrame | None = None, reasonings: DataFrame | None = None) -> DataFrame:
    """Reports of a run.

    ``docs`` needs ``doc_id`` and ``brief_type``; ``cover_text``, ``path`` and
    the counts are used where present.  ``advised`` is the optional outside
    opinion of AGG-14.  ``reasonings`` (``doc_id``, ``reasoning``) are a caller's own
    words for a verdict, one a document; empty ones leave what the rules say.  Without
    ``results`` each of ``docs`` brings its own in an array ``results``
    (``mechanical.with_results``), and the report is made in its row.
    """
    keep = [c for c in ("brief_type", "total_pages", "body_pages", "word_count", "path")
            if c in docs.columns]
    facts = docs.select("doc_id", *keep, *_case_facts(docs), *([_listed_in_row()] if results is None else []))
    if results is None:
        decided = _advised(verdict.decide_listed(facts), advised, reasonings)
        return decided.withColumn("report_id", X.report_id(F.col("doc_id"), run_id))
    order = F.struct(verdict.result_group().alias("g"), "check_id", "name")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(
        order.alias("o"), F.struct(*RESULT_FIELDS).alias("r")))), lambda x: x["r"])
    decided = _advised(verdict.decide(results, listed.alias("results")), advised, reasonings)
    return (
        facts.join(decided, "doc_id")
        .withColumn("report_id", X.report_id(F.col("doc_id"), run_id))
    )


def _listed_in_row() -> Column:
    """The results of a document's own array in the order of a report."""
    keyed = F.transform("results", lambda r: F.struct(
        F.struct(verdict.result_group(r).alias("g"), r["check_id"].alias("check_id"), r["name"].alias("name")).alias("o"),
        F.struct(*[r[c].alias(c) for c in RESULT_FIELDS]).alias("r")))
    return F.transform(F.array_sort(keyed), lambda x: x["r"]).alias("results")


def _advised(decided: DataFrame, advised: DataFrame | None, reasonings: DataFrame | None) -> DataFrame:
    if advised is not None:
        raised = verdict.escalate(decided, advised).select("doc_id", "recommendation", "reasoning")
        decided = decided.drop("recommendation", "reasoning").join(raised, "doc_id")
    if reasonings is not None:
        own = reasonings.filter("reasoning <> ''").groupBy("doc_id").agg(F.max("reasoning").alias("own_words"))
        decided = decided.join(own, "doc_id", "left").withColumn(
            "reasoning", F.coalesce("own_words", "reasoning")).drop("own_words")
    return decided


def _case_facts(docs: DataFrame) -> list:
    if "cover_text" not in docs.columns:
        return [F.lit("").alias("case_number"), F.lit("").alias("case_title"),
                F.lit("").alias("brief_label")]
    cover = F.col("cover_text")
    path = F.col("path") if "path" in docs.columns else F.lit("")
    return [X.case_number(cover).alias("case_number"),
            X.case_title(cover, path).alias("case_title"),
            X.brief_label(cover).alias("brief_label")]
