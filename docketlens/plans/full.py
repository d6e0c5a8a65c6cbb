"""The whole analysis of a corpus: from layout tables to report rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from docketlens import rules as R
from docketlens.operators import catalog, documents, layout
from docketlens.plans import mechanical
from docketlens.plans.registry import Registry
from docketlens.plans.reports import report_rows
from docketlens.plans.stages import Stage, inline


@dataclass
class Corpus:
    """The tables of a corpus."""

    docs: DataFrame   # doc_id, path, cover_text, full_text[, brief_type]
    pages: DataFrame  # doc_id, page_no, width_pt, height_pt, text
    spans: DataFrame  # flattened layout, or its stored features
    geometry: DataFrame | None = None  # page facts of nested documents, where they are at hand

    @classmethod
    def from_layout(cls, nested: DataFrame) -> Corpus:
        """Tables of nested documents; no shuffle happens here."""
        return cls(documents.layout_text(nested), layout.layout_pages(nested),
                   layout.flatten_layout(nested), layout.nested_page_facts(nested))


@dataclass
class Analysis:
    facts: DataFrame
    results: DataFrame
    reports: DataFrame


def analyse(corpus: Corpus, run_id: str, overrides: DataFrame | None = None,
            answers: DataFrame | None = None, advised: DataFrame | None = None,
            check_catalog: DataFrame | None = None, registry: Registry | None = None,
            th: R.Thresholds = R.DEFAULTS, stage: Stage = inline,
            fix_types: bool = False, reasonings: DataFrame | None = None) -> Analysis:
    """Classify, check, merge outside answers, decide, report.

    ``answers`` holds raw judge answers (``doc_id``, ``answer``, and ``part_no``
    where parts of a text were asked), ``advised`` outside verdicts.  Judged checks take part only when answers exist.
    """
    docs = corpus.docs
    if "brief_type" not in docs.columns:
        docs = documents.classify(docs, fix_types)
    if overrides is not None:
        docs = documents.override_type(docs, overrides)
    facts = mechanical.document_facts(docs, corpus.pages, corpus.spans, th, stage, geometry=corpus.geometry)
    facts = stage("document_facts", facts)
    results = mechanical.results_of(facts, th)
    if registry is not None:
        extra = registry.results(docs, corpus.pages, corpus.spans)
        results = results if extra is None else catalog.all_results(results, extra)
    if answers is not None:
        checks = check_catalog or R.check_catalog(docs.sparkSession)
        judged = catalog.judged_rows(answers)
        if "part_no" in judged.columns:
            judged = catalog.join_parts(judged, checks)
        judged = stage("judged", judged)  # read by two branches of the merge
        results = catalog.all_results(
            results, catalog.semantic_results(facts.select("doc_id", "brief_type"), checks, judged))
    results = stage("results", results)
    return Analysis(facts, results, report_rows(facts, results, run_id, advised, reasonings))


def judge_requests(corpus: Corpus, facts: DataFrame, rule_texts: DataFrame,
                   check_catalog: DataFrame | None = None,
                   th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """Requests for the documents of an analysis, text included.

    The rule corpus itself (``catalog.rule_corpus``) is kept under the key that requests carry.
    """
    spark = facts.sparkSession
    docs = corpus.docs.select("doc_id", "full_text").join(
        facts.select("doc_id", "brief_type", "total_pages", "word_count"), "doc_id")
    return catalog.judge_requests(
        docs, check_catalog or R.check_catalog(spark), catalog.rules_key(catalog.rule_corpus(rule_texts)), th)
