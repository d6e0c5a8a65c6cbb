"""Catalogue, judgements, verdicts, governance, registry, sources and sinks."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from conformance import views as V
from conformance.cases import QUERIES
from docketlens import rules as R
from docketlens import schema as S
from docketlens.operators import catalog, fonts, governance, sensitive, verdict
from docketlens.plans import mechanical
from docketlens.plans.full import Corpus, analyse, judge_requests
from docketlens.plans.registry import Registry, judge_with
from docketlens.plans.stages import Kept, parquet_stage
from docketlens.sources import readers, writers
from tests.helpers import doc, docs_df, page, pages_df, span, spans_df

RESULT = ("doc_id long, check_id string, name string, rule string, passed boolean, "
          "severity string, applicable boolean, message string, details string, pages array<int>")


def results_df(spark, rows):
    """Rows of (doc, check, passed, severity, applicable)."""
    return spark.createDataFrame(
        [(d, c, f"name {c}", "1(a)", p, s, a, "m", None, None) for d, c, p, s, a in rows], RESULT)


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return Corpus(V.fx_docs(spark, sf_dir), V.fx_pages(spark, sf_dir), V.fx_spans(spark, sf_dir))


def test_verdicts(spark):
    rows = [(1, "A", False, "note", True), (1, "B", True, "reject", True),
            (2, "A", False, "correction", True), (2, "B", False, "reject", False),
            (3, "B", False, "reject", True), (3, "A", False, "reject", True),
            (3, "C", False, "correction", True), (4, "A", True, "note", True)]
    got = {r.doc_id: r for r in verdict.hard_recommendation(results_df(spark, rows)).collect()}
    assert {d: r.recommendation for d, r in got.items()} == {
        1: "accept", 2: "correction_letter", 3: "reject", 4: "accept"}
    assert got[3].reasoning == "REJECT due to 2 critical failure(s): A (name A); B (name B)"
    assert got[2].reasoning == "Correction letter recommended due to 1 issue(s): A (name A)"
    assert (got[1].total_checks, got[1].failed_checks, got[1].passed_checks) == (2, 1, 1)


def test_a_failing_row_never_lowers_a_verdict(spark):
    rank = R.RECOMMENDATION_RANK
    rows = [(d, "A", False, s, True) for d, s in enumerate(R.SEVERITY_RANK)]
    before = {r.doc_id: r.recommendation
              for r in verdict.hard_recommendation(results_df(spark, rows)).collect()}
    for extra in R.SEVERITY_RANK:
        more = rows + [(d, "B", False, extra, True) for d in range(3)]
        for r in verdict.hard_recommendation(results_df(spark, more)).collect():
            assert rank[r.recommendation] >= rank[before[r.doc_id]]


def test_escalation(spark):
    rows = [(d, "A", False, s, True) for d, s in
            enumerate(["note", "correction", "reject", "correction", "note", "correction"])]
    rows.append((6, "A", True, "reject", True))
    advice = [(0, "correction_letter"), (1, "accept"), (2, "accept"), (3, "reject"), (4, "maybe"),
              (6, "reject")]
    advised = spark.createDataFrame([(d, v, "why") for d, v in advice],
                                    "doc_id long, recommendation string, reasoning string")
    hard = verdict.hard_recommendation(results_df(spark, rows))
    got = {r.doc_id: r for r in verdict.escalate(hard, advised).collect()}
    assert [got[d].recommendation for d in range(7)] == [
        "correction_letter", "correction_letter", "reject", "reject", "accept",
        "correction_letter", "accept"]
    assert "overridden" in got[1].reasoning and got[3].reasoning == "why"
    assert got[2].reasoning.startswith("REJECT") and got[6].reasoning == "All checks passed."


@pytest.mark.parametrize("raw,ids", [
    ('[{"id":"SEC-001","passed":false}]', ["SEC-001"]),
    ('```json\n[{"id":"SEC-001"},{"id":"SEC-003"}]\n```', ["SEC-001", "SEC-003"]),
    ('Sure: [{"id":"SEC-001"}] Done.', ["SEC-001"]), ("[]", []),
    ("not json", None), ("[oops", None), ("see [1] and [2]", None)])
def test_parse_judgement(spark, raw, ids):
    df = spark.createDataFrame([(raw,)], "t string")
    got = df.select(catalog.parse_judgement(F.col("t"))).first()[0]
    assert (None if got is None else [r.id for r in got]) == ids


def test_merge_judgements(spark):
    docs = spark.createDataFrame([(1, "reply"), (2, "appellant")], "doc_id long, brief_type string")
    answers = spark.createDataFrame([
        (1, '[{"id":"SEC-001","passed":false,"rule":"28(z)","message":"no"},'
            '{"id":"SEC-006","passed":false},{"id":"ZZZ","passed":false},{"id":"SEC-003","rule":""}]'),
        (2, "nothing")], "doc_id long, answer string")
    rows = catalog.semantic_results(docs, R.check_catalog(spark), catalog.judged_rows(answers)).collect()
    assert len(rows) == 62
    by = {(r.doc_id, r.check_id): r for r in rows}
    first = by[1, "SEC-001"]
    assert (first.passed, first.rule, first.severity) == (False, "28(z)", "reject")
    assert not by[1, "SEC-006"].applicable and by[1, "SEC-006"].passed
    assert by[1, "SEC-003"].passed and by[1, "SEC-003"].rule == "28(b)(2)"
    assert by[1, "SEC-003"].message == "No details provided."
    assert by[1, "CIT-002"].message == catalog.UNANSWERED
    assert all(r.passed for r in rows if r.doc_id == 2)
    assert by[2, "SEC-001"].message.startswith("AI analysis unavailable")


def test_order_results(spark):
    rows = [(1, "A", True, "note", True), (1, "B", False, "note", True),
            (1, "C", False, "reject", True), (1, "D", True, "reject", False),
            (1, "E", False, "correction", True)]
    got = verdict.order_results(results_df(spark, rows)).orderBy("position").collect()
    assert [r.check_id for r in got] == ["C", "E", "B", "A", "D"]


def test_governance(spark, tmp_path):
    manifest = {"version": "1", "rule_hashes": {
        "a.md": "sha256:" + __import__("hashlib").sha256(b"one").hexdigest(),
        "b.md": "sha256:0", "c.md": "sha256:0"}}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    (tmp_path / "rules").mkdir()
    for name, text in (("a.md", "one"), ("b.md", "two"), ("d.md", "extra")):
        (tmp_path / "rules" / name).write_text(text)
    texts = readers.read_rules(spark, str(tmp_path / "rules"))
    got = governance.verify_manifest(
        readers.read_rule_manifest(spark, str(tmp_path / "manifest.json")), readers.rule_hashes(texts))
    assert {(r.file_name, r.status) for r in got.collect()} == {("b.md", "modified"), ("c.md", "missing")}
    corpus_text = catalog.rule_corpus(texts, ["b.md", "rule-9.md", "a.md"]).first()[0].split("\n\n---\n\n")
    assert corpus_text[0] == "two" and corpus_text[2] == "one" and "[Rule 9 text not" in corpus_text[1]


def test_needs_refresh(spark):
    day = datetime.date(2026, 6, 1)
    cases = {"2026-06-01": False, str(day - datetime.timedelta(89)): False,
             str(day - datetime.timedelta(90)): True, str(day - datetime.timedelta(91)): True,
             "junk": True, None: True}
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    got = {r.d: r.due for r in df.select(
        "d", governance.needs_refresh(F.col("d"), F.lit(day)).alias("due")).collect()}
    assert got == cases


def test_sensitive_scan(spark):
    text = ("See 20240017 and 20990001, not 120240018 or 20270001.\n08-2024-CV-00123 00-0000-CV-00000\n"
            "Interest of A.B.\nExample: Interest of C.D.\nadoption of XYZ")
    docs = spark.createDataFrame([(1, text)], "doc_id long, full_text string")
    assert tuple(sensitive.sensitive_counts(docs).first()) == (1, 1, 1, 2)
    hits = sensitive.allowlist_except(sensitive.docket_hits(docs), sensitive.placeholder_hits(spark))
    assert {(r.kind, r.hit) for r in sensitive.distinct_hits(hits).collect()} == {
        ("supreme", "20240017"), ("district", "08-2024-CV-00123")}
    files = spark.createDataFrame([("a.PDF",), ("b.md",), ("c.xlsx",)], "file_name string")
    assert sensitive.binary_names(files).count() == 2


def test_manifest_of_files(spark, tmp_path):
    for name, size in (("a.pdf", 10), ("b.PDF", 100), ("c.txt", 10), ("d.pdf", 2000)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = readers.read_manifest(spark, str(tmp_path), R.Thresholds(max_filing_bytes=1000)).collect()
    assert {r.file_name: r.status for r in got} == {"a.pdf": "ok", "b.PDF": "ok", "d.pdf": "oversized"}
    assert all(r.content_hash.startswith("sha256:") for r in got)


def test_json_round_trip_gives_the_same_verdict(spark, corpus, tmp_path):
    facts = mechanical.document_facts(corpus.docs, corpus.pages, corpus.spans, stage=Kept())
    results = mechanical.results_of(facts).persist()
    writers.write_documents(facts, results, str(tmp_path / "out"))
    back = readers.read_results(spark, str(tmp_path / "out"))
    cols = ["doc_id", "recommendation", "failed_ids", "total_checks"]
    one = sorted(map(tuple, verdict.hard_recommendation(results).select(*cols).collect()))
    two = sorted(map(tuple, verdict.hard_recommendation(back).select(*cols).collect()))
    assert one == two and len(one) == 200


def test_interchange_holds_whole_documents(spark, sf_dir, corpus, tmp_path):
    """F16: texts stand in the files and come back, and so do page lists longer than the ten that a message shows."""
    facts = mechanical.document_facts(corpus.docs, corpus.pages, corpus.spans, stage=Kept(), keep_text=True)
    writers.write_documents(mechanical.with_results(facts), None, str(tmp_path / "out"))
    back = readers.read_documents(spark, str(tmp_path / "out"))
    own = lambda df: sorted(map(tuple, df.select("doc_id", "cover_text", "full_text").collect()))
    assert own(back) == own(corpus.docs) and len(own(back)) == 200
    plain = mechanical.document_facts(corpus.docs, corpus.pages, corpus.spans, stage=Kept())
    assert "full_text" not in plain.columns
    pages = lambda df: sorted((r.doc_id, r.check_id, r.pages) for r in df.collect() if r.pages)
    found = pages(readers.read_results(spark, str(tmp_path / "out")))
    assert found == pages(mechanical.results_of(plain)) and max(len(p) for _, _, p in found) > 10
    asked = QUERIES["SNK-1"](spark, sf_dir)
    assert asked.filter("text_hash is null").count() == 0


def test_report_store_and_html(spark, corpus, tmp_path):
    analysis = analyse(corpus, "r1", stage=Kept())
    html = {r.doc_id: r.html for r in writers.render_reports(analysis.reports, "v<1>").collect()}
    assert len(html) == 200 and all(h.startswith("<!DOCTYPE html>") for h in html.values())
    row = analysis.reports.filter("recommendation = 'reject'").orderBy("doc_id").first()
    page = html[row.doc_id]
    assert "<b>REJECT</b>" in page and f"Failed Checks ({row.failed_checks})" in page
    assert page.index("Critical") < page.index("Passed Checks") and "v&lt;1&gt;" in page
    assert row.report_id in page
    for _ in range(2):  # a rerun leaves one copy
        writers.write_reports(analysis.reports, str(tmp_path / "store"), "r1")
    writers.write_reports(analysis.reports.limit(3), str(tmp_path / "store"), "r2", files=2)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 203
    found = writers.report_by_id(spark, str(tmp_path / "store"), row.report_id)
    assert {r.doc_id for r in found.collect()} == {row.doc_id}
    assert "PartitionFilters: [isnotnull(id_prefix" in found._jdf.queryExecution().executedPlan().toString()
    assert writers.report_by_id(spark, str(tmp_path / "store"), "ffffffffffff").count() == 0


def test_full_analysis_with_judge_and_registry(spark, corpus, tmp_path):
    registry = Registry()

    @registry.check("USR-001", "reject", "x", name="Has Words")
    def has_words(docs, pages, spans):
        return docs.select("doc_id", (F.length("full_text") > 0).alias("passed"))

    first = analyse(corpus, "r1", stage=parquet_stage(str(tmp_path / "stages")))
    rules = spark.createDataFrame([("rule-28.md", "text of 28")], "file_name string, text string")
    requests = judge_requests(corpus, first.facts, rules)
    assert requests.count() == 200

    def judge(batch):
        return [json.dumps([{"id": c["id"], "passed": c["id"] != "SEC-001"}
                            for c in json.loads(checks)]) for checks in batch["checks_json"]]

    answers = judge_with(requests, judge)
    done = analyse(corpus, "r2", answers=answers, registry=registry)
    rows = done.results.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.countDistinct("check_id").alias("ids")).collect()
    assert all((r.n, r.ids) == (51, 51) for r in rows) and len(rows) == 200
    assert done.reports.filter("recommendation <> 'reject'").count() == 0  # SEC-001 rejects
    assert done.results.columns == S.RESULT_COLUMNS


def test_large_catalogue(spark):
    rows = [(f"X-{i}", "n", "r", ["reply"] if i % 2 else None, "note", "d") for i in range(3000)]
    docs = spark.createDataFrame([(1, "reply"), (2, None), (3, "bogus")], "doc_id long, brief_type string")
    got = catalog.applicable_checks(docs, R.check_catalog(spark, rows))
    assert {r.doc_id: (r["n"], r["m"]) for r in got.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum(F.col("applicable").cast("int")).alias("m")).collect()} == {
            1: (3000, 3000), 2: (3000, 1500), 3: (3000, 1500)}


@pytest.mark.parametrize("value,passed", [("true", True), ("false", False), ("0", False), ("null", False), ('""', False),
                                          ("[]", False), ("{}", False), ("1", True), ('"yes"', True), ("[1]", True)])
def test_truth_of_passed(spark, value, passed):
    df = spark.createDataFrame([(f'[{{"id":"A","passed":{value}}}, {{"id":"B"}}]',)], "t string")
    got = df.select(catalog.parse_judgement(F.col("t"))).first()[0]
    assert [r.passed for r in got] == [passed, None]


def test_parts_of_a_text_are_asked_and_joined(spark):
    text = "x" * 25 + "\n" + "é" * 10
    docs = spark.createDataFrame([(1, "reply", 1, 2, text), (2, "reply", 1, 0, ""), (3, "reply", 1, 0, None)],
                                 "doc_id long, brief_type string, total_pages int, word_count int, full_text string")
    asked = catalog.judge_requests(docs, R.check_catalog(spark), "key", R.Thresholds(judge_text_chars=10))
    parts = sorted((r.doc_id, r.part_no, r.part_count, r.brief_text) for r in asked.collect())
    assert "".join(p[3] for p in parts if p[0] == 1) == text
    assert [p[:3] for p in parts] == [(1, i, 4) for i in (1, 2, 3, 4)] + [(2, 1, 1), (3, 1, 1)]


def test_each_check_joins_its_parts_its_own_way(spark):
    checks = ["SEC-001", "CNT-001", "CIT-002", "PRV-004", "REC-002", "ODD-1"]
    judged = [(1, i, None, c, i != 2, "r", f"m{i}", f"d{i}" if i == 2 else None) for i in (1, 2, 3) for c in checks]
    judged += [(2, i, None, c, False, "r", f"m{i}", None) for i in (1, 3) for c in checks]
    judged += [(3, 1, None, "PRV-004", None, None, None, None), (3, 2, "unreadable", None, None, None, None, None)]
    df = spark.createDataFrame(judged, "doc_id long, part_no int, problem string, check_id string, passed boolean, "
                                       "rule string, message string, details string")
    rows = catalog.join_parts(df.repartition(5), R.check_catalog(spark)).collect()
    got = {(r.doc_id, r.check_id): (r.passed, r.message, r.details) for r in rows}
    assert len(got) == len(rows)
    assert got[1, "SEC-001"] == (True, "m1", None)  # once is enough
    assert got[2, "SEC-001"] == (False, "m1", None)
    for check in ("CNT-001", "CIT-002", "PRV-004", "REC-002", "ODD-1"):  # a fault in one part is a fault
        assert got[1, check] == (False, "m2", "d2")
    assert got[2, "CNT-001"] == (False, "m1", None) and got[2, "PRV-004"] == (False, "part 1: m1; part 3: m3", None)
    assert got[3, "PRV-004"] == (True, None, None)
    assert [r.problem for r in rows if r.doc_id == 3 and r.check_id is None] == ["unreadable"]


def test_broken_lines_are_listed(spark, tmp_path):
    lines = ['{"doc_id": 1, "pages": [{"page_no": 0, "blocks": []}]}', "{broken", '{"pages": []}',
             '{"doc_id": 2, "pages": [{"blocks": []}]}']
    (tmp_path / "a.json").write_text("\n".join(lines))
    got = readers.rejected_lines(readers.read_layout(spark, str(tmp_path))).collect()
    assert sorted((r.reason, r.line) for r in got) == [
        ("no doc_id", None), ("not JSON", "{broken"), ("page without number", None)]
    assert readers.rejected_lines(readers.read_documents(spark, str(tmp_path))).filter("reason = 'not JSON'").count() == 1


def test_long_digit_runs_and_full_lists(spark):
    df = spark.createDataFrame([("on 99999999999, 4", False)], "m string, p boolean")
    from docketlens.functions import text as X
    assert df.select(X.pages_from_message(F.col("m"), F.lit(None), F.col("p"))).first()[0] == [4]


def test_rule_warnings(spark):
    day = datetime.date(2026, 6, 1)
    log = spark.createDataFrame([("a", "2026-05-30", "old"), ("b", "2020-01-01", "old"), ("c", None, "old")],
                                "rule string, last_checked string, warning string")
    fresh = spark.createDataFrame([("b", "new")], "rule string, warning string")
    got = {r.rule: r.warning for r in governance.rule_warnings(log, fresh, F.lit(day)).collect()}
    assert got == {"a": "old", "b": "new", "c": None}


def test_results_carry_everything_their_texts_shorten(spark):
    cites = " ".join(f"{i} N.W.2d {i} {'x' * 300}" for i in range(1, 10))
    spans = [span(doc=1, page=p, text="plain words of the body") for p in range(14)]
    spans += [span(doc=1, page=p, block=1, text="a running head", size=9.0, y=30.0) for p in range(14)]
    rows = {r.check_id: r for r in mechanical.mechanical_checks(
        docs_df(spark, [doc(1, text=cites)]), pages_df(spark, [page(1, p, "x") for p in range(14)]),
        spans_df(spark, spans)).collect()}
    assert rows["CIT-001"].items == [f"{i} N.W.2d {i}" for i in range(1, 10)] and "(and 4 more)" in rows["CIT-001"].details
    font = rows["FMT-006"]
    assert font.passed and font.items == [f"headers/footers on page {p}" for p in range(1, 15)]


def test_capitals_without_a_body_size_are_body_text(spark):
    spans = [span(doc=1, page=0, text="CAPITALS OF NO SIZE AT ALLXX", size=0.0)]
    rows = mechanical.mechanical_checks(docs_df(spark, [doc(1)]), pages_df(spark, [page(1)]), spans_df(spark, spans))
    font = rows.filter("check_id = 'FMT-006'").first()
    assert not font.passed and font.severity == "reject"
    histogram = fonts.font_histogram(spans_df(spark, spans))
    assert fonts.page_font_counts(histogram, fonts.doc_font_stats(histogram)).first().body_chars == 28


def test_sections_go_on_over_pages(spark):
    from docketlens.operators import evidence
    cases = [f"{c}bel v. Cain, ¶ {i}" for i, c in enumerate("ABCDEFGHIJKL")]
    late = [*cases[:10], cases[11], cases[10]]
    rows = []
    for d, names in ((1, cases), (2, late)):
        rows += [(d, 0, "cover"), (d, 1, "TABLE OF CONTENTS\nIssue ... 3\n[4] Facts"), (d, 2, "Argument .... 9\n\nTable of Authorities:\n" + "\n".join(names[:4])),
                 (d, 3, "\n".join(names[4:8])), (d, 4, None), (d, 5, "\n".join(names[8:]) + "\nStatement of the Issues\nAaron v. Zed")]
    rows += [(3, 0, "As N.D.C.C. § 14-09-06 and N.D.C.C. § 1-2-3 say"), (3, 1, "Addendum\nN.D.C.C. § 14-9-6 Title"), (3, 2, "text\n  § 5-6 more"), (4, 0, None)]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, text string").repartition(4)
    toc = {r.doc_id: (r.toc_pages, r.paragraph_refs, r.page_refs) for r in evidence.toc_reference_style(pages).collect()}
    assert toc == {1: (2, 1, 2), 2: (2, 1, 2)}
    toa = {r.doc_id: (r.case_lines, r.in_order, r.paragraph_refs) for r in evidence.authorities_sorted(pages).collect()}
    assert toa == {1: (12, True, 12), 2: (12, False, 12)}
    code = {r.doc_id: (r.cited, r.set_out, r.missing) for r in evidence.statutes_set_out(pages).collect()}
    assert code[3] == (["1-2-3", "14-9-6"], ["14-9-6", "5-6"], ["1-2-3"]) and code[4] == ([], [], []) and len(code) == 4


def test_one_report_is_found_by_its_row_group(spark, tmp_path):
    from docketlens.sources import writers
    reports = spark.range(40_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("00"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 10)).alias("report_id"),
        F.sha2(F.concat(F.lit("x"), F.col("id")), 512).alias("reasoning"))
    writers.write_reports(reports, str(tmp_path / "store"), "r", block_bytes=1 << 18)
    wanted = reports.filter("doc_id = 777").first()
    found = writers.report_by_id(spark, str(tmp_path / "store"), wanted.report_id)
    rows = found.collect()
    assert [(r.doc_id, r.reasoning) for r in rows] == [(777, wanted.reasoning)]
    assert writers.report_by_id(spark, str(tmp_path / "store"), "00missing").count() == 0
    plan, scanned = found._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName().startswith("Scan"):
            scanned.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
    walk(plan)
    assert len(scanned) == 1 and 0 < scanned[0] < 10_000  # one row group of many
