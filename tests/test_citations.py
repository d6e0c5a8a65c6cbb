"""Citation windows against brute force over whole texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docketlens import rules as R
from docketlens.operators import citations

REPORTER = re.compile(R.REPORTER_CITE)
NEUTRAL = re.compile(R.NEUTRAL_CITE)


def texts(n=120, seed=3):
    rng = random.Random(seed)
    parts = ["700 N.W.2d 15", "1 N.W.2d 1", "99 N.W. 2d 7", "2005 ND 123", "1999 ND App 8",
             "12005 ND 5", "x" * 150, "y" * 190, "z" * 201, " ", "; ", "\n", "é" * 30, "7"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def missing(text):
    out = []
    for m in REPORTER.finditer(text):
        around = text[max(0, m.start() - 200):m.end() + 200]
        if not NEUTRAL.search(around):
            out.append(m.group())
    return out


def frame(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "doc_id long, full_text string")


def test_missing_neutral_citations(spark):
    items = texts()
    rows = citations.with_missing_citations(frame(spark, items)).orderBy("doc_id").collect()
    assert [r.missing_cites for r in rows] == [missing(t) for t in items]
    assert [r.reporter_cites for r in rows] == [len(REPORTER.findall(t)) for t in items]
    assert sum(len(r.missing_cites) for r in rows) > 20


def test_window_edge(spark):
    items = [f"9 N.W.2d 7{'x' * n} 1999 ND 8" for n in range(180, 205)]
    rows = citations.with_missing_citations(frame(spark, items)).orderBy("doc_id").collect()
    assert [r.missing_cites for r in rows] == [missing(t) for t in items]


def test_positions(spark):
    items = texts()
    got = citations.citation_positions(frame(spark, items), R.REPORTER_CITE).collect()
    assert sorted((r.doc_id, r.start, r.end, r.hit) for r in got) == sorted(
        (i, m.start(), m.end(), m.group()) for i, t in enumerate(items)
        for m in REPORTER.finditer(t))


def test_band_anti_join_matches_all_pairs(spark):
    rng = random.Random(5)
    # One document holds most of the citations.
    a = sorted({(rng.choice([1, 1, 1, 2]), rng.randrange(0, 30000)) for _ in range(400)})
    b = [(rng.choice([1, 1, 1, 2]), rng.randrange(0, 30000)) for _ in range(60)]
    left = spark.createDataFrame([(d, s, s + 12) for d, s in a], "doc_id long, start int, end int")
    right = spark.createDataFrame([(d, s, s + 9) for d, s in b], "doc_id long, start int, end int")
    got = {(r.doc_id, r.start) for r in citations.nearby_citation_anti(left, right).collect()}
    expected = {(d, s) for d, s in a if not any(
        d == e and t >= s - 200 and t + 9 <= s + 12 + 200 for e, t in b)}
    assert got == expected and 0 < len(got) < len(a)


def test_examples_are_cut_at_five(spark):
    from tests.helpers import check, doc, page
    text = "; ".join(f"{n} N.W.2d {n}" for n in range(1, 8))
    row = check(spark, [], [page()], [doc(text=text)], "CIT-001")[1]
    assert not row.passed and row.message.startswith("7 of 7")
    assert "5 N.W.2d 5 (and 2 more)" in row.details and "6 N.W.2d 6" not in row.details


@pytest.mark.parametrize("part", [1, 2, 7, 40, 200, 211, 1000])
def test_parts_of_any_size_give_the_same(spark, part):
    items = [*texts(60, 11), "", None, "1 N.W.2d " * 90 + "5", "9" * 700 + " N.W.2d 3 tail", "x1 N.W.2d 4" + "y" * 199 + "2001 ND 5z2001 ND 5"]
    docs = frame(spark, items)
    for pattern in (R.REPORTER_CITE, R.NEUTRAL_CITE):
        rows = citations.citation_positions(docs, pattern, part_chars=part).collect()
        wanted = {(i, k, m.group(), m.start(), m.end()) for i, t in enumerate(items) for k, m in enumerate(re.finditer(pattern, t or ""))}
        assert {(r.doc_id, r.hit_no, r.hit, r.start, r.end) for r in rows} == wanted and len(rows) == len(wanted)
    rows = citations.missing_citations_by_part(docs, part_chars=part).orderBy("doc_id").collect()
    assert [(r.reporter_cites, r.missing_cites) for r in rows] == [
        (len(REPORTER.findall(t or "")), missing(t or "")) for t in items]


def test_many_hits_in_one_text_take_linear_time(spark):
    def seconds(n):
        docs = frame(spark, ["ab 12 N.W.2d 345 " * n])
        start = time.time()
        assert citations.citation_positions(docs, R.REPORTER_CITE).agg({"end": "max"}).first()[0] == 17 * n - 1
        return time.time() - start
    seconds(1000)
    few, many = min(seconds(50_000) for _ in range(2)), min(seconds(100_000) for _ in range(2))
    assert many < 3 * few + 0.5


def test_texts_are_cut_once_at_their_citations(spark):
    """The pieces between citations serve both ends of the window: one search for the hits and one for the cuts."""
    rows = spark.createDataFrame([(1, "1 N.W.2d 2 and 3 N.W.2d 4"), (2, "N.W. of none"), (3, None)], "doc_id long, full_text string")
    df = citations.with_missing_citations(rows)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("split(full_text") == 1 and text.count("regexp_extract_all(full_text") == 1
    assert [(r.reporter_cites, r.missing_cites) for r in df.orderBy("doc_id").collect()] == [
        (2, ["1 N.W.2d 2", "3 N.W.2d 4"]), (0, []), (0, [])]
