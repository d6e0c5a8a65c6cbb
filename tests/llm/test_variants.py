import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

from docketlens.llm import queries
from docketlens.llm import variants as V
from tests.llm.fixtures import no_docs, odd_docs, odd_rows


def plain_counts(rows, damage=31, least_length=7, least_count=2):
    """Words of (id, text) rows by a loop over characters."""
    counts = Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % damage == 0 else run] += 1
                run = ""
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def plain_forms(counts, ratio=10):
    near = defaultdict(set)
    for a, b in combinations(counts, 2):
        if one_edit(a, b):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w in counts:
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        if best and counts[best] >= ratio * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {w: (form.get(w), root(w), counts[w], len(near[w]), counts[form[w]] if w in form else None) for w in counts}


def as_dict(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_pivots_are_the_lightest_disjoint_pair():
    draw = np.random.default_rng(5)
    for _ in range(300):
        places = sorted(draw.choice(12, draw.integers(3, 8), replace=False).tolist())
        prefix = [(p, int(draw.integers(0, 50))) for p in places]
        best = min(a[1] + b[1] for a, b in combinations(prefix, 2) if b[0] - a[0] >= 2)
        (p, w), (q, x) = V.pivots(prefix)
        assert q - p >= 2 and w + x == best and {(p, w), (q, x)} <= set(prefix)


def test_near_words_of_few_letters(spark):
    """Words over three letters: repeated bigrams, ties, many neighbours, crowded keys."""
    draw = np.random.default_rng(6)
    words = {"".join(draw.choice(list("abé"), draw.integers(4, 9))) for _ in range(700)}
    counts = {w: int(n) for w, n in zip(sorted(words), 10 ** draw.uniform(0, 5, len(words)), strict=True)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    wanted = {(a, b) for a in words for b in words if one_edit(a, b)}
    for size in (V.KEY_WORDS, 7):
        rows = V.near_words(df, key_words=size).collect()
        assert {(r["word"], r["other"]) for r in rows} == wanted and len(rows) == len(wanted)
        assert all(counts[r["word"]] == r["n"] and counts[r["other"]] == r["other_n"] for r in rows)
    assert as_dict(V.spelling_forms(df)) == plain_forms(counts)


def test_chains_of_forms(spark):
    chain = {"abcdefgh"[:8 - i] + "z" * i: 10 ** (18 - i) for i in range(8)}
    df = spark.createDataFrame(list(chain.items()), "word string, n long")
    assert as_dict(V.spelling_forms(df)) == plain_forms(chain)
    assert as_dict(V.spelling_forms(df))["azzzzzzz"][1] == "abcdefgh"


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(50 + i, "Mulberry mulberry ÉÀlanvital × ÷naïveté") for i in range(60)]
    docs = odd_docs(spark).select("doc_id", "text").union(spark.createDataFrame(rows[len(odd_rows()):], "doc_id long, text string"))
    counts = plain_counts(rows)
    assert "éàlanvital" not in counts and counts["Éàlanvital".replace("à", "À")] > 40
    assert as_dict(V.spelling_forms(V.word_counts(docs))) == plain_forms(counts)
    assert V.spelling_forms(V.word_counts(no_docs(spark))).count() == 0


def test_registered_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    counts = plain_counts([(r["doc_id"], r["text"]) for r in docs])
    assert as_dict(queries.QUERIES["op12_spelling_variants"](spark, sf_dir)) == plain_forms(counts)
