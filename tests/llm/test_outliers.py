import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from docketlens.llm import outliers as O
from docketlens.llm import queries
from tests.llm.fixtures import SCHEMA, no_docs, odd_docs, odd_rows


def plain_facts(text):
    text = text or ""
    words = [w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(inside))


def plain_vector(f):
    n, chars, symbols, lines, dup, rep = f
    w, c = max(n, 1), max(chars, 1)
    values = (math.log(w), math.log(c / w), math.sqrt(symbols / c), math.asin(math.sqrt(dup / (lines + 5))),
              math.asin(math.sqrt(rep / (w + 50))))
    return tuple(math.floor(v * 256 + 0.5) for v in values)


def plain_distance(x, mean, cov):
    d = x - mean
    return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)


def plain_mcd(x):
    """Estimates of distinct vectors: three starts, concentration, weighting."""
    ridge, n = (O.FLOOR * 256) ** 2, len(x)

    def estimate(part, share):
        return part.mean(0), np.cov(part.T, bias=True).reshape(5, 5) * O.consistency(share, 5) + ridge * np.eye(5)

    low = np.sort(x, axis=0)[(n + 1) // 2 - 1]
    scale = np.maximum(1.4826 * np.sort(np.abs(x - low), axis=0)[(n + 1) // 2 - 1], O.FLOOR * 256)
    z = (x - low) / scale
    size = np.sqrt((z ** 2).sum(1, keepdims=True))
    covs = [np.diag(scale ** 2)]
    for score in (np.divide(z, size, out=np.zeros_like(z), where=size > 0), np.tanh(z)):
        put = np.round(score * 4096)
        covs.append((np.cov(put.T, bias=True).reshape(5, 5) / 4096 ** 2 + 0.01 * np.eye(5)) * np.outer(scale, scale))
    now = [(low, c, np.inf) for c in covs]
    for _ in range(O.STEPS):
        after = []
        for mean, cov, _ in now:
            bins = np.floor(256 * np.log1p(plain_distance(x, mean, cov))).astype(int)
            order = np.sort(bins)
            mean, cov = estimate(x[bins <= order[math.ceil(n * O.H) - 1]], O.H)
            after.append((mean, cov, np.linalg.slogdet(cov)[1]))
        settled = not any(a[2] < b[2] - 1e-9 for a, b in zip(after, now, strict=True))
        now = after
        if settled:
            break
    mean, cov, _ = min(now, key=lambda e: e[2])
    near = x[plain_distance(x, mean, cov) <= O.chi_square_quantile(O.INNER, 5)]
    return estimate(near, O.INNER)


def check(rows, texts, least):
    """Against the plain computation; ``texts`` lists (lang, source, text)."""
    facts = [plain_facts(t) for _, _, t in texts]
    failed = [f[0] < 10 or 100 * f[5] > 20 * f[0] for f in facts]
    own = defaultdict(set)
    for (lang, source, _), f, bad in zip(texts, facts, failed, strict=True):
        if not bad:
            own[lang, source].add(plain_vector(f))
    rest = Counter()
    for (lang, _), x in own.items():
        rest[lang] += len(x) * (len(x) < least)
    name = {k: (0, *k) if len(x) >= least else (1, k[0]) if rest[k[0]] >= least else (2,) for k, x in own.items()}
    members = defaultdict(set)
    for k, x in own.items():
        members[name[k]] |= x
    # Repeated vectors of a pooled group count once as well.
    fits = {g: plain_mcd(np.array(sorted(x), float)) for g, x in members.items()}
    wanted = Counter()
    for (lang, source, _), f, bad in zip(texts, facts, failed, strict=True):
        if bad:
            wanted[(*f, True, False, None)] += 1
        else:
            d = plain_distance(np.array([plain_vector(f)], float), *fits[name[lang, source]])[0]
            wanted[(*f, False, bool(d <= O.chi_square_quantile(O.LEVEL, 5)), round(float(d), 6))] += 1
    got = Counter((r["n_words"], r["word_chars"], r["n_symbols"], r["n_lines"], r["n_dup_lines"], r["n_repeat_words"],
                   r["base_failed"], r["kept"], None if r["distance"] is None else round(r["distance"], 6)) for r in rows)
    assert got == wanted


def test_chi_square():
    assert O.chi_square_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-4)
    assert O.chi_square_quantile(0.75, 5) == pytest.approx(6.62568, abs=1e-4)
    assert O.consistency(1 - 1e-12, 5) == pytest.approx(1, abs=1e-6)


def test_odd_rows(spark):
    texts = [(r[2], r[3], r[1]) for r in odd_rows()]
    check(O.judge(odd_docs(spark), least=3).collect(), texts, 3)
    assert O.judge(no_docs(spark)).count() == 0


def test_groups_against_the_plain_computation(spark):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(900):
        lang, source = ("en", "de", None)[i % 3], ("a", "b", "c", None)[i % 7 % 4]
        n = int(draw.lognormal(4, 1)) + 5
        words = ["x" * int(k) for k in draw.integers(1, 12, n)]
        text = " ".join(words[:n // 2]) + "\n" + " ".join(words[n // 2:])
        if i % 11 == 0:
            text = text.replace("x ", "x### ") + "\nsame line\nsame line"
        rows.append((i, text if i % 50 else "spam " * 30, lang, source, 0, 0, "k", 0.0, "", 0))
    rows += [(1000 + i, "one text of many copies " + "word" * 9 + " a b c d e f g h", "en", "a", 0, 0, "k", 0.0, "", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = O.judge(docs.repartition(13)).collect()
    check(out, [(r[2], r[3], r[1]) for r in rows], O.LEAST)
    assert any(not r["kept"] and not r["base_failed"] for r in out) and all(r["kept"] for r in out if r["id"] >= 1000)
    assert sorted(map(str, O.judge(docs.repartition(2)).collect())) == sorted(map(str, out))


def test_registered_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    out = queries.QUERIES["op11_quality_rules"](spark, sf_dir)
    assert not {"Python", "Arrow", "Pandas"} & set(out._jdf.queryExecution().executedPlan().toString().replace("_", " ").split())
    facts = {r["doc_id"]: plain_facts(r["text"]) for r in docs}
    rows = out.collect()
    assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows} == {
        k: (f[0], f[1], f[2], f[4], f[5]) for k, f in facts.items()}
    assert len(rows) == len(docs)
