import math
import zlib
from collections import Counter

import numpy as np

from docketlens.llm import brown, queries
from tests.llm.fixtures import no_docs, odd_docs, odd_rows


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def test_registered_base_score_and_gain(spark, sf_dir):
    docs = {r["doc_id"]: tokens(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counts = Counter(t for i, own in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1 for t in own)
    n, v = sum(counts.values()), len(counts)
    rows = queries.QUERIES["op2_brown_lm"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        own = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(t in counts for t in own), n)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        assert math.isclose(base, r["base_score"], rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_add_up_to_one(spark):
    """Over all known words and one unknown word per ending, after any class."""
    model = brown.train(odd_docs(spark), clustered=20, listed=40, number=6, rounds=3)
    p_unit = brown.MIX * model.step[:, model.classes] * model.emit + (1 - brown.MIX) * model.alone
    assert np.allclose(p_unit.sum(1), 1)
    words = {bytes(r["word"]): r["n"] for r in model.counts.collect()}
    for e in range(brown.ENDINGS):
        own = sum(n for w, n in words.items() if brown.ending(w) == e and w not in model.units.words[:model.units.clustered])
        assert own == model.known[e]
    assert sum(words.values()) == model.tokens


def test_scores_match_a_plain_reading_of_the_model(spark):
    docs = odd_docs(spark)
    model = brown.train(docs.filter("doc_id is null or doc_id <> 12"), clustered=20, listed=40, number=6, rounds=3)
    words, units = {bytes(r["word"]): r["n"] for r in model.counts.collect()}, model.units
    own_unit = {w: i for i, w in enumerate(units.words[:units.clustered])}

    def plain(text):
        total, before = 0.0, model.classes[0]
        for t in tokens(text):
            unit = own_unit.get(t, units.clustered + brown.ending(t))
            c, e = model.classes[unit], brown.ending(t)
            p = brown.MIX * model.step[before, c] * model.emit[unit] + (1 - brown.MIX) * model.alone[unit]
            if t not in own_unit:
                p *= (words.get(t) or model.unseen[e]) / (model.known[e] + model.unseen[e])
            total, before = total + math.log10(p), c
        return total
    found = sorted((r["id"] or -1, round(r["score"], 6)) for r in brown.score(docs, model).collect())
    assert found == sorted((r[0] or -1, round(plain(r[1]), 6)) for r in odd_rows())


def test_exchange_separates_two_languages(spark):
    draw = np.random.default_rng(0)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{int(x)}" for x in draw.integers(0, 30, 40))) for i in range(200)]
    model = brown.train(spark.createDataFrame(rows, "doc_id long, text string"), clustered=61, listed=100, number=4, rounds=8)
    classes = {w: model.classes[i] for i, w in enumerate(model.units.words) if w}
    assert not {c for w, c in classes.items() if w[:1] == b"a"} & {c for w, c in classes.items() if w[:1] == b"b"}


def test_empty_tables(spark):
    model = brown.train(no_docs(spark))
    rows = brown.score(odd_docs(spark), model).collect()
    assert len(rows) == len(odd_rows()) and all(math.isfinite(r["score"]) and r["base_score"] <= 0 for r in rows)
    assert brown.score(no_docs(spark), model).count() == 0


def test_the_list_of_frequent_words_is_no_cut(spark):
    """Words beyond the list meet their exact counts in a join: known words and scores do not depend on its size."""
    docs = odd_docs(spark)
    def scores(listed):
        rows = brown.score(docs, brown.train(docs, clustered=1, listed=listed, number=6, rounds=3)).collect()
        return sorted((r["id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in rows)
    assert scores(0) == scores(20) == scores(10 ** 6)
