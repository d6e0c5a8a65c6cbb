import zlib

import numpy as np

from docketlens.llm import quality, queries, toxicity
from tests.llm.fixtures import no_docs, odd_docs

LABELS = "doc_id long, quality int, toxic int"


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    labels = np.array(labels)
    ones = (labels == 1).sum()
    return (rank[labels == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(labels) - ones))


def held_out_scores(spark, name, column):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES[name](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    for r in rows[:500]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    own = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    return zip(*own, strict=True)


def test_quality_of_held_out_documents(spark):
    labels, scores, predicted = held_out_scores(spark, "op7_quality", "quality")
    assert auc(labels, scores) > 0.98
    assert np.mean(np.array(labels) == np.array(predicted)) > 0.96
    assert [int(s >= 0.3) for s in scores] == list(predicted)


def test_toxicity_of_held_out_documents(spark):
    labels, scores, predicted = held_out_scores(spark, "op4_toxicity", "toxic")
    assert auc(labels, scores) > 0.95
    assert np.mean(np.array(labels) == np.array(predicted)) > 0.97
    assert [int(s >= 0.5) for s in scores] == list(predicted)


def test_folding():
    assert toxicity.fold_text("1d10t Idiоt іdiot pathét!c $cum 42 7") == ["idiot", "idiot", "idiot", "pathetic", "scum"]
    assert toxicity.fold_text(None) == []


def test_exceptions_and_length():
    lexicon = toxicity.Lexicon({" trash ": 3.0, " vequ": 2.0}, [" trash can "])
    automaton = lexicon.automaton()
    assert toxicity.matched(automaton, "this trash talk".split()) == (3.0, 3)
    assert toxicity.matched(automaton, "the trash can".split()) == (0.0, 3)
    assert toxicity.matched(automaton, "vequta xvequta".split()) == (2.0, 2)
    short, long = toxicity.measures(3.0, 30), toxicity.measures(3.0, 3000)
    assert short[0] == long[0] and short[1] > long[1]


def test_exceptions_are_learned(spark):
    rows = [(i, f"you are trash number{i}" if i % 2 else f"put it in the trash can number{i}") for i in range(400)]
    rows += [(1000 + i, f"nothing here at all{i}") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 1000 and i % 2 == 1)) for i, _ in rows], LABELS)
    lexicon = toxicity.train(docs, labels)
    assert any("trash" in e for e in lexicon.weights) and " trash can " in lexicon.exceptions
    scores = {r["id"]: r["score"] for r in toxicity.score(docs, lexicon).collect()}
    assert scores[5] > 0.5 > scores[6]


def test_no_entry_of_a_rich_vocabulary_is_lost(spark):
    """Each word brings its beginnings too: 1,000 words have some 6,000 candidates."""
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5][:16]
    digits = str.maketrans("0123456789", "qbvrtzmpks")
    words = sorted({f"{zlib.crc32(str(i).encode()):010d}".translate(digits)[::-1] for i in range(1000)})
    docs = spark.createDataFrame([(i, " ".join(words) if n % 2 else "some other words") for n, i in enumerate(ids)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], "doc_id long, toxic int")
    automaton = toxicity.train(docs, labels).automaton()
    assert not [w for w in words if not toxicity.matched(automaton, [w])[0]]


def test_final_digits_and_signs_are_read_as_letters_too():
    automaton = toxicity.Lexicon({" ass ": 2.0, " hate ": 3.0, " pla": 1.0}).automaton()
    assert toxicity.read_words(automaton, "a55 A$$! hat3, h4t3 play5 hat ass5") == ["ass", "ass", "hate", "hate", "play", "hat", "ass"]
    assert toxicity.read_words(automaton, "number123 x5_y 52 a2 b1!2 a5!5") == toxicity.fold_text("number123 x5_y 52 a2 b1!2 a5!5")
    assert toxicity.read_words(toxicity.Lexicon().automaton(), "a55") == ["a"]


def test_odd_rows(spark):
    docs, empty = odd_docs(spark), spark.createDataFrame([], LABELS)
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (6, 1, 0), (6, 0, 1), (99, 1, 1), (4, 0, 0)], LABELS)
    for own in (labels, empty):
        weights = quality.train(docs, own)
        assert quality.score(docs, weights).count() == docs.count()
        kept = quality.keep_good(docs, weights, 0.0)
        assert kept.columns == docs.columns and kept.count() == docs.count()
        assert quality.score(no_docs(spark), weights).count() == 0
        lexicon = toxicity.train(docs, own)
        assert toxicity.score(docs, lexicon).filter("score between 0 and 1").count() == docs.count()
        assert toxicity.score(no_docs(spark), lexicon).count() == 0
    assert quality.score(docs, quality.train(docs, empty)).filter("score = 0.5").count() == docs.count()


def test_ftrl_learns_and_keeps_noise_at_zero():
    draw = np.random.default_rng(0)
    rows = []
    for i in range(600):
        noise = np.sort(draw.choice(np.arange(10, 4000), 20, replace=False))
        rows.append((i % 2, np.r_[0, 1 + i % 2, noise].astype(np.int32), np.r_[1.0, 0.5, np.full(20, 0.1)]))
    w = quality.ftrl(rows, bits=12)
    assert w[2] > 0 > w[1] and (w[10:] == 0).mean() > 0.9
