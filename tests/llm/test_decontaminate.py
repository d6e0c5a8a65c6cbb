import re

from docketlens.llm import decontaminate as D
from docketlens.llm import queries
from tests.llm.fixtures import BASE, LONG, no_docs, odd_docs

ITEM = "item_id long, text string"


def brute(docs, items, n=5, threshold=0.8):
    def words(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    def parts(text, n):
        w = words(text)
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
    out = []
    for i, t in items:
        z = min(n, len(words(t)))
        own = parts(t, z)
        for d, text in docs:
            shared = len(own & parts(text, z))
            if own and shared / len(own) >= threshold:
                out.append((d, i, len(own), shared))
    return sorted(out)


def test_registered_query_matches_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = queries.QUERIES["op1_decontamination"](spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["item_id"], r["item_shingles"], r["found_shingles"]) for r in found) == brute(docs, items)
    assert len(found) >= 3


def test_partial_items_at_the_threshold(spark):
    """Items of every size with a growing run replaced, scattered or at one end."""
    docs, items = [], []
    for size in (5, 6, 9, 16, 33, 70):
        words = [f"w{size}x{i}" for i in range(size)]
        items.append((size, " ".join(words)))
        for cut in range(0, size, max(1, size // 12)):
            docs.append((size * 1000 + cut, "before " * 40 + " ".join(words[cut:]) + " after" * 30))
        docs.append((size * 1000 + 999, " ".join(words[:size // 2]) + " middle " * 500 + " ".join(words[size // 2:])))
    found = D.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM), chars=200)
    assert sorted((r["id"], r["item"], r["item_shingles"], r["found_shingles"]) for r in found.collect()) == brute(docs, items)


def test_items_of_fewer_than_five_words(spark):
    items = [(1, "Answer is: forty two!"), (2, "forty two"), (3, "two forty"), (4, "?!"), (5, "alone"),
             (6, "answer is forty two in the end")]
    docs = [(1, "far " * 900 + "the answer is\nforty-two, then " + "on " * 900), (2, "answer is forty"), (3, "forty"), (4, None),
            (5, "two alone"), (6, "forty two forty"), (7, "answer is forty two in the end")]
    found = D.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM), chars=30)
    rows = sorted((r["id"], r["item"], r["item_shingles"], r["found_shingles"]) for r in found.collect())
    assert rows == brute(docs, items)
    assert {r[:2] for r in rows} == {(1, 1), (1, 2), (5, 5), (6, 2), (6, 3), (7, 1), (7, 2), (7, 6)}


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, " ".join(BASE.upper().split()[10:40])), (2, None), (3, ""), (4, "one two"),
                                   (5, " ".join(LONG.split()[100:200])), (5, " ".join(LONG.split()[100:200])), (None, "zz " * 9)], ITEM)
    docs = odd_docs(spark)
    found = sorted((r["id"] or -1, r["item"]) for r in D.contained_items(docs, items).collect())
    assert found == [(-1, 1), (5, 4), (6, 1), (6, 1), (7, 1), (8, 1), (9, 1), (10, 5), (10, 5), (11, 5), (11, 5), (14, 4)]
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 12, 13, 13]
    assert D.contained_items(no_docs(spark), items).count() == 0
    assert D.contained_items(docs, items.limit(0)).count() == 0
    assert D.decontaminate(docs, items.limit(0)).count() == docs.count()
