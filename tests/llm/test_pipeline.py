import corpus_pipeline
from docketlens.llm import common, quality
from tests.llm.fixtures import no_docs, odd_docs
from tests.llm.test_decontaminate import brute
from tests.llm.test_dedup import brute_groups
from tests.llm.test_packing import check_pieces


def test_stages_against_brute_force(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    stages, rows = dict(corpus_pipeline.STAGES), [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert list(stages) == ["quality classifier", "exact dedup", "simhash near-dedup", "benchmark decontamination", "packing"]
    columns = docs.columns

    def run(name):
        nonlocal docs, rows
        docs = common.staged(stages[name](spark, docs, sf_dir), "t")
        before, rows = dict(rows), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        assert docs.columns == columns and all(before[i] == t for i, t in rows) and len(dict(rows)) == len(rows)
        return before

    before = run("quality classifier")
    weights = quality.train(common.documents(spark, sf_dir), common.labels(spark, sf_dir))
    assert {i for i, _ in rows} == {i for i, t in before.items() if quality._score(weights, t, quality.BITS) >= 0.3}
    before = run("exact dedup")
    assert {i for i, _ in rows} == {min(g, key=lambda m: (-len(m[1]), m[0]))[0] for g in brute_groups(before.items()).values()}
    before = run("simhash near-dedup")
    assert 0.8 * len(before) < len(rows) < len(before)
    before = run("benchmark decontamination")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(before) - {i for i, _ in rows} == {d for d, *_ in brute(before.items(), items)}
    pieces = stages["packing"](spark, docs, sf_dir).withColumnRenamed("doc_id", "id").collect()
    check_pieces(pieces, {i: [t] for i, t in rows})


def test_stages_take_odd_and_empty_tables(spark, sf_dir):
    for docs in (odd_docs(spark), no_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() <= docs.count() + 400
            assert name == "packing" or out.columns == docs.columns
