"""The files of a manifest: one for each document, none in a folder of its own."""

from conformance import cases, views


def test_documents_share_folders(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "work_folder", lambda spark: f"file://{tmp_path}")
    rows = cases.QUERIES["manifest_of_files"](spark, sf_dir).collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(i for i in ids if i % 4 != 2)
    assert all(r.length == 65 * (1 + r.doc_id % 3) for r in rows)
    assert len([p for p in tmp_path.rglob("*") if p.is_dir()]) == 13
    assert len([p for p in tmp_path.rglob("part-*") if p.stat().st_size]) == len(ids)


def test_files_are_written_and_read_by_few_tasks(spark, sf_dir, tmp_path, monkeypatch):
    """no shuffle, no checksum file beside each file, no task for every few files; rows whose id repeats all stay."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows.unionByName(rows.filter("doc_id < 20")).repartition(5).write.parquet(f"{tmp_path}/in/documents.parquet")
    monkeypatch.setattr(views, "work_folder", lambda spark: f"file://{tmp_path}/out")
    got = cases.QUERIES["manifest_of_files"](spark, f"{tmp_path}/in")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert len(files) == 220 and all(p.name.startswith("part-") for p in files)
    ids = [i for i in [*range(200), *range(20)] if i % 4 != 2]
    assert sorted(r.doc_id for r in got.collect()) == sorted(ids)
