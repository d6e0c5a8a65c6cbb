"""Streams give what the batch operators give."""

import datetime
import json

from pyspark.sql import functions as F

from conformance import views as V
from docketlens.operators import verdict
from docketlens.plans.full import Corpus
from docketlens.plans.mechanical import mechanical_checks
from docketlens.streaming import intake


def test_layout_stream_equals_batch(spark, sf_dir, tmp_path):
    nested = V.fx_layout(spark, sf_dir)
    nested.withColumn("received_at", F.lit(None).cast("timestamp")).repartition(4).write.json(
        str(tmp_path / "in"))
    query = intake.stream_checks(
        intake.stream_layout(spark, str(tmp_path / "in"), files_per_batch=2),
        str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    cols = ["doc_id", "recommendation", "failed_ids"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*cols).collect()))
    corpus = Corpus.from_layout(nested)
    batch = verdict.hard_recommendation(mechanical_checks(corpus.docs, corpus.pages, corpus.spans))
    assert got == sorted(map(tuple, batch.select(*cols).collect())) and len(got) == 200


def _write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_repeated_uploads_are_dropped_and_late_ones_kept(spark, tmp_path):
    start = datetime.datetime(2026, 1, 1)

    def upload(name, hours):
        _write(tmp_path / "in", name, [
            {"content_hash": h, "received_at": (start + datetime.timedelta(hours=i)).isoformat()} for h, i in hours])

    def run():
        stream = spark.readStream.schema("content_hash string, received_at timestamp").json(str(tmp_path / "in"))
        intake.dedupe_uploads(stream, str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()
        return sorted((r.content_hash, r.received_at.hour) for r in spark.read.parquet(str(tmp_path / "store")).collect())

    upload("1.json", [("a", 3), ("b", 1), ("a", 2), ("c", 3), ("b", 4)])
    assert run() == [("a", 2), ("b", 1), ("c", 3)]
    upload("2.json", [("a", 9000), ("d", -5000), ("d", -4999)])  # late, but never seen
    assert [h for h, _ in run()] == ["a", "b", "c", "d"]


def test_window_counts_on_a_stream(spark, tmp_path):
    def at(hour, minute=0):
        return datetime.datetime(2026, 1, 1, hour, minute).isoformat()

    folder = tmp_path / "in"
    _write(folder, "1.json", [{"ts": at(1, m), "recommendation": "accept"} for m in (0, 10, 50)]
           + [{"ts": at(2), "recommendation": "reject"}])
    stream = spark.readStream.schema("ts timestamp, recommendation string").json(str(folder))
    query = intake.intake_counts(stream, "1 hour", late="10 minutes").writeStream.format(
        "memory").queryName("counts").outputMode("append").start()
    query.processAllAvailable()
    _write(folder, "2.json", [{"ts": at(5), "recommendation": "accept"}])
    query.processAllAvailable()
    _write(folder, "3.json", [{"ts": at(1, 5), "recommendation": "accept"},  # too late
                              {"ts": at(9), "recommendation": "accept"}])
    query.processAllAvailable()
    query.stop()
    got = {(r.window_start.hour, r.recommendation): r.n for r in spark.table("counts").collect()}
    assert got[1, "accept"] == 3 and got[2, "reject"] == 1


def test_a_batch_does_not_read_what_was_kept(spark, tmp_path):
    """Twenty batches; everything kept before is destroyed before each, and repeats are recognised still."""
    columns = ["content_hash", "received_at", "name"]
    expected, seen = [], set()
    for k in range(20):
        rows = [(f"h{(k * 7 + i * 3) % 60}" if i % 5 else None, datetime.datetime(2026, 1, 1, 0, i % 3).isoformat(), f"n{k % 4}-{i}") for i in range(12)]
        _write(tmp_path / "in", f"{k}.json", [dict(zip(columns, r, strict=True)) for r in rows])
        keys = {}
        for r in sorted(rows, key=lambda r: (r[1], r[2])):
            keys.setdefault(r[0] or r, r)
        expected.append({r[2] for key, r in keys.items() if key not in seen})
        seen |= set(keys)
        for old in (tmp_path / "store").glob("*/*.parquet"):
            old.write_bytes(b"gone")
        stream = spark.readStream.schema("content_hash string, received_at timestamp, name string").json(str(tmp_path / "in"))
        query = intake.dedupe_uploads(stream, str(tmp_path / "store"), str(tmp_path / "state"))
        query.awaitTermination()
        got = spark.read.parquet(str(tmp_path / "store" / f"batch_id={k}")).collect()
        assert {r.name for r in got} == expected[k] and len(got) == len(expected[k])
        assert sum(p["numInputRows"] for p in query.recentProgress) == 12


def test_late_rows_are_kept_beside_the_counts(spark, tmp_path):
    def at(hour, minute=0):
        return datetime.datetime(2026, 1, 1, hour, minute).isoformat()

    batches = [[at(1), at(1, 30), at(3)], [at(1, 45), at(2, 5), at(9), at(9, 1)], [at(1), at(7, 59), at(8, 1), at(7)], [None]]
    for k, times in enumerate(batches):
        _write(tmp_path / "in", f"{k}.json", [{"ts": t, "recommendation": "accept"} for t in times])
        stream = spark.readStream.schema("ts timestamp, recommendation string").json(str(tmp_path / "in"))
        for _ in range(2):  # a second run finds nothing new
            intake.count_intake(stream, str(tmp_path / "out"), str(tmp_path / "late"), str(tmp_path / "state")).awaitTermination()
    counts = {r.window_start.hour: r.n for r in intake.counted(spark.read.parquet(str(tmp_path / "out"))).collect()}
    late = sorted((r.ts.hour, r.ts.minute, r.window_start.hour) for r in spark.read.parquet(str(tmp_path / "late")).collect())
    assert counts == {1: 2, 3: 1, 2: 1, 9: 2, 8: 1} and late == [(1, 0, 1), (1, 45, 1), (7, 0, 7), (7, 59, 7)]


def test_streams_read_a_table_of_one_file_or_of_many(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.repartition(5).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    (tmp_path / "one").mkdir()
    docs.coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    docs.limit(3).write.parquet(str(tmp_path / "many" / "documents.parquet.old"))  # beside it, not part of it
    ids = sorted(r.doc_id for r in docs.collect())
    for kind in ("many", "one"):
        path = str(tmp_path / kind / "documents.parquet")
        found = intake.run_available(spark, path, docs.schema, lambda batch: batch.select("doc_id"), str(tmp_path / f"checks-{kind}"))
        assert sorted(r.doc_id for r in found.collect()) == ids
        kept = intake.run_uploads(spark, path, docs.schema, lambda rows: rows.select(
            F.sha2("text", 256).alias("content_hash"), F.timestamp_seconds("doc_id").alias("received_at")), str(tmp_path / f"uploads-{kind}"))
        assert kept.count() == docs.select("text").distinct().count()
