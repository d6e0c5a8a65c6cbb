"""Documents arriving over time: the same checks, de-duplication, counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlens import rules as R
from docketlens import schema as S
from docketlens.operators import documents, layout, verdict
from docketlens.plans import mechanical


def stream_layout(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Nested documents as they are dropped into a folder."""
    return (
        spark.readStream.schema(S.LAYOUT).option("maxFilesPerTrigger", files_per_batch).json(folder)
    )


def check_batch(docs: DataFrame, pages: DataFrame, spans: DataFrame,
                th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """Verdicts of one micro-batch; documents arrive whole, so batches are complete."""
    return verdict.hard_recommendation(mechanical.mechanical_checks(docs, pages, spans, th))


def check_layout_batch(batch: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    return check_batch(documents.layout_text(batch), layout.layout_pages(batch),
                       layout.flatten_layout(batch), th)


def stream_checks(layout_stream: DataFrame, out: str, checkpoint: str,
                  check: Callable[[DataFrame], DataFrame] = check_layout_batch, **trigger):
    """STR-1: check every micro-batch and keep its verdicts under ``out``.

    Each batch owns one folder and overwrites it, so a batch that is replayed
    after a failure leaves no second copy.
    """
    staged = checkpoint.rstrip("/") + "-batches"

    def process(batch: DataFrame, batch_id: int) -> None:
        # Several branches read the batch: its source is read and parsed once.
        path = f"{staged}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        stored = batch.sparkSession.read.schema(batch.schema).parquet(path)
        check(stored).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = layout_stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def dedupe_uploads(uploads: DataFrame, store: str, checkpoint: str, **trigger):
    """STR-2: keep the first upload of every content under ``store``, however late it comes.

    Known contents live in the query's state, one row per hash in an embedded key-value
    store on the executors' disks, so a batch looks up its own hashes only and never
    reads what was kept before.  A hash is new in the batch in which it is first and last
    seen; of several uploads in that batch the earliest stays.  A replayed batch has the
    time it had before and overwrites its own folder.  No watermark is involved, so an
    upload that was never seen is never dropped.  Uploads without a hash are the same
    only if all their columns are.
    """
    spark, columns = uploads.sparkSession, uploads.columns
    whole_row = F.concat(F.lit("row:"), F.sha2(F.to_json(F.struct(*columns)), 256))
    seen = uploads.withColumns({"__key": F.coalesce("content_hash", whole_row), "__at": F.current_timestamp()})
    # One value holds the row: ties of received_at are broken by the other columns.
    first = F.min(F.struct("received_at", *[c for c in columns if c != "received_at"])).alias("__row")
    known = seen.groupBy("__key").agg(F.min("__at").alias("__since"), F.max("__at").alias("__last"), first)

    def process(batch: DataFrame, batch_id: int) -> None:
        new = batch.filter("__since = __last").select(*[F.col(f"__row.{c}").alias(c) for c in columns])
        new.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")

    writer = known.writeStream.outputMode("update").foreachBatch(process).option("checkpointLocation", checkpoint)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # a query keeps the setting it starts with
    try:
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def intake_counts(verdicts: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """STR-3: verdicts per window; ``late`` sets the watermark on streams."""
    if late:
        verdicts = verdicts.withWatermark("ts", late)
    return verdicts.groupBy(F.window("ts", width), "recommendation").agg(
        F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "recommendation", "n")


def count_intake(verdicts: DataFrame, out: str, late_out: str, checkpoint: str, width: str = "1 hour",
                 late: str = "1 hour", **trigger):
    """STR-3 with nothing lost: counts per window under ``out``, rows behind the watermark under ``late_out``.

    A batch counts its rows per window; such counts add up (:func:`counted`).  A row is
    late when its window had ended ``late`` before the newest row of the batches before;
    it is kept with its window instead of being dropped.  Each batch writes the newest
    time so far beside its counts and reads that of the batch before, and overwrites its
    own folders when it is replayed.
    """
    spark = verdicts.sparkSession

    def process(batch: DataFrame, batch_id: int) -> None:
        newest = spark.read.schema("newest timestamp").parquet(f"{checkpoint}-newest/batch_id={batch_id - 1}").first()[0] if batch_id else None
        rows = batch.withColumn("window", F.window("ts", width))
        ended = F.lit(newest) - F.expr(f"interval {late}")
        behind = F.coalesce(F.col("window.end") <= ended, F.lit(False)) if newest else F.lit(False)
        stored = f"{checkpoint}-batches/batch_id={batch_id}"  # read by three branches
        rows.withColumn("behind", behind).write.mode("overwrite").parquet(stored)
        rows = spark.read.parquet(stored)
        ends = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]
        rows.filter("not behind and window is not null").groupBy("window", "recommendation").agg(
            F.count(F.lit(1)).alias("n")).select(*ends, "recommendation", "n").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        rows.filter("behind").select(*batch.columns, *ends).write.mode("overwrite").parquet(f"{late_out}/batch_id={batch_id}")
        top = rows.agg(F.greatest(F.max("ts"), F.lit(newest).cast("timestamp")).alias("newest"))
        top.coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}-newest/batch_id={batch_id}")

    writer = verdicts.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def counted(counts: DataFrame) -> DataFrame:
    """The counts of all batches of :func:`count_intake` as one per window and verdict."""
    return counts.groupBy("window_start", "window_end", "recommendation").agg(F.sum("n").alias("n"))


def _read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """``path`` is one file or a folder of files; a stream takes a single file only as what a pattern matches."""
    path = path.rstrip("/")
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(spark: SparkSession, path: str, schema, check: Callable[[DataFrame], DataFrame],
                  work: str) -> DataFrame:
    """Everything that has arrived under ``path``, checked as a stream; ``work`` is a shared folder."""
    query = stream_checks(_read_stream(spark, path, schema), f"{work}/out", f"{work}/state", check)
    query.awaitTermination()
    return spark.read.parquet(f"{work}/out")


def run_uploads(spark: SparkSession, path: str, schema, uploads: Callable[[DataFrame], DataFrame],
                work: str) -> DataFrame:
    """The uploads kept of everything that has arrived; ``uploads`` gives content_hash and received_at."""
    rows = uploads(_read_stream(spark, path, schema))
    dedupe_uploads(rows, f"{work}/out", f"{work}/state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{work}/out")


def run_counts(spark: SparkSession, path: str, schema, verdicts: Callable[[DataFrame], DataFrame],
               work: str) -> tuple[DataFrame, DataFrame]:
    """Counts on time and late rows of everything that has arrived."""
    rows = verdicts(_read_stream(spark, path, schema))
    count_intake(rows, f"{work}/counts", f"{work}/late", f"{work}/state").awaitTermination()
    return counted(spark.read.parquet(f"{work}/counts")), spark.read.parquet(f"{work}/late")
