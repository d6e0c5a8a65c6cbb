"""Readers: filing manifest, layout, interchange results, rule texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlens import rules as R
from docketlens import schema as S
from docketlens.functions import text as X


def candidate_filings(files: DataFrame, th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """Every file with the right extension, its content hash, and whether it is oversized.

    Nothing is left out: ``status`` lets the caller treat large filings apart.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return (
        files.withColumn("file_name", name)
        .filter(X.matches(F.col("file_name"), r"\.pdf$", "i"))
        .withColumn("status", F.when(F.col("length") <= th.max_filing_bytes, "ok").otherwise("oversized"))
        .withColumn("content_hash", X.content_hash(F.col("content")))
        .drop("content")
    )


def read_manifest(spark: SparkSession, folder: str, th: R.Thresholds = R.DEFAULTS, tasks: int | None = None) -> DataFrame:
    """SRC-1: candidate filings of a folder with their content hash.

    Spark counts each file as 4 MB and so gives a task few of them; of very many small
    ones ``tasks`` makes that many tasks at most.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]")
        .option("recursiveFileLookup", "true").load(folder)
    )
    return candidate_filings(files if tasks is None else files.coalesce(tasks), th)


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: nested documents, one JSON object per line.

    :func:`docketlens.operators.layout.flatten_layout` turns them into spans.
    A line that cannot be parsed keeps its text in ``_corrupt_record``;
    :func:`rejected_lines` lists those.
    """
    return spark.read.schema(S.LAYOUT).option("mode", "PERMISSIVE").json(path)


def rejected_lines(nested: DataFrame) -> DataFrame:
    """Lines that give no rows, with the reason: broken JSON, no document id, no page number.

    Write them to a table of rejects beside the results and count them there.
    """
    broken = F.col("_corrupt_record").isNotNull()
    reason = F.when(broken, "not JSON").when(F.col("doc_id").isNull(), "no doc_id")
    if "pages" in nested.columns:
        reason = reason.when(F.exists("pages", lambda p: p["page_no"].isNull()), "page without number")
    return nested.withColumn("reason", reason).filter("reason is not null").select(
        "doc_id", "reason", F.col("_corrupt_record").alias("line"))


def unfold_results(documents: DataFrame) -> DataFrame:
    """Result rows of interchange documents of either producer.

    A missing ``applicable`` means true; missing page lists of failed results
    are recovered from the message.
    """
    empty = F.array().cast(documents.schema["mechanical_results"].dataType)
    rows = documents.select("doc_id", F.explode(F.concat(
        F.coalesce("mechanical_results", empty), F.coalesce("semantic_results", empty)))
        .alias("r")).select("doc_id", "r.*")
    return rows.withColumns({
        "applicable": F.coalesce("applicable", F.lit(True)),
        "pages": F.coalesce("pages", X.pages_from_message(
            F.col("message"), F.col("details"), F.col("passed"))),
    }).select(*S.RESULT_COLUMNS)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Interchange documents; a malformed line keeps its text in ``_corrupt_record``."""
    return (
        spark.read.schema(S.DOCUMENT_JSON).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: result rows of all interchange documents under ``path``."""
    return unfold_results(read_documents(spark, path))


def read_rules(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-4: rule texts by file name, one row per file."""
    return (
        spark.read.option("wholetext", "true").option("pathGlobFilter", "*.md").text(folder)
        .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    )


def rule_hashes(rule_texts: DataFrame) -> DataFrame:
    """Content hash of each rule text, as the manifest states it."""
    return rule_texts.select("file_name", X.content_hash(F.col("text")).alias("content_hash"))


def read_rule_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest JSON to one row per rule file."""
    schema = ("version string, build_date string, rules_verified string, "
              "rules_freshness_days int, check_url string, rule_hashes map<string,string>")
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(
        F.explode("rule_hashes").alias("file_name", "expected_hash"))
