"""Exact duplicates by progressive refinement, in DataFrame operations only.

Texts are equal when they are identical after deleting white space.  One scan
reduces each text to its normalised size and the hash of its normalised
beginning.  Rows whose size is unique leave first, then rows whose (size,
prefix hash) is unique; only the rest is read again and hashed in full.

Hot groups: every grouping is a combining aggregate, so a group that holds a
third of the rows costs one row per task; rows meet their group's summary in an
equi-join whose skewed side adaptive execution may split.

Defined cases: null text is empty; all empty or white texts are equal; a null
id takes part and loses ties; rows repeated with the same id and text count as
copies and exactly one of them is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_SPACE, staged, text_of

#: Code points of the normalised text under the prefix hash.
PREFIX = 256


def without_space(text: Column) -> Column:
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), WHITE_SPACE, text)


def content_hash(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, lower-case hex."""
    return F.sha2(without_space(text), 256)


def duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     prefix: int = PREFIX) -> DataFrame:
    """Groups of two or more equal texts: (content_hash, keep_id, keep_chars, group_size).

    Of a group the row with the most code points in its original text, then the
    smallest id, is to be kept.
    """
    text = text_of(text_column)
    facts = staged(
        docs.select(F.col(id_column).alias("id"), F.char_length(text).alias("chars"),
                    without_space(text).alias("plain"))
        .select("id", "chars", F.octet_length("plain").alias("size"),
                F.xxhash64(F.substring("plain", 1, prefix)).alias("head")), "dedup-facts")
    # Written first, these few keys are broadcast where they are small, and the
    # facts, among which one size may be frequent, are not dealt by size.
    sizes = staged(facts.groupBy("size").count().filter("count > 1").select("size"), "dedup-sizes")
    same_size = facts.join(sizes, "size", "left_semi")
    heads = staged(same_size.groupBy("size", "head").count().filter("count > 1").select("size", "head"), "dedup-heads")
    suspects = same_size.join(heads, ["size", "head"], "left_semi").select("id").distinct()

    # The second scan: full contents of the suspects alone.
    full = (docs.select(F.col(id_column).alias("id"), text.alias("text"))
            .join(suspects.withColumnRenamed("id", "suspect"),
                  F.col("id").eqNullSafe(F.col("suspect")), "left_semi")
            .select("id", F.char_length("text").alias("chars"),
                    content_hash(F.col("text")).alias("content_hash")))
    first = F.min(F.struct((-F.col("chars")).alias("fewer"), F.col("id").isNull().alias("no_id"), F.col("id")))
    return (full.groupBy("content_hash").agg(first.alias("first"), F.count("*").alias("group_size"))
            .filter("group_size > 1")
            .select("content_hash", F.col("first.id").alias("keep_id"),
                    (-F.col("first.fewer")).alias("keep_chars"), "group_size"))


def labelled_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  prefix: int = PREFIX) -> DataFrame:
    """One row per input row: (id, chars, content_hash, keep_id, group_size, kept)."""
    groups = staged(duplicate_groups(docs, id_column, text_column, prefix), "dedup-groups")
    text = text_of(text_column)
    # Numbers rows that agree in everything, so that one of them stays; its key
    # is unique unless rows are repeated, hence never hot.
    twin = Window.partitionBy("content_hash", "id", "chars").orderBy(F.lit(1))
    rows = (docs.select(F.col(id_column).alias("id"), F.char_length(text).alias("chars"),
                        content_hash(text).alias("content_hash"))
            .withColumn("twin", F.row_number().over(twin)))
    alone = F.col("group_size").isNull()
    return (rows.join(groups, "content_hash", "left")
            .select("id", "chars", "content_hash",
                    F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    (alone | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
                              & (F.col("twin") == 1))).alias("kept")))


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                prefix: int = PREFIX) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    Two rows may share an id; they are told apart by their content hash.
    """
    rows = staged(labelled_rows(docs, id_column, text_column, prefix), "dedup-rows")
    # Only what goes is joined back: copies are fewer than documents.
    by_row = rows.groupBy("id", "chars", "content_hash").agg(
        F.max("kept").alias("stays"), F.count("*").alias("times"))
    gone = by_row.filter("not stays").select(
        F.col("id").alias("__id"), F.col("chars").alias("__chars"), F.col("content_hash").alias("__gone"))
    text = text_of(text_column)
    hashed = docs.withColumns({"__hash": content_hash(text), "__own": F.char_length(text)})
    left = hashed.join(gone, hashed[id_column].eqNullSafe(gone["__id"]) & (F.col("__hash") == F.col("__gone"))
                       & (F.col("__own") == F.col("__chars")), "left_anti")
    if not by_row.filter("stays and times > 1").isEmpty():  # the same row more than once
        left = left.dropDuplicates([id_column, "__hash", "__own"])
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
