"""Rows that every operator must take: nulls, empty, very long, tied, repeated, clashing columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("id", T.LongType()),
    T.StructField("key", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("fp", T.StringType()), T.StructField("count", T.LongType())])

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
BASE = " ".join(f"term{i * 7 % 101}y{i}" for i in range(200))


def odd_rows():
    def row(i, text, lang="en", source="s"):
        return (i, text, lang, source, None if text is None else len(text), 7, "k", 1.0, "f", 2)
    near = BASE.replace("term7y1 ", "changed ")
    return [row(1, None), row(2, ""), row(3, " \n\t "), row(4, "one"), row(5, "one two"),
            row(6, BASE), row(6, BASE), row(7, BASE.replace(" ", "  ")), row(8, near), row(9, near.upper()),
            row(10, LONG, None, None), row(11, LONG + " end", None, None), row(None, "a null id"),
            row(None, BASE), row(12, "é\x0b ü\x85 <|endoftext|>   end"), row(13, "same id one"),
            row(13, "same id two, another text"), row(14, "One\x0cTwo")]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
