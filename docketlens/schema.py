"""Explicit schemas of every table the engine reads; nothing is inferred."""

from pyspark.sql import types as T

SPAN = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("font", T.StringType()),
    T.StructField("size", T.DoubleType()),
    T.StructField("flags", T.IntegerType()),
    T.StructField("origin", T.ArrayType(T.DoubleType())),
])
LINE = T.StructType([T.StructField("spans", T.ArrayType(SPAN))])
BLOCK = T.StructType([
    T.StructField("type", T.IntegerType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("lines", T.ArrayType(LINE)),
])
PAGE = T.StructType([
    T.StructField("page_no", T.IntegerType()),
    T.StructField("width_pt", T.DoubleType()),
    T.StructField("height_pt", T.DoubleType()),
    T.StructField("text", T.StringType()),
    T.StructField("blocks", T.ArrayType(BLOCK)),
])
LAYOUT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("pages", T.ArrayType(PAGE)),
    T.StructField("_corrupt_record", T.StringType()),
])

RESULT_FIELDS = [
    T.StructField("check_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("applicable", T.BooleanType()),
    T.StructField("pages", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),  # everything a shortened text stands for
]
RESULT = T.StructType(RESULT_FIELDS)

# One JSON object per document: either producer's array may be present.
DOCUMENT_JSON = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("pdf_path", T.StringType()),
    T.StructField("brief_type", T.StringType()),
    T.StructField("total_pages", T.LongType()),
    T.StructField("body_pages", T.LongType()),
    T.StructField("word_count", T.LongType()),
    T.StructField("cover_text", T.StringType()),
    T.StructField("full_text", T.StringType()),
    T.StructField("mechanical_results", T.ArrayType(RESULT)),
    T.StructField("semantic_results", T.ArrayType(RESULT)),
    T.StructField("_corrupt_record", T.StringType()),
])

JUDGEMENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("rule", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("details", T.StringType()),
])

RESULT_COLUMNS = [
    "doc_id", "check_id", "name", "rule", "passed", "severity", "applicable",
    "message", "details", "pages", "items",
]
