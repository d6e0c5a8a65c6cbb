"""The registered queries of the operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (brown, common, decontaminate, exact_dedup, licenses, line_dedup, outliers, packing, quality, simhash,
               toxicity, variants, warc, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


@_query("op3_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS n
  FROM d WINDOW w AS (PARTITION BY h ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g""")
def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, with the row of its group that stays."""
    return exact_dedup.labelled_rows(common.documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("content_hash").alias("text_sha256"))


@_query("op10_simhash_near_dedup")
def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at three or fewer differing bits."""
    prints = simhash.shingle_fingerprints(common.documents(spark, sf_dir), words=3)
    return simhash.near_groups(prints).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


@_query("op9_best_fit_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens, one row per piece."""
    pieces = packing.token_pieces(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces).withColumnRenamed("id", "doc_id")


@_query("op1_decontamination", r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
z AS (SELECT DISTINCT least(len(w), 5) AS z FROM i WHERE len(w) > 0),
si AS (SELECT DISTINCT item_id, array_to_string(w[k:k + z - 1], ' ') AS s FROM (
  SELECT item_id, w, z, unnest(range(1, len(w) - z + 2)) AS k FROM i JOIN z ON z = least(len(w), 5))),
sd AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + z - 1], ' ') AS s FROM (
  SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS k FROM d JOIN z ON z <= len(w))),
n AS (SELECT item_id, count(*) AS item_shingles FROM si GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS found_shingles FROM si JOIN sd USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles, found_shingles, found_shingles / item_shingles AS containment
FROM f JOIN n USING (item_id) WHERE found_shingles / item_shingles >= 0.8""")
def contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the benchmark item it contains."""
    return decontaminate.contained_items(
        common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
    ).withColumnsRenamed({"id": "doc_id", "item": "item_id"})


@_query("op7_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of good quality of every document."""
    docs = common.documents(spark, sf_dir)
    weights = quality.train(docs, common.labels(spark, sf_dir))
    return quality.score(docs, weights).select(
        F.col("id").alias("doc_id"), (common.fold("id") == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query("op4_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of toxicity of every document."""
    docs = common.documents(spark, sf_dir)
    lexicon = toxicity.train(docs, common.labels(spark, sf_dir))
    return toxicity.score(docs, lexicon).select(
        F.col("id").alias("doc_id"), (common.fold("id") == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "weight", "words")


@_query("op2_brown_lm")
def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every document, by words alone and by class bigrams."""
    docs = common.documents(spark, sf_dir)
    model = brown.train(docs.filter(~brown.held_out()))
    return brown.score(docs, model).select(
        F.col("id").alias("doc_id"), brown.held_out("id").alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@_query("op6_warc_index", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> head THEN head END AS refers_to FROM m""")
def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, indexed, looked up by their keys and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archive = warc.write_archives(pages)
    index = warc.build_index(archive)
    return warc.read_records(archive, warc.lookup(index, pages)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op5_line_dedup")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated chunks removed."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.line_dedup(docs, report=("removed_chunks", "removed_bytes"))


def _paths(docs: DataFrame) -> DataFrame:
    """The documents as files of a tree: ten to a directory, ten directories to one above,
    and so on; the first of ten is its directory's license file."""
    i = F.col("doc_id")
    level = lambda n: F.floor(i / n).cast("string")
    name = F.when(i % 10 == 0, F.lit("LICENSE")).otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    # The license file of the first directory of ten stands one level higher, and so on.
    where = (F.when(i % 1000 == 0, F.concat_ws("/", level(1000)))
             .when(i % 100 == 0, F.concat_ws("/", level(1000), level(100)))
             .otherwise(F.concat_ws("/", level(1000), level(100), level(10))))
    return docs.select("doc_id", F.concat_ws("/", F.lit("docs"), where, name).alias("path"), "text")


_LICENSE_SQL = r"""
WITH RECURSIVE p AS (
  SELECT doc_id, coalesce(text, '') AS text, 'docs/' ||
    CASE WHEN doc_id % 1000 = 0 THEN '' || doc_id // 1000
         WHEN doc_id % 100 = 0 THEN doc_id // 1000 || '/' || doc_id // 100
         ELSE doc_id // 1000 || '/' || doc_id // 100 || '/' || doc_id // 10 END AS dir,
    doc_id % 10 = 0 AS is_file, CASE WHEN doc_id % 10 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS name
  FROM documents),
h AS (SELECT doc_id, name, text, CASE WHEN regexp_matches(string_split_regex(text, '%(no_comment)s')[1], '%(cue)s')
    THEN string_split_regex(text, '%(no_comment)s')[1] END AS header FROM p),
j AS (SELECT doc_id, name, text, regexp_replace(regexp_replace(regexp_replace(text, '%(mark)s', '\1', 'g'), '%(paragraph)s', '. ', 'g'), '\n', ' ', 'g') AS joined,
    regexp_replace(regexp_replace(regexp_replace(header, '%(mark)s', '\1', 'g'), '%(paragraph)s', '. ', 'g'), '\n', ' ', 'g') AS header FROM h),
s0 AS (SELECT doc_id, 0 AS kind, unnest(string_split(regexp_replace(text, '([.!?])[ \t\n\x0b\x0c\r]+', '\1' || chr(10), 'g'), chr(10))) AS s FROM j
  UNION SELECT doc_id, 0, unnest(string_split(regexp_replace(joined, '([.!?])[ \t\n\x0b\x0c\r]+', '\1' || chr(10), 'g'), chr(10))) FROM j),
s AS (SELECT * FROM s0 WHERE regexp_matches(s, '%(cue)s')
  UNION SELECT doc_id, 1, joined FROM j WHERE regexp_matches(name, '%(file_name)s')
  UNION SELECT doc_id, 1, header FROM j WHERE header IS NOT NULL
  UNION SELECT doc_id, 2, 'spdx ' || regexp_replace(lower(unnest(regexp_extract_all(text, '%(tag)s', 1))), '%(noise)s', '', 'g') FROM j),
u AS (SELECT s, count(*) AS times, regexp_extract_all(lower(s), '%(term)s') AS terms FROM s GROUP BY s),
n AS (SELECT coalesce(sum(times), 0) AS n FROM u),
df AS (SELECT term, sum(times) AS df FROM (SELECT times, unnest(list_distinct(terms)) AS term FROM u) GROUP BY term),
t(template, license, body) AS (VALUES %(templates)s),
st AS (SELECT s, term, count(*) AS tf FROM (SELECT s, unnest(terms) AS term FROM u) GROUP BY s, term),
tt AS (SELECT template, license, term, count(*) AS tf FROM (
  SELECT template, license, unnest(regexp_extract_all(lower(body), '%(term)s')) AS term FROM t) GROUP BY ALL),
sw AS (SELECT s, term, tf * (ln((n.n + 1) / (df + 1)) + 1) AS w FROM st JOIN df USING (term), n),
tw AS (SELECT template, license, term, tf * (ln((n.n + 1) / (coalesce(df, 0) + 1)) + 1) AS w FROM tt LEFT JOIN df USING (term), n),
sn AS (SELECT s, sqrt(sum(w * w)) AS size FROM sw GROUP BY s),
tn AS (SELECT template, sqrt(sum(w * w)) AS size FROM tw GROUP BY template),
c AS (SELECT sw.s, tw.license, round(sum(sw.w * tw.w) / (any_value(sn.size) * any_value(tn.size)), 6) AS cosine
  FROM sw JOIN tw USING (term) JOIN sn ON sn.s = sw.s JOIN tn ON tn.template = tw.template
  GROUP BY sw.s, tw.template, tw.license),
b AS (SELECT * FROM c WHERE cosine >= 0.6 QUALIFY row_number() OVER (PARTITION BY s ORDER BY cosine DESC, license) = 1),
o AS (SELECT doc_id, license, cosine FROM s JOIN b USING (s)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kind DESC, cosine DESC, license) = 1),
f AS (SELECT p.doc_id, p.dir, p.name, p.is_file, o.license AS own_license, o.cosine AS own_similarity FROM p LEFT JOIN o USING (doc_id)),
g AS (SELECT dir, arg_max(own_license, {'c': own_similarity, 'l': own_license}) AS dir_license FROM f WHERE is_file AND own_license IS NOT NULL GROUP BY dir),
i AS (SELECT f.doc_id, g.dir, g.dir_license FROM f JOIN g ON f.dir = g.dir OR starts_with(f.dir, g.dir || '/') WHERE f.own_license IS NULL
  QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(g.dir) DESC) = 1)
SELECT doc_id, f.dir || '/' || name AS path, own_license, own_similarity, coalesce(own_license, dir_license) AS license,
       CASE WHEN own_license IS NOT NULL THEN 'own' WHEN dir_license IS NOT NULL THEN 'inherited' END AS via, i.dir AS license_dir
FROM f LEFT JOIN i USING (doc_id)"""
_BODIES = [*licenses.TEMPLATES, *((x, "spdx " + x.lower().replace("-", "").replace(".", "")) for x in sorted({x for x, _ in licenses.TEMPLATES}))]
for _mark, _value in (("%(cue)s", licenses.CUE), ("%(term)s", licenses.TERM), ("%(no_comment)s", licenses.NO_COMMENT),
                      ("%(mark)s", licenses.MARK), ("%(paragraph)s", licenses.PARAGRAPH), ("%(file_name)s", licenses.FILE_NAME),
                      ("%(tag)s", licenses.TAG), ("%(noise)s", licenses.TAG_NOISE),
                      ("%(templates)s", ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_BODIES)))):
    _LICENSE_SQL = _LICENSE_SQL.replace(_mark, _value)


@_query("op8_license_scan", _LICENSE_SQL)
def licensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license of every document, its own or that of the nearest directory above."""
    files = _paths(common.documents(spark, sf_dir))
    return licenses.inherit_licenses(licenses.scan_licenses(files, keep=["doc_id"])).drop("file")


@_query("op11_quality_rules")
def outlying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers of every document."""
    return outliers.judge(common.documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "distance")


@_query("op12_spelling_variants")
def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word, the near word it goes back to, and the root of that chain."""
    return variants.spelling_forms(variants.word_counts(common.documents(spark, sf_dir)))


@_query("op13_embedding_whitening")
def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid vector on the four leading components, whitened."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitening.whiten(vectors, whitening.fit(vectors, k=4)).withColumnRenamed("id", "vec_id")
