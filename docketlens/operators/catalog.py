"""Judged checks: who is asked what, and how outside answers are merged.

No model is called here.  ``judge_requests`` builds the question table;
answers come back as a table and are checked against it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens import rules as R
from docketlens import schema as S
from docketlens.functions import text as X

UNANSWERED = "Not evaluated by AI analysis; manual review recommended."
NO_MESSAGE = "No details provided."


# Documents of one type meet the checks of their type on this many keys.
SALTS = 8


def asked() -> Column:
    return F.col("types").isNull() | F.array_contains("types", F.col("brief_type"))


def checks_by_type(catalog: DataFrame) -> DataFrame:
    """Every catalogue row once per document type, with ``applicable``: few rows, whatever the documents."""
    types = F.array(*[F.lit(t) for t in R.BRIEF_TYPES])
    return catalog.withColumn("brief_type", F.explode(types)).withColumn(
        "applicable", F.coalesce(asked(), F.lit(False)))


def docs_by_checks(docs: DataFrame, catalog: DataFrame) -> DataFrame:
    """JN-3: every document with every catalogue row, by an equi-join on its type.

    The catalogue side is small and Spark broadcasts it by its size; where it is
    not, the salt spreads the few types over more keys.  Types outside the
    enumeration are treated as unknown.  Select the document columns needed
    beforehand.
    """
    rows = checks_by_type(catalog).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("brief_type", "type_key")
    kind = F.when(F.col("brief_type").isin(*R.BRIEF_TYPES), F.col("brief_type")).otherwise("unknown")
    keyed = docs.withColumns({"type_key": kind, "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})
    return keyed.join(rows, ["type_key", "salt"]).drop("type_key", "salt")


def applicable_checks(docs: DataFrame, catalog: DataFrame) -> DataFrame:
    """PRJ-12: per document which checks are asked; the others pass unasked."""
    return docs_by_checks(docs.select("doc_id", "brief_type"), catalog)


def inapplicable_results(applicable: DataFrame) -> DataFrame:
    return applicable.filter(~F.col("applicable")).select(
        "doc_id", "check_id", "name", "rule", F.lit(True).alias("passed"), "severity",
        F.lit(False).alias("applicable"),
        F.format_string("Not applicable to %s briefs.", F.col("brief_type")).alias("message"),
        F.lit(None).cast("string").alias("details"),
        F.lit(None).cast("array<int>").alias("pages"),
        F.lit(None).cast("array<string>").alias("items"))


def rule_corpus(rule_texts: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Rule texts in corpus order as one row; a missing rule leaves a placeholder.

    One text per required rule takes part: of several under one name the last in order.
    """
    names = list(required or R.REQUIRED_RULES)
    wanted = rule_texts.sparkSession.createDataFrame(
        list(enumerate(names)), "rule_no int, file_name string")
    number = F.regexp_extract("file_name", r"^rule-(.*)\.md$", 1)
    gap = F.format_string("[Rule %s text not available. Expected at %s]", number, F.col("file_name"))
    known = rule_texts.filter(F.col("file_name").isin(names)).groupBy("file_name").agg(F.max("text").alias("text"))
    filled = wanted.join(known, "file_name", "left").select(
        "rule_no", F.coalesce("text", gap).alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("rule_no", "text")))  # one text per required rule
    return filled.groupBy().agg(F.array_join(
        F.transform(parts, lambda p: p["text"]), R.RULE_SEPARATOR).alias("rules_text"))


def rules_key(corpus: DataFrame) -> str:
    """The name under which a rule corpus is kept: requests carry it instead of the text."""
    return corpus.select(X.content_hash(F.col("rules_text"))).first()[0]


def requested_checks(catalog: DataFrame) -> DataFrame:
    """Per document type the JSON array of checks to ask.

    Built once per type (seven rows), not once per document.
    """
    items = F.array_sort(F.collect_list(F.struct(
        "check_no", F.struct(F.col("check_id").alias("id"), "name", "rule", "description")
        .alias("item"))))
    return checks_by_type(catalog).filter("applicable").groupBy("brief_type").agg(
        F.to_json(F.transform(items, lambda i: i["item"])).alias("checks_json"),
        F.count(F.lit(1)).alias("asked_checks"))


def judge_requests(docs: DataFrame, catalog: DataFrame, rules: str,
                   th: R.Thresholds = R.DEFAULTS) -> DataFrame:
    """PRJ-14: everything a judge needs, one row per part of a document's text.

    No text is cut off: the parts, at most ``judge_text_chars`` long, are numbered
    from 1 and joined give the whole.  The rule corpus is named by its key.
    """
    parts = X.text_parts(F.col("full_text"), th.judge_text_chars)
    return (
        docs.join(requested_checks(catalog), "brief_type")
        .select("doc_id", "brief_type", "total_pages", "word_count", "asked_checks", "checks_json",
                F.lit(rules).alias("rules_key"), F.size(parts).alias("part_count"),
                F.posexplode(parts).alias("part", "brief_text"))
        .withColumn("part_no", F.col("part") + 1).drop("part")
    )


def join_parts(judged: DataFrame, checks: DataFrame) -> DataFrame:
    """Answers about parts of a text as one per document and check.

    The catalogue's ``combine`` decides: ``any`` passes if one part passes, the
    others only if no part fails.  The first part that decided gives rule, message
    and details; ``worst`` gives those of every failing part, in order.  Parts
    without an answer decide nothing.  Checks the catalogue does not know are
    joined as ``all``; unreadable answers keep their problem.
    """
    ok = F.coalesce("passed", F.lit(True))
    answer = F.struct("part_no", "rule", "message", "details")
    policies = checks.select("check_id", "combine").dropDuplicates(["check_id"])
    grouped = judged.join(policies, "check_id", "left").groupBy("doc_id", "check_id").agg(
        F.min("problem").alias("problem"), F.first("combine").alias("combine"),
        F.bool_or(ok).alias("some"), F.bool_and(ok).alias("every"),
        F.min(F.when(ok, answer)).alias("good"), F.min(F.when(~ok, answer)).alias("bad"),
        # As many as the text has parts that fail, and only where all are shown.
        F.array_sort(F.collect_list(F.when(~ok & (F.col("combine") == "worst"), answer))).alias("all_bad"))

    def listed(field: str) -> Column:
        texts = F.transform(F.filter("all_bad", lambda a: a[field].isNotNull()), lambda a: F.format_string(
            "part %d: %s", a["part_no"], a[field]))
        return F.when(F.size("all_bad") > 1, F.nullif(F.array_join(texts, "; "), F.lit(""))).otherwise(F.col(f"j.{field}"))

    passed = F.when(F.col("combine") == "any", F.col("some")).otherwise(F.col("every"))
    return grouped.withColumn("passed", passed).withColumn("j", F.when(F.col("passed"), F.col("good")).otherwise(
        F.col("bad"))).select("doc_id", "problem", "check_id", F.when(F.col("check_id").isNotNull(), F.col("passed")).alias("passed"),
                              "j.rule", listed("message").alias("message"), listed("details").alias("details"))


def parse_judgement(raw: Column) -> Column:
    """SCL-13: the answer's JSON array, or null when there is none.

    Code-fence lines go first; text around the array is tolerated.
    """
    trimmed = X.strip(raw)
    unfenced = F.array_join(F.filter(
        F.split(trimmed, "\n", -1), lambda line: ~line.startswith("```")), "\n")
    body = F.when(trimmed.startswith("```"), unfenced).otherwise(trimmed)
    outer = F.regexp_extract(body, r"(?s)\[.*\]", 0)
    falsy = ["false", "null", "0", "0.0", "-0", "", "[]", "{}"]

    def item(m: Column) -> Column:
        # A map tells a null from a missing field: null is false, missing is left open.
        passed = F.when(F.map_contains_key(m, "passed"), F.coalesce(~F.lower(m["passed"]).isin(falsy), F.lit(False)))
        return F.struct(m["id"].alias("id"), passed.alias("passed"),
                        *[m[k].alias(k) for k in ("rule", "message", "details")])

    def parsed(text: Column) -> Column:
        whole = F.when(X.strip(text).startswith("["), F.from_json(text, "array<map<string,string>>"))
        read = ~F.exists(whole, lambda m: m.isNull())
        return F.when(read, F.transform(whole, item))

    return F.coalesce(parsed(body), parsed(F.when(outer != "", outer)))


def parse_problem(raw: Column, items: Column) -> Column:
    """Why an answer gave no rows; null when it was read."""
    return F.when(items.isNull(), F.when(
        raw.rlike(r"(?s)\[.*\]"), "the answer could not be parsed as JSON.").otherwise(
        "the answer holds no JSON array."))


def judged_rows(answers: DataFrame, raw: str = "answer") -> DataFrame:
    """Judged items of raw answers, one row each.

    An answer that cannot be read leaves one row with ``problem`` set.
    """
    items = answers.withColumn("items", parse_judgement(F.col(raw)))
    part = [c for c in ("part_no",) if c in answers.columns]
    return items.select(
        "doc_id", *part, parse_problem(F.col(raw), F.col("items")).alias("problem"),
        F.explode_outer("items").alias("j")).select(
        "doc_id", *part, "problem", F.col("j.id").alias("check_id"), "j.passed", "j.rule",
        "j.message", "j.details")


def merge_judgements(applicable: DataFrame, judged: DataFrame) -> DataFrame:
    """JN-8: answers for checks that were asked, and a pass for the unanswered.

    The catalogue decides name and severity; the judge may correct the rule.
    Silence never fails a document: ``evaluated`` tells such rows apart.
    Answers given twice stay twice, as in the source.
    """
    asked_rows = applicable.filter("applicable").select(
        "doc_id", "check_id", "name", F.col("rule").alias("catalog_rule"), "severity")
    answers = judged.select(
        "doc_id", "check_id", F.col("passed").alias("j_passed"), F.col("rule").alias("j_rule"),
        F.col("message").alias("j_message"), F.col("details").alias("details"),
        F.lit(True).alias("evaluated")).filter(F.col("check_id").isNotNull())
    merged = asked_rows.join(answers, ["doc_id", "check_id"], "left")
    unanswered = F.lit(UNANSWERED)
    if "problem" in judged.columns:
        problems = judged.groupBy("doc_id").agg(F.min("problem").alias("problem")).filter(
            F.col("problem").isNotNull())
        merged = merged.join(problems, "doc_id", "left")
        unanswered = F.coalesce(
            F.concat(F.lit("AI analysis unavailable: "), "problem"), unanswered)
    evaluated = F.coalesce("evaluated", F.lit(False))
    return merged.select(
        "doc_id", "check_id", "name",
        F.coalesce(F.nullif("j_rule", F.lit("")), "catalog_rule").alias("rule"),
        F.coalesce("j_passed", F.lit(True)).alias("passed"), "severity",
        F.lit(True).alias("applicable"),
        F.when(evaluated, F.coalesce("j_message", F.lit(NO_MESSAGE)))
        .otherwise(unanswered).alias("message"),
        "details", F.lit(None).cast("array<int>").alias("pages"),
        F.lit(None).cast("array<string>").alias("items"), evaluated.alias("evaluated"))


def requested_minus_judged(applicable: DataFrame, judged: DataFrame) -> DataFrame:
    """SET-3: checks that were asked and never answered."""
    return applicable.filter("applicable").select("doc_id", "check_id").join(
        judged.select("doc_id", "check_id"), ["doc_id", "check_id"], "left_anti")


def semantic_results(docs: DataFrame, catalog: DataFrame, judged: DataFrame) -> DataFrame:
    """All judged checks of every document: answered, unanswered, not asked."""
    applicable = applicable_checks(docs, catalog)
    merged = merge_judgements(applicable, judged).select(*S.RESULT_COLUMNS)
    return all_results(merged, inapplicable_results(applicable))


def all_results(first: DataFrame, second: DataFrame) -> DataFrame:
    """SET-1: both result sets, duplicates kept."""
    return first.unionByName(second, allowMissingColumns=True)
