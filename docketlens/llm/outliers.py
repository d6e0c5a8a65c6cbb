"""Quality rules: base rules, then robust multivariate outliers by language and source.

Five statistics of a text (words, mean word length, symbols, repeated lines, words
in repeated windows) are transformed so that their spread is even, and put on an
integer grid, so that all sums are exact whatever the partitioning.  For each
language and source the minimum covariance determinant gives location and scatter
that outliers cannot pull: from three robust starts (independent scales, spatial
signs, bounded scores), concentration steps take the share ``H`` of the vectors that
lie nearest by Mahalanobis distance, until their determinant no longer falls; the
start with the least determinant wins.  Vectors near it are weighted in once more.
Rows farther than a chi-square quantile are rejected.

A concentration step is one aggregation: distances fall into bins, moments are summed
per (group, start, bin), and the bins up to the one that reaches the share are added.
Groups never meet in one task.  Everything is DataFrame operations; matrices of five
are factorised in columns.

Choices: each distinct vector of a group counts once, so groups of copies do not pull
the estimates.  A ridge (``FLOOR`` squared) is added to every variance, as for
regularised determinants, since most texts have no symbols or repeats at all.  Rows
that fail the base rules take no part in the estimates.  Sources with fewer than
``LEAST`` distinct vectors are pooled by language, small languages with each other.

Defined cases: null text has no words and fails the base rules; null languages and
sources are groups of their own; repeated rows get the same verdict each; a group with
one vector keeps it; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_of

#: Fixed values of the base rules.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # in a hundred

#: Grid steps per unit of a transformed statistic.
GRID = 256
STATISTICS = 5
#: Unrepeated lines and words added to every text before its shares are taken.
PRIOR_LINES, PRIOR_WORDS = 5, 50
#: Share of a group's vectors that a concentration step keeps.
H = 0.75
#: Least standard deviation of a transformed statistic.
FLOOR = 0.1
#: Distinct vectors that a group needs for estimates of its own.
LEAST = 50
#: Rows beyond this quantile of the chi-square distribution are rejected.
LEVEL = 1 - 1e-6
#: Rows within this quantile take part in the weighted estimates.
INNER = 0.975
STEPS = 12
#: Bins of a distance, per natural logarithm of 1 + its square.
BINS = 256
STARTS = 3
#: Rows of one group meet its estimates on this many keys.
SALTS = 16

V = [f"v{i}" for i in range(STATISTICS)]
PAIRS = [(i, j) for i in range(STATISTICS) for j in range(i + 1)]
MEAN = [f"m{i}" for i in range(STATISTICS)]
#: Entries of the inverse of the scatter's Cholesky factor.
FACTOR = [f"w{i}_{j}" for i, j in PAIRS]
GROUP = ["g_level", "g_lang", "g_source"]


# -- chi square -------------------------------------------------------------

def chi_square_cdf(x: float, k: int) -> float:
    """Series of the regularised lower incomplete gamma function."""
    term = total = 1 / (k / 2)
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= x / 2 / (k / 2 + n)
        total += term
    return total * math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2)) if x > 0 else 0.0


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, k) < p else (low, middle)
    return high


def consistency(share: float, k: int) -> float:
    """Factor that makes the scatter of the nearest ``share`` estimate that of all."""
    return share / chi_square_cdf(chi_square_quantile(share, k), k + 2)


# -- statistics -------------------------------------------------------------

def text_facts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """(id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every row."""
    text = F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    rows = docs.select(F.col(id_column).alias("id"), F.col(lang_column).alias("lang"),
                       F.col(source_column).alias("source"), text_of(text_column).alias("text"))
    keys = ["id", "lang", "source"]
    rows = rows.select(*keys, "text", F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(text, SPACES, -1)).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("words")
    shifted = [F.slice("words", F.lit(k), n - (WINDOW_WORDS - 1)) for k in range(1, WINDOW_WORDS + 1)]
    hashes = F.when(n >= WINDOW_WORDS, F.transform(F.arrays_zip(*shifted), lambda w: F.xxhash64(w)))
    rows = rows.select(
        *keys, n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"), lines.alias("lines"),
        hashes.alias("hashes"))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    # Only texts with a repeated window are sorted; equal windows are neighbours then.
    rows = rows.withColumn("sorted", F.when(repeats, F.sort_array(
        F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.col("sorted")

    def repeated(w: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(at, i - 1)["h"] == w["h"])
        return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(at, i + 1)["h"] == w["h"], F.lit(False))

    places = F.sort_array(F.transform(F.filter(at, repeated), lambda w: w["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW_WORDS).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW_WORDS), p - a["last"])).alias("n"), p.alias("last")))
    return rows.select(
        *keys, "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered["n"], F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def statistic_vectors(facts: DataFrame) -> DataFrame:
    """Adds v0...v4: lengths as logarithms, shares by their variance-stabilising transforms, on the grid.

    Shares of lines and words are shrunk by a few unrepeated ones: one repeated line in three says little.
    """
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    values = [F.log(words), F.log(chars / words), F.sqrt(F.col("n_symbols") / chars),
              F.asin(F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + PRIOR_LINES))),
              F.asin(F.sqrt(F.col("n_repeat_words") / (words + PRIOR_WORDS)))]
    return facts.withColumns({v: F.round(x * GRID).cast("long") for v, x in zip(V, values, strict=True)})


# -- groups -----------------------------------------------------------------

def _grouped(vectors: DataFrame, least: int) -> DataFrame:
    """The group of each (lang, source): its own, its language's small sources, or all small languages."""
    own = vectors.groupBy("lang", "source").count().withColumn("small", F.col("count") < least)
    rest = own.groupBy(F.col("lang").alias("rest_lang")).agg(
        F.sum(F.when(F.col("small"), F.col("count")).otherwise(0)).alias("rest"))
    known = own.join(rest, F.col("lang").eqNullSafe(F.col("rest_lang"))).withColumn(
        "level", F.when(~F.col("small"), 0).when(F.col("rest") >= least, 1).otherwise(2))
    by_lang, by_source = F.col("level") < 2, F.col("level") < 1

    def missing(column: str, used: Column) -> Column:  # null is not the empty name
        return F.when(used & F.col(column).isNull(), 1).otherwise(0)

    return known.select(
        "lang", "source", (F.col("level") + 4 * missing("lang", by_lang) + 8 * missing("source", by_source)).alias("g_level"),
        F.when(by_lang, F.coalesce("lang", F.lit(""))).otherwise("").alias("g_lang"),
        F.when(by_source, F.coalesce("source", F.lit(""))).otherwise("").alias("g_source"))


def _meet(rows: DataFrame, small: DataFrame, on: list[str], null_safe: bool = False) -> DataFrame:
    """Join of many rows with few: a hot key is spread over salts where Spark does not broadcast the few."""
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(*V), F.lit(SALTS)).cast("int"))
    right = small.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    right = right.withColumnsRenamed({c: f"__{c}" for c in on})
    same = F.col("__salt") == F.col("__salt2")
    for c in on:
        other = F.col(f"__{c}")
        same = same & (left[c].eqNullSafe(other) if null_safe else left[c] == other)
    return left.join(right, same).drop("__salt", "__salt2", *[f"__{c}" for c in on])


# -- medians and scales -----------------------------------------------------

def _medians(rows: DataFrame, name: str) -> DataFrame:
    """Per group and statistic the lower median, from counts of the grid's values."""
    values = rows.select(*GROUP, F.posexplode(F.array(*V)).alias("k", "x"))
    counts = values.groupBy(*GROUP, "k", "x").count()
    side = Window.partitionBy(*GROUP, "k")
    upto = F.sum("count").over(side.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(*GROUP, "k", "x", upto.alias("upto"), F.sum("count").over(side).alias("all"))
    middle = ranked.filter(2 * F.col("upto") >= F.col("all")).groupBy(*GROUP, "k").agg(F.min("x").alias("x"))
    return middle.groupBy(*GROUP).agg(*[F.max(F.when(F.col("k") == i, F.col("x"))).alias(f"{name}{i}") for i in range(STATISTICS)])


# -- matrices in columns ----------------------------------------------------

def factorised(moments: DataFrame, keep: list[str], scale: Column, ridge: float) -> DataFrame:
    """Location and inverse Cholesky factor from count ``n``, sums ``s*`` and products ``p*_*``.

    Adds m0..m4 (the sums' mean), w*_* and the logarithm of the determinant.
    """
    t = moments.withColumns({m: F.col(f"s{i}") / F.col("n") for i, m in enumerate(MEAN)})
    t = t.withColumns({f"c{i}_{j}": (F.col(f"p{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * scale
                       + (F.lit(ridge) if i == j else F.lit(0.0)) for i, j in PAIRS})

    def total(terms: list[Column]) -> Column:
        out = F.lit(0.0)
        for x in terms:
            out = out + x
        return out

    for j in range(STATISTICS):  # column by column: the factor L, then its inverse W
        pivot = F.sqrt(F.col(f"c{j}_{j}") - total([F.col(f"l{j}_{k}") ** 2 for k in range(j)]))
        t = t.withColumn(f"l{j}_{j}", pivot)
        t = t.withColumns({f"l{i}_{j}": (F.col(f"c{i}_{j}") - total([F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)]))
                           / F.col(f"l{j}_{j}") for i in range(j + 1, STATISTICS)})
    for i in range(STATISTICS):
        t = t.withColumns({f"w{i}_{j}": (F.lit(1.0) if i == j else
                                         -total([F.col(f"l{i}_{k}") * F.col(f"w{k}_{j}") for k in range(j, i)]))
                           / F.col(f"l{i}_{i}") for j in range(i + 1)})
    size = total([2 * F.log(f"l{i}_{i}") for i in range(STATISTICS)])
    return t.select(*keep, *MEAN, *FACTOR, size.alias("log_det"))


def distance() -> Column:
    """Squared Mahalanobis distance of v* to m* by the factor w*."""
    out = F.lit(0.0)
    for i in range(STATISTICS):
        row = F.lit(0.0)
        for j in range(i + 1):
            row = row + F.col(f"w{i}_{j}") * (F.col(f"v{j}") - F.col(f"m{j}"))
        out = out + row * row
    return out


def _sums(of: list[Column]) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(of)],
            *[F.sum(of[i] * of[j]).alias(f"p{i}_{j}") for i, j in PAIRS]]


MOMENTS = ["n", *[f"s{i}" for i in range(STATISTICS)], *[f"p{i}_{j}" for i, j in PAIRS]]


# -- minimum covariance determinant -----------------------------------------

def starts(vectors: DataFrame) -> DataFrame:
    """Three estimates per group: independent scales, covariance of spatial signs, covariance of bounded scores.

    Scores are put on a grid as well, so that their sums are exact.
    """
    middle = staged(_medians(vectors, "c"), "medians")
    centred = _meet(vectors, middle, GROUP)
    spread = _medians(centred.select(*GROUP, *[F.abs(F.col(v) - F.col(f"c{i}")).alias(v) for i, v in enumerate(V)]), "d")
    scales = staged(middle.join(spread, GROUP).select(
        *GROUP, *[f"c{i}" for i in range(STATISTICS)],
        *[F.greatest(1.4826 * F.col(f"d{i}"), F.lit(FLOOR * GRID)).alias(f"d{i}") for i in range(STATISTICS)]), "scales")
    scored = _meet(vectors, scales, GROUP).select(
        *GROUP, *[((F.col(v) - F.col(f"c{i}")) / F.col(f"d{i}")).alias(f"z{i}") for i, v in enumerate(V)])
    length = F.sqrt(sum((F.col(f"z{i}") ** 2 for i in range(1, STATISTICS)), F.col("z0") ** 2))
    parts = []
    for start, score in ((1, lambda z: F.coalesce(F.try_divide(z, length), F.lit(0.0))), (2, F.tanh)):
        put = scored.select(*GROUP, *[F.round(score(F.col(f"z{i}")) * 4096).cast("long").alias(v) for i, v in enumerate(V)])
        moments = put.groupBy(*GROUP).agg(*_sums([F.col(v) for v in V]))
        # The scatter of scores, about their mean, in units of the scales.
        fitted = factorised(moments, GROUP, F.lit(1 / 4096 ** 2), 0.01).join(scales, GROUP)
        parts.append(fitted.select(
            *GROUP, F.lit(start).alias("start"), *[F.col(f"c{i}").cast("double").alias(m) for i, m in enumerate(MEAN)],
            *[(F.col(f"w{i}_{j}") / F.col(f"d{j}")).alias(f"w{i}_{j}") for i, j in PAIRS], F.lit(math.inf).alias("log_det")))
    parts.append(scales.select(
        *GROUP, F.lit(0).alias("start"), *[F.col(f"c{i}").cast("double").alias(m) for i, m in enumerate(MEAN)],
        *[(1 / F.col(f"d{i}") if i == j else F.lit(0.0)).alias(f"w{i}_{j}") for i, j in PAIRS], F.lit(math.inf).alias("log_det")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def concentrate(vectors: DataFrame, estimates: DataFrame, share: float = H) -> DataFrame:
    """One step: moments of the nearest share of each group's vectors, for every start."""
    key = [*GROUP, "start"]
    binned = _meet(vectors, estimates, GROUP).withColumn("bin", F.floor(BINS * F.log1p(distance())).cast("int"))
    sums = binned.groupBy(*key, "bin").agg(*_sums([F.col(v) for v in V]))
    side = Window.partitionBy(*key)
    before = F.coalesce(F.sum("n").over(side.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = sums.withColumns({"before": before, "all": F.sum("n").over(side)}).filter(
        F.col("before") < F.ceil(F.col("all") * share))
    total = inside.groupBy(*key).agg(*[F.sum(c).alias(c) for c in MOMENTS])
    return factorised(total, key, F.lit(consistency(share, STATISTICS)), (FLOOR * GRID) ** 2)


def robust_estimates(vectors: DataFrame, steps: int = STEPS) -> DataFrame:
    """(group, m*, w*): weighted minimum-covariance-determinant estimates of distinct grid vectors."""
    key = [*GROUP, "start"]
    now = staged(starts(vectors), "starts")
    for _ in range(steps):
        after = staged(concentrate(vectors, now), "estimates")
        old = now.select(*key, F.col("log_det").alias("old"))
        settled = after.join(old, key).filter("log_det < old - 1e-9").isEmpty()
        now = after
        if settled:
            break
    best = now.groupBy(*GROUP).agg(F.min(F.struct("log_det", "start", *MEAN, *FACTOR)).alias("best")).select(*GROUP, "best.*")
    near = _meet(vectors, best, GROUP).filter(distance() <= chi_square_quantile(INNER, STATISTICS))
    moments = near.groupBy(*GROUP).agg(*_sums([F.col(v) for v in V]))
    return factorised(moments, GROUP, F.lit(consistency(INNER, STATISTICS)), (FLOOR * GRID) ** 2)


def judge(docs: DataFrame, level: float = LEVEL, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text",
          lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """(id, lang, source, facts, base_failed, kept, distance): distance is null where the base rules decide."""
    rows = staged(statistic_vectors(text_facts(docs, id_column, text_column, lang_column, source_column))
                  .withColumn("base_failed", base_failed()), "facts")
    good = rows.filter("not base_failed")
    distinct = staged(good.select("lang", "source", *V).distinct(), "distinct")
    groups = staged(_grouped(distinct, least), "groups")
    vectors = staged(_meet(distinct, groups, ["lang", "source"], True).select(*GROUP, *V).distinct(), "vectors")
    estimates = robust_estimates(vectors)
    fitted = staged(groups.join(estimates, GROUP), "fitted")
    judged = _meet(good, fitted.drop(*GROUP), ["lang", "source"], True).withColumn("distance", distance())
    out = ["id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]
    limit = chi_square_quantile(level, STATISTICS)
    return judged.select(*out, (F.col("distance") <= limit).alias("kept"), "distance").unionByName(
        rows.filter("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")))
