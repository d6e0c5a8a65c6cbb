"""Spelling variants: words one edit apart, found by pivotal grams, and the form each goes back to.

Two words of at most one edit share most bigrams.  Bigrams are ordered by how
many words hold them, rare ones first.  A word's prefix is its first three bigrams
in that order, together with others of the third one's kind; two disjoint bigrams
of the prefix, chosen by dynamic programming for the least weight, are its pivots.
One edit destroys at most one of two disjoint bigrams, so one pivot survives in the
other word, and if the other word's prefix reaches at least as far in the order, it
lies in that prefix.  So it is enough to look pivots up in the prefixes that reach
as far.  Position limits make the look-up an equi-join: an edit lies on one side of
the bigram that survives, so the word is equal either up to it (same place from the
left) or from it on (same place from the right), and lengths differ by one at most.
Keys with many words are salted.  Candidates whose
letter counts differ as one edit allows are verified by edit distance.

A word's form is the near word that occurs most, where that is often enough; its
root is found by following forms, in rounds that double the steps.

Defined cases: null texts hold no words and a null id counts as an empty id; repeated rows
count each; words of any length take part; ties between forms go to the smaller word
in code-point order; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, staged

#: The letters of a word, A-Z lowered, and U+00C0 to U+00FF in UTF-8.
RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")
#: One run in this many loses a letter.
DAMAGE = 31
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form occurs at least this many times as often as the word.
RATIO = 10
#: Bigrams a single edit can touch, and one more: the prefix.
PREFIX = 3
#: Words of one key in a task, about; keys with more are salted.
KEY_WORDS = 4096
#: Distinct words counted in a task before they are handed on.
HELD = 200_000


# -- words ------------------------------------------------------------------

def damaged(word: bytes, h: int) -> bytes:
    """The word without code point h % length."""
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1:]).encode()


def word_counts(docs: DataFrame, damage: int | None = DAMAGE, least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n) of all texts; each ``damage``-th run, by a hash of id and run, loses a letter first."""
    rows = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.col(text_column).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        held: Counter[bytes] = Counter()
        for batch in batches:
            for i, text in zip(byte_texts(batch.column(0)), byte_texts(batch.column(1)), strict=True):
                start = zlib.crc32(i + b":")
                for word, n in Counter(RUN.findall(text.lower())).items():
                    if damage and not (h := zlib.crc32(word, start)) % damage:
                        word = damaged(word, h)
                    # At most two bytes a code point.
                    if len(word) >= least_length and (len(word) >= 2 * least_length or len(word.decode()) >= least_length):
                        held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return (rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least_count))


# -- signatures -------------------------------------------------------------

def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """Bigrams in the order of how many they are: place by bigram.

    Bounded by the square of the alphabet: 90 letters give at most 8,100.
    """
    grams = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("gram"))
    rows = grams.groupBy("gram").count().collect()
    return {g: i for i, (_, g) in enumerate(sorted((r["count"], r["gram"]) for r in rows))}


def pivots(prefix: list[tuple[int, int]], many: int = 2) -> list[tuple[int, int]]:
    """Of (place, weight) sorted by place the ``many`` disjoint bigrams of least weight.

    best[j] holds the least (weight, chosen) of j bigrams among the places so far;
    ``ready`` lags so that it ends before the present bigram begins.
    """
    none = (float("inf"), ())
    best: list[tuple[float, tuple]] = [(0, ()), *[none] * many]
    history: list[tuple[int, list]] = []
    for place, weight in prefix:
        ready = next((b for p, b in reversed(history) if p <= place - 2), [(0, ()), *[none] * many])
        best = [best[0], *[min(best[j], (ready[j - 1][0] + weight, (*ready[j - 1][1], (place, weight))))
                           for j in range(1, many + 1)]]
        history.append((place, best))
    return list(best[many][1])


def signature(word: str, ranks: dict[str, int]) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]]]:
    """(reach, prefix, pivots): the prefix as (place, rank), and the rank it reaches."""
    grams = [(ranks[word[i:i + 2]], i) for i in range(len(word) - 1)]
    reach = sorted(grams)[PREFIX - 1][0]
    prefix = [(i, r) for r, i in grams if r <= reach]
    return reach, prefix, pivots(prefix)


def _key(part: bytes, side: int, length: int) -> int:
    """Key of a word's left or right part for words of one length; equal hashes of other parts fail verification."""
    return xxhash.xxh64_intdigest(part, length << 1 | side) - (1 << 63)


def _keys(word: str, place: int, lengths: tuple[int, ...]) -> list[int]:
    """An edit beside the bigram at ``place`` leaves the word equal up to it, or from it on."""
    left, right = word[:place + 2].encode(), word[place:].encode()
    return [_key(left, 0, n) for n in lengths] + [_key(right, 1, n) for n in lengths]


def parity(word: str) -> int:
    """A bit for each letter that occurs an odd number of times; one edit turns at most two."""
    bits = 0
    for letter in word:
        c = ord(letter) - 97
        bits ^= 1 << (c if 0 <= c < 26 else 26 + c % 38)
    return bits - (1 << 63)


def signatures(words: DataFrame, ranks: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Prefix rows and pivot rows (key, word, n, reach, parity)."""
    def rows_of(pivot: bool):
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                owner, keys, reaches, odd = [], [], [], []
                for i, word in enumerate(batch.column(0).to_pylist()):
                    reach, prefix, chosen = signature(word, ranks)
                    n = len(word)
                    places, lengths = (chosen, (n - 1, n, n + 1)) if pivot else (prefix, (n,))
                    own = [key for p, _ in places for key in _keys(word, p, lengths)]
                    owner += [i] * len(own)
                    keys += own
                    reaches += [reach] * len(own)
                    odd += [parity(word)] * len(own)
                at = pa.array(owner, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), batch.column(0).take(at), batch.column(1).take(at),
                     pa.array(reaches, pa.int32()), pa.array(odd, pa.int64())], ["key", "word", "n", "reach", "parity"])
        return make

    schema = "key long, word string, n long, reach int, parity long"
    return words.mapInArrow(rows_of(False), schema), words.mapInArrow(rows_of(True), schema)


def near_words(words: DataFrame, key_words: int = KEY_WORDS) -> DataFrame:
    """(word, n, other, other_n), both ways, of all words exactly one edit apart; ``words`` has distinct (word, n).

    Words need at least four code points, so that a prefix holds two disjoint bigrams.
    """
    prefix, pivot = signatures(words, bigram_ranks(words))
    prefix = staged(prefix, "prefix")
    # Few keys are crowded; their prefix rows are dealt to salts, their pivot rows meet each salt.
    crowded = prefix.groupBy("key").count().filter(F.col("count") > key_words).select(
        "key", F.ceil(F.col("count") / key_words).cast("int").alias("salts"))
    crowded = staged(crowded, "crowded")
    salts = F.coalesce("salts", F.lit(1))
    left = pivot.join(crowded, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    right = (prefix.join(crowded, "key", "left").withColumn("salt", F.pmod(F.xxhash64("word"), salts).cast("int"))
             .select("key", "salt", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("reach").alias("other_reach"),
                     F.col("parity").alias("other_parity")))
    found = (left.join(right, ["key", "salt"])
             .filter("reach <= other_reach and bit_count(parity ^ other_parity) <= 2 and word <> other")
             .filter(F.levenshtein("word", "other", 1) == 1))
    mine, theirs = F.struct("word", "n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"))
    pairs = found.select(F.least(mine, theirs).alias("a"), F.greatest(mine, theirs).alias("b")).distinct()
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    return both.select("p.a.word", "p.a.n", F.col("p.b.word").alias("other"), F.col("p.b.n").alias("other_n"))


# -- forms ------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: each round replaces a word's goal by its goal's goal.

    A form occurs at least ten times as often, so chains are at most 19 long and five rounds do.
    """
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(5):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = staged(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        if at.join(further.select("root"), "root", "left_semi").isEmpty():
            break
    return at


def spelling_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of the distinct words (word, n)."""
    words = staged(words, "words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), "other")).alias("best"))
    known = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.expr(f"-best.rank div {ratio} >= n"), F.col("best.other")).alias("form"), (-F.col("best.rank")).alias("top"))
    known = staged(known, "forms")
    linked = roots(known.filter("form is not null"))
    return known.join(linked, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
        F.when(F.col("form").isNotNull(), F.col("top")).alias("form_n"))
