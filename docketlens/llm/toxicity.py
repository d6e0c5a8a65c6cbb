"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, strips accents, maps look-alike letters to Latin ones and
digits and signs inside words to the letters they stand for; at a word's end they
are read both as letters and as none, and the heavier reading counts.

The lexicon is learned from a bounded sample of labelled rows, ``TRAIN_ROWS`` by
the smallest hash of the id: folded words and word beginnings that come with
label 1 get their log odds as weight, where these are certain enough.  Phrases of
two words around an entry that come without label 1 become exceptions, and a
match inside one does not count.  A document's matched weight, alone and per
word, goes through a logistic curve fitted on the same sample.

Defined cases: null text is empty; texts without matches, empty ones too, score
by the curve's intercept; null labels are ignored; without labels of both kinds
the lexicon is empty and the score is the share of label 1, or 0 without any.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .quality import training_rows

TRAIN_ROWS = 20_000
#: Documents of label 1 that must have an entry, and its least log odds.
LEAST, LEAST_ODDS = 4, 2.0
#: Word beginnings of these lengths are candidates beside whole words.
BEGINNINGS = range(4, 9)

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ҽ": "e", "ғ": "f", "ɡ": "g", "һ": "h", "і": "i", "ї": "i",
    "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s",
    "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    "α": "a", "β": "b", "ϲ": "c", "δ": "d", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "π": "n",
    "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ſ": "s", "ɑ": "a", "ɩ": "i"}
#: Digits and signs that stand for letters where a letter follows.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
               "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "£": "l"}
_LETTERS = str.maketrans(LOOK_ALIKES)
_LOOK_ALIKE = re.compile(f"[{''.join(LOOK_ALIKES)}]")
_MARKS = re.compile(f"[{''.join(re.escape(chr(c)) for c in range(0x300, 0x10000) if unicodedata.combining(chr(c)))}]+")
_SIGNS = str.maketrans(SUBSTITUTES)
_SIGNED = re.compile(r"[0-9@$!|€£]+(?=[^\W\d_])")
#: At a word's end they may be letters as well, all of them or all before an exclamation mark.
_FINAL = [re.compile(r"(?<=[^\W\d_])[013-9@$!|€£]+(?![^\W_])"), re.compile(r"(?<=[^\W\d_])[013-9@$!|€£]*[013-9@$|€£](?=!)")]
_WORD = re.compile(r"[^\W\d_]+")


def _folded(text: str | None) -> str:
    text = (text or "").lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        if _LOOK_ALIKE.search(text):
            text = text.translate(_LETTERS)
    return _SIGNED.sub(lambda m: m[0].translate(_SIGNS), text)


def fold_text(text: str | None) -> list[str]:
    """The folded words of a text."""
    return _WORD.findall(_folded(text))


def read_words(automaton, text: str | None) -> list[str]:
    """The folded words; one with digits or signs at its end is read with them as letters if that reading weighs more."""
    folded = _folded(text)
    words = _WORD.findall(folded)
    if len(automaton) and _FINAL[0].search(folded):
        plain = words
        for final in _FINAL:
            # No letter follows such signs, so the words of all readings correspond.
            other = _WORD.findall(final.sub(lambda m: m[0].translate(_SIGNS), folded))
            if other != plain:
                words = [b if a != b and matched(automaton, [b])[0] > matched(automaton, [a])[0] else a
                         for a, b in zip(words, other, strict=True)]
    return words


@dataclass
class Lexicon:
    """Entries ' word ' or ' beginning' with weights; exceptions ' one two '; the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (0.0, 0.0, -35.0)

    def automaton(self):
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found


def matched(automaton, words: list[str]) -> tuple[float, int]:
    """(weight of the matches outside exceptions, words); of the entries of one word the heaviest counts."""
    if not len(automaton) or not words:
        return 0.0, len(words)
    best, spans = {}, []
    for end, (length, weight) in automaton.iter(f" {' '.join(words)} "):
        start = end - length + 1
        if weight is None:
            spans.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if spans and best:
        for start in [s for s in best if any(a <= s < b for a, b in spans)]:
            del best[start]
    return sum(best.values()), len(words)


def measures(weight: float, words: int) -> tuple[float, float]:
    """What the curve reads: the matched weight, and the same per hundred words."""
    return np.log1p(weight), np.log1p(100.0 * weight / max(words, 20))


def _candidates(words: set[str]) -> set[str]:
    out = set()
    for w in words:
        if 2 < len(w) < 40:
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in BEGINNINGS if n < len(w))
    return out


def _counts(sample: DataFrame, listed) -> DataFrame:
    """(entry, toxic, clean): documents of either label that have an entry of listed(text)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label].update(listed(text))
            if len(seen[0]) + len(seen[1]) > 1_000_000:
                yield flush(seen)
        yield flush(seen)

    def flush(seen) -> pa.RecordBatch:
        entries = list(seen[0] | seen[1])
        out = pa.RecordBatch.from_arrays(
            [pa.array(entries, pa.string()), *[pa.array([seen[k][e] for e in entries], pa.int64()) for k in (1, 0)]],
            ["entry", "toxic", "clean"])
        seen[0].clear()
        seen[1].clear()
        return out

    return (sample.mapInArrow(count, "entry string, toxic long, clean long")
            .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _odds(toxic: int, clean: int):
    return F.log((F.col("toxic") + 0.25) / (toxic + 0.5)) - F.log((F.col("clean") + 0.25) / (clean + 0.5))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_column: str = "doc_id",
          text_column: str = "text") -> Lexicon:
    sample = staged(training_rows(docs, labels, "toxic", rows, id_column, text_column)
                    .filter("label in (0, 1)"), "toxicity-sample")
    totals = dict(sample.groupBy("label").count().collect())
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        share = toxic / max(1, toxic + clean)
        return Lexicon(curve=(0.0, 0.0, 35.0 if share else -35.0))
    odds = _odds(toxic, clean)
    chosen = (_counts(sample, lambda text: _candidates(set(fold_text(text))))
              .filter(f"toxic >= {LEAST}").withColumn("odds", odds).filter(f"odds >= {LEAST_ODDS}")
              .collect())  # of ``rows`` texts at most
    # A beginning must stand for more than one word, or the word itself is the entry.
    of_words: dict[str, int] = {}
    for row in chosen:
        if row["entry"].endswith(" "):
            for n in BEGINNINGS:
                start = row["entry"][:n + 1]
                of_words[start] = max(of_words.get(start, 0), row["toxic"])
    chosen = [r for r in chosen if r["entry"].endswith(" ") or r["toxic"] > 1.25 * of_words.get(r["entry"], 0)]
    weights = {}
    for row in sorted(chosen, key=lambda r: len(r["entry"])):
        # A longer entry says something only if a beginning of it weighs less.
        held = max((weights.get(row["entry"][:n], 0.0) for n in range(1, len(row["entry"]))), default=0.0)
        if row["odds"] > held + 0.5:
            weights[row["entry"]] = row["odds"]
    lexicon = Lexicon(weights)
    entries = lexicon.automaton()

    def around(text: str | None) -> set[str]:
        words = read_words(entries, text)
        hit = [i for i, w in enumerate(words) if matched(entries, [w])[0]] if matched(entries, words)[0] else []
        return {f" {a} {b} " for i in hit for a, b in (words[i - 1:i + 1] if i else [None, None], words[i:i + 2]
                if i + 1 < len(words) else [None, None]) if a}

    lexicon.exceptions = [r["entry"] for r in _counts(sample, around).filter(f"clean >= {LEAST}")
                          .withColumn("odds", odds).filter("odds <= 0").orderBy("odds", "entry").collect()]
    points = _measured(sample.select(F.col("label").alias("id"), "text"), lexicon).groupBy("id", "weight", "words").count()
    lexicon.curve = fit([(r["id"], *measures(r["weight"], r["words"]), r["count"]) for r in points.collect()])  # ``rows`` at most
    return lexicon


def fit(points: list[tuple], steps: int = 400) -> tuple[float, float, float]:
    """Logistic regression over two measures by Newton steps with a small ridge."""
    data = np.array(points, float)
    x, y, n = np.c_[data[:, 1:3], np.ones(len(data))], data[:, 0], data[:, 3]
    w, ridge = np.zeros(3), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), x.T @ (n * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w)


def _measured(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(id, weight, words) of rows (id, text)."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lexicon.automaton()
        for batch in batches:
            out = [matched(found, read_words(found, t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.int64())],
                ["id", "weight", "words"])

    return rows.mapInArrow(measure, f"id {rows.schema['id'].dataType.simpleString()}, weight double, words long")


def score(docs: DataFrame, lexicon: Lexicon, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score, weight, words) of every document."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    a, b, c = lexicon.curve
    per = F.log1p(F.lit(100.0) * F.col("weight") / F.greatest("words", F.lit(20)))
    line = F.lit(float(a)) * F.log1p("weight") + F.lit(float(b)) * per + F.lit(float(c))
    return _measured(rows, lexicon).select("id", (1 / (1 + F.exp(-line))).alias("score"), "weight", "words")
