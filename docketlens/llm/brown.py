"""Language-model scores from Brown's class-based bigrams.

Words get classes by exchange clustering.  What is clustered are units: the
``CLUSTERED`` most frequent words and the end are units of their own, and every
other word, known or not, belongs to the unit of its ending, one of ``ENDINGS``.
So each word has a class, and what clustering needs is bounded by the number of
units however large the vocabulary.

    P(w | before) = [ m P(class | class before) P(unit | class) + (1 - m) P(unit) ] P(w | unit)

P(w | unit) is 1 for a unit of one word; otherwise it is the word's share of the
unit's tokens, and all unknown words of an ending together have the share that
its words seen once suggest.  The distributions add up to one over known words
and one unknown word per ending.

Spark counts words and unit pairs over all training documents.  Each round of
exchange sums the pairs by class, and every second unit, in turns, moves to
the class under which the corpus is likeliest with all others held; the best
round stays.  Frequent words' counts, ``LISTED`` at most, go to the scoring tasks;
all other words meet their counts in a join.

Defined cases: null text is empty, and scores its end; a null id falls into the
fold of the empty text; repeated rows are scored each; without training rows all
counts are zero and every formula still holds; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, fold, staged

CLUSTERED = 4096
ENDINGS = 256
LISTED = 200_000
CLASSES = 128
ROUNDS = 8
#: Weight of the class bigram against the unit alone, and of the prior over classes.
MIX, PRIOR = 0.95, 4.0
#: The end of a text, as a word: no word is empty.
END = b""
#: Distinct words that a task counts before it passes them on.
HELD = 500_000


def ending(word: bytes) -> int:
    return crc32(word[-3:]) % ENDINGS


def _ending(word: Column) -> Column:
    return F.pmod(F.crc32(F.substring(word, -3, 3)), F.lit(ENDINGS)).cast("int")


class Index(dict):
    """Word to its place in the list; words outside have -1."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Units:
    """The listed words, most frequent first and the end at place 0, and their units."""

    words: list[bytes]
    counts: np.ndarray
    clustered: int

    @property
    def size(self) -> int:
        return self.clustered + ENDINGS

    def place_units(self) -> np.ndarray:
        """The unit of every listed place."""
        own = np.arange(len(self.words))
        rest = [self.clustered + ending(w) for w in self.words[self.clustered:]]
        return np.r_[own[:self.clustered], np.array(rest, np.int64)].astype(np.int64)

    def index(self) -> Index:
        return Index(zip(self.words, range(len(self.words)), strict=True))


def _places(index: Index, units: np.ndarray, clustered: int, text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of a text, then the end; their places and units."""
    words = text.lower().split()
    words.append(END)
    places = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    own = units[places]
    for i in np.flatnonzero(places < 0).tolist():
        own[i] = clustered + ending(words[i])
    return words, places, own


# -- counting ---------------------------------------------------------------

def word_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(word, n) over all rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in byte_texts(batch.column(0)):
                seen.update(text.lower().split())
                seen[END] += 1
                if len(seen) > HELD:
                    yield flush(seen)
                    seen = Counter()
        yield flush(seen)

    def flush(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                          ["word", "n"])

    return (docs.select(text_column).mapInArrow(count, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def list_words(counts: DataFrame, listed: int = LISTED, clustered: int = CLUSTERED) -> Units:
    """The most frequent words, at most ``listed``: all from some count on."""
    band = F.floor(F.log2("n") * 64).cast("int")
    bands = counts.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect()  # 64 * 64 at most
    total, least = 0, 1 << 20
    for row in bands:
        total += row["count"]
        if total > listed:
            break
        least = row["band"]
    rows = counts.filter(band >= least).filter(F.octet_length("word") > 0).toArrow()
    n, words = rows["n"].to_numpy(), rows["word"].to_pylist()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    ends = counts.filter(F.octet_length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return Units([END, *[words[i] for i in order]], np.r_[ends, n[order]].astype(np.int64), min(clustered, len(words) + 1))


def pair_counts(docs: DataFrame, units: Units, text_column: str = "text") -> DataFrame:
    """(a, b, n): how often unit b follows unit a; a text follows an end."""
    shared = docs.sparkSession.sparkContext.broadcast((units.words, units.place_units(), units.clustered, units.size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, place_units, clustered, size = shared.value
        index = Index(zip(words, range(len(words)), strict=True))
        held, held_rows = [], 0
        for batch in batches:
            for text in byte_texts(batch.column(0)):
                own = _places(index, place_units, clustered, text)[2]
                held.append(np.r_[0, own[:-1]] * size + own)
                held_rows += len(own)
                if held_rows > 4_000_000:
                    yield flush(held, size)
                    held, held_rows = [], 0
        if held:
            yield flush(held, size)

    def flush(held: list[np.ndarray], size: int) -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs // size, pa.int32()), pa.array(pairs % size, pa.int32()),
                                           pa.array(n, pa.int64())], ["a", "b", "n"])

    return (docs.select(text_column).mapInArrow(count, "a int, b int, n long")
            .groupBy("a", "b").agg(F.sum("n").alias("n")))


# -- exchange ---------------------------------------------------------------

def class_sums(pairs: DataFrame, classes: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Per unit: how often each class follows it and precedes it (units x classes)."""
    spark = pairs.sparkSession
    named = F.broadcast(spark.createDataFrame(list(enumerate(classes.tolist())), "unit int, class int"))  # one row a unit
    def side(own: str, other: str, label: int) -> DataFrame:
        return (pairs.join(named.withColumnRenamed("unit", other), other).groupBy(F.col(own).alias("unit"), "class")
                .agg(F.sum("n").alias("n")).withColumn("side", F.lit(label)))
    found = side("a", "b", 0).unionByName(side("b", "a", 1)).toArrow()  # 2 * units * classes rows at most
    out = np.zeros((2, len(classes), number))
    out[found["side"].to_numpy(), found["unit"].to_numpy(), found["class"].to_numpy()] = found["n"].to_numpy()
    return out[0], out[1]


def _likelihood(joint: np.ndarray) -> float:
    def xlogx(x: np.ndarray) -> float:
        x = x[x > 0]
        return float((x * np.log(x)).sum())
    return xlogx(joint) - xlogx(joint.sum(0)) - xlogx(joint.sum(1))


def _moves(follows: np.ndarray, precedes: np.ndarray, classes: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The best class of every unit with all others held, itself taken out of its own class."""
    u, size, smooth = np.arange(len(classes)), follows.sum(1), 0.1
    room = smooth * len(joint)
    marginals = np.log(joint.sum(1) + room) + np.log(joint.sum(0) + room)
    gain = follows @ np.log(joint + smooth).T + precedes @ np.log(joint.T + smooth).T - np.outer(size, marginals)
    to, into = np.maximum(joint[classes] - follows, 0), np.maximum(joint.T[classes] - precedes, 0)
    rest = np.log(to.sum(1) + room) + np.log(into.sum(1) + room)
    gain[u, classes] = ((follows * np.log(to + smooth)).sum(1) + (precedes * np.log(into + smooth)).sum(1) - size * rest)
    return gain.argmax(1)


def exchange(pairs: DataFrame, units: int, number: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the units, and how often class follows class."""
    number = max(1, min(number, units))
    classes, best, u = np.arange(units) % number, None, np.arange(units)
    for turn in range(rounds + 1):
        follows, precedes = class_sums(pairs, classes, number)
        joint = np.zeros((number, number))
        np.add.at(joint, classes, follows)
        likelihood = _likelihood(joint)
        if best is None or likelihood > best[0]:
            best = likelihood, classes, joint
        if turn == rounds:
            break
        moved = _moves(follows, precedes, classes, joint)
        classes = np.where((u + turn) % 2 == 0, moved, classes)
    return best[1], best[2]


# -- the model --------------------------------------------------------------

@dataclass
class Model:
    """Everything that the scoring tasks need, of bounded size; counts holds all words."""

    units: Units
    classes: np.ndarray
    step: np.ndarray          # class before, class: log-free probabilities
    emit: np.ndarray          # P(unit | class)
    alone: np.ndarray         # P(unit)
    known: np.ndarray         # tokens of every ending's words that are no units
    unseen: np.ndarray        # the weight of an ending's unknown word
    tokens: int
    vocabulary: int
    counts: DataFrame


def train(docs: DataFrame, text_column: str = "text", clustered: int = CLUSTERED, listed: int = LISTED,
          number: int = CLASSES, rounds: int = ROUNDS) -> Model:
    counts = staged(word_counts(docs, text_column), "word-counts")
    tokens, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    units = list_words(counts, listed, clustered)
    pairs = staged(pair_counts(docs, units, text_column), "unit-pairs")
    classes, joint = exchange(pairs, units.size, number, rounds)

    known, once = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for row in counts.groupBy(_ending(F.col("word")).alias("e")).agg(
            F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect():  # ENDINGS rows
        known[row["e"]], once[row["e"]] = row["n"], row["once"]
    for word, n in zip(units.words[:units.clustered], units.counts[:units.clustered].tolist(), strict=True):
        known[ending(word)] -= n
        once[ending(word)] -= n == 1

    size = np.r_[units.counts[:units.clustered], known]
    total = size.sum()
    alone = (size + 0.5) / (total + 0.5 * len(size))
    in_class = np.bincount(classes, weights=size + 0.5, minlength=len(joint))
    share = np.bincount(classes, weights=alone, minlength=len(joint))
    step = (joint + PRIOR * share) / (joint.sum(1, keepdims=True) + PRIOR)
    return Model(units, classes, step, (size + 0.5) / in_class[classes], alone, known, np.maximum(once, 0) + 0.5,
                 int(tokens), int(vocabulary), counts)


def score(docs: DataFrame, model: Model, mix: float = MIX, id_column: str = "doc_id",
          text_column: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row; scores are log10 probabilities."""
    units, spark = model.units, docs.sparkSession
    place_units = units.place_units()
    own_ending = np.array([-1] * units.clustered + [ending(w) for w in units.words[units.clustered:]], np.int64)
    room = model.known + model.unseen
    within = np.zeros(len(units.words))
    outside = own_ending >= 0
    within[outside] = np.log10(units.counts[outside] / room[own_ending[outside]])
    ground = model.tokens + 0.5 * (model.vocabulary + 1)
    base = np.log10((units.counts + 0.5) / ground)
    shared = spark.sparkContext.broadcast((units.words, place_units, units.clustered, units.counts > 0, within, base,
                                           model.classes, mix * model.step, model.emit, (1 - mix) * model.alone))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own_units, clustered, is_known, inside, ground_log, classes, step, emit, alone = shared.value
        index = Index(zip(words, range(len(words)), strict=True))
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys, facts, tail_keys, tail_words, tail_times = [], [], [], [], []
            for text in byte_texts(batch.column(1)):
                tokens, places, own = _places(index, own_units, clustered, text)
                of = classes[own]
                p = step[np.r_[classes[0], of[:-1]], of] * emit[own] + alone[own]
                listed = places[places >= 0]
                facts.append((len(tokens), int(is_known[listed].sum()), float(ground_log[listed].sum()),
                              float(np.log10(p).sum() + inside[listed].sum())))
                keys.append(key)
                rare = Counter(tokens[i] for i in np.flatnonzero(places < 0).tolist())
                tail_keys.extend([key] * len(rare))
                tail_words.extend(rare)
                tail_times.extend(rare.values())
                key += 1
            yield out(keys + tail_keys, batch.column(0), facts, tail_words, tail_times)

    def out(keys, ids, facts, tail_words, tail_times) -> pa.RecordBatch:
        none = len(tail_words)
        n_tokens, n_known, ground_log, model_log = zip(*facts, strict=True) if facts else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.concat_arrays([ids, pa.nulls(none, ids.type)]),
             *[pa.array([*x, *[None] * none], t) for x, t in ((n_tokens, pa.int64()), (n_known, pa.int64()),
                                                             (ground_log, pa.float64()), (model_log, pa.float64()))],
             pa.array([None] * len(facts) + tail_words, pa.binary()),
             pa.array([None] * len(facts) + tail_times, pa.int64())],
            ["row", "id", "n_tokens", "n_known", "base", "model", "word", "times"])

    both = staged(rows.mapInArrow(
        scored, f"row long, id {kind}, n_tokens long, n_known long, base double, model double, word binary, times long"),
        "lm-parts")
    rooms = F.broadcast(spark.createDataFrame(
        list(zip(range(ENDINGS), room.tolist(), model.unseen.tolist(), strict=True)), "e int, room double, unseen double"))
    seen = F.coalesce("n", F.lit(0))
    rare = (both.filter("word is not null").select("row", "word", "times").join(model.counts, "word", "left")
            .withColumn("e", _ending(F.col("word"))).join(rooms, "e")
            .groupBy("row").agg(
                F.sum(F.col("times") * F.log10((seen + 0.5) / F.lit(ground))).alias("rare_base"),
                F.sum(F.col("times") * F.log10(F.when(seen > 0, seen).otherwise(F.col("unseen")) / F.col("room"))).alias("rare_model"),
                F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("rare_known")))
    docs_part = both.filter("word is null").drop("word", "times")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return docs_part.join(rare, "row", "left").select(
        "id", "n_tokens", plus("n_known", "rare_known").alias("n_known"),
        plus("base", "rare_base").alias("base_score"), plus("model", "rare_model").alias("score"))


def held_out(id_column: str = "doc_id") -> Column:
    """The fold that training leaves out: remainder 1."""
    return fold(id_column) == 1
