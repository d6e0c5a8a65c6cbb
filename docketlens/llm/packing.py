"""Token sequences for training: best-fit decreasing over shards.

A document is its token ids and an end id.  It is first cut into full windows,
each a sequence of its own; what remains is shorter than a window.  Remainders
are dealt to shards of bounded size, and every shard is packed by best-fit
decreasing: a segment tree over remaining capacities finds the tightest open
window that still holds the piece.  A shard holds tens of thousands of pieces, so
that its unfilled windows are few beside its full ones.

Defined cases: null text is empty, and an empty document is one end id; repeated
rows are packed each; a null id keeps its pieces; an empty table gives none.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

WINDOW = 4096
END = 2
#: Remainders in a shard, about.
SHARD = 40_000
#: Words, and letter cores of words, that a Python worker remembers: the last so many, about twice that at most.
#: Cores cost most to make; words are put together of them.
WORDS, PARTS = 250_000, 500_000
#: Texts whose new words are encoded together, and words in one call.
TOGETHER, IN_A_CALL = 256, 1000


# -- tokens -----------------------------------------------------------------

class Aging(dict):
    """Remembers what was used last: when more than ``limit`` keys are held, they become the old ones, and the older ones go.

    ``make`` gives the value of a key that is not known.
    """

    def __init__(self, limit: int, make):
        super().__init__()
        self.limit, self.make, self.old = limit, make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        self[key] = value = self.make(key) if value is None else value
        return value

    def age(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()

    def unknown(self, keys: Iterable[str]) -> Iterator[str]:
        return filterfalse(self.old.__contains__, filterfalse(self.__contains__, keys))


class WordIds:
    """Ids of texts by a tokenizer that treats words between white space apart.

    Words repeat, so their ids are remembered as bytes.  A word of Latin letters
    with trailing punctuation is encoded as its lower-case letters and its
    punctuation, which the tokenizer separates as well; this needs a tokenizer
    that lower-cases and splits letters from punctuation.  New letter cores are
    encoded many in a call, as one text, and told apart by the tokenizer's own
    numbering of words.
    """

    SPACES = "\t\n\x0b\x0c\r"
    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")

    def __init__(self, path: str, limit: int = WORDS, parts: int = PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts, self.words = Aging(parts, self._encode), Aging(limit, self._compose)

    def split(self, text: str) -> list[str]:
        """Words between white space; between two blanks stands an empty one."""
        for space in self.SPACES:
            text = text.replace(space, " ")
        return text.split(" ")

    def _encode(self, part: str) -> bytes:
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def _compose(self, word: str) -> bytes:
        split = self.PLAIN.fullmatch(word)
        return self.parts[split[1].lower()] + self.parts[split[2]] if split else self.parts[word]

    def learn(self, words: set[str]) -> None:
        """Encode the letter cores of new words, many in a call."""
        self.words.age()
        self.parts.age()
        split = [(w, m[1].lower(), m[2]) for w in self.words.unknown(words) if (m := self.PLAIN.fullmatch(w))]
        parts, cores = self.parts, list(set(self.parts.unknown(core for _, core, _ in split)))
        for i in range(0, len(cores), IN_A_CALL):
            some = cores[i:i + IN_A_CALL]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, owner = np.array(found.ids, "<u4").tobytes(), np.array(found.word_ids)
            cuts = [0, *(4 * (np.flatnonzero(np.diff(owner)) + 1)).tolist(), len(ids)]
            if len(cuts) == len(some) + 1:  # else a core is several words to the tokenizer, or none: one by one
                parts.update(zip(some, (ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
        self.words.update((w, parts[core] + parts[rest]) for w, core, rest in split)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self.ids_of(self.split(text))

    def ids_of(self, words: list[str]) -> bytes:
        return b"".join(map(self.words.__getitem__, words))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per Python worker, which outlives a task."""
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, with_ids: bool = False,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]): full windows and the remainder of each document."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    tail = np.array([end], "<u4").tobytes()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        for batch in batches:
            owner, start, length, crc, total, ids = [], [], [], [], [], []
            texts = batch.column(1)
            for i in range(batch.num_rows):
                if i % TOGETHER == 0:
                    split = [encoder.split(t or "") for t in texts.slice(i, TOGETHER).to_pylist()]
                    encoder.learn(set().union(*split))
                own = encoder.ids_of(split[i % TOGETHER]) + tail
                for at in range(0, len(own), 4 * window):
                    piece = own[at:at + 4 * window]
                    owner.append(i)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(own) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int64))
            columns = [batch.column(0).take(pa.array(owner, pa.int32()))]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            columns += [pa.array(ids, pa.list_(pa.int64()))] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return rows.mapInArrow(cut, schema)


# -- packing ----------------------------------------------------------------

class Capacities:
    """A segment tree over capacities 0..size: how many open windows have each."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, capacity: int, count: int) -> None:
        at = capacity + self.leaves
        while at:
            self.tree[at] += count
            at >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least ``need`` that some window has, else -1."""
        at, tree = need + self.leaves, self.tree
        while not tree[at]:
            while at & 1:  # a right child: the next leaves are under an ancestor's sibling
                at >>= 1
                if at <= 1:
                    return -1
            at += 1
        while at < self.leaves:
            at *= 2
            if not tree[at]:
                at += 1
        return at - self.leaves


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of every piece."""
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free, open_, made = Capacities(window), [[] for _ in range(window + 1)], 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = free.tightest(need)
        if room < 0:
            room, at, made = window, made, made + 1
        else:
            at = open_[room].pop()
            free.add(room, -1)
        number[i], offset[i] = at, window - room
        if room > need:
            open_[room - need].append(at)
            free.add(room - need, 1)
    return number, offset


def pack(pieces: DataFrame, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of at most the window."""
    pieces = staged(pieces, "pieces")
    full, rest = pieces.filter(F.col("length") == window), pieces.filter(F.col("length") < window)
    shards = max(1, -(-rest.count() // shard))
    # The row number decides, not the id: repeated rows may be many.
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def fill(table: pa.Table) -> pa.Table:
        number, offset = best_fit_decreasing(table["length"].to_numpy(), window)
        first = table["shard"][0].as_py() << 32 if table.num_rows else 0
        return (table.drop_columns(["shard"]).append_column("sequence_id", pa.array(number + first, pa.int64()))
                .append_column("offset", pa.array(offset, pa.int64())))

    columns = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in pieces.schema)
    packed = dealt.groupBy("shard").applyInArrow(fill, f"{columns}, sequence_id long, offset long")
    # Shards number their windows from shard * 2**32; full windows follow from 2**62.
    return packed.unionByName(full.withColumns({
        "sequence_id": F.monotonically_increasing_id() + F.lit(1 << 62), "offset": F.lit(0).cast("long")}))
