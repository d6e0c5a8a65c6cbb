"""Benchmark items inside documents: size-partitioned MinHash containment search.

An item is the set of its five-word shingles; one of fewer words is a single
shingle, its whole sequence of words.  Items are partitioned by size into
classes [2**c, 2**(c+1)).  A class keeps of each item the k smallest shingle
hashes, its bottom-k MinHash sketch, with k one more than the shingles that a
document containing the item to the threshold may lack at the class's upper
bound: such a document has at least one hash of the sketch, and, by the item's
own size, at least k - missing of them.  No item is lost, however long the
document, because the sketch is looked up among all the document's shingles and
not compared with a sketch of the document.  Candidates are verified by exact
containment of shingles as text.

The items are a query set: they are taken in blocks of bounded size, and
each block is held by the tasks that scan the documents.

Defined cases: null text is empty; items without a word match nothing; items of
fewer than five words match where their words stand together; repeated items or documents match each; documents
without words are clean; an empty table on either side gives no match.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

WORDS = 5
THRESHOLD = 0.8
#: Characters of item text in one block, unless a single item has more.
BLOCK_CHARS = 4_000_000
_WORD = re.compile(r"[^\W_]+")
_BASE = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, lower case."""
    return _WORD.findall((text or "").lower())


def word_keys(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_keys(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n-word shingle: a polynomial over the word hashes h."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + h[i:len(h) - n + 1 + i]
    return out ^ (out >> np.uint64(29))


def shingles(words: list[str], n: int) -> set[tuple[str, ...]]:
    return set(zip(*[words[i:] for i in range(n)], strict=False))


def at_least(size: int, threshold: float) -> int:
    """The least count whose share of ``size`` reaches the threshold."""
    count = max(0, int(threshold * size) - 1)
    while count / size < threshold:
        count += 1
    return count


class Sketches:
    """A block of items: shingles as text, and bottom-k sketches by size class."""

    def __init__(self, items: list[tuple], n: int, threshold: float):
        self.items, keys, owners = [], [], []
        for item, text in items:
            words = words_of(text)
            length = min(n, len(words))
            if not length:
                continue
            own = shingles(words, length)
            size = len(own)
            upper = 2 ** size.bit_length() - 1
            k = min(size, upper - at_least(upper, threshold) + 1)
            sketch = np.unique(shingle_keys(word_keys(words), length))[:k]
            enough = at_least(size, threshold)
            least = max(1, len(sketch) - (size - enough))
            owners.extend([len(self.items)] * len(sketch))
            keys.extend(sketch.tolist())
            self.items.append((item, own, least, enough, length))
        #: Words of a shingle: n, and the sizes of shorter items.
        self.lengths = sorted({i[4] for i in self.items})
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.keys, self.owners = np.array(keys, np.uint64)[order], np.array(owners, np.int64)[order]

    def matches(self, text: str | None) -> list[tuple]:
        """(item, shingles of the item, of these in the text), where enough are."""
        words = words_of(text)
        if not words or not self.items:
            return []
        h = word_keys(words)
        keys = np.concatenate([shingle_keys(h, length) for length in self.lengths])
        if not len(keys):
            return []
        at = np.searchsorted(self.keys, keys)
        met = np.unique(keys[self.keys[np.minimum(at, len(self.keys) - 1)] == keys])
        if not len(met):
            return []
        left, right = np.searchsorted(self.keys, met, "left"), np.searchsorted(self.keys, met, "right")
        hits = Counter(int(o) for a, b in zip(left, right, strict=True) for o in self.owners[a:b])
        likely = [i for i, count in hits.items() if count >= self.items[i][2]]
        if not likely:
            return []
        own = {length: shingles(words, length) for length in {self.items[i][4] for i in likely}}
        found = []
        for i in sorted(likely):
            item, parts, _, enough, length = self.items[i]
            shared = sum(p in own[length] for p in parts)
            if shared >= enough:
                found.append((item, len(parts), shared))
        return found


def item_blocks(items: DataFrame, id_column: str = "item_id", text_column: str = "text",
                chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The items in blocks of bounded text; rows arrive partition by partition."""
    block, size = [], 0
    for row in items.select(id_column, text_column).toLocalIterator():
        length = len(row[1] or "")
        if block and size + length > chars:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += length
    if block:
        yield block


def contained_items(docs: DataFrame, items: DataFrame, n: int = WORDS, threshold: float = THRESHOLD,
                    id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
                    item_text: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item, item_shingles, found_shingles, containment) of every document and item it contains."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kinds = rows.schema["id"].dataType.simpleString(), items.schema[item_column].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, item_shingles long, found_shingles long"
    item_type = to_arrow_type(items.schema[item_column].dataType)
    found = None
    for block in item_blocks(items, item_column, item_text, chars):
        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            sketches = Sketches(block, n, threshold)
            for batch in batches:
                met = [(i, *m) for i, text in enumerate(batch.column(1).to_pylist()) for m in sketches.matches(text)]
                at, item, size, shared = zip(*met, strict=True) if met else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int32())), pa.array(item, item_type),
                     pa.array(size, pa.int64()), pa.array(shared, pa.int64())],
                    ["id", "item", "item_shingles", "found_shingles"])
        part = rows.mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumn("containment", F.col("found_shingles") / F.col("item_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = WORDS, threshold: float = THRESHOLD,
                  text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
                  chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their own columns; rows pass each block once."""
    at = docs.columns.index(text_column)
    for block in item_blocks(items, item_column, item_text, chars):
        def clean(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            sketches = Sketches(block, n, threshold)
            for batch in batches:
                yield batch.filter(pa.array([not sketches.matches(t) for t in batch.column(at).to_pylist()], pa.bool_()))
        docs = docs.mapInArrow(clean, docs.schema)
    return docs
