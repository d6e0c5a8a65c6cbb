"""Line de-duplication by content-defined chunks of ``WORDS`` words.

Lines are as the corpus has them or a page long, so chunks do not follow line
breaks.  A chunk starts at a word chosen by its content: of every ``APART``
neighbouring stretches of ``WORDS`` words the one with the least hash.  A passage
is thus cut alike wherever it stands, and one of ``WORDS + APART - 1`` words
always holds a chunk.  As ``APART`` is less than ``WORDS``, chunks overlap or
touch and no word between two of them is left out: of a repeated passage at most
``APART - 1`` words stay at either end.  What is shared over fewer than ``WORDS``
words is never touched.  Hashes come from one running polynomial over the bytes.

A chunk that occurs more than once in the corpus stays where it occurs first
(smallest id, then position) and is removed elsewhere; a word removed by one
chunk is not brought back by another.  Chunk hashes are counted first; a bit map
of fixed size of the repeated ones tells the second scan which chunks may repeat,
and these alone are shipped, as digests of 128 bits of their bytes, which decide.

Defined cases: null text stays null; texts without a repeated chunk stay as they
are; rows repeated with the same id and text are one document and are cleaned
alike; a null id comes first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Words of a chunk, and words between the starts of neighbouring chunks at most; APART is a power of two.
WORDS, APART = 32, 16
#: Bits of the map of repeated chunk hashes, 8 MB.
MAP_BITS = 26

_B = 0x100000001B3 | 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) <= size:
        n = max(size + 1, 1 << 16)
        with np.errstate(over="ignore"):
            tables = [np.multiply.accumulate(np.r_[1, np.full(n, base)].astype(np.uint64))
                      for base in (np.uint64(_B), np.uint64(pow(_B, -1, 1 << 64)))]
        _powers[:] = tables
    return _powers[0], _powers[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _GOLD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def chunks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) in bytes of the chunks of a text, in order."""
    raw = np.frombuffer(text, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts) < WORDS:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    power, inverse = _power_tables(len(raw))
    running = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)])]
    a, b = starts[:len(starts) - WORDS + 1], ends[WORDS - 1:]
    hashes = _mixed((running[b] - running[a]) * inverse[a] + (b - a).astype(np.uint64))
    # The place modulo APART in the low bits tells which of APART neighbours has the least hash.
    low = np.uint64(APART - 1)
    least, step = (hashes & ~low) | (np.arange(len(a), dtype=np.uint64) & low), 1
    if len(a) < APART:
        chosen = np.array([int(least.argmin())])
    else:
        while step < APART:
            least, step = np.minimum(least[:-step], least[step:]), step * 2
        at = np.arange(len(least))
        chosen = at + (((least & low).astype(np.int64) - at) & (APART - 1))
        chosen = chosen[np.r_[True, chosen[1:] != chosen[:-1]]]
    return hashes[chosen], a[chosen], b[chosen]


def _documents(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("row_hash"),
                       F.col(text_column).cast("binary").alias("text"))


def _repeated_map(rows: DataFrame, bits: int) -> np.ndarray:
    """The bit map of the chunk hashes that occur more than once."""
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chunks(t)[0] for t in batch.column(0).to_pylist() if t]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], ["hash"])

    repeated = rows.select("text").mapInArrow(hashes, "hash long").groupBy("hash").count().filter("count > 1")
    place = F.shiftrightunsigned("hash", 64 - bits)
    words = (repeated.groupBy(F.shiftright(place, 6).alias("at"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int))")).alias("bits"))
             .toArrow())  # 2**(bits - 6) rows at most
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def removals(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = MAP_BITS) -> DataFrame:
    """(id, row_hash, start, end) in bytes: every later occurrence of a repeated chunk."""
    rows = _documents(docs, id_column, text_column)
    shared = docs.sparkSession.sparkContext.broadcast(_repeated_map(rows, bits))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            owner, start, end, parts = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                if not text:
                    continue
                h, a, b = chunks(text)
                place = h >> np.uint64(64 - bits)
                hit = (seen[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                owner.extend([i] * int(hit.sum()))
                start.extend(a[hit].tolist())
                end.extend(b[hit].tolist())
                parts.extend(blake2b(text[x:y], digest_size=16).digest() for x, y in zip(a[hit].tolist(), b[hit].tolist(), strict=True))
            take = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                 pa.array(parts, pa.binary())], ["id", "row_hash", "start", "end", "part"])

    found = staged(rows.mapInArrow(likely, "id long, row_hash long, start long, `end` long, part binary"), "chunks")
    first = (found.groupBy("part").agg(F.min(F.struct("id", "row_hash", "start")).alias("first"), F.count("*").alias("n"))
             .filter("n > 1").select("part", "first"))
    here = F.struct("id", "row_hash", "start")
    return (found.join(first, "part").filter(~F.col("first").eqNullSafe(here))
            .select("id", "row_hash", "start", "end"))


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = MAP_BITS,
               report: tuple[str, str] | None = None) -> DataFrame:
    """The rows of ``docs`` with their texts cleaned; report names two columns for chunks and bytes removed."""
    gone = (removals(docs, id_column, text_column, bits).groupBy("id", "row_hash")
            .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__gone"))  # one document's chunks
            .withColumnsRenamed({"id": "__id", "row_hash": "__row"}))
    names = docs.columns
    joined = docs.withColumn("__own", F.xxhash64(text_column)).join(
        gone, docs[id_column].cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__row")), "left")
    at = names.index(text_column)
    whole = joined.select(*[F.col(f"`{c}`") for c in names], F.col("__gone.start").alias("__start"), F.col("__gone.end").alias("__end"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, chunks_gone, bytes_gone = batch.column(at).to_pylist(), [], []
            for i, (start, end) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)):
                chunks_gone.append(len(start or ()))
                bytes_gone.append(0)
                if start:
                    raw = texts[i].encode()
                    # Chunks overlap: what is kept between two of them may be nothing.
                    kept = b"".join(raw[a:b] for a, b in zip([0, *end], [*start, len(raw)], strict=True))
                    bytes_gone[-1] = len(raw) - len(kept)
                    texts[i] = kept.decode()
            columns = list(batch.columns[:-2])
            columns[at] = pa.array(texts, columns[at].type)
            extra = [pa.array(chunks_gone, pa.int64()), pa.array(bytes_gone, pa.int64())] if report else []
            yield pa.RecordBatch.from_arrays([*columns, *extra], [*names, *(report or ())])

    schema = docs.schema
    for name in report or ():
        schema = type(schema)([*schema.fields]).add(name, "long")
    return whole.mapInArrow(clean, schema)
