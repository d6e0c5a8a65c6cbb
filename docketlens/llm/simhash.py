"""SimHash near-duplicates by covering locality-sensitive hashing.

Radius r gives 2**(r+1) - 1 bit masks.  Each of the 64 bits draws a non-zero
vector of r+1 bits; mask v holds the bits whose vector has odd overlap with v.
Whatever r bits two fingerprints differ in, their vectors span at most r
dimensions, so some v is orthogonal to all of them: under that mask the two
agree.  No pair within the radius is lost.

Longer fingerprints are cut into B blocks of 64 bits.  Two that differ in at most
B*(r+1) - 1 bits differ in at most r bits of some block, so covering each block
with radius r loses no pair within that total.

Distinct fingerprints are bucketed by (block, mask, masked bits).  A bucket is
split by a second set of masks when it is larger than ``BUCKET``, and those by a
third; by then nearly all bits of the block are fixed.  Inside a bucket,
neighbours within the radius leave as a spanning forest, never as all pairs.

Defined cases: null text is empty, and texts without words have fingerprint zero;
null ids take part; repeated rows share their fingerprint and component, and
de-duplication keeps one of them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, staged
from .components import components

#: Buckets above this many distinct fingerprints are split by further masks.
BUCKET = 1024
_DRAW = 20_240_607


@lru_cache
def covering_masks(radius: int, level: int = 0) -> tuple[int, ...]:
    """Masks over 64 bits; each level draws anew."""
    draw = np.random.default_rng(_DRAW + level).permutation(64)
    vectors = draw % ((1 << (radius + 1)) - 1) + 1  # dealt evenly
    return tuple(sum(1 << bit for bit in range(64) if (int(vectors[bit]) & v).bit_count() & 1)
                 for v in range(1, 1 << (radius + 1)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


# -- fingerprints -----------------------------------------------------------

def majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Bit majority over rows of bytes: a bit is 1 if set in over half the weight."""
    total, ones = 0.0, np.zeros(hashes.shape[1] * 8)
    for i in range(0, len(hashes), 1 << 12):  # a long text takes no more memory than a short one
        bits = np.unpackbits(hashes[i:i + (1 << 12)], axis=1, bitorder="little")
        if weights is None:
            ones += bits.sum(axis=0, dtype=np.int32)
            total += len(bits)
        else:
            w = weights[i:i + (1 << 12)]
            ones += w @ bits
            total += w.sum()
    return np.packbits(ones * 2 > total, bitorder="little") if total else np.zeros(hashes.shape[1], np.uint8)


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 (seed 42) of every shingle, repeats included, of the lower-cased text."""
    tokens = text.lower().split()
    if not tokens:
        return []
    line, ends, at = b" ".join(tokens), [], -1
    for t in tokens:
        at += len(t) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    h = xxhash.xxh64_intdigest
    return [h(line[a:b], 42) for a, b in zip(starts, ends[words - 1:] or ends[-1:], strict=False)]


def shingle_fingerprint(text: bytes, words: int) -> int:
    hashes = np.array(shingle_hashes(text, words), np.uint64)
    return int(majority(hashes.view(np.uint8).reshape(-1, 8)).view(np.int64)[0]) if len(hashes) else 0


def shingle_fingerprints(docs: DataFrame, words: int, id_column: str = "doc_id",
                         text_column: str = "text") -> DataFrame:
    """(id, f0): the 64-bit SimHash over word shingles; zero without words."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [shingle_fingerprint(t, words) for t in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "f0"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(make, f"id {kind}, f0 long")


# -- neighbours -------------------------------------------------------------

def _buckets(block: Column, bits: Column, masks: tuple[int, ...], *outer: Column) -> Column:
    """The bucket keys of one 64-bit block under every mask."""
    return F.array(*[F.struct(block.cast("tinyint").alias("block"),
                              F.xxhash64(*outer, block, F.lit(i), bits.bitwiseAND(F.lit(_signed(m)))).alias("key"))
                     for i, m in enumerate(masks)])


def _forest(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph 'at most radius bits apart' over points (blocks, n)."""
    n = points.shape[1]
    unseen, a, b = np.arange(n), [], []
    while len(unseen):
        queue, unseen = [int(unseen[0])], unseen[1:]
        while queue and len(unseen):
            at = queue.pop()
            near = np.bitwise_count(points[:, unseen] ^ points[:, at:at + 1]).sum(axis=0) <= radius
            found, unseen = unseen[near].tolist(), unseen[~near]
            queue.extend(found)
            a.extend([at] * len(found))
            b.extend(found)
    return np.array(a, np.int64), np.array(b, np.int64)


def _run_links(keys: np.ndarray, nodes: np.ndarray, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys; the many small runs are tested together."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    left, right = [nodes[:0]], [nodes[:0]]
    for size in (2, 3, 4):
        at = starts[sizes == size]
        for i in range(size):
            for j in range(i + 1, size):
                near = np.bitwise_count(points[:, at + i] ^ points[:, at + j]).sum(axis=0) <= radius
                left.append(nodes[at + i][near])
                right.append(nodes[at + j][near])
    for s, size in zip(starts[sizes > 4].tolist(), sizes[sizes > 4].tolist(), strict=True):
        a, b = _forest(points[:, s:s + size], radius)
        left.append(nodes[s:s + size][a])
        right.append(nodes[s:s + size][b])
    return np.concatenate(left), np.concatenate(right)


def _links_within(members: DataFrame, points: DataFrame, blocks: int, radius: int) -> DataFrame:
    """Bucket members (key, node) to links; a bucket's rows arrive in one run."""
    fps = [f"f{i}" for i in range(blocks)]
    ordered = (members.select("key", "node").join(points, "node").select("key", "node", *fps)
               .repartition("key").sortWithinPartitions("key"))

    def links_of(table: np.ndarray) -> pa.RecordBatch:
        a = b = np.empty(0, np.int64)
        if table.shape[1]:
            a, b = _run_links(table[0], table[1], table[2:], radius)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((blocks + 2, 0), np.int64)
        for batch in batches:
            if batch.num_rows:
                new = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                table = np.concatenate([held, new], axis=1)
                last = int(np.searchsorted(table[0], table[0, -1]))  # this run may go on
                held = table[:, last:]
                yield links_of(table[:, :last])
        yield links_of(held)

    return ordered.mapInArrow(find, "a long, b long").distinct()


def fingerprint_links(points: DataFrame, blocks: int = 1, block_radius: int = 3, radius: int | None = None,
                      bucket: int = BUCKET) -> DataFrame:
    """Points (node, f0, f1, ...), distinct in (f0, ...), to links (a, b) that connect all within the radius."""
    most = blocks * (block_radius + 1) - 1
    radius = most if radius is None else radius
    if radius > most:
        raise ValueError(f"{blocks} blocks of radius {block_radius} cover {most} bits, not {radius}")
    fps = [f"f{i}" for i in range(blocks)]
    masks = covering_masks(block_radius)
    rows = points.select("node", F.inline(F.concat(*[_buckets(F.lit(i), F.col(f), masks) for i, f in enumerate(fps)])))
    links = None
    for level in (1, 2, 3):
        crowded = staged(rows.groupBy("key").count().filter("count > 1"), "buckets")
        last = level == 3
        fit = crowded if last else crowded.filter(f"count <= {bucket}")
        part = _links_within(rows.join(fit.select("key"), "key", "left_semi"), points, blocks, radius)
        links = part if links is None else links.unionByName(part)
        large = crowded.filter(f"count > {bucket}").select("key")
        if last or large.isEmpty():
            return links
        # Only members of one large bucket meet again: its key is part of the next.
        again = rows.join(large, "key", "left_semi").join(points, "node")
        own = F.element_at(F.array(*[F.col(f) for f in fps]), F.col("block").cast("int") + 1)
        rows = again.withColumn("own", own).withColumnRenamed("key", "outer").select(
            "node", F.inline(_buckets(F.col("block"), F.col("own"), covering_masks(block_radius, level), F.col("outer"))))
    raise AssertionError


def near_groups(prints: DataFrame, blocks: int = 1, block_radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Adds group, and component_id, the smallest id reachable over links, to rows with id, f0, f1, ...

    Rows with equal fingerprints are represented by their smallest id (where all
    are null, by a hash); links and components are sought among these only.
    """
    fps = [f"f{i}" for i in range(blocks)]
    prints = staged(prints, "prints")
    points = prints.groupBy(*fps).agg(F.min("id").alias("first"))
    # A node's name: the fingerprint itself, or the first id; a hash only where
    # that id is null or, wrongly, belongs to several documents.
    nth = F.row_number().over(Window.partitionBy("first", F.when(F.col("first").isNull(), F.col("f0"))).orderBy(*fps))
    named = F.when((nth == 1) & F.col("first").isNotNull(), F.col("first")).otherwise(F.xxhash64("first", *fps))
    points = staged(points.withColumn("node", F.col("f0") if blocks == 1 else named), "points")
    links = fingerprint_links(points.select("node", *fps), blocks, block_radius, bucket=bucket)
    named = staged(points.select("node", "first").join(components(links), "node"), "components")
    names = named.groupBy("component").agg(F.min("first").alias("name"))
    parts = named.join(names, "component").select("node", "component", "name")
    whole = points.join(parts, "node", "left").select(
        *fps, F.coalesce("component", "node").alias("group"), F.coalesce("name", "first").alias("component_id"))
    return prints.join(whole, fps)


# -- documents --------------------------------------------------------------

#: Blocks and block radius of the document fingerprints below: 256 bits, radius 19.
WORD_BLOCKS, WORD_BLOCK_RADIUS = 4, 4


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public SplitMix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_fingerprint(text: bytes, blocks: int) -> list[int]:
    """SimHash of the words, each weighted by log(1 + its count)."""
    counts = Counter(text.lower().split())
    if not counts:
        return [0] * blocks
    h = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts))
    wide = np.stack([_mixed(h + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) % (1 << 64))) for i in range(blocks)], axis=1)
    weights = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    return majority(np.ascontiguousarray(wide).view(np.uint8), weights).view(np.int64).tolist()


def word_fingerprints(docs: DataFrame, blocks: int = WORD_BLOCKS, id_column: str = "doc_id",
                      text_column: str = "text") -> DataFrame:
    """(id, row_hash, f0, f1, ...) of every row; row_hash tells rows of one id apart."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("row_hash"),
                       F.col(text_column).alias("text"))
    fps = [f"f{i}" for i in range(blocks)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([word_fingerprint(t, blocks) for t in byte_texts(batch.column(2))],
                            np.int64).reshape(-1, blocks)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(made[:, i]) for i in range(blocks)]],
                ["id", "row_hash", *fps])

    return rows.mapInArrow(make, "id long, row_hash long, " + ", ".join(f"{f} long" for f in fps))


def simhash_dedup(docs: DataFrame, blocks: int = WORD_BLOCKS, block_radius: int = WORD_BLOCK_RADIUS,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near duplicates the smallest id.

    Word fingerprints of 256 bits at radius 19 stand for a five-word shingle
    similarity of 0.8 or more.  Of rows without an id in one group, one stays if
    none has an id.
    """
    found = staged(near_groups(word_fingerprints(docs, blocks, id_column, text_column), blocks, block_radius), "near")
    by_row = found.groupBy("group", "id", "row_hash").count()
    best = by_row.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_hash")).alias("best"))
    stays = best.select(F.col("best.id").alias("__id"), F.col("best.row_hash").alias("__stays"))
    gone = by_row.join(stays, by_row["id"].eqNullSafe(stays["__id"]) & (F.col("row_hash") == F.col("__stays")),
                       "left_anti").select(F.col("id").alias("__id"), F.col("row_hash").alias("__gone"))
    hashed = docs.withColumn("__row", F.xxhash64(text_column))
    left = hashed.join(gone, hashed[id_column].cast("long").eqNullSafe(F.col("__id"))
                       & (F.col("__row") == F.col("__gone")), "left_anti")
    if not by_row.filter("count > 1").isEmpty():  # the same row more than once
        left = left.dropDuplicates([id_column, "__row"])
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
