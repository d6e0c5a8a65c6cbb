import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from docketlens.llm import exact_dedup, queries, simhash
from tests.llm.fixtures import BASE, no_docs, odd_docs, odd_rows

SPACE = re.compile("[\x20\x09-\x0d]")


def brute_groups(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[hashlib.sha256(SPACE.sub("", text or "").encode()).hexdigest()].append((i, text or ""))
    return groups


def test_exact_rows_match_brute_force(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    groups = brute_groups(rows)
    found = exact_dedup.labelled_rows(odd_docs(spark)).collect()
    assert Counter(r["id"] for r in found) == Counter(i for i, _ in rows)
    for h, members in groups.items():
        own = [r for r in found if r["content_hash"] == h]
        assert len(own) == len(members) and {r["group_size"] for r in own} == {len(members)}
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        assert {r["keep_id"] for r in own} == {best[0]}
        assert sum(r["kept"] for r in own) == 1


def test_exact_dedup_keeps_rows_whole(spark):
    docs = odd_docs(spark)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(brute_groups([(r[0], r[1]) for r in odd_rows()]))
    assert exact_dedup.exact_dedup(no_docs(spark)).count() == 0


def test_covering_masks_lose_no_pair():
    draw = np.random.default_rng(5)
    for radius in (1, 3, 4):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(300):
            diff = sum(1 << int(b) for b in draw.choice(64, radius, replace=False))
            assert any(not diff & m for m in masks)


def brute_fingerprint(text, n):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, radius):
    """Point -> smallest point reachable."""
    todo, part = sorted(points), {}
    for p in todo:
        if p in part:
            continue
        part[p], queue = p, [p]
        while queue:
            at = queue.pop()
            for q in todo:
                if q not in part and (at ^ q).bit_count() <= radius:
                    part[q] = p
                    queue.append(q)
    return part


def test_registered_fingerprints_and_components(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: brute_fingerprint(r["text"] or "", 3) for r in rows}
    part = brute_components(set(prints.values()), 3)
    least = {}
    for i, p in prints.items():
        least[part[p]] = min(i, least.get(part[p], i))
    found = queries.QUERIES["op10_simhash_near_dedup"](spark, sf_dir).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == least[part[prints[r["doc_id"]]]]


def test_components_of_chains_and_split_buckets(spark):
    """Chains of near fingerprints, with buckets split at two members."""
    draw = np.random.default_rng(3)
    points = set()
    for _ in range(40):
        p = int(draw.integers(0, 1 << 63))
        for _ in range(int(draw.integers(1, 12))):
            points.add(p)
            for b in draw.choice(63, int(draw.integers(1, 4)), replace=False):
                p ^= 1 << int(b)
    order = sorted(points)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(order)], "id long, f0 long")
    part = brute_components(points, 3)
    for bucket in (2, 1024):
        found = {r["f0"]: r["component_id"] for r in simhash.near_groups(df, bucket=bucket).collect()}
        assert found == {p: order.index(part[p]) for p in order}


def test_near_dedup_of_odd_rows(spark):
    docs = odd_docs(spark)
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[6] == 1 and not {7, 8, 9, 11, 2, 3} & set(ids)
    assert ids[1] == ids[4] == ids[10] == ids[12] == 1 and ids[13] == 2
    assert simhash.simhash_dedup(no_docs(spark)).count() == 0


def test_near_copies_found_and_others_left(spark):
    words = BASE.split()
    rows = [(0, BASE), (1, " ".join(words[:50] + ["new"] + words[51:])), (2, " ".join(reversed(words[:90])))]
    kept = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {0, 2}
