from collections import defaultdict

from docketlens.llm import line_dedup as L
from docketlens.llm import queries
from tests.llm.fixtures import no_docs, odd_docs, odd_rows

PASSAGE = " ".join(f"passage{i * 37 % 91} of{i}" for i in range(45))


def brute(rows):
    """Removed byte ranges of every (id, text): all but the first occurrence of each chunk's bytes."""
    seen = defaultdict(set)
    for i, text in rows:
        raw = (text or "").encode()
        _, start, end = L.chunks(raw)
        for a, b in zip(start.tolist(), end.tolist()):
            seen[raw[a:b]].add((i is not None, i or 0, text, a, b))
    gone = defaultdict(list)
    for found in seen.values():
        for _, i, text, a, b in sorted(found, key=lambda x: (x[0], x[1], x[3]))[1:]:
            gone[i, text].append((a, b))
    return gone


def cleaned(text, ranges):
    raw, at, out = text.encode(), 0, b""
    for a, b in sorted(ranges):
        out, at = out + raw[at:a], b
    return (out + raw[at:]).decode()


def test_registered_query_matches_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    gone = brute(rows)
    found = {r["doc_id"]: r for r in queries.QUERIES["op5_line_dedup"](spark, sf_dir).collect()}
    assert set(found) == {i for i, _ in rows}
    for i, text in rows:
        own = gone.get((i, text), [])
        assert found[i]["removed_chunks"] == len(own)
        assert found[i]["text"] == cleaned(text, own)
    assert sum(map(len, gone.values())) > 20


def test_shifted_passages_are_found_inside_lines(spark):
    hosts = [" ".join(f"host{d}w{i * i % 613}" for i in range(60)) for d in range(5)]
    rows = [(d, f"{h[:80 + 31 * d]} {PASSAGE} {h[200:]}" if d < 4 else h) for d, h in enumerate(hosts)]
    rows[2] = (2, rows[2][1].replace(" ", "\n", 9))
    found = {r["doc_id"]: r for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"),
                                                   report=("n", "b")).collect()}
    assert found[0]["text"] == rows[0][1] and found[4]["text"] == rows[4][1]
    for d in (1, 2, 3):
        assert found[d]["n"] > 0 and found[d]["b"] > len(PASSAGE) // 4 and PASSAGE not in found[d]["text"]
        assert all(f"host{d}w{i * i % 613}" in found[d]["text"] for i in range(3))


def test_bit_map_only_narrows_the_search(spark):
    """A map of 64 bits sends nearly all chunks to the comparison of bytes; results stay."""
    rows = [(d, f"start{d} {PASSAGE} end{d} " + " ".join(f"x{d}y{i}" for i in range(80))) for d in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small, large = (sorted(map(tuple, L.removals(docs, bits=b).collect())) for b in (6, 26))
    assert small == large and small


def test_odd_rows(spark):
    docs = odd_docs(spark)
    kept = L.line_dedup(docs)
    assert kept.columns == docs.columns
    gone = brute([(r[0], r[1]) for r in odd_rows()])
    wanted = sorted((r[0] or -1, r[1] and cleaned(r[1], set(gone.get((r[0] or 0, r[1]), [])))) if r[1] else (r[0] or -1, r[1] or "")
                    for r in odd_rows())
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == wanted
    assert kept.filter("text is null").count() == 1
    assert L.line_dedup(no_docs(spark)).count() == 0


def test_a_shared_phrase_is_left_alone(spark):
    """Clean documents that share a phrase or a sentence, but no passage, stay whole."""
    shared = [[f"phrase{k}w{i}" for i in range(6 + k % 26)] for k in range(60)]
    rows = [(d, " ".join([*(f"own{d}w{i}" for i in range(70)), *shared[d // 2], *(f"then{d}w{i}" for i in range(70))]))
            for d in range(2 * len(shared))]
    found = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), report=("n", "b")).collect()
    assert sorted((r["doc_id"], r["text"], r["n"], r["b"]) for r in found) == [(*r, 0, 0) for r in rows]


def test_of_a_repeated_passage_only_words_at_its_ends_stay(spark):
    """Every passage of over 50 words is found wherever it stands, and removed but for its ends."""
    rows, sizes = [], [51, 60, 90, 200]
    for k in range(40):
        passage = [f"p{k}x{i * i % 997}" for i in range(sizes[k % 4])]
        for copy in range(2):
            before, after = ([f"d{k}c{copy}{side}{i}" for i in range((k * 13 + copy * 29 + ord(side)) % 97)] for side in "ab")
            rows.append((2 * k + copy, " ".join([*before, *passage, *after]), len(passage), len(before) + len(after)))
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = {r["doc_id"]: r for r in L.line_dedup(table, report=("n", "b")).collect()}
    for i, text, passage, around in rows:
        left = found[i]["text"].split()
        if i % 2 == 0:
            assert found[i]["text"] == text
        else:
            of_passage = [j for j, w in enumerate(text.split()) if w.startswith("p") and w in set(left)]
            assert len(left) - around == len(of_passage) <= 2 * (L.APART - 1)
            assert found[i]["b"] == len(text.encode()) - len(found[i]["text"].encode())
    # With the words of the ends, that is; inside nothing stays.
    gone = sum(len(t.split()) - len(found[i]["text"].split()) for i, t, _, _ in rows)
    assert gone > 0.8 * sum(n for i, _, n, _ in rows if i % 2)
