import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from docketlens.llm import packing, queries
from tests.llm.fixtures import no_docs, odd_docs, odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def direct_ids(text):
    ids = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids
    return [*ids, 2]


def test_remembered_words_give_the_tokenizer_s_ids():
    texts = ["a <|endoftext|> b", "x́ ́y", "a\x1cb É", "İ A ΑΣ", "don't it's. '' O'Neil_x ___ a_b",
             "Élan,,, ßx º1 A1b2", "", " \n", "été... 12 中文", "A.\x0bB\x0c\x00c\x85d e"]
    words = packing.WordIds(PATH, limit=5, parts=4)
    for k, text in enumerate(texts * 3):
        if k % 2:
            words.learn(set(words.split(text)))
            assert len(words.words) <= 5 + len(words.split(text))
        assert np.frombuffer(words.ids(text), "<u4").tolist() == direct_ids(text)[:-1]


def test_best_fit_takes_the_tightest_window():
    number, offset = packing.best_fit_decreasing(np.array([7, 6, 3, 4, 1]), 10)
    assert number.tolist() == [0, 1, 0, 1, 2] and offset.tolist() == [0, 0, 7, 6, 0]
    draw = np.random.default_rng(1)
    for _ in range(20):
        lengths = draw.integers(1, 65, 300)
        number, offset = packing.best_fit_decreasing(lengths, 64)
        windows, free, slow = [], [], 0
        for n in sorted(lengths, reverse=True):
            fits = [i for i, f in enumerate(free) if f >= n]
            if fits:
                free[min(fits, key=lambda i: free[i])] -= n
            else:
                free.append(64 - n)
        assert number.max() + 1 == len(free)
        fill = np.zeros(number.max() + 1, int)
        np.add.at(fill, number, lengths)
        assert fill.max() <= 64


def check_pieces(rows, texts):
    """Each id in one piece; sequences gapless from 0 and at most 4096 long."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["id"]].append(r)
    for doc, own in by_doc.items():
        wanted = sorted((s, len(p), zlib.crc32(p), len(ids)) for ids in map(direct_ids, texts[doc])
                        for s in range(0, len(ids), 4096) for p in [ids[s:s + 4096]]
                        for p in [np.array(p, "<u4").tobytes()] for _ in [0])
        wanted = sorted((s, n // 4, crc, total) for s, n, crc, total in wanted)
        assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in own) == wanted
    assert set(by_doc) == set(texts)


def test_odd_rows_round_trip(spark):
    texts = defaultdict(list)
    for r in odd_rows():
        texts[r[0]].append(r[1])
    pieces = packing.token_pieces(odd_docs(spark), PATH, with_ids=True)
    rows = packing.pack(pieces, shard=5).collect()
    check_pieces(rows, texts)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert packing.pack(packing.token_pieces(no_docs(spark), PATH)).count() == 0


def test_registered_query(spark, sf_dir):
    texts = {r["doc_id"]: [r["text"]] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op9_best_fit_packing"](spark, sf_dir).withColumnRenamed("doc_id", "id").collect()
    check_pieces(rows, texts)
    used = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= used / 4096 * 1.02 + 1
