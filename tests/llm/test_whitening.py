import math

import numpy as np
import pytest
from pyspark.sql import types as T

from docketlens.llm import queries
from docketlens.llm import whitening as W


def vectors(spark, rows):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                           T.StructField("n", T.LongType()), T.StructField("x", T.StringType())])
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], schema).repartition(3)


def check(rows, given, k=4):
    """Against whole-matrix eigenvectors in plain numpy; ``given`` lists (id, vector)."""
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in given if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [v for _, v in good]
    once = [list(v) for v in {tuple(v) for v in x}]
    n, s = len(once), [sum(v) for v in zip(*once, strict=True)]
    y = np.array([[(n * a - b) / n for a, b in zip(v, s, strict=True)] for v in once])
    v = y.T @ y / n
    values, columns = np.linalg.eigh(v)
    values, columns = values[::-1], columns[:, ::-1]
    m = min(k, int((values > 1e-13 * np.trace(v)).sum()))
    assert len(rows) == len(good) * m
    by = {}
    for r in rows:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, m + 1))
    for c, own in by.items():
        mine = np.array([[(n * a - b) / n for a, b in zip(u, s, strict=True)] for u in x]) @ columns[:, c - 1] / math.sqrt(values[c - 1])
        wanted = sorted((str(i), sum((n * a - b) ** 2 for a, b in zip(u, s, strict=True)), w)
                        for (i, u), w in zip(good, mine.tolist(), strict=True))
        best = min(max(abs(a - b) for a, b in zip([w for _, _, w in wanted], [r["whitened"] * sign for r in ordered], strict=True))
                   for sign in (1, -1) for ordered in [sorted(own, key=lambda r: (str(r["id"]), r["deviation"], r["whitened"] * sign))])
        assert best < 1e-8
        assert sorted((i, d) for i, d, _ in wanted) == sorted((str(r["id"]), r["deviation"]) for r in own)
        assert {r["n"] for r in own} == {n} and max(r["identity_error"] for r in own) < 1e-9
        assert all(r["explained"] == pytest.approx(values[c - 1] / np.trace(v), rel=1e-9) for r in own)


def test_odd_rows(spark):
    draw = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate((draw.standard_normal((60, 7)) * [9, 5, 3, 2, 1, 1, 1]).tolist())]
    rows += [(70, rows[0][1]), (70, rows[0][1]), (None, rows[1][1]), (None, None), (71, None), (72, [None] + rows[0][1][1:]),
             (73, [float("nan")] * 7), (74, [float("inf")] * 7)]
    out = lambda r, k=4: W.whiten(vectors(spark, r), W.fit(vectors(spark, r), k)).collect()
    check(out(rows), rows)
    check(out(rows, 7), rows, 7)
    # Lengths apart from the commonest and entries beyond the grid go; fewer components than asked for.
    assert len(out([*rows, (75, [1.0]), (76, []), (77, [1e300] * 7)])) == len(out(rows))
    check(out([(i, v[:2]) for i, v in rows if i is not None and i < 60]), [(i, v[:2]) for i, v in rows if i is not None and i < 60])
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]
    check(out(flat), flat)
    assert out([]) == [] and out([(1, None)]) == [] and out([(1, [])]) == [] and out([(1, [1.0, 2.0])] * 3) == []


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(i * 10 ** 9), float(i % 3)]) for i in range(50)]
    out = W.whiten(vectors(spark, rows), W.fit(vectors(spark, rows))).collect()
    assert {r["deviation"] for r in out} == {None} or all(r["deviation"] is None or r["deviation"] >= 0 for r in out)
    x = [[256 * i * 10 ** 9, 256 * (i % 3)] for i in range(50)]
    s = [sum(v) for v in zip(*x, strict=True)]
    for r in out:
        d = sum((50 * a - b) ** 2 for a, b in zip(x[r["id"]], s, strict=True))
        assert r["deviation"] == (d if d < 1 << 63 else None)


@pytest.mark.parametrize("values", [[1] * 30, [5, 5, 5, 5, 5, 1, 1, 0, 0], [1] * 40 + [2, 2 + 1e-9, 3], [1e6, 1, 1e-3, 1e-6, 1e-9], [2]])
def test_intervals_are_complete(spark, values):
    """Repeated, close and wide-ranging eigenvalues; inertia counts match."""
    draw = np.random.default_rng(2)
    q, _ = np.linalg.qr(draw.standard_normal((len(values),) * 2))
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    found, columns = W.components(spark, v, 4)
    wanted = np.linalg.eigvalsh(v)[::-1][:4]
    assert np.allclose(found, wanted[:len(found)], rtol=1e-9, atol=1e-13 * max(values))
    assert np.allclose(columns.T @ columns, np.eye(len(found)), atol=1e-12)
    assert np.abs(v @ columns - columns * found).max() < 1e-12 * max(values)
    for shift in draw.uniform(-1, 6, 20):
        assert W.inertia_below(v, shift) == (np.linalg.eigvalsh(v) < shift).sum()


def test_projection_keeps_what_lies_inside(spark):
    v = np.diag([9.0, 8.0, 7.0, 1.0, 0.5, 0.1])
    part = W.project(spark, v, np.eye(6), W.contour_nodes(5.0, 11.0))
    assert np.allclose(np.abs(np.diag(part)), [1, 1, 1, 0, 0, 0], atol=1e-3)


def test_registered_query(spark, sf_dir):
    given = [(r["vec_id"], list(map(float, r["embedding"]))) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(queries.QUERIES["op13_embedding_whitening"](spark, sf_dir).withColumnRenamed("vec_id", "id").collect(), given)
