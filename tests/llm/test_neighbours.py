"""Nearest vectors against comparing all with all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<double>, rank int, query_id string"


def plain(rows, asks, k):
    """{query: [(id, score)]} in the order of nearness."""
    good = [(i, np.array(x, float)) for i, x in rows if i is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    out = {}
    for q in {i for i, _ in good if asks(i)}:
        best = {}
        for i, x in good:
            if i == q:
                for j, y in good:
                    if j != q and len(x) == len(y):
                        x1, y1 = x / np.abs(x).max(), y / np.abs(y).max()
                        s = float(x1 @ y1 / np.sqrt(x1 @ x1) / np.sqrt(y1 @ y1))
                        best[j] = max(s, best.get(j, -2))
        out[q] = sorted(best.items(), key=lambda r: (-round(r[1], 12), r[0]))[:k]
    return out


def compare(spark, rows, asks, condition, k=5, parts=3, **how):
    df = spark.createDataFrame([(i, x, 1, "z") for i, x in rows], SCHEMA).repartition(parts)
    got = {}
    for r in neighbours.nearest(df, condition, k, **how).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = {q: v for q, v in plain(rows, asks, k).items() if v}
    assert {q: [(r, i) for r, i, _ in v] for q, v in got.items()} == {q: [(n + 1, i) for n, (i, _) in enumerate(v)] for q, v in want.items()}
    for q, v in want.items():
        assert np.allclose([s for _, s in v], [s for _, _, s in got[q]], atol=1e-14)


@pytest.mark.parametrize("dim", [1, 3, 64])
def test_all_queries_against_all_rows(spark, dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(700, dim))
    x[100:160] = x[100] + rng.normal(size=(60, dim)) * 1e-4  # near copies, which codes can't tell apart
    x[200:290] = x[200]  # copies
    compare(spark, [(k, v.tolist()) for k, v in enumerate(x)], lambda i: i % 7 == 0, F.col("vec_id") % 7 == 0, query_rows=16, stripe_rows=64)


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(60)]
    rows += [(60, None), (61, []), (62, [0.0] * 8), (63, [float("nan")] + [1.0] * 7), (64, [None] + [1.0] * 7), (65, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    rows += [(70, [1e200] * 8), (71, [1e-200] * 8), (72, [-0.0] + [1.0] * 7), (73, [0.0] + [1.0] * 7), (80, [1.0, 2.0]), (90, [2.0, 1.0]), (100, [3.0])]
    rows += [rows[5]] * 4 + [(10, rng.normal(size=8).tolist()), (11, rows[12][1]), (20, rows[13][1])]
    compare(spark, rows, lambda i: i % 10 == 0, F.col("vec_id") % 10 == 0, stripe_rows=16)


def test_a_vector_that_a_third_of_all_rows_hold(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    x[::3] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in rows], SCHEMA).repartition(7)
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0, stripe_rows=500).collect()
    own = [r for r in got if r.query_id % 3 == 0]
    assert {r.rank: r.vec_id for r in own if r.query_id == 150} == {1: 0, 2: 3, 3: 6, 4: 9, 5: 12}
    assert {r.rank: r.vec_id for r in own if r.query_id == 0} == {1: 3, 2: 6, 3: 9, 4: 12, 5: 15}
    assert len(got) == 300


def test_many_dimensions_and_few_candidates(spark):
    rng = np.random.default_rng(2)
    compare(spark, [(k, rng.normal(size=2500).tolist()) for k in range(40)], lambda i: i % 10 == 0, F.col("vec_id") % 10 == 0)
    compare(spark, [(k, rng.normal(size=4).tolist()) for k in range(3)], lambda i: True, F.lit(True))
    compare(spark, [(0, [1.0, 2.0])], lambda i: True, F.lit(True))
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = neighbours.unit(rng.normal(size=(200, 48))), neighbours.unit(rng.normal(size=(300, 48)) ** 3)
    block = neighbours.Block(np.arange(200), a, 5)
    codes, step, error = neighbours.quantised(b)
    near = neighbours.products(block.codes, codes) * block.step[:, None] * step
    assert (np.abs(near - a @ b.T) <= block.norm[:, None] * error + block.error[:, None] + 1e-6).all()
    assert np.abs(codes).max() <= 127


def test_query_and_recall(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = queries.op13_neighbours(spark, sf)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = plain(rows, lambda i: i % 50 == 0, 5)
    assert {(r.query_id, r.rank): r.vec_id for r in got.collect()} == {(q, n + 1): i for q, v in want.items() for n, (i, _) in enumerate(v)}
    assert neighbours.recall(table, got) == 1.0
