"""Blocks with odd rows, draws, inference, many runs, kernel fits, penalties."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import expressions as X
from gleaner.operators import blocks, factorized, inference, sampling
from gleaner.plans import explore


def summing():
    class Sum:  # workers can't import this file
        def score_block(self, x):
            return (x.sum(axis=1) > 0).astype(float), x.sum(axis=1), x[:, 0]

    return Sum()


def test_rows_without_a_vector_keep_their_place(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [3.0, 4.0]), (3, [None, 5.0]), (4, [6.0, 7.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>").coalesce(1)
    got = {r.id: (r.pred, r.proba, r.rank) for r in blocks.score(df, summing()).collect()}
    assert got == {0: (1, 3, 1), 1: (None, None, None), 2: (1, 7, 3), 3: (None, None, None), 4: (1, 13, 6)}
    assert {r.id: r.x for r in blocks.transform(df, lambda v: v * 2).collect()} == {0: [2, 4], 1: None, 2: [6, 8], 3: None, 4: [12, 14]}
    assert {(r.id, r.k) for r in blocks.kernel_table(df, np.array([[1.0, 1.0]]), blocks.Kernel("linear")).collect()} == {(0, 3), (2, 7), (4, 13)}
    full = df.filter("id in (0, 2, 4)").withColumn("y", F.lit(1.0))
    one, two = (factorized.gradient(d, np.zeros(2), np.ones((2, 2))).first() for d in (full, df.withColumn("y", F.lit(1.0))))
    assert one.n == two.n == 3 and np.allclose(one.gradient, two.gradient)
    nothing = df.filter("x is null")
    assert [r.pred for r in blocks.score(nothing, summing()).collect()] == [None]
    assert blocks.score(df.limit(0), summing()).count() == 0


def test_vectors_of_different_lengths_raise(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [1.0, 2.0, 3.0])], "id long, x array<double>").coalesce(1)
    with pytest.raises(Exception, match="vectors of 1 and of 3 numbers"):
        blocks.score(df, summing()).collect()
    with pytest.raises(ValueError, match="without a vector"):
        blocks.collected(spark.createDataFrame([(0, None, 1.0)], "id long, x array<double>, y double"))


def test_partial_labels_of_blocks(spark):
    df = spark.createDataFrame([([0.6, 0.6, 0.9],), ([0.8, 0.7, 0.3],), ([0.9, 0.26, 0.9],)], "p array<double>")
    sets, subspaces = [[0, 1], [1, 2]], [[0], [1], [2]]
    assert X.blocks_of(subspaces, sets) == [[0, 1], [1, 2]]
    got = [r.b for r in df.select(X.blend_partial("p", X.blocks_of(subspaces, sets)).alias("b")).collect()]
    want = [[float(a * b**0.5 > 0.5), float(b**0.5 * c > 0.5)] for a, b, c in ((0.6, 0.6, 0.9), (0.8, 0.7, 0.3), (0.9, 0.26, 0.9))]
    assert got == want
    assert df.limit(1).select(X.blend_partial("p", [[0, 1]]).alias("b")).first().b == [0.0]  # 0.36


def draw_by_hand(rows, n, seed, own):
    """(asked, cached): first from the unknown rows until own are open, then from all that are left."""
    order = sorted(rows, key=lambda r: (r[2], hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest(), r[0]))
    asked, cached, gone = [], {}, set()
    for most, among in ((own, [r for r in order if r[1] == "unknown"]), (n - own, order)):
        opened = 0
        for r in among:
            if opened == most:
                break
            if r[0] in gone:
                continue
            gone.add(r[0])
            if r[3] == 0.5:
                asked.append(r[0])
                opened += 1
            else:
                cached[r[0]] = r[3]
    return set(asked), cached


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
@pytest.mark.parametrize("n", [1, 7, 60])
def test_one_draw_from_two_rankings(spark, share, n):
    rng = np.random.default_rng(n)
    rows = [(k, "unknown" if rng.random() < 0.6 else "inferred", float(rng.integers(0, 9)), float(rng.choice([0.0, 0.5, 0.5, 1.0]))) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, state string, rank double, polytope double").repartition(5)
    ask, cache = sampling.dual_space_draw(df, n, 3, share)
    own = sum(int(hashlib.md5(f"3:pick:{i}".encode()).hexdigest()[:8], 16) / 2**32 < share for i in range(1, n + 1))
    asked, cached = draw_by_hand(rows, n, 3, own)
    assert {r.id for r in ask.collect()} == asked and {r.id: r.label for r in cache.collect()} == cached


def rounds_by_hand(rows, width):
    known = {(k, v): 1.0 for label, values in rows if label == 1 for k, v in enumerate(values)}
    while True:
        found = set()
        for label, values in rows:
            if label != 0:
                continue
            cells = list(enumerate(values))
            unknown = [c for c in cells if c not in known]
            if any(known.get(c) == 0.0 for c in cells):
                continue
            if len(unknown) == 1:
                found.add(unknown[0])
        if not found:
            return {(k, v): y for (k, v), y in known.items() if v is not None}
        known.update(dict.fromkeys(found, 0.0))


def test_inference_by_joins_is_the_fixpoint_of_rounds(spark):
    rng = np.random.default_rng(4)
    for size in (6, 40, 400):
        rows = []
        for _ in range(size):
            v = [None if rng.random() < 0.03 else str(rng.integers(0, 12)) for _ in range(3)]
            rows.append((float(all(x is None or int(x) < 8 for x in v)), v))
        df = spark.createDataFrame([(k, y, *v) for k, (y, v) in enumerate(rows)], "id long, label double, a string, b string, c string").repartition(3)
        got = {(r.k, r.v): r.known for r in inference.infer_values(df, ["a", "b", "c"]).collect()}
        assert got == rounds_by_hand(rows, 3)


def test_inference_from_more_labels_than_a_driver_would_take(spark):
    n = 150_000
    df = spark.range(n).select("id", (F.col("id") % 2).cast("double").alias("label"), (F.col("id") / 2).cast("long").cast("string").alias("a"), F.when(F.col("id") % 2 == 1, "yes").otherwise("no").alias("b"))
    known = inference.infer_values(df, ["a", "b"])
    assert known.filter("k = 0 and known = 1").count() == n // 2 and [r.v for r in known.filter("k = 1 and known = 0").collect()] == ["no"]


def test_many_runs_side_by_side_are_the_runs_one_by_one(spark):
    from gleaner.queries.models import Steady, SteadyFirst

    rng = np.random.default_rng(5)
    x = rng.random((600, 2))
    y = ((x[:, 0] < 0.5) & (x[:, 1] < 0.6)).astype(float)
    df = spark.createDataFrame([(k, v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y))], "id long, x array<double>, label double").repartition(4)
    runs = [explore.Run("a", Steady, 1), explore.Run("a", Steady, 2), explore.Run("b", SteadyFirst, 1)]
    log = explore.explore_many(df, df, runs, 3, 2).collect()
    key = lambda seed, k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest()
    for run in runs:
        own = [min((k for k in range(600) if y[k] == v), key=lambda k: (key(run.seed, k), k)) for v in (1, 0)]
        for it in range(4):
            pred, _, rank = run.fit(x[sorted(own)], y[sorted(own)]).score_block(x)
            tp, fp, fn = ((pred == 1) & (y == 1)).sum(), ((pred == 1) & (y == 0)).sum(), ((pred == 0) & (y == 1)).sum()
            got = {r.key: r.value for r in log if r.run == run.name and r.iter == it}
            assert (got["tp"], got["fp"], got["fn"]) == (tp, fp, fn) and abs(got["fscore"] - 2 * tp / (2 * tp + fp + fn)) < 1e-12
            own += sorted((k for k in range(600) if k not in own), key=lambda k: (rank[k], key(run.seed, k), k))[:2]


def test_kernel_fit_is_the_fit_of_stored_features(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 4))
    y = ((x[:, :2] ** 2).sum(axis=1) < 2).astype(float)
    df = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "x array<double>, y double").repartition(3)
    kernel, parts = blocks.Kernel("rbf", gamma=0.5), [[0, 1], [2, 3]]
    features, mask = factorized.kernel_features(x[:12], kernel, parts)
    assert mask.shape == (2, 24) and mask.sum() == 24
    stored = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(features(x), y)], "x array<double>, y double")
    start = np.zeros(2), mask * 0.1
    want = factorized.fit(stored, 2, "l2", 1e-3, mask=mask, start=start, steps=40)
    for rows in (50_000, 20):
        got = factorized.fit_kernel(df, x[:12], kernel, parts, penalty="l2", strength=1e-3, start=start, steps=40, driver_rows=rows)
        assert np.allclose(got.bias, want[0], atol=1e-8) and np.allclose(got.w, want[1], atol=1e-8) and not (got.w * (1 - mask)).any()
    model = factorized.fit_kernel(df, x, kernel, 1, steps=200)  # the kernel itself
    assert ((model.score_block(x)[0] == 1) == (y == 1)).mean() > 0.9
    assert np.allclose(got.partial_proba(x).prod(axis=1), got.score_block(x)[1])


def test_sparse_group_penalty_by_its_own_minimum():
    rng = np.random.default_rng(7)
    for groups in (None, [[0, 1], [2], [3, 4]]):
        p = factorized.SparseGroup(0.3, 0.5, groups)
        for _ in range(20):
            v = rng.normal(size=(3, 5))
            best = p.prox(v, 0.7)
            value = lambda w: ((w - v) ** 2).sum() / 2 + 0.7 * p.value(w)
            assert all(value(best) <= value(best + rng.normal(size=best.shape) * s) + 1e-12 for s in (1e-3, 1e-2, 0.1) for _ in range(40))


def test_factorization_is_refined_from_the_present_model(spark):
    rng = np.random.default_rng(8)
    x = rng.random((400, 4))
    y = ((x[:, 0] < 0.6) & (x[:, 2] < 0.7)).astype(float)
    df = spark.createDataFrame([(k, v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y))], "id long, x array<double>, y double")
    start = np.array([3.0, 3.0]), np.array([[-5.0, 0.1, 0, 0], [0, 0, -4.0, 0.1]])
    learned = factorized.learn_factorization(df, df, l1=1e-3, group=1e-3, start=start, steps=300)
    assert learned.sets == [[0], [2]] and sorted(learned.subspaces) == [[0], [2]]
    labels = {r.id: r.b for r in df.select("id", learned.partial_labels("x").alias("b")).collect()}
    right = np.mean([labels[k] == [float(x[k, 0] < 0.6), float(x[k, 2] < 0.7)] for k in range(400)])
    assert right > 0.85
    with pytest.raises(ValueError):
        factorized.learn_factorization(df, df)
    everything = factorized.learn_factorization(df, df.withColumn("y", F.lit(1.0)), 2, steps=60, threshold=0.01)
    assert everything.sets == []


def test_chains_that_have_mixed_and_chains_that_have_not(spark):
    rng = np.random.default_rng(9)
    mixed = [(c, k, [float(rng.normal()), float(rng.normal() + 5 * c)]) for c in range(4) for k in range(100)]
    got = {r.k: r.ratio for r in blocks.chain_diagnostic(spark.createDataFrame(mixed, "chain long, draw int, w array<double>")).collect()}
    assert abs(got[0] - 1) < 0.05 and got[1] > 3
    v = np.array([[m[2][1] for m in mixed if m[0] == c] for c in range(4)])
    within, between = v.var(axis=1, ddof=1).mean(), 100 * v.mean(axis=1).var(ddof=1)
    assert abs(got[1] - np.sqrt((0.99 * within + between / 100) / within)) < 1e-9
    with pytest.raises(ValueError):
        blocks.stacked(spark.createDataFrame(mixed, "chain long, draw int, w array<double>"), most=10)


def test_runs_that_stop_labels_that_are_noisy_and_own_measures(spark):
    from gleaner.queries.models import Steady

    rng = np.random.default_rng(10)
    x = rng.random((200, 2))
    y = (x[:, 0] < 0.5).astype(float)
    df = spark.createDataFrame([(k, v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y))], "id long, x array<double>, label double").repartition(3)
    least = lambda rows, seed: rows.filter("id < 30")
    learnt = []

    def fit(a, b):
        learnt.append((a, b))
        return Steady(a, b)

    log = explore.explore_many(df, df, [explore.Run("a", fit, 1), explore.Run("b", fit, 2)], 3, 2, least, lambda asked: asked.withColumn("label", 1 - F.col("label")), {"wrong": lambda v: v["fp"] + v["fn"]}, lambda v: v["wrong"] < 0).collect()
    assert len(learnt) == 8 and [len(a) for a, _ in learnt] == [30, 30, 32, 32, 34, 34, 36, 36]
    for a, b in learnt:
        assert (b == 1 - (a[:, 0] < 0.5)).all()  # also those that were asked later
    assert {(r.run, r.iter) for r in log} == {(f"{n}:{s}", i) for n, s in (("a", 1), ("b", 2)) for i in range(4)}
    values = {(r.run, r.iter, r.key): r.value for r in log}
    assert all(values[run, i, "wrong"] == values[run, i, "fp"] + values[run, i, "fn"] for run in ("a:1", "b:2") for i in range(4))
    stopped = explore.explore_many(df, df, [explore.Run("a", Steady, 1), explore.Run("b", Steady, 2)], 3, 1, least, stop=lambda v: v["accuracy"] > 0.5).collect()
    assert {(r.run, r.iter) for r in stopped} == {("a:1", 0), ("b:2", 0)}
