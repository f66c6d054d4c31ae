"""Numeric invariants of fits, draws and features."""

import numpy as np
import pytest

from gleaner.functions import expressions as X
from gleaner.operators import blocks, factorized, margin


def test_chord():
    rng = np.random.default_rng(12)
    for _ in range(200):
        signed, w, d = rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=4)
        w *= 0.9 / np.linalg.norm(w)
        signed *= np.where(signed @ w > 0, 1, -1)[:, None]
        a, b = blocks.chord(signed, w, d)
        t = np.linspace(a - 1, b + 1, 4001)
        points = w + t[:, None] * d
        ok = (points @ signed.T >= 0).all(axis=1) & ((points**2).sum(axis=1) <= 1)
        assert a < 0 < b and (ok == ((t >= a) & (t <= b)))[np.minimum(abs(t - a), abs(t - b)) > 1e-9].all()
    with pytest.raises(ValueError):
        blocks.chord(np.array([[1.0, 0.0]]), np.array([-0.5, 0.0]), np.array([0.0, 1.0]))
    with pytest.raises(ValueError):
        blocks.chord(np.array([[1.0, 0.0]]), np.array([2.0, 0.0]), np.array([0.0, 1.0]))


def test_entropy_by_pattern():
    rng = np.random.default_rng(8)
    space = blocks.VersionSpace(rng.normal(size=(7, 4)))
    x, ref = rng.normal(size=(300, 3)), rng.normal(size=(20, 3))
    votes, at = space.votes(x), space.votes(ref)
    cut = np.abs(votes.mean(axis=1) - 0.5)
    got = blocks.ExpectedEntropy(space, at, cut.min()).score_block(x)[2]

    def entropy(p):
        return 0.0 if p in (0.0, 1.0) else -(p * np.log(p) + (1 - p) * np.log(1 - p))

    for v, c, g in zip(votes, cut, got):
        if c > cut.min():
            assert g == np.inf
            continue
        want = 0.0
        for side in (v > 0, v == 0):
            if side.any():
                want += side.mean() * np.mean([entropy(r[side].mean()) for r in at])
        assert abs(g - want) < 1e-9


def test_version_space_membership():
    a = np.array([[-1.0, 0.0], [-1.0, 2.0]]) * -1
    inside = [(a @ np.array(p) > 0).all() for p in ((0, 0), (2, 1), (0, -1), (4, 1), (-1, -1), (1, 1))]
    assert inside == [False, False, False, True, False, False]


def test_hypotheses_are_right_on_labels():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 2))
    y = (x @ [1.0, -2.0] + 0.3 > 0).astype(float)
    space = blocks.sample_version_space(x, y, 20, 100, 10, 1)
    assert (space.votes(x).T == y).all() and (np.linalg.norm(space.hypotheses, axis=1) <= 1 + 1e-9).all()
    with pytest.raises(ValueError):
        blocks.start_point(np.array([[1.0], [-1.0]]), rounds=50)


def test_svm_conditions():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2))
    y = ((x**2).sum(1) < 1).astype(float)
    m = blocks.fit_svm(x, y, blocks.Kernel("rbf", gamma=1.0), 1e3)
    s = np.where(y == 1, 1, -1)
    assert (s * m.decision(x) > 1 - 1e-3).all()
    assert abs(m.dual.sum()) < 1e-6
    with pytest.raises(ValueError):
        blocks.fit_svm(x, np.ones(60), blocks.Kernel())


def test_kernels_and_jitter():
    x = np.random.default_rng(0).normal(size=(6, 3))
    assert np.allclose(np.diag(blocks.Kernel("poly", coef0=1.0, jitter=0.1)(x)), blocks.Kernel("poly", coef0=1.0, jitter=0.1).diagonal(x))
    f = blocks.nystroem(x, blocks.Kernel())(x)
    assert np.allclose(f @ f.T, blocks.Kernel()(x), atol=1e-6)
    with pytest.raises(ValueError):
        blocks.Kernel("other")(x)


def test_kernel_features_have_the_kernel_norm():
    x = np.random.default_rng(0).normal(size=(6, 3))
    z = np.random.default_rng(1).normal(size=(9, 3))
    assert np.allclose((blocks.kernel_features(x, blocks.Kernel())(z) ** 2).sum(1), 1, atol=1e-6)


def test_gradient_is_the_slope():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(40, 3)), (rng.random(40) < 0.4).astype(float)
    b, w = rng.normal(size=2), rng.normal(size=(2, 3))
    _, g = factorized.block_gradient(x, y, b, w)
    eps = 1e-6
    for k in range(2):
        for i in range(3):
            up = w.copy()
            up[k, i] += eps
            slope = (factorized.block_gradient(x, y, b, up)[0] - factorized.block_gradient(x, y, b, w)[0]) / eps
            assert abs(slope - g[k, 1 + i]) < 1e-3 * max(1, abs(slope))


def test_gradient_on_spark_is_the_same(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(50, 2)), (rng.random(50) < 0.5).astype(float)
    df = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "x array<double>, y double").repartition(5)
    b, w = np.array([0.1, -0.2]), rng.normal(size=(2, 2))
    value, g = factorized.block_gradient(x, y, b, w)
    r = factorized.gradient(df, b, w).first()
    assert abs(r.loss - value / 50) < 1e-9 and np.allclose(r.gradient, g.ravel() / 50)


def test_distributed_fit_equals_local(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 2))
    df = spark.createDataFrame([(v.tolist(), float(v[0] > 0)) for v in x], "x array<double>, y double").repartition(1)
    one = factorized.fit(df, 1, steps=5)
    two = factorized.fit(df, 1, steps=5, driver_rows=3)
    assert np.allclose(one[1], two[1], atol=1e-6)


def test_set_partitions():
    assert len(list(factorized.set_partitions(4))) == 15
    assert len(list(factorized.set_partitions(4, 2))) == 7
    assert all(max(map(len, p)) <= 2 for p in factorized.set_partitions(4, None, 2))


def test_interaction_pairs():
    assert X.interaction_pairs(np.array([0, 0, 0, 1.0, 0, -2.0]), 0.1) == [(0, 1), (1, 2)]
    assert X.interaction_pairs(np.array([0, 0, 1.0, 0, 3.0]), 0.1, True) == [(0, 0), (0, 1)]
    with pytest.raises(ValueError):
        X.interaction_pairs(np.zeros(4), 0.1)


def test_custom_scores_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 3)))]
    space = blocks.VersionSpace(rng.normal(size=(5, 4)))
    out = []
    for n in (1, 3, 16):
        df = spark.createDataFrame(rows, "id long, x array<double>").repartition(n)
        out.append(sorted(tuple(r) for r in blocks.score(df, space).collect()))
    assert out[0] == out[1] == out[2]


def test_disagreement_fits():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 2))
    y = (x[:, 0] > 0).astype(float)
    background = rng.normal(size=(50, 2)) * 3
    m = blocks.fit_disagreement((x, y), background, blocks.Kernel("rbf", gamma=0.5), 1e3, 1e-3)
    far = np.array([[9.0, 9.0], [-9.0, 9.0], [0.0, -9.0]])  # beyond all labels only the background speaks
    assert m.positive.decision(far).min() > m.negative.decision(far).max()
    pred, _, rank = m.score_block(x)
    assert (pred == y).all() and rank.mean() > 0.8
    assert (m.score_block(far)[2] == ((m.positive.decision(far) > 0) == (m.negative.decision(far) > 0))).all()


def test_subspaces_that_fit():
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(size=80), rng.integers(0, 4, 80), rng.integers(0, 2, (80, 3))]).astype(float)
    partial = np.column_stack([x[:, 0] > 0, x[:, 1] != 2, x[:, 2] == 0]).astype(float)
    model = blocks.fit_subspaces(x, partial, [[0], [1], [2, 3, 4]], [lambda a, b: blocks.fit_svm(a, b, blocks.Kernel("linear"), 100.0), blocks.Categories.fit, blocks.ItemSets.fit])
    _, p, _ = model.score_block(x)
    assert (p[(partial == 0).any(axis=1) & (p != 0)] < 0.5).all() and (p[x[:, 1] == 2] == 0).all()
    assert blocks.Categories.fit(np.array([[1.0], [1.0]]), np.array([0.0, 1.0])).score_block(np.array([[1.0]]))[1][0] == 0.5
    with pytest.raises(ValueError):
        blocks.fit_subspaces(x, partial[:, :2], [[0], [1], [2]], blocks.Categories.fit)


def test_laplace_mode_and_hessian():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(60, 2)), (rng.random(60) < 0.5).astype(float)
    for precision in (1.0, 0.0):
        m = blocks.fit_laplace(x, y, precision)
        a = np.column_stack([np.ones(60), x])

        def cost(w):
            z = a @ w
            return np.logaddexp(0, z).sum() - y @ z + precision * (w @ w) / 2

        for i in range(3):
            e = np.eye(3)[i] * 1e-4
            assert abs(cost(m.mode + e) - cost(m.mode - e)) < 1e-6
            for j in range(3):
                f = np.eye(3)[j] * 1e-4
                second = (cost(m.mode + e + f) - cost(m.mode + e - f) - cost(m.mode - e + f) + cost(m.mode - e - f)) / 4e-8
                assert abs(second - m.hessian[i, j]) < 1e-3
    with pytest.raises((RuntimeError, np.linalg.LinAlgError)):
        blocks.fit_laplace(x, (x[:, 0] > 0).astype(float), 0.0)


def test_ratio_margin_refits_both_ways():
    rng = np.random.default_rng(8)
    x, y, k = rng.normal(size=(12, 2)), np.array([0.0, 1.0] * 6), blocks.Kernel("rbf")
    rows = rng.normal(size=(5, 2))
    got = margin.RatioMargin(x, y, k, 10.0).score_block(rows)[2]
    for r, g in zip(rows, got):
        m = []
        for v in (0.0, 1.0):
            model = blocks.fit_svm(np.vstack([x, r]), np.append(y, v), k, 10.0, tol=1e-11)
            m.append(sum(a * b * np.exp(-((s - t) ** 2).sum() / 2) for a, s in zip(model.dual, model.support) for b, t in zip(model.dual, model.support)))
        assert abs(g + min(m[0] / m[1], m[1] / m[0])) < 1e-9


def test_expressions_refuse_too_many_terms():
    X.votes("x", [0.0] * 20, [[1.0] * 10] * 20)
    with pytest.raises(ValueError):
        X.votes("x", [0.0] * 21, [[1.0] * 10] * 21)
    with pytest.raises(ValueError):
        X.factorized("x", [0.0] * 4, [[1.0] * 64] * 4)


def test_factorized_fit_takes_the_plain_steps(spark):
    """Adam on the mean loss, written out, gives the same weights on the driver and in Spark."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(80, 2))
    y = ((x[:, 0] > -0.5) & (x[:, 1] < 0.5)).astype(float)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(3)
    start = rng.normal(size=2), rng.normal(size=(2, 2))
    fits = [factorized.fit(df, 2, steps=12, start=start, driver_rows=n) for n in (1000, 10)]
    a = np.column_stack(start)
    m, v, best = np.zeros_like(a), np.zeros_like(a), (np.inf, a)

    def loss(a):
        p = np.prod(1 / (1 + np.exp(-(x @ a[:, 1:].T + a[:, 0]))), axis=1)
        return -np.mean(np.where(y > 0, np.log(p), np.log(1 - p)))

    for t in range(1, 13):
        if loss(a) < best[0]:
            best = loss(a), a
        g = np.zeros_like(a)
        for i in np.ndindex(a.shape):
            e = np.zeros_like(a)
            e[i] = 1e-6
            g[i] = (loss(a + e) - loss(a - e)) / 2e-6
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        a = a - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    for bias, w, value in fits:
        assert np.allclose(np.column_stack([bias, w]), best[1], atol=1e-4) and abs(value - best[0]) < 1e-6


def test_partition_searches(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(120, 3))
    y = ((x[:, 0] + x[:, 1] > 0) & (x[:, 2] > -0.3)).astype(float)
    every = {tuple(sorted(map(tuple, p))): factorized.fit_partition(x, y, p, 150)[2] for p in factorized.set_partitions(3)}
    assert len(every) == 5
    best = factorized.brute_force(spark, x, y).first()
    assert abs(best.loss - min(every.values())) < 1e-9
    path = factorized.greedy(spark, x, y, warm=False)
    for (before, a), (after, b) in zip(path, path[1:]):
        assert b < a and len(after) == len(before) - 1
        merges = [v for k, v in every.items() if len(k) == len(after) and all(any(set(p) <= set(q) for q in k) for p in before)]
        assert abs(b - min(merges)) < 1e-9
    assert max(map(len, factorized.greedy(spark, x, y, max_dim=2, blocks=1)[-1][0])) == 2


def _near_nothing():
    """Rows that the four hypotheses of the queries hardly tell from 0: hundredths and twenty-fourths."""
    from gleaner.queries.models import HYPOTHESES

    x = np.array([[v / 100 / 100, h / 24] for v in range(0, 20_000) for h in range(24)])
    close = [np.abs(b + x @ np.array(w)) < 1e-12 for b, w in zip(*HYPOTHESES)]
    said = np.column_stack([(b + x[:, 0] * w[0]) + x[:, 1] * w[1] > 0 for b, w in zip(*HYPOTHESES)])
    return HYPOTHESES, x, np.any(close, axis=0), said


def test_votes_of_blocks_are_summed_from_the_bias_on():
    (biases, weights), x, close, said = _near_nothing()
    space = blocks.VersionSpace(np.column_stack([biases, weights]))
    assert close.any()
    for rows in (slice(None), close, np.arange(7)):  # a product of blocks depends on how many rows there are
        assert (space.votes(x[rows]) == said[rows]).all()
    for k in np.flatnonzero(close):
        assert (space.votes(x[k : k + 1]) == said[k]).all()


def test_votes_of_expressions_are_summed_from_the_bias_on(spark):
    (biases, weights), x, close, said = _near_nothing()
    rows = spark.createDataFrame([(k, a) for k, a in enumerate(x[close].tolist())], "id int, x array<double>")
    got = [r.p for r in rows.select("id", X.votes("x", biases, weights).alias("p")).orderBy("id").collect()]
    assert got == said[close].mean(axis=1).tolist()


def test_equal_rows_share_their_projection(spark, tmp_path):
    from gleaner.queries import models

    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).round(3)
    x[::4] = x[0]  # ten rows are equal
    x[0, 0], x[4, 0], x[8:40:4, 0] = 0.0, -0.0, 0.0
    spark.createDataFrame([(k, v, 0) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = models.random_projection(spark, str(tmp_path)).collect()
    assert len(got) == 320 and all(r["product"] is not None for r in got)


def test_projections_of_round_numbers():
    x = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8) if a or b or c], float)
    x /= 2.0 ** np.ceil(np.log2(np.abs(x).max(axis=1, keepdims=True))) * 2  # numbers of few bits
    x = np.unique(x, axis=0)
    eps, share = 0.9 / (2 * (1 + 3**0.5)), 1 / (1 + 3**0.5)
    z = blocks.projection(3, 3, 0.9, 2000, 0.1, 7)(x)
    assert np.abs(z @ z.T - share * (x @ x.T) - (1 - share) * np.eye(len(x))).max() <= eps
