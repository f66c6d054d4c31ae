"""Posteriors and ratio margins against differences and whole fits."""

import math

import numpy as np
import pytest

from gleaner.operators import blocks, margin, posterior


def data(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    return x, (x @ rng.normal(size=dim) + rng.normal(size=n) > 0).astype(float)


def test_the_normal_distribution():
    z = np.concatenate([np.linspace(-9, 9, 3001), [0.0, -40.0, 40.0]])
    assert np.abs(blocks.normal_cdf(z) - np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z])).max() < 1e-14
    assert len(blocks.normal_cdf(np.zeros(0))) == 0


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_newton_on_spark_is_the_fit_of_collected_rows(spark, parts):
    x, y = data(4000, 3, 0)
    rows = [(v.tolist(), float(t)) for v, t in zip(x, y)] + [(None, 1.0), ([1.0, None, 2.0], 0.0), ([1.0, 2.0, 3.0], None)]
    df = spark.createDataFrame(rows, "x array<double>, y double").repartition(parts)
    got, want = posterior.fit_laplace(df, 3, 0.5), blocks.fit_laplace(x, y, 0.5)
    assert np.allclose(got.mode, want.mode, atol=1e-8) and np.allclose(got.hessian, want.hessian, rtol=1e-6)
    loss, g, _, n = posterior.at(df, got.mode, 0.5)
    assert n == 4000 and np.abs(g).max() < 1e-5
    for k in range(4):
        step = np.eye(4)[k] * 1e-4
        up, down = (posterior.at(df, got.mode + s, 0.5) for s in (step, -step))
        assert abs((up[0] - down[0]) / 2e-4 - g[k]) < 1e-4
        assert np.allclose((up[1] - down[1]) / 2e-4, want.hessian[k], rtol=1e-5, atol=1e-4)


def test_newton_with_features_and_without_a_mode(spark):
    x, y = data(500, 2, 1)
    df = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "x array<double>, y double")
    work = lambda v: np.column_stack([v, v[:, 0] * v[:, 1]])
    assert np.allclose(posterior.fit_laplace(df, 3, 1.0, work).mode, blocks.fit_laplace(x, y, 1.0, work).mode, atol=1e-7)
    apart = spark.createDataFrame([([float(k)], float(k > 4)) for k in range(10)], "x array<double>, y double")
    with pytest.raises((RuntimeError, np.linalg.LinAlgError)):
        posterior.fit_laplace(apart, 1, 0.0)


def test_kernel_posterior_by_differences():
    x, y = data(25, 3, 2)
    kernel, precision = blocks.Kernel("rbf", gamma=0.4), 0.7
    m = posterior.fit_kernel_laplace(x, y, kernel, precision)
    k = kernel(x)

    def loss(a):
        f = k @ a
        return np.logaddexp(0, np.where(y == 1, -f, f)).sum() + precision / 2 * a @ f

    for j in range(25):
        step = np.eye(25)[j] * 1e-5
        assert abs(loss(m.dual + step) - loss(m.dual - step)) / 2e-5 < 1e-7
    p = 1 / (1 + np.exp(-(k @ m.dual)))
    assert np.allclose(m.weight**2, p * (1 - p)) and np.allclose(m.lower @ m.lower.T, k * np.outer(m.weight, m.weight) + precision * np.eye(25))
    # The same variance from the Gaussian process that the dual stands for: prior K / precision, noise 1 / (p (1 - p)).
    rows = np.random.default_rng(3).normal(size=(9, 3))
    near = kernel(rows, x)
    var = 1 / precision - np.einsum("ij,jk,ik->i", near / precision, np.linalg.inv(k / precision + np.diag(1 / (p * (1 - p)))), near / precision)
    want = [0.5 * (1 + math.erf(f / math.sqrt(v + 8 / math.pi) / math.sqrt(2))) for f, v in zip(near @ m.dual, var)]
    assert np.allclose(m.score_block(rows)[1], want)


@pytest.mark.parametrize("c", [1.0, 10.0, 1e4])
@pytest.mark.parametrize("name,gamma", [("rbf", 0.3), ("poly", 0.5), ("linear", None)])
def test_rows_added_to_a_fit_give_what_fits_from_nothing_give(c, name, gamma):
    if c == 1e4 and name != "rbf":
        pytest.skip("labels that no such model separates")
    x, y = data(24, 3, 4)
    rows = np.random.default_rng(5).normal(size=(25, 3))
    kernel = blocks.Kernel(name, gamma=gamma, coef0=1.0)
    model = margin.RatioMargin(x, y, kernel, c)
    got = model.score_block(rows)[2]
    for r, rank in zip(rows, got):
        m = [blocks.fit_svm(np.vstack([x, r]), np.append(y, v), kernel, c, tol=1e-9, rounds=2_000_000).margin() for v in (0.0, 1.0)]
        assert abs(rank + min(m[0] / m[1], m[1] / m[0])) < 1e-6
    assert model.refits <= 10


def test_repeated_rows_and_rows_of_the_fit_itself():
    x, y = data(12, 2, 6)
    x, y = np.vstack([x, x[:4]]), np.append(y, y[:4])
    kernel = blocks.Kernel("rbf", gamma=0.5)
    got = margin.RatioMargin(x, y, kernel, 5.0).score_block(x[:6])[2]
    for r, rank in zip(x[:6], got):
        m = [blocks.fit_svm(np.vstack([x, r]), np.append(y, v), kernel, 5.0, tol=1e-9).margin() for v in (0.0, 1.0)]
        assert abs(rank + min(m[0] / m[1], m[1] / m[0])) < 1e-6
