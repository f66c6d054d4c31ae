"""Laplace posteriors of Bayesian logistic regression beyond collected labels: a Newton fit whose sums run on Spark, and the
kernel form.

Newton: one pass a step; each task adds up loss, gradient and Hessian of its rows (d * (d + 2) numbers whatever the rows), and these sums
meet in a Spark aggregation. A step that doesn't lower the loss is halved. Rows without a vector or a label don't count.

Kernel form: with row weights C = sqrt(p (1 - p)) at the mode and L L' = C K C + precision I, a row with kernel values k against the fitted
rows has mean k . dual and variance (k(x, x) - |L^-1 (C k)|^2) / precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Kernel, Laplace, matrix, normal_cdf


def _with_one(x: np.ndarray, features: Callable | None) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x if features is None else features(x)])


def block_sums(a: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(d + 1, d + 1): n, loss sum and gradient in row 0 (from place 1 on: gradient; place 0: loss), the Hessian below; all without the prior."""
    m = a @ w
    p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
    loss = (np.logaddexp(0, m) - y * m).sum()
    return np.vstack([np.append(loss, a.T @ (p - y)), np.column_stack([a.T @ (p * (1 - p)), (a * (p * (1 - p))[:, None]).T @ a])])


def sums(rows: DataFrame, w: np.ndarray, features: Callable | None = None) -> DataFrame:
    """(r, c, v): the table of block_sums() over all rows (x, y), by place; -1, 0: how many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(w) + 1, len(w) + 1)), 0
        for batch in batches:
            there, x = matrix(batch.column(0))
            if len(x):
                total += block_sums(_with_one(x, features), batch.column(1).to_numpy(zero_copy_only=False).astype(float)[there], w)
                n += len(x)
        r, c = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(r.ravel(), -1), pa.int32()), pa.array(np.append(c.ravel(), 0), pa.int32()), pa.array(np.append(total.ravel(), float(n)))], ["r", "c", "v"])

    parts = rows.filter("y is not null").select("x", F.col("y").cast("double").alias("y")).mapInArrow(run, "r int, c int, v double")
    return parts.groupBy("r", "c").agg(F.sum("v").alias("v"))


def at(rows: DataFrame, w: np.ndarray, precision: float, features: Callable | None = None) -> tuple[float, np.ndarray, np.ndarray, int]:
    """(loss, gradient, Hessian, rows) of the posterior's negative logarithm at w: one job, d * (d + 2) numbers to the driver."""
    table, n = np.zeros((len(w) + 1, len(w) + 1)), 0
    for r in sums(rows, w, features).collect():
        if r.r < 0:
            n = int(r.v)
        else:
            table[r.r, r.c] = r.v
    loss = table[0, 0] + precision / 2 * float(w @ w)
    return loss, table[0, 1:] + precision * w, table[1:, 1:] + precision * np.eye(len(w)), n


def fit_laplace(rows: DataFrame, dim: int, precision: float = 1.0, features: Callable | None = None, tol: float = 1e-9, steps: int = 60) -> Laplace:
    """A posterior from all of rows (x, y), however many; dim: of the vectors, or of their features. Ends when the gradient is under tol a row and
    the next step is small; without a mode (separable rows and a flat prior) it raises."""
    w, size = np.zeros(dim + 1), 1.0
    loss, g, h, n = at(rows, w, precision, features)
    for _ in range(steps):
        step = np.linalg.solve(h, g)
        if np.abs(g).max() <= tol * max(n, 1) and np.abs(step).max() <= 1e-6 * (1 + np.abs(w).max()):
            return Laplace(w, h, features or (lambda v: v))
        new = w - size * step
        after = at(rows, new, precision, features)
        if after[0] > loss + 1e-12 * abs(loss):
            size /= 2
            continue
        w, size, (loss, g, h, _) = new, min(1.0, 2 * size), after
    raise RuntimeError("no mode was found; the labels may be separable and the prior flat")


@dataclass
class KernelLaplace:
    """Posterior over the dual of a kernel model: no bias; rank is the distance of the probability from a half."""

    kernel: Kernel
    train: np.ndarray
    dual: np.ndarray
    weight: np.ndarray
    precision: float

    def __post_init__(self) -> None:
        k = self.kernel(self.train)
        self.lower = np.linalg.cholesky(k * self.weight * self.weight[:, None] + self.precision * np.eye(len(k)))

    def score_block(self, x: np.ndarray):
        k = self.kernel(x, self.train)
        inner = np.linalg.solve(self.lower, (k * self.weight).T)
        var = np.maximum(self.kernel.diagonal(x) - (inner**2).sum(axis=0), 0) / self.precision
        p = normal_cdf(k @ self.dual / np.sqrt(var + 8 / np.pi))
        return (p > 0.5).astype(float), p, np.abs(p - 0.5)


def fit_kernel_laplace(x: np.ndarray, y: np.ndarray, kernel: Kernel, precision: float = 1.0, steps: int = 100) -> KernelLaplace:
    """The mode of sum ln(1 + exp(-+k . dual)) + precision / 2 dual' K dual, by Newton steps on collected labels."""
    k = kernel(x)
    dual, size = np.zeros(len(x)), 1.0

    def loss(a: np.ndarray) -> float:
        m = k @ a
        return float((np.logaddexp(0, m) - y * m).sum() + precision / 2 * a @ m)

    now = loss(dual)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(k @ dual, -500, 500)))
        w = p * (1 - p)
        slope = p - y + precision * dual
        if np.abs(slope).max() < 1e-12:
            break
        new = dual - size * np.linalg.solve(w[:, None] * k + precision * np.eye(len(k)), slope)
        after = loss(new)
        if after > now + 1e-13 * abs(now):
            size /= 2
            if size < 1e-6:
                break
            continue
        dual, now, size = new, after, min(1.0, 2 * size)
    else:
        raise RuntimeError("no mode was found")
    p = 1 / (1 + np.exp(-np.clip(k @ dual, -500, 500)))
    return KernelLaplace(kernel, x, dual, np.sqrt(p * (1 - p)), precision)
