"""Ratio margin: for each row the model that it would give as a negative and as a positive, from one fitted model.

A row is added to the fitted solution by raising its dual from 0 until it lies on the margin or at the bound. On the way the rows
on the margin stay there (a linear system over these few rows), and whenever one of them reaches a bound, or another row
reaches the margin, it changes sides. So a row costs a few small systems instead of two fits from nothing. Where no row is
on the margin, or those on it depend on each other, the row is fitted from nothing."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .blocks import Kernel, KernelSVM, fit_svm


@dataclass
class Solution:
    """Of a fit: kernel matrix k, signs s, duals alpha in [0, c], bias; free: rows on the margin; gap: s f - 1."""

    k: np.ndarray
    s: np.ndarray
    alpha: np.ndarray
    bias: float
    c: float
    free: np.ndarray
    gap: np.ndarray


class Dependent(ArithmeticError):
    """No unique way to go on."""


def solution(x: np.ndarray, y: np.ndarray, kernel: Kernel, c: float, tol: float = 1e-9) -> tuple[Solution, KernelSVM]:
    """The fitted model, with the duals on the margin solved for exactly."""
    model = fit_svm(x, y, kernel, c, tol=tol)
    k, s = kernel(x), np.where(y == 1, 1.0, -1.0)
    alpha = np.zeros(len(x))
    for v, d in zip(model.support, model.dual):  # equal rows share their dual among those of the same sign
        same = np.flatnonzero((x == v).all(axis=1) & (s == np.sign(d)) & (alpha == 0))
        alpha[same[0]] = abs(d)
    free = (alpha > 1e-7 * c) & (alpha < c * (1 - 1e-7))
    alpha[~free] = np.where(alpha[~free] > c / 2, c, 0.0)
    if free.any():
        known = k[np.ix_(free, ~free)] @ (alpha * s)[~free]
        system = np.block([[np.zeros((1, 1)), np.ones((1, free.sum()))], [np.ones((free.sum(), 1)), k[np.ix_(free, free)]]])
        bias, *beta = _solved(system, np.append(-(alpha * s)[~free].sum(), s[free] - known))
        alpha[free] = np.array(beta) * s[free]
    else:
        bias = model.bias
    return Solution(k, s, alpha, float(bias), c, free, s * (k @ (alpha * s) + bias) - 1), model


def _solved(system: np.ndarray, right: np.ndarray) -> np.ndarray:
    try:
        out = np.linalg.solve(system, right)
    except np.linalg.LinAlgError as e:
        raise Dependent from e
    if not np.allclose(system @ out, right, atol=1e-8 * max(1.0, np.abs(right).max())):
        raise Dependent
    return out


def added(base: Solution, row: np.ndarray, own: float, sign: float, most: int = 500) -> np.ndarray:
    """Signed duals of all rows and the new one, last. row: its kernel values with the others; own: with itself."""
    n = len(base.s)
    alpha, gap, free, bias, new = base.alpha.copy(), base.gap.copy(), base.free.copy(), base.bias, 0.0
    own_gap = sign * (row @ (alpha * base.s) + bias) - 1
    for _ in range(most):
        if own_gap >= -1e-10 or new >= base.c - 1e-12:
            return np.append(alpha * base.s, new * sign)
        m = int(free.sum())
        if not m:
            raise Dependent
        here = np.flatnonzero(free)
        system = np.block([[np.zeros((1, 1)), np.ones((1, m))], [np.ones((m, 1)), base.k[np.ix_(here, here)]]])
        d_bias, *rest = -sign * _solved(system, np.append(1.0, row[here]))
        beta = np.array(rest)
        d_alpha = np.zeros(n)
        d_alpha[here] = beta * base.s[here]
        d_gap = base.s * (d_bias + base.k[:, here] @ beta + row * sign)
        d_gap[here] = 0.0
        d_own = sign * (d_bias + row[here] @ beta + own * sign)
        if d_own <= 1e-12:
            step = base.c - new  # the row can't reach the margin before its bound
        else:
            step = min(base.c - new, -own_gap / d_own)
        turn = -1
        with np.errstate(divide="ignore", invalid="ignore"):
            to_bound = np.where(d_alpha > 1e-14, (base.c - alpha) / d_alpha, np.where(d_alpha < -1e-14, -alpha / d_alpha, np.inf))
            to_bound[~free] = np.inf
            outside = ~free & (((alpha <= 0) & (d_gap < -1e-14)) | ((alpha >= base.c) & (d_gap > 1e-14)))
            to_margin = np.where(outside, np.maximum(-gap / d_gap, 0), np.inf)
        for distance in (to_bound, to_margin):
            k = int(distance.argmin())
            if distance[k] < step:
                step, turn = max(distance[k], 0.0), k
        alpha, gap, bias, new, own_gap = alpha + step * d_alpha, gap + step * d_gap, bias + step * d_bias, new + step, own_gap + step * d_own
        if turn >= 0:
            if free[turn]:
                alpha[turn] = 0.0 if d_alpha[turn] < 0 else base.c
            gap[turn] = 0.0
            free[turn] = not free[turn]
    raise Dependent


@dataclass
class RatioMargin:
    """Rank -min(m1 / m0, m0 / m1) of the squared norms of the two models' normals; a norm that isn't positive makes the ratio infinite.
    Meant for a sample of the pool."""

    x: np.ndarray
    y: np.ndarray
    kernel: Kernel
    c: float = 1.0

    def __post_init__(self) -> None:
        self.base, self.model = solution(self.x, self.y, self.kernel, self.c)
        self.refits = 0

    def score_block(self, rows: np.ndarray):
        pred, proba, _ = self.model.score_block(rows)
        near, own = self.kernel(rows, self.x), self.kernel.diagonal(rows)
        rank = np.empty(len(rows))
        for k, (row, r) in enumerate(zip(near, rows)):
            m = [self._norm(row, float(own[k]), r, v) for v in (0.0, 1.0)]
            rank[k] = -np.inf if min(m) <= 0 else -min(m[0] / m[1], m[1] / m[0])
        return pred, proba, rank

    def _norm(self, row: np.ndarray, own: float, r: np.ndarray, label: float) -> float:
        try:
            beta = added(self.base, row, own, 1.0 if label == 1 else -1.0)
        except Dependent:
            self.refits += 1
            return fit_svm(np.vstack([self.x, r]), np.append(self.y, label), self.kernel, self.c, tol=1e-9).margin()
        whole = np.block([[self.base.k, row[:, None]], [row[None, :], np.array([[own]])]])
        return float(beta @ whole @ beta)
