"""Column expressions: subspaces, connectors, losses, kernels, stable logarithms, linear models.

All stay on the JVM. Sums over a fixed number of terms are written out, so that they compile with the
rest of the stage; more than TERMS terms in one model raise, for operators.blocks does that work in numpy blocks instead."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 200


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(terms: list[Column]) -> Column:
    """Their sum, as a balanced tree."""
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0] if terms else F.lit(0.0)


def within_terms(n: int) -> None:
    """An expression of very many terms doesn't compile with its stage, and plans slowly."""
    if n > TERMS:
        raise ValueError(f"{n} terms are too many for an expression ({TERMS}); score with operators.blocks")


def project(x: Column | str, indexes: list[int]) -> Column:
    """The attributes of one subspace."""
    return F.array(*(F.get(_c(x), F.lit(i)) for i in indexes))


def split_text(x: Column | str, partial: Column | str, text_start: int) -> tuple[Column, Column, Column, Column]:
    """(structured attributes, text attributes, structured partial labels, text label, which is the last)."""
    x, partial = _c(x), _c(partial)
    return F.slice(x, 1, text_start), F.slice(x, text_start + 1, F.greatest(F.size(x) - text_start, F.lit(0))), F.slice(partial, 1, F.size(partial) - 1), F.element_at(partial, -1)


def interactions(x: Column | str, dim: int, self_interacting: bool = False) -> Column:
    """[x, x squared if self_interacting, x_i * x_j for i < j]."""
    at = [F.get(_c(x), F.lit(i)) for i in range(dim)]
    return F.array(*at, *([a * a for a in at] if self_interacting else []), *(a * b for a, b in combinations(at, 2)))


def interaction_pairs(weights: np.ndarray, tol: float, self_interacting: bool = False) -> list[tuple[int, int]]:
    """Which pairs (i, j) have a weight above tol, for weights of interactions(); the number of attributes
    follows from the length."""
    n = len(weights)
    dim = next((d for d in range(1, n + 1) if d + d * self_interacting + d * (d - 1) // 2 == n), None)
    if dim is None:
        raise ValueError(f"no number of attributes gives {n} weights")
    pairs = [(i, i) for i in range(dim)] * self_interacting + list(combinations(range(dim), 2))
    return [p for p, w in zip(pairs, weights[dim:]) if abs(w) > tol]


def pairs_over(weights: Column | str, dim: int, tol: float, self_interacting: bool = False) -> Column:
    """The same for a column of weights: array of struct(i, j) whose weight is over tol."""
    pairs = [(i, i) for i in range(dim)] * self_interacting + list(combinations(range(dim), 2))
    named = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.abs(F.get(_c(weights), F.lit(dim + k))).alias("w")) for k, (i, j) in enumerate(pairs)))
    return F.transform(F.filter(named, lambda p: p["w"] > tol), lambda p: F.struct(p["i"].alias("i"), p["j"].alias("j")))


def category(block: Column | str) -> Column:
    """A one-hot block's category number; the first of equal maxima."""
    return (F.array_position(_c(block), F.array_max(_c(block))) - 1).cast("long")


def all_of(values: Column | str) -> Column:
    return F.array_min(_c(values))


def any_of(values: Column | str) -> Column:
    return F.array_max(_c(values))


def product(values: Column | str) -> Column:
    return F.aggregate(_c(values), F.lit(1.0), lambda a, v: a * v)


def summed(values: Column | str) -> Column:
    return F.aggregate(_c(values), F.lit(0.0), lambda a, v: a + v)


LABEL_CONNECTORS = {"AND": all_of, "OR": any_of}
PROBA_CONNECTORS = {"MIN": all_of, "MAX": any_of, "PROD": product}
RANK_CONNECTORS = {"SUM": summed, "SQUARE": lambda v: summed(F.transform(_c(v), lambda a: a * a))}
LOSSES = {
    "GREEDY": lambda p: product(F.transform(_c(p), lambda a: 1 - 2 * a * (1 - a))),
    "SQUARE": lambda p: summed(F.transform(_c(p), lambda a: (a - 0.5) * (a - 0.5))),
    "PRODUCT": lambda p: F.abs(product(p) - 0.5),
}


def connect(values: Column | str, how, table: dict) -> Column:
    """A named connector, or a function of the array column."""
    if callable(how):
        return how(_c(values))
    if how.upper() not in table:
        raise ValueError(f"no connector {how}; there are {', '.join(table)}")
    return table[how.upper()](values)


def label_of(probas: Column | str, how: str | None, labels: Column | str | None = None) -> Column:
    """Connected labels, or without a connector whether the connected probability is over a half."""
    return (product(probas) > 0.5).cast("double") if how is None else connect(labels, how, LABEL_CONNECTORS)


def dot(x: Column | str, w: list[float]) -> Column:
    within_terms(len(w))
    return total([F.get(_c(x), F.lit(i)) * F.lit(float(v)) for i, v in enumerate(w)])


def dot_columns(x: Column | str, z: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(x), _c(z), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def linear_kernel(x, z) -> Column:
    return dot_columns(x, z)


def rbf_kernel(x, z, gamma: float | None = None, dim: int | None = None) -> Column:
    g = gamma if gamma is not None else 1.0 / dim
    return F.exp(-g * F.aggregate(F.zip_with(_c(x), _c(z), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def poly_kernel(x, z, degree: int = 3, gamma: float | None = None, coef0: float = 0.0, dim: int | None = None) -> Column:
    g = gamma if gamma is not None else 1.0 / dim
    return F.pow(g * dot_columns(x, z) + coef0, degree)


def jittered(kernel: Column, id_one: Column, id_two: Column, jitter: float) -> Column:
    """The kernel matrix with jitter on its diagonal."""
    return F.when(id_one == id_two, kernel + jitter).otherwise(kernel)


def sigmoid(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log1m_exp(x: Column) -> Column:
    """ln(1 - e^x) for x < 0; null from 0 on."""
    small = x < -0.6931471805599453
    return F.when(small, F.log1p(-F.exp(F.when(small, x).otherwise(F.lit(-1.0))))).when(x < 0, F.log(-F.expm1(F.when(x < 0, x).otherwise(F.lit(-1.0)))))


def votes(x: Column | str, biases: list[float], weights: list[list[float]]) -> Column:
    """Share of hypotheses with b + w . x > 0, summed from the bias on."""
    within_terms(sum(map(len, weights)))
    value = lambda b, w: reduce(lambda s, i: s + F.get(_c(x), F.lit(i)) * F.lit(float(w[i])), range(len(w)), F.lit(float(b)))
    return total([F.when(value(b, w) > 0, 1.0).otherwise(0.0) for b, w in zip(biases, weights)]) / len(biases)


def margins(x: Column | str, biases, weights) -> list[Column]:
    within_terms(sum(map(len, weights)))
    return [dot(x, list(w)) + F.lit(float(b)) for b, w in zip(biases, weights)]


def factorized(x: Column | str, biases, weights) -> dict[str, Column]:
    """P = product of sigmoid(w_k . x + b_k): proba, pred (ln P > ln 1/2), rank, partial probabilities and
    labels."""
    m = margins(x, biases, weights)
    log_p = total([log_sigmoid(v) for v in m])
    p = F.exp(log_p)
    return {"proba": p, "pred": (log_p > float(np.log(0.5))).cast("double"), "rank": F.abs(p - 0.5), "partial_proba": F.array(*(sigmoid(v) for v in m)), "partial": F.array(*((v > 0).cast("double") for v in m))}


def uncertainty(proba: Column | str) -> Column:
    return F.abs(_c(proba) - 0.5)


def relevance(w: Column | str, groups: list[list[int]] | None = None) -> Column:
    """Which attributes (or groups of one-hot attributes) hold more than an even share of abs(w)."""
    a = F.transform(_c(w), lambda v: F.abs(v))
    if groups:
        a = F.array(*(total([F.get(a, F.lit(i)) for i in g]) for g in groups))
    sums = summed(a)
    return F.transform(a, lambda v: F.when(sums > 0, v / F.when(sums > 0, sums)).otherwise(0.0) > 1.0 / F.size(a))


def blocks_of(subspaces: list[list[int]], factorization: list[list[int]]) -> list[list[int]]:
    """For each attribute set of a factorization the numbers of the subspaces that lie in it."""
    return [[k for k, s in enumerate(subspaces) if set(s) <= set(f)] for f in factorization]


def blend_partial(probas: Column | str, blocks: list[list[int]]) -> Column:
    """Partial labels of blocks of subspaces: whether the product of its subspaces' probabilities, each raised to one over the number of
    blocks that it is in, is over a half. A block of nothing says yes."""
    p = _c(probas)
    logs = {k: F.log(F.greatest(F.get(p, F.lit(k)), F.lit(1e-300))) / sum(k in b for b in blocks) for b in blocks for k in b}
    return F.array(*((F.exp(total([logs[k] for k in b])) > 0.5).cast("double") for b in blocks))
