"""Factorized linear models P(x) = product over subspaces of sigmoid(w_k . x + b_k): losses, fits, pruning,
factorizations, partition search.

A full-batch gradient is one pass: each task adds up its rows' part, K * (d + 1) numbers, and only these
meet (in a Spark sum). Below DRIVER_ROWS rows the same steps run on collected rows, since a job a step costs
more than the step."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import blend_partial, blocks_of, factorized as factorized_columns, log1m_exp, log_sigmoid, margins, sigmoid, total
from .blocks import Kernel, matrix, nystroem, per_subspace

DRIVER_ROWS = 50_000


def loss(rows: DataFrame, biases, weights, penalty: float = 0.0) -> DataFrame:
    """One row: mean of -ln P (y > 0) or -ln(1 - P), plus the penalty."""
    lp = total([log_sigmoid(m) for m in margins("x", biases, weights)])
    return rows.agg((F.avg(F.when(F.col("y") > 0, -lp).otherwise(-log1m_exp(lp))) + penalty).alias("loss"))


def block_gradient(x: np.ndarray, y: np.ndarray, bias: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed loss, and summed gradient (K, 1 + d) with the bias first."""
    m = x @ w.T + bias
    log_s = np.minimum(m, 0) - np.log1p(np.exp(-np.abs(m)))
    lp = np.minimum(log_s.sum(axis=1), -1e-12)
    part = np.exp(log_s)
    positive = y > 0
    total_loss = -lp[positive].sum() - np.log(-np.expm1(lp[~positive])).sum()
    row = np.where(positive, -1.0, np.exp(lp) / -np.expm1(lp))
    g = row[:, None] * (1 - part)
    return float(total_loss), np.column_stack([g.sum(axis=0), g.T @ x])


def gradient(rows: DataFrame, bias: np.ndarray, w: np.ndarray, features: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """One row: n, loss and gradient (flat, K * (1 + d)), all means, of rows (x, y); rows without a vector don't count. features: made of
    each block on the way, so a kernel's features are never stored."""
    size = w.shape[0] * (1 + w.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, g = 0, 0.0, np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                there, x = matrix(batch.column(0))
                if len(x):
                    x = x if features is None else features(x)
                    a, b = block_gradient(x, batch.column(1).to_numpy(zero_copy_only=False).astype(float)[there], bias, w)
                    n, sums, g = n + len(x), sums + a, g + b.ravel()
        yield pa.RecordBatch.from_arrays([pa.array([n] * size, pa.int64()), pa.array([sums] * size), pa.array(np.arange(size), pa.int32()), pa.array(g)], ["n", "loss", "k", "g"])

    parts = rows.select("x", F.col("y").cast("double")).mapInArrow(run, "n long, loss double, k int, g double")
    n = F.sum("n")
    by_place = parts.groupBy("k").agg(n.alias("n"), (F.sum("loss") / n).alias("loss"), (F.sum("g") / n).alias("g"))
    return by_place.agg(F.max("n").alias("n"), F.max("loss").alias("loss"), F.transform(F.array_sort(F.collect_list(F.struct("k", "g"))), lambda r: r["g"]).alias("gradient"))


# Penalties: value and proximal map (for FISTA), or value and gradient (for Adam) -----------------------


def prox_l1(w: np.ndarray, t: float) -> np.ndarray:
    return np.sign(w) * np.maximum(np.abs(w) - t, 0)


def prox_group_l2(w: np.ndarray, t: float) -> np.ndarray:
    """Whole subspaces shrink."""
    norm = np.linalg.norm(w, axis=1, keepdims=True)
    return w * np.maximum(1 - t / np.maximum(norm, 1e-300), 0)


PENALTIES: dict[str, tuple[Callable[[np.ndarray], float], Callable[[np.ndarray, float], np.ndarray]]] = {
    "l1": (lambda w: float(np.abs(w).sum()), prox_l1),
    "group": (lambda w: float(np.linalg.norm(w, axis=1).sum()), prox_group_l2),
    "sparse-group": (lambda w: float(0.5 * np.abs(w).sum() + 0.5 * np.linalg.norm(w, axis=1).sum()), lambda w, t: prox_group_l2(prox_l1(w, t / 2), t / 2)),
    "l2": (lambda w: float((w**2).sum() / 2), lambda w, t: w / (1 + t)),
}
SMOOTH: dict[str, tuple[Callable[[np.ndarray], float], Callable[[np.ndarray], np.ndarray]]] = {
    "huber": (lambda w: float(np.where(np.abs(w) < 1e-3, w**2 / 2e-3, np.abs(w) - 5e-4).sum()), lambda w: np.clip(w / 1e-3, -1, 1)),
    "interaction": (lambda w: float((((w**2).sum(axis=0)) ** 2 - (w**4).sum(axis=0)).sum() / 2), lambda w: 2 * w * ((w**2).sum(axis=0) - w**2)),
}


@dataclass
class SparseGroup:
    """l1 times the sum of absolute weights plus group times the sum of the subspaces' norms. groups: attributes that stand for one (one-hot
    ones); then l1 weighs the norms of these groups instead."""

    l1: float
    group: float
    groups: list[list[int]] | None = None

    def value(self, w: np.ndarray) -> float:
        single = np.abs(w).sum() if self.groups is None else sum(np.linalg.norm(w[:, g], axis=1).sum() for g in self.groups)
        return float(self.l1 * single + self.group * np.linalg.norm(w, axis=1).sum())

    def prox(self, w: np.ndarray, t: float) -> np.ndarray:
        if self.groups is None:
            return prox_group_l2(prox_l1(w, self.l1 * t), self.group * t)
        out = w.copy()
        for g in self.groups:
            out[:, g] = prox_group_l2(w[:, g], self.l1 * t)
        return prox_group_l2(out, self.group * t)


def fit(rows: DataFrame, k: int, penalty: str | SparseGroup | None = None, strength: float = 0.0, mask: np.ndarray | None = None, start: tuple[np.ndarray, np.ndarray] | None = None, restarts: int = 1, steps: int = 200, rate: float = 0.1, seed: int = 0, driver_rows: int = DRIVER_ROWS, features: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(bias, weights, loss) of the best restart. rows: (x, y). mask (K, d): attributes that a subspace may
    use. Proximal penalties take FISTA, smooth ones (huber, interaction) and none take Adam. features: of the rows, made in
    each pass. Rows without a vector don't count."""
    rows = rows.select("x", F.col("y").cast("double").alias("y")).filter("x is not null")
    small = rows.limit(driver_rows + 1).count() <= driver_rows
    if small:
        sample = rows.collect()
        x, y = np.array([r.x for r in sample], float), np.array([r.y for r in sample])
        x = x if features is None else features(x)
        dim = x.shape[1]
    else:  # every step reads the rows, so they are scored and read once
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        first = np.array([rows.first().x], float)
        dim = (first if features is None else features(first)).shape[1]

    def step(bias: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        if small:
            value, g = block_gradient(x, y, bias, w)
            return value / len(y), g / len(y)
        r = gradient(rows, bias, w, features).first()
        return r.loss, np.array(r.gradient).reshape(k, 1 + dim)

    best = None
    try:
        for trial in range(restarts):
            rng = np.random.default_rng(seed + trial)
            bias, w = (a.copy() for a in start) if start is not None and trial == 0 else (rng.normal(0, 0.1, k), rng.normal(0, 0.5, (k, dim)))
            if mask is not None:
                w = w * mask
            bias, w, value = (_fista if isinstance(penalty, SparseGroup) or penalty in PENALTIES else _adam)(step, bias, w, penalty, strength, mask, steps, rate)
            if best is None or value < best[2]:
                best = bias, w, value
    finally:
        if not small:
            rows.unpersist()
    return best


def _value(w: np.ndarray, penalty: str | SparseGroup | None, strength: float) -> float:
    if isinstance(penalty, SparseGroup):
        return penalty.value(w)
    return strength * ({**PENALTIES, **SMOOTH}[penalty][0](w)) if penalty else 0.0


def _adam(step, bias, w, penalty, strength, mask, steps, rate):
    a = np.column_stack([bias, w])
    m, v, best = np.zeros_like(a), np.zeros_like(a), (np.inf, a)
    for t in range(1, steps + 1):
        value, g = step(a[:, 0], a[:, 1:])
        value += _value(a[:, 1:], penalty, strength)
        if value < best[0]:
            best = value, a.copy()
        if penalty:
            g[:, 1:] += strength * SMOOTH[penalty][1](a[:, 1:])
        if mask is not None:
            g[:, 1:] *= mask
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        a = a - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return best[1][:, 0], best[1][:, 1:], float(best[0])


def _fista(step, bias, w, penalty, strength, mask, steps, rate):
    a = np.column_stack([bias, w])
    z, t, size, best = a.copy(), 1.0, 10 * rate, (np.inf, a)
    prox = penalty.prox if isinstance(penalty, SparseGroup) else lambda v, t: PENALTIES[penalty][1](v, t * strength)
    for _ in range(steps):
        value, g = step(z[:, 0], z[:, 1:])
        while True:  # halve the step until the quadratic bound holds
            new = z - size * g
            new[:, 1:] = prox(new[:, 1:] if mask is None else new[:, 1:] * mask, size)
            after = step(new[:, 0], new[:, 1:])[0]
            d = new - z
            if after <= value + (g * d).sum() + (d * d).sum() / (2 * size) + 1e-12 or size < 1e-8:
                break
            size /= 2
        whole = after + _value(new[:, 1:], penalty, strength)
        if whole < best[0]:
            best = whole, new.copy()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, a, t = new + (t - 1) / t_next * (new - a), new, t_next
    return best[1][:, 0], best[1][:, 1:], float(best[0])


# Kernel features -----------------------------------------------------------------------------------------


@dataclass
class KernelFactorized:
    """P(x) = product over subspaces of sigmoid(w_k . features(x) + b_k), for blocks.score."""

    features: Callable[[np.ndarray], np.ndarray]
    bias: np.ndarray
    w: np.ndarray

    def partial_proba(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(x) @ self.w.T + self.bias, -500, 500)))

    def score_block(self, x: np.ndarray):
        m = self.features(x) @ self.w.T + self.bias
        log_p = (np.minimum(m, 0) - np.log1p(np.exp(-np.abs(m)))).sum(axis=1)
        p = np.exp(log_p)
        return (log_p > np.log(0.5)).astype(float), p, np.abs(p - 0.5)


def kernel_features(landmarks: np.ndarray, kernel: Kernel, parts: list[list[int]] | None = None) -> tuple[Callable[[np.ndarray], np.ndarray], np.ndarray | None]:
    """(features of rows against landmarks, mask): of all attributes together; with parts, of each subspace's attributes, side by side, and
    which of them belong to which subspace."""
    if parts is None:
        return nystroem(landmarks, kernel), None
    mask = np.kron(np.eye(len(parts)), np.ones((1, len(landmarks))))
    return per_subspace(parts, [nystroem(landmarks[:, p], kernel) for p in parts]), mask


def fit_kernel(rows: DataFrame, landmarks: np.ndarray, kernel: Kernel, subspaces: int | list[list[int]], **how) -> KernelFactorized:
    """A factorized model of kernel features, of a number of subspaces that all see all attributes, or of given subspaces. With the labelled rows
    as landmarks these are the kernel's own features; with a sample of the pool they are Nystroem's. how: as in fit()."""
    parts = None if isinstance(subspaces, int) else subspaces
    features, mask = kernel_features(landmarks, kernel, parts)
    bias, w, _ = fit(rows, subspaces if parts is None else len(parts), mask=mask, features=features, **how)
    return KernelFactorized(features, bias, w)


# Pruning and factorizations ----------------------------------------------------------------------------


def subspace_minima(pool: DataFrame, biases, weights) -> DataFrame:
    """(k, min_proba, norm): the least sigmoid(m_k) over the whole pool, all subspaces in one pass."""
    ms = margins("x", biases, weights)
    one = pool.agg(*(F.min(sigmoid(m)).alias(f"p{k}") for k, m in enumerate(ms)))
    norms = [float(np.linalg.norm(w)) for w in weights]
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("min_proba"), F.lit(norms[k]).alias("norm")) for k in range(len(ms))))).alias("r")).select("r.*")


def prune(pool: DataFrame, biases, weights, threshold: float, tol: float) -> DataFrame:
    """Subspaces that say no to some row, with weights that aren't zero."""
    return subspace_minima(pool, biases, weights).filter((F.col("min_proba") < threshold) & (F.col("norm") > tol))


def factorization(subspaces: DataFrame) -> DataFrame:
    """Distinct attribute sets (attributes array<int>) that no other contains, in order."""
    sets = subspaces.select(F.array_sort("attributes").alias("attributes")).distinct()
    larger = sets.select(F.col("attributes").alias("other"))
    contained = (F.size(F.array_except("attributes", "other")) == 0) & (F.size("attributes") < F.size("other"))
    return sets.join(larger, contained, "left_anti").orderBy("attributes")  # a model's few subspaces


def compatible(learned: DataFrame, user: DataFrame) -> DataFrame:
    """(k, user_k) if each learned subspace lies in exactly one of the user's, one to one, and both are as
    many; else no rows. learned: (k, attributes), user: (user_k, user_attributes)."""
    inside = learned.join(user, F.size(F.array_except("attributes", "user_attributes")) == 0)
    a = inside.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    b = inside.groupBy("user_k").agg(F.count(F.lit(1)).alias("m"))
    sizes = learned.agg(F.count(F.lit(1)).alias("c1")).crossJoin(user.agg(F.count(F.lit(1)).alias("c2")))  # one row
    one = inside.join(a, "k").join(b, "user_k").filter("n = 1 and m = 1").select("k", "user_k")
    matched = one.agg(F.count(F.lit(1)).alias("c3"))
    return one.crossJoin(sizes).crossJoin(matched).filter("c1 = c2 and c1 = c3").select("k", "user_k").orderBy("user_k")


@dataclass
class Learned:
    """sets: the factorization; subspaces: attributes that each subspace of the model uses."""

    sets: list[list[int]]
    subspaces: list[list[int]]
    bias: np.ndarray
    w: np.ndarray

    def partial_labels(self, x: Column | str) -> Column:
        """One label for each attribute set of the factorization."""
        return blend_partial(factorized_columns(x, self.bias, self.w)["partial_proba"], blocks_of(self.subspaces, self.sets))


def learn_factorization(pool: DataFrame, rows: DataFrame, k: int | None = None, l1: float = 1e-4, group: float = 1e-4, start: tuple[np.ndarray, np.ndarray] | None = None, threshold: float = 0.99, tol: float = 1e-8, steps: int = 2500, groups: list[list[int]] | None = None, seed: int = 0) -> Learned:
    """From the present model (start: bias, weights), or from k subspaces at random: refined with a sparse-group penalty; subspaces pruned that say
    yes to the whole pool; attributes pruned that hold no more than an even share of their subspace's weight; refitted with what is left, from
    where it stands. rows: (x, y), labelled. groups: one-hot attributes that go together."""
    if start is None and k is None:
        raise ValueError("a model to start from, or a number of subspaces")
    bias, w, _ = fit(rows, len(start[0]) if start is not None else k, SparseGroup(l1, group, groups), start=start, steps=steps, rate=0.5, seed=seed)
    kept = [r.k for r in prune(pool, bias.tolist(), w.tolist(), threshold, tol).orderBy("k").collect()]
    bias, w = bias[kept], w[kept]
    if not kept:
        return Learned([], [], bias, w)
    share = np.abs(w) / np.maximum(np.abs(w).sum(axis=1, keepdims=True), 1e-300)
    for g in groups or []:
        share[:, g] = share[:, g].sum(axis=1, keepdims=True)
    mask = (share > 1 / (w.shape[1] if groups is None else len(groups))).astype(float)
    bias, w, _ = fit(rows, len(kept), None, mask=mask, start=(bias, w * mask), steps=min(steps, 500), rate=0.1, seed=seed)
    subspaces = [np.flatnonzero(m).tolist() for m in mask]
    distinct = sorted({tuple(s) for s in subspaces})
    return Learned([list(s) for s in distinct if not any(set(s) < set(o) for o in distinct)], subspaces, bias, w)


# Partition search ----------------------------------------------------------------------------------------


def set_partitions(dim: int, blocks: int | None = None, max_dim: int | None = None) -> Iterator[list[list[int]]]:
    """Every partition of 0..dim-1, with that many blocks, none larger than max_dim."""

    def grow(k: int, parts: list[list[int]]) -> Iterator[list[list[int]]]:
        if k == dim:
            if blocks is None or len(parts) == blocks:
                yield [list(p) for p in parts]
            return
        for p in parts:
            if max_dim is None or len(p) < max_dim:
                p.append(k)
                yield from grow(k + 1, parts)
                p.pop()
        if blocks is None or len(parts) < blocks:
            parts.append([k])
            yield from grow(k + 1, parts)
            parts.pop()

    yield from grow(0, [])


def mask_of(partition: list[list[int]], dim: int) -> np.ndarray:
    mask = np.zeros((len(partition), dim))
    for k, p in enumerate(partition):
        mask[k, p] = 1.0
    return mask


def fit_partition(x: np.ndarray, y: np.ndarray, partition: list[list[int]], steps: int, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Block weights of one candidate."""
    mask = mask_of(partition, x.shape[1])
    bias, w = start if start is not None else (np.zeros(len(partition)), mask * 0.1)

    def step(b: np.ndarray, v: np.ndarray) -> tuple[float, np.ndarray]:
        value, g = block_gradient(x, y, b, v)
        return value / len(y), g / len(y)

    return _adam(step, bias, w * mask, None, 0.0, mask, steps, 0.1)


def merge_blocks(bias: np.ndarray, w: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Two blocks as one: biases add up, weights stand side by side."""
    keep = [k for k in range(len(bias)) if k not in (i, j)]
    return np.append(bias[keep], bias[i] + bias[j]), np.vstack([w[keep], w[i] + w[j]])


def losses_of(spark: SparkSession, x: np.ndarray, y: np.ndarray, candidates: list[list[list[int]]], steps: int = 150, starts: list | None = None) -> DataFrame:
    """(partition array<array<int>>, loss, bias, w): every candidate fitted, one row of work each, in many
    small tasks as the solves are uneven. x, y: the labelled rows."""
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(candidates)], "k int, partition array<array<int>>").repartition(max(1, min(len(candidates), 4 * spark.sparkContext.defaultParallelism)), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(1).to_pylist()
            got = [fit_partition(x, y, p, steps, starts[k] if starts else None) for k, p in zip(batch.column(0).to_pylist(), parts)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.list_(pa.list_(pa.int32()))), pa.array([g[2] for g in got]), pa.array([g[0].tolist() for g in got], pa.list_(pa.float64())), pa.array([g[1].tolist() for g in got], pa.list_(pa.list_(pa.float64())))], ["partition", "loss", "bias", "w"])

    return rows.mapInArrow(run, "partition array<array<int>>, loss double, bias array<double>, w array<array<double>>")


def brute_force(spark: SparkSession, x: np.ndarray, y: np.ndarray, blocks: int | None = None, max_dim: int | None = None, most: int = 5000, steps: int = 150) -> DataFrame:
    """The partition of least loss (one row). More than most candidates: error, use greedy()."""
    candidates = []
    for c in set_partitions(x.shape[1], blocks, max_dim):
        candidates.append(c)
        if len(candidates) > most:
            raise ValueError(f"more than {most} partitions; use greedy()")
    return losses_of(spark, x, y, candidates, steps).orderBy(F.round("loss", 6), "partition").limit(1)


def greedy(spark: SparkSession, x: np.ndarray, y: np.ndarray, steps: int = 150, warm: bool = True, blocks: int | None = None, max_dim: int | None = None) -> list[tuple[list[list[int]], float]]:
    """From single attributes on the best merge of two blocks, until none gains: (partition, loss) by level. No block grows
    over max_dim; while there are more than blocks blocks, the best merge is taken even if it doesn't gain."""
    now = [[k] for k in range(x.shape[1])]
    bias, w, value = fit_partition(x, y, now, steps)
    path = [(now, value)]
    while len(now) > 1:
        pairs = [(i, j) for i, j in combinations(range(len(now)), 2) if max_dim is None or len(now[i]) + len(now[j]) <= max_dim]
        if not pairs:
            break
        tries = [[p for k, p in enumerate(now) if k not in (i, j)] + [sorted(now[i] + now[j])] for i, j in pairs]
        starts = [merge_blocks(bias, w, i, j) for i, j in pairs] if warm else None
        best = losses_of(spark, x, y, tries, steps, starts).orderBy("loss").first()
        if best.loss >= path[-1][1] - 1e-9 and (blocks is None or len(now) <= blocks):
            break
        now, bias, w = [list(p) for p in best.partition], np.array(best.bias), np.array(best.w)
        path.append((now, best.loss))
    return path
