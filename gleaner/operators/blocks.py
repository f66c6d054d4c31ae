"""Scorers that need dense blocks: kernels, support vectors, version spaces, Laplace posteriors, projections.

One shape for all: a model is fitted on the few labelled rows, goes into the closure (its size follows the
labelled rows, not the pool), and score() maps Arrow batches of (id, x) to (id, pred, proba, rank), so scoring
never shuffles and a block is one batch times the model's rows. A custom learner is any object with
score_block(X) -> (pred, proba, rank)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import itemsets

#: Rows of a block at a time; with 2000 reference rows a block holds 4096 * 2000 doubles, 64 MB.
ROWS = 4096


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a vector, their vectors). A vector that is null or holds a null is none; vectors of different lengths raise."""
    lists = column.cast(pa.list_(pa.float64()))
    there = ~lists.is_null().to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    sizes = np.diff(offsets)[there]
    if not len(sizes):
        return there, np.zeros((0, 0))
    if (sizes != sizes[0]).any():
        raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} numbers")
    rows = offsets[:-1][there, None] + np.arange(sizes[0])
    holes = lists.values.is_null().to_numpy(zero_copy_only=False)[rows].any(axis=1) if lists.values.null_count else np.zeros(len(rows), bool)
    there[np.flatnonzero(there)[holes]] = False
    return there, lists.values.to_numpy(zero_copy_only=False)[rows[~holes]]


def spread(values, there: np.ndarray) -> pa.Array:
    """One number for each row, null where there is none."""
    out = np.full(len(there), np.nan)
    out[there] = np.asarray(values, float)
    return pa.array(out, mask=~there)


def score(pool: DataFrame, learner, id_type: str | None = None) -> DataFrame:
    """(id, pred, proba, rank) for every row of the pool (id, x); nulls for a row without a vector."""
    kind = id_type or dict(pool.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                there, x = matrix(part.column(1))
                scores = learner.score_block(x) if len(x) else ([], [], [])
                yield pa.RecordBatch.from_arrays([part.column(0), *(spread(v, there) for v in scores)], ["id", "pred", "proba", "rank"])

    return pool.select("id", "x").mapInArrow(run, f"id {kind}, pred double, proba double, rank double")


def transform(pool: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, x) with x replaced by work(block); a row without a vector stays without one."""
    kind = dict(pool.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                there, x = matrix(part.column(1))
                y = np.asarray(work(x), float) if len(x) else np.zeros((0, 0))
                offsets = np.concatenate([[0], np.cumsum(there * y.shape[1])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(y.ravel()), mask=pa.array(~there))], ["id", "x"])

    return pool.select("id", "x").mapInArrow(run, f"id {kind}, x array<double>")


def collected(rows: DataFrame, most: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """X and y of labelled rows (id, x, y), in order of id; more than most raise, and so does a row without a vector."""
    got = rows.select("id", "x", "y").orderBy("id").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} labelled rows")
    if any(r.x is None or None in r.x for r in got):
        raise ValueError("a labelled row without a vector")
    return np.array([r.x for r in got], float), np.array([r.y for r in got], float)


# Kernels ---------------------------------------------------------------------------------------------


@dataclass
class Kernel:
    """rbf exp(-gamma |x - z|^2), poly (gamma x.z + coef0)^degree, linear x.z; gamma defaults to 1 / dim."""

    name: str = "rbf"
    gamma: float | None = None
    degree: int = 3
    coef0: float = 0.0
    jitter: float = 0.0

    def __call__(self, x: np.ndarray, z: np.ndarray | None = None) -> np.ndarray:
        same, z = z is None, x if z is None else z
        g = self.gamma if self.gamma is not None else 1.0 / x.shape[1]
        k = x @ z.T
        if self.name == "rbf":
            k = np.exp(-g * np.maximum((x**2).sum(1)[:, None] + (z**2).sum(1) - 2 * k, 0))
        elif self.name == "poly":
            k = (g * k + self.coef0) ** self.degree
        elif self.name != "linear":
            raise ValueError(f"no kernel {self.name}")
        return k + self.jitter * np.eye(len(x)) if same else k

    def diagonal(self, x: np.ndarray) -> np.ndarray:
        g = self.gamma if self.gamma is not None else 1.0 / x.shape[1]
        square = (x**2).sum(1)
        k = np.ones(len(x)) if self.name == "rbf" else square if self.name == "linear" else (g * square + self.coef0) ** self.degree
        return k + self.jitter


def kernel_table(pool: DataFrame, refs: np.ndarray, kernel: Kernel) -> DataFrame:
    """(id, ref, k): the kernel of every row that has a vector with each reference row."""
    kind = dict(pool.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                there, x = matrix(part.column(1))
                k = kernel(x, refs) if len(x) else np.zeros((0, len(refs)))
                rows = pa.array(np.repeat(np.flatnonzero(there), len(refs)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array(np.tile(np.arange(len(refs)), len(k)), pa.int32()), pa.array(k.ravel())], ["id", "ref", "k"])

    return pool.select("id", "x").mapInArrow(run, f"id {kind}, ref int, k double")


def nystroem(landmarks: np.ndarray, kernel: Kernel) -> Callable[[np.ndarray], np.ndarray]:
    """Features K(x, Z) K_zz^(-1/2), to be used with transform()."""
    values, vectors = np.linalg.eigh(kernel(landmarks))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T
    return lambda x: kernel(x, landmarks) @ root


def per_subspace(parts: list[list[int]], works: list[Callable[[np.ndarray], np.ndarray]]) -> Callable[[np.ndarray], np.ndarray]:
    """Features of each subspace, side by side."""
    return lambda x: np.concatenate([w(x[:, p]) for p, w in zip(parts, works)], axis=1)


def projection(dim: int, n_labels: int, margin: float, n_rows: int, delta: float, seed: int = 0) -> Callable[[np.ndarray], np.ndarray]:
    """Random signs: x -> a * S x / sqrt(k), beside a random sign of size sqrt(1 - a^2) a row and dimension.
    eps = margin / (2 (1 + sqrt(H))), k = ceil(4 ln(4 N / delta) / (eps^2 (1 - eps))), a = 1 / sqrt(1 + sqrt(H))."""
    eps = margin / (2 * (1 + np.sqrt(n_labels)))
    k = int(np.ceil(4 * np.log(4 * n_rows / delta) / (eps**2 * (1 - eps))))
    a = 1 / np.sqrt(1 + np.sqrt(n_labels))
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (dim, k)) / np.sqrt(k)
    columns = np.arange(1, k + 1, dtype=np.uint64)

    def mixed(key: np.ndarray) -> np.ndarray:
        """Every bit of a key in every bit of the result (round numbers differ in few of them)."""
        key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return key ^ (key >> np.uint64(31))

    def work(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.ascontiguousarray(x + 0.0).view(np.uint64).reshape(len(x), -1)  # -0.0 and 0.0 are the same number
            key = mixed(mixed(h + np.arange(1, h.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1))
            bits = (key[:, None] ^ (columns * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        sign = np.where(bits >> np.uint64(63), 1.0, -1.0)  # depends on the row's numbers and the dimension only: equal rows share it
        return a * (x @ signs) + np.sqrt(1 - a * a) * sign / np.sqrt(k)

    return work


# Support vectors -------------------------------------------------------------------------------------


def fit_svm(x: np.ndarray, y: np.ndarray, kernel: Kernel, c: float = 1.0, weights: np.ndarray | None = None, tol: float = 1e-5, rounds: int = 200_000) -> "KernelSVM":
    """Dual solution by sequential minimal steps on the most violating pair; box C * weight a row."""
    if len(np.unique(y)) < 2:
        raise ValueError("both classes are needed")
    s = np.where(y == 1, 1.0, -1.0)
    box = c * (np.ones(len(y)) if weights is None else np.asarray(weights, float))
    q = kernel(x)
    alpha, f = np.zeros(len(y)), -s.copy()  # f: decision without bias, less the sign
    for _ in range(rounds):  # the bound is there for input that no step improves, and raises
        up = ((s > 0) & (alpha < box - 1e-12)) | ((s < 0) & (alpha > 1e-12))
        down = ((s > 0) & (alpha > 1e-12)) | ((s < 0) & (alpha < box - 1e-12))
        i, j = np.where(up, f, np.inf).argmin(), np.where(down, f, -np.inf).argmax()
        if f[j] - f[i] < tol:
            break
        room = min(box[i] - alpha[i] if s[i] > 0 else alpha[i], alpha[j] if s[j] > 0 else box[j] - alpha[j])
        step = min(room, (f[j] - f[i]) / max(q[i, i] + q[j, j] - 2 * q[i, j], 1e-12))
        alpha[i] += s[i] * step
        alpha[j] -= s[j] * step
        f += step * (q[i] - q[j])
    else:
        raise RuntimeError(f"no solution within {tol} after {rounds} steps")
    free = (alpha > 1e-9) & (alpha < box - 1e-9)
    bias = -(f[free].mean() if free.any() else (f[i] + f[j]) / 2)
    used = alpha > 1e-12
    return KernelSVM(kernel, x[used], (alpha * s)[used], float(bias))


@dataclass
class KernelSVM:
    """Simple margin: rank is the distance to the boundary."""

    kernel: Kernel
    support: np.ndarray
    dual: np.ndarray
    bias: float

    def decision(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x, self.support) @ self.dual + self.bias

    def margin(self) -> float:
        """Squared norm of the normal."""
        return float(self.dual @ self.kernel(self.support, self.support) @ self.dual)

    def score_block(self, x: np.ndarray):
        f = self.decision(x)
        return (f > 0).astype(float), 1 / (1 + np.exp(-np.clip(f, -500, 500))), np.abs(f)


@dataclass
class Disagreement:
    """Rank 0 where the two biased models differ; labels and probabilities are the unbiased model's."""

    plain: KernelSVM
    positive: KernelSVM
    negative: KernelSVM

    def score_block(self, x: np.ndarray):
        pred, proba, _ = self.plain.score_block(x)
        return pred, proba, ((self.positive.decision(x) > 0) == (self.negative.decision(x) > 0)).astype(float)


def fit_disagreement(labelled: tuple[np.ndarray, np.ndarray], background: np.ndarray, kernel: Kernel, c: float = 1.0, weight: float = 1e-5) -> Disagreement:
    """Three fits: on the labelled rows alone, and with the background sample as all positive and all negative rows of
    little weight. With labels of one class only the biased fits take the other class from the background."""
    x, y = labelled
    every = np.vstack([x, background])
    weights = np.concatenate([np.ones(len(x)), np.full(len(background), weight)])
    biased = [fit_svm(every, np.concatenate([y, np.full(len(background), v)]), kernel, c, weights) for v in (1.0, 0.0)]
    return Disagreement(fit_svm(x, y, kernel, c), *biased)


# Version spaces --------------------------------------------------------------------------------------


def hit_and_run(signed: np.ndarray, start: np.ndarray, n: int, warmup: int, thin: int, rng: np.random.Generator) -> np.ndarray:
    """n points of {w: signed w > 0, |w| <= 1} from one chain."""
    w, out = start, []
    for k in range(warmup + n * thin):
        d = rng.normal(size=len(w))
        d /= np.linalg.norm(d)
        a, b = chord(signed, w, d)
        w = w + (a + (b - a) * rng.random()) * d
        if k >= warmup and (k - warmup + 1) % thin == 0:
            out.append(w)
    return np.array(out)


def chord(signed: np.ndarray, w: np.ndarray, d: np.ndarray) -> tuple[float, float]:
    """The ends (a, b) of {t: signed (w + t d) >= 0, |w + t d| <= 1}; no such t raises. The ball is cut at the
    foot of the perpendicular from the origin, plus or minus half the chord; then each half-space that t d
    enters or leaves takes its part away."""
    length = float(np.linalg.norm(d))
    foot = -float(w @ d) / length**2
    inside = 1.0 - float(((w + foot * d) ** 2).sum())
    if inside < 0:
        raise ValueError("the line misses the unit ball")
    a, b = foot - inside**0.5 / length, foot + inside**0.5 / length
    slack, slope = signed @ w, signed @ d
    for room, speed in zip(slack.tolist(), slope.tolist()):
        if speed > 0:
            a = max(a, -room / speed)
        elif speed < 0:
            b = min(b, room / -speed)
        elif room < 0:
            raise ValueError("the line misses the cone")
    if a > b:
        raise ValueError("the line misses the cone")
    return a, b


def start_point(signed: np.ndarray, rounds: int = 100_000) -> np.ndarray:
    """A point strictly inside the cone, of norm one half (perceptron); none: error."""
    w = signed.mean(axis=0)
    for _ in range(rounds):
        m = signed @ w
        k = m.argmin()
        if m[k] > 0:
            return w / np.linalg.norm(w) / 2
        w = w + signed[k]
    raise ValueError("the labels can't be separated")


@dataclass
class VersionSpace:
    """Vote of hypotheses (bias first) over features: probability is the share with b + w . x > 0, summed from the bias
    on. A product of blocks adds up in an order of its own, so sums that it can't tell from 0 are done again in that order."""

    hypotheses: np.ndarray
    features: Callable[[np.ndarray], np.ndarray] = lambda x: x

    def votes(self, x: np.ndarray) -> np.ndarray:
        z, bias, w = self.features(x), self.hypotheses[:, 0], self.hypotheses[:, 1:]
        value = z @ w.T + bias
        size = np.abs(bias) + np.outer(np.linalg.norm(z, axis=1), np.linalg.norm(w, axis=1))
        rows, which = np.nonzero(np.abs(value) <= 2 * (w.shape[1] + 2) * np.finfo(float).eps * size)
        again = bias[which]
        for i in range(w.shape[1] if len(rows) else 0):
            again = again + z[rows, i] * w[which, i]
        value[rows, which] = again
        return (value > 0).astype(float)

    def score_block(self, x: np.ndarray):
        p = self.votes(x).mean(axis=1)
        return (p > 0.5).astype(float), p, np.abs(p - 0.5)


def kernel_features(train: np.ndarray, kernel: Kernel, decompose: bool = True) -> Callable[[np.ndarray], np.ndarray]:
    """k(x, train), or [L^-1 k(x), sqrt(k(x, x) - |L^-1 k(x)|^2)] with the kernel's Cholesky factor."""
    if not decompose:
        return lambda x: kernel(x, train)
    k = kernel(train)
    lower = np.linalg.cholesky(k + 1e-10 * np.eye(len(k)))

    def work(x: np.ndarray) -> np.ndarray:
        v = np.linalg.solve(lower, kernel(x, train).T).T
        return np.column_stack([v, np.sqrt(np.maximum(kernel.diagonal(x) - (v**2).sum(1), 0))])

    return work


def sample_version_space(x: np.ndarray, y: np.ndarray, n: int, warmup: int = 100, thin: int = 10, seed: int = 0, features: Callable | None = None) -> VersionSpace:
    """Hypotheses (bias first) that are right on every labelled row, from one chain."""
    work = features or (lambda v: v)
    signed = np.where(y == 1, 1.0, -1.0)[:, None] * np.column_stack([np.ones(len(x)), work(x)])
    return VersionSpace(hit_and_run(signed, start_point(signed), n, warmup, thin, np.random.default_rng(seed)), work)


def sample_chains(tasks: DataFrame, x: np.ndarray, y: np.ndarray, warmup: int, thin: int, n: int = 1, features: Callable | None = None) -> DataFrame:
    """(chain, draw, w): n hypotheses from each of many independent chains; tasks: (chain, seed) rows spread over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chain, seed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = sample_version_space(x, y, n, warmup, thin, seed, features).hypotheses.tolist()
                yield pa.RecordBatch.from_arrays([pa.array([chain] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(ws, pa.list_(pa.float64()))], ["chain", "draw", "w"])

    return tasks.select("chain", "seed").mapInArrow(run, "chain long, draw int, w array<double>")


def chain_diagnostic(draws: DataFrame) -> DataFrame:
    """(k, within, between, ratio) of each coordinate of draws (chain, draw, w): mean variance within the chains, variance of their means times
    their length, and sqrt(((n - 1) / n within + between / n) / within), near 1 for chains that have mixed. Sums by chain, then by coordinate."""
    each = draws.select("chain", F.posexplode("w").alias("k", "v")).groupBy("chain", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
    n, within, between = F.avg("n"), F.avg("var"), F.avg("n") * F.var_samp("mean")
    return each.groupBy("k").agg(within.alias("within"), between.alias("between"), F.sqrt(((n - 1) / n * within + between / n) / within).alias("ratio"))


def stacked(draws: DataFrame, features: Callable | None = None, most: int = 10_000) -> VersionSpace:
    """The hypotheses of all chains as one model for score(), entropy_reduction() and the like; more than most raise (a model goes with each task)."""
    rows = draws.orderBy("chain", "draw").select("w").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} hypotheses")
    return VersionSpace(np.array([r.w for r in rows]), features or (lambda v: v))


def _entropy(p: np.ndarray) -> np.ndarray:
    q = np.clip(p, 1e-300, 1)
    r = np.clip(1 - p, 1e-300, 1)
    return -(p * np.log(q) + (1 - p) * np.log(r))


def entropy_reduction(pool: DataFrame, space: VersionSpace, reference: np.ndarray) -> DataFrame:
    """(id, rank): among rows that cut the space most evenly the expected mean entropy of the reference rows
    after the label; infinite elsewhere; 0 everywhere if no row cuts. All that counts of a row is which
    hypotheses say yes, so the expectation is worked out once for each such pattern of a block."""
    ranked = score(pool, space)
    least = ranked.agg(F.min("rank")).first()[0]
    if least is None or least == 0.5:
        return ranked.select("id", F.lit(0.0).alias("rank"))
    return score(pool, ExpectedEntropy(space, space.votes(reference), least)).select("id", "rank")


@dataclass
class ExpectedEntropy:
    """Rank: expected entropy of the reference rows (votes: rows x hypotheses) where the cut score is least."""

    space: VersionSpace
    votes: np.ndarray
    least: float

    def score_block(self, x: np.ndarray):
        v = self.space.votes(x) > 0
        p = v.mean(axis=1)
        out, best = np.full(len(x), np.inf), np.flatnonzero(np.abs(p - 0.5) == self.least)
        patterns, which = np.unique(v[best], axis=0, return_inverse=True)
        n = patterns.shape[1]
        for side in (patterns, ~patterns):  # the hypotheses that the label would leave
            size = side.sum(axis=1)
            share = self.votes @ side.T / np.maximum(size, 1)
            expected = size / n * _entropy(share).mean(axis=0)
            out[best] = (0.0 if side is patterns else out[best]) + expected[which.ravel()]
        return (p > 0.5).astype(float), p, out


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """Phi(z), by the series of positive terms exp(-z^2 / 2) (z + z^3 / 3 + z^5 / 15 + ...)."""
    x = np.clip(z, -9, 9)
    term = x.copy()
    out = x.copy()
    for k in range(3, 400, 2):
        term = term * x * x / k
        out += term
        if not len(x) or np.abs(term).max() <= 1e-18 * np.abs(out).max():
            break
    return np.clip(0.5 + np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * out, 0, 1)


# Laplace posterior -----------------------------------------------------------------------------------


def fit_laplace(x: np.ndarray, y: np.ndarray, precision: float = 1.0, features: Callable | None = None) -> "Laplace":
    """Bayesian logistic regression: the mode by Newton steps, the Hessian sum p (1 - p) x x' + precision I. precision 0 is
    the improper flat prior, for labels that no plane separates; with separable ones there is no mode, which raises."""
    work = features or (lambda v: v)
    a = np.column_stack([np.ones(len(x)), work(x)])
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        h = (a * (p * (1 - p))[:, None]).T @ a + precision * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (p - y) + precision * w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    else:
        raise RuntimeError("no mode was found; the labels may be separable and the prior flat")
    p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
    return Laplace(w, (a * (p * (1 - p))[:, None]).T @ a + precision * np.eye(len(w)), work)


@dataclass
class Laplace:
    """p = Phi(mu / sqrt(var + 8 / pi)) with mu = x . w and var = x' H^-1 x."""

    mode: np.ndarray
    hessian: np.ndarray
    features: Callable[[np.ndarray], np.ndarray]

    def score_block(self, x: np.ndarray):
        a = np.column_stack([np.ones(len(x)), self.features(x)])
        var = (a * np.linalg.solve(self.hessian, a.T).T).sum(axis=1)
        z = a @ self.mode / np.sqrt(np.maximum(var, 0) + 8 / np.pi)
        p = normal_cdf(z)
        return (p > 0.5).astype(float), p, np.abs(p - 0.5)


@dataclass
class Subspaces:
    """One learner a subspace, on its columns, combined by functions of the (K, n) values."""

    parts: list[list[int]]
    learners: list
    proba: Callable[[np.ndarray], np.ndarray] = lambda p: p.prod(axis=0)
    rank: Callable[[np.ndarray], np.ndarray] = lambda p: np.prod(1 - 2 * p * (1 - p), axis=0)
    label: Callable[[np.ndarray], np.ndarray] | None = None

    def score_block(self, x: np.ndarray):
        each = [m.score_block(x[:, p]) for p, m in zip(self.parts, self.learners)]
        probas = np.array([e[1] for e in each])
        p = self.proba(probas)
        return (p > 0.5).astype(float) if self.label is None else self.label(np.array([e[0] for e in each])), p, self.rank(probas)


def fit_subspaces(x: np.ndarray, partial: np.ndarray, parts: list[list[int]], fit: Callable[[np.ndarray, np.ndarray], object] | list, **how) -> Subspaces:
    """A learner for each subspace, fitted on its columns and its partial labels (n x K). fit: (x, y) -> learner, one for all or
    one a subspace (so kernel, version-space and categorical members mix). how: what Subspaces combines them with."""
    fits = fit if isinstance(fit, list) else [fit] * len(parts)
    if not len(parts) == len(fits) == partial.shape[1]:
        raise ValueError(f"{len(parts)} subspaces, {len(fits)} fits, {partial.shape[1]} partial labels")
    return Subspaces(parts, [f(x[:, p], partial[:, k]) for k, (p, f) in enumerate(zip(parts, fits))], **how)


@dataclass
class Categories:
    """Known values of a categorical subspace (a number, or a one-hot block): probability 1, 0, or 1/2 for a value never seen.
    A value labelled both ways makes all unknown."""

    known: dict[float, float]

    @staticmethod
    def values(x: np.ndarray) -> np.ndarray:
        return x[:, 0] if x.shape[1] == 1 else x.argmax(axis=1).astype(float)

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> "Categories":
        known: dict[float, float] = {}
        for v, label in zip(Categories.values(x).tolist(), y.tolist()):
            if known.setdefault(v, label) != label:
                return Categories({})
        return Categories(known)

    def score_block(self, x: np.ndarray):
        seen, labels = (np.array(v, float) for v in zip(*sorted(self.known.items()))) if self.known else (np.zeros(0), np.zeros(0))
        v = self.values(x)
        at = np.minimum(np.searchsorted(seen, v), max(len(seen) - 1, 0))
        p = np.where(seen[at] == v, labels[at], 0.5) if len(seen) else np.full(len(x), 0.5)
        return (p > 0.5).astype(float), p, np.abs(p - 0.5)


@dataclass
class ItemSets:
    """Known items of a multi-set subspace (a 0/1 block). Probability: of a random item set that agrees with the labels holding all of the row's
    items, so 1 if all are positive, 0 if any is negative (operators.itemsets). Labels that no item set agrees with raise."""

    positive: np.ndarray
    negative: np.ndarray
    pending: list[frozenset[int]] = field(default_factory=list)

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> "ItemSets":
        held = x > 0
        positive = held[y == 1].any(axis=0)
        left = np.unique(held[y != 1] & ~positive, axis=0)
        if len(left) and not left.any(axis=1).all():
            raise itemsets.ConflictError("a negative row has positive items only")
        negative = left[left.sum(axis=1) == 1].any(axis=0) if len(left) else np.zeros(x.shape[1], bool)
        return ItemSets(positive, negative, [frozenset(np.flatnonzero(r).tolist()) for r in left if r.sum() > 1 and not (r & negative).any()])

    def score_block(self, x: np.ndarray):
        p = itemsets.share(x > 0, self.positive, self.negative, self.pending)
        return (p > 0.5).astype(float), p, np.abs(p - 0.5)
