"""Three-valued models: what convexity, categories and item sets say about a row (1, 0, or 0.5: unknown).

Fitting sees labelled rows only (small); predicting is a column expression over the pool: bounds and facets are
literals of the expression up to expressions.TERMS numbers, beyond which it raises and the same model scores numpy blocks
(blocks.score); known categories are a joined table. Hulls of many positives are found per partition first (hulls merge)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import TERMS, dot, total, within_terms
from . import itemsets, state as states
from .hulls import facets, hull_vertices, span, vertices


class ConvexError(ValueError):
    """A negative point inside the positive region."""


def cone(vertex: np.ndarray, points: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """Equations of the facets at the vertex of the hull of vertex and points: where all are at least 0, a row
    lies behind the vertex. A vertex inside the points' hull raises ConvexError."""
    corners, equations, sets = facets(np.vstack([vertex, points]), tol)
    here = np.flatnonzero((corners == vertex).all(axis=1))
    if not len(here):
        raise ConvexError("a negative point lies inside the positive region")
    return np.array([e for e, s in zip(equations, sets) if here[0] in s])


class Polytope:
    """Positive hull and one negative cone per negative point, in any number of dimensions. While points don't span
    all dimensions, the hull or cone isn't built and says nothing."""

    def __init__(self, tol: float = 1e-12) -> None:
        if tol <= 0:
            raise ValueError("tol must be positive")
        self.tol, self.positive, self.negative, self.valid = tol, None, None, True

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Polytope":
        return self.update(x, y)

    def update(self, x: np.ndarray, y: np.ndarray) -> "Polytope":
        """Adds labelled points; a conflict makes the model invalid, and updating that raises."""
        if not self.valid:
            raise RuntimeError("the polytope is invalid")
        x, y = np.atleast_2d(np.asarray(x, float)), np.asarray(y)
        self.positive = x[y == 1] if self.positive is None else np.vstack([self.positive, x[y == 1]])
        self.negative = x[y != 1] if self.negative is None else np.vstack([self.negative, x[y != 1]])
        try:
            self._cones()
        except ConvexError:
            self.valid = False
        return self

    @property
    def is_built(self) -> bool:
        if self.positive is None or len(self.positive) <= self.positive.shape[1]:
            return False
        return self.positive.shape[1] == 1 or len(span(self.positive)) == self.positive.shape[1]

    def _cones(self) -> list:
        """For each negative point what lies behind it: in 1-D (point, side), else equations."""
        pos, dim = self.positive, self.positive.shape[1]
        out = []
        if dim == 1:
            if not len(pos):
                return out
            low, high = pos.min(), pos.max()
            for (v,) in self.negative:
                if low <= v <= high:
                    raise ConvexError("a negative point lies inside the positive region")
                out.append((v, 1 if v > high else -1))
            return out
        base = vertices(pos)
        for v in self.negative:
            try:
                out.append(cone(v, base, self.tol))
            except ConvexError:
                raise
            except ValueError:
                continue  # points that don't span all dimensions yet say nothing
        return out

    def column(self, x: Column | str) -> Column:
        """1 inside the hull, then 0 inside any cone, else 0.5."""
        if not self.valid or self.positive is None:
            return F.lit(0.5)
        x = F.col(x) if isinstance(x, str) else x
        dim = self.positive.shape[1]
        if dim == 1:
            v = F.get(x, F.lit(0))
            inside = v.between(float(self.positive.min()), float(self.positive.max())) if len(self.positive) > 1 else F.lit(False)
            behind = [(v >= float(p)) if side > 0 else (v <= float(p)) for p, side in self._cones()]
        else:
            inside = F.lit(False)
            cones = self._cones()
            equations = facets(self.positive, self.tol)[1] if self.is_built else np.zeros((0, dim + 1))
            within_terms(dim * (len(equations) + sum(map(len, cones))))
            if self.is_built:
                inside = F.greatest(*(dot(x, e[:-1]) + F.lit(float(e[-1])) for e in equations)) <= self.tol
            behind = [F.least(*(dot(x, e[:-1]) + F.lit(float(e[-1])) for e in eqs)) >= -self.tol if len(eqs) > 1 else (dot(x, eqs[0][:-1]) + F.lit(float(eqs[0][-1])) >= -self.tol) for eqs in cones]
        cone = F.lit(False)
        for b in behind:
            cone = cone | b
        return F.when(cone, 0.0).when(inside, 1.0).otherwise(0.5)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The same for a few points at hand."""
        x = np.atleast_2d(np.asarray(x, float))
        out = np.full(len(x), 0.5)
        if not self.valid or self.positive is None:
            return out
        if self.positive.shape[1] == 1:
            if len(self.positive) > 1:
                out[(x[:, 0] >= self.positive.min()) & (x[:, 0] <= self.positive.max())] = 1.0
            for p, side in self._cones():
                out[side * (x[:, 0] - p) >= 0] = 0.0
            return out
        if self.is_built:
            e = facets(self.positive, self.tol)[1]
            out[(x @ e[:, :-1].T + e[:, -1]).max(axis=1) <= self.tol] = 1.0
        for e in self._cones():
            out[(x @ e[:, :-1].T + e[:, -1]).min(axis=1) >= -self.tol] = 0.0
        return out


    def score_block(self, x: np.ndarray):
        """As a learner of blocks.score: a row that isn't decided ranks first."""
        p = self.predict(x)
        return p, p, np.abs(p - 0.5)

    def rows(self) -> list[tuple[float, list[float]]]:
        """(label, x): what a saved polytope is, together with tol; positives only as far as they are vertices."""
        kept = [] if self.positive is None else [(1.0, v.tolist()) for v in vertices(self.positive)]
        return kept + ([] if self.negative is None else [(0.0, v.tolist()) for v in self.negative])

    def save(self, spark: SparkSession, path: str) -> None:
        """Vertices, negative points and tol as a table. What update() adds to a loaded polytope is what it would have added to this one."""
        spark.createDataFrame([(self.tol, self.valid, y, x) for y, x in self.rows()], "tol double, valid boolean, label double, x array<double>").write.mode("overwrite").parquet(path)


def load_polytope(spark: SparkSession, path: str) -> "Polytope":
    rows = spark.read.parquet(path).collect()  # labelled points
    out = Polytope(rows[0].tol) if rows else Polytope()
    if rows:
        out.update(np.array([r.x for r in rows]), np.array([r.label for r in rows]))
        out.valid = rows[0].valid
    return out


class FlippedPolytope(Polytope):
    """For a convex negative region."""

    def update(self, x: np.ndarray, y: np.ndarray) -> "FlippedPolytope":
        super().update(x, 1 - np.asarray(y))
        return self

    def column(self, x: Column | str) -> Column:
        return 1 - super().column(x)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 - super().predict(x)


class PersistPolytope:
    """Positive while that is valid, then flipped, then unknown."""

    def __init__(self, tol: float = 1e-12) -> None:
        self.models = [Polytope(tol), FlippedPolytope(tol)]

    @property
    def valid(self) -> bool:
        return any(m.valid for m in self.models)

    def update(self, x: np.ndarray, y: np.ndarray) -> "PersistPolytope":
        if not self.valid:
            raise RuntimeError("the polytope is invalid")
        for m in self.models:
            if m.valid:
                m.update(x, y)
        return self

    fit = update

    def column(self, x: Column | str) -> Column:
        return next((m.column(x) for m in self.models if m.valid), F.lit(0.5))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return next((m.predict(x) for m in self.models if m.valid), np.full(len(np.atleast_2d(x)), 0.5))


MODES = {"positive": Polytope, "negative": FlippedPolytope, "persist": PersistPolytope}


def polytope(mode: str, tol: float = 1e-12):
    if mode.lower() not in MODES:
        raise ValueError(f"no mode {mode}; there are {', '.join(MODES)}")
    return MODES[mode.lower()](tol)


# Categories and item sets ----------------------------------------------------------------------------


def conflicts(labels: DataFrame, value: str) -> DataFrame:
    """Values that were labelled both ways."""
    return labels.groupBy(value).agg(F.count_distinct("label").alias("n_labels")).filter("n_labels > 1")


def category_model(labels: DataFrame, value: str) -> DataFrame:
    """(value, known): 1, 0; empty if any value was labelled both ways."""
    known = labels.groupBy(value).agg(F.min("label").alias("known"), F.max("label").alias("_most"))
    bad = known.agg(F.count_if(F.col("known") != F.col("_most")).alias("bad"))
    return known.crossJoin(F.broadcast(bad)).filter("bad = 0").select(value, "known")  # bad is one row


def category_label(pool: DataFrame, model: DataFrame, value: str, name: str = "pred") -> DataFrame:
    """The known label of a row's value, 0.5 where it was never seen."""
    return pool.join(model.withColumnRenamed("known", name), value, "left").withColumn(name, F.coalesce(name, F.lit(0.5)))


MOST_SETS = 100_000


class MultiSet:
    """Positive items are those of positive rows. A negative row without its known positive items: one item
    left makes that one negative, several are kept, none is a conflict."""

    def __init__(self, positive: set[int], negative: set[int], pending: list[frozenset[int]], valid: bool) -> None:
        self.positive, self.negative, self.pending, self.valid = positive, negative, pending, valid

    @staticmethod
    def fit(labels: DataFrame, items: str = "items") -> "MultiSet":
        """From labelled rows. Of these only the positive items and the distinct rests of negative rows get to the driver; more than MOST_SETS
        rests raise."""
        pos = {r[0] for r in labels.filter("label = 1").select(F.explode(items)).distinct().collect()}
        rest = F.array_sort(F.array_except(items, F.array(*(F.lit(i) for i in sorted(pos))).cast("array<int>"))).alias("s")
        rows = labels.filter("label = 0").select(rest).distinct().limit(MOST_SETS + 1).collect()
        if len(rows) > MOST_SETS:
            raise ValueError(f"more than {MOST_SETS} distinct item sets of negative rows")
        left = sorted({frozenset(r.s) for r in rows}, key=sorted)
        negative = {next(iter(s)) for s in left if len(s) == 1}
        return MultiSet(pos, negative, [s for s in left if len(s) > 1 and not s & negative], all(left) and not pos & negative)

    def column(self, items: Column | str) -> Column:
        x = F.col(items) if isinstance(items, str) else items
        if not self.valid:
            return F.lit(0.5)
        pos, neg = (F.array(*(F.lit(i) for i in sorted(s))).cast("array<int>") for s in (self.positive, self.negative))
        return F.when(F.arrays_overlap(x, neg), 0.0).when(F.size(F.array_except(x, pos)) == 0, 1.0).otherwise(0.5)

    def proba(self, items: Column | str, n_items: int, n_samples: int = itemsets.SAMPLES, seed: int = 0) -> Column:
        """Chance that a random item set, consistent with what is known, holds all of the row's items. Items that pending sets tie together
        are enumerated or, where they are more than itemsets.EXACT, drawn n_samples times by a chain. Large groups make large expressions, which
        raise; blocks.ItemSets does the same in blocks."""
        x = F.col(items) if isinstance(items, str) else items
        if not self.valid:
            raise itemsets.ConflictError("no item set agrees with the labels")
        groups = itemsets.groups_of(self.pending)
        tied = {i for own, _ in groups for i in own}
        array = lambda values: F.array(*(F.lit(i) for i in sorted(values))).cast("array<int>")
        free = array(set(range(n_items)) - self.positive - self.negative - tied)
        out = F.when(F.arrays_overlap(x, array(self.negative)), 0.0).otherwise(F.pow(F.lit(0.5), F.size(F.array_intersect(x, free))))
        for own, sets in groups:
            drawn = itemsets.consistent(len(own), sets, n_samples, seed)
            within_terms(len(drawn))
            left_out = [F.when(F.arrays_overlap(x, array(i for i, there in zip(own, s) if not there)), 0.0).otherwise(1.0) for s in drawn.tolist()]
            out = out * total(left_out) / len(drawn)
        return out


# Subspaces together ----------------------------------------------------------------------------------


def factorized_label(parts: list[Column], valid: list[bool]) -> Column:
    """The least of the valid subspaces' labels, from 1, or from 0.5 if some subspace is invalid."""
    used = [p for p, ok in zip(parts, valid) if ok]
    return F.least(F.lit(1.0 if all(valid) else 0.5), *used) if used else F.lit(0.5)


def dual_space(polytope_label: Column | str, learner: Column | str, valid: bool = True) -> Column:
    """The polytope's value where it has one, the learner's elsewhere."""
    p, m = (F.col(c) if isinstance(c, str) else c for c in (polytope_label, learner))
    return F.when(p != 0.5, p).otherwise(m) if valid else m


def infer(unknown: DataFrame, label: Column) -> DataFrame:
    """(id, pred) of unknown rows that the model decides: what becomes inferred."""
    return unknown.select("id", label.alias("pred")).filter("pred <> 0.5")


def dual_space_pass(pool: DataFrame, state: DataFrame, cache: DataFrame, model, x: np.ndarray, y: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(state, cache) after a batch of user labels (x, y). The model learns the batch; a conflict flushes all inferred rows;
    automatic labels (cache: id, x, label) that the model no longer decides are dropped; then every unknown row that it
    decides becomes inferred. One narrow pass over the unknown rows."""
    if model.valid:
        model.update(x, y)
        if not model.valid:
            state = states.remove_inferred(state)
    label = model.column("x")
    decided = infer(states.view(pool, state, "unknown"), label)
    kept = cache.withColumn("_now", label).filter("_now = label").drop("_now")
    return state.unionByName(decided.select("id", F.lit("inferred").alias("state"))), kept


def merge_cache(user: DataFrame, cached: DataFrame, label: Column) -> DataFrame:
    """User labels and those automatic labels that the model still decides."""
    kept = cached.withColumn("pred", label).filter("pred <> 0.5").select(*cached.columns)
    return user.select("id", "label", F.lit("user").alias("origin")).unionByName(kept.select("id", "label", F.lit("cache").alias("origin")))


__all__ = ["TERMS", "ConvexError", "cone", "FlippedPolytope", "MultiSet", "PersistPolytope", "Polytope", "category_label", "category_model", "conflicts", "dual_space", "facets", "factorized_label", "hull_vertices", "infer", "dual_space_pass", "load_polytope", "merge_cache", "polytope"]
