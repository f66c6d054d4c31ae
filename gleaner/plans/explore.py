"""Composite jobs: one round of exploration, final retrieval, many tasks at once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators import blocks, sampling, state


def explore_round(pool: DataFrame, truth: DataFrame, labels: DataFrame, fit: Callable[[np.ndarray, np.ndarray], object], iteration: int, k: int = 1, subsample: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(selected rows, labels after the round). Until both classes are labelled, one row of each class is
    drawn; then the learner fitted on the labels ranks the unlabelled rows and the best k are asked."""
    summary = state.label_summary(labels).first()
    unlabelled = pool.join(labels.select("id"), "id", "left_anti")
    if not summary.both_classes:
        picked = sampling.stratified(truth.join(labels.select("id"), "id", "left_anti"), 1, 1, seed, check=False).select("id")
    else:
        x, y = blocks.collected(state.training_set(pool, labels))
        picked = sampling.select_next(blocks.score(sampling.sample(unlabelled, subsample, seed), fit(x, y)), k, seed=seed).select("id", "rank")
    batch = state.label_selected(picked, truth).withColumn("iter", F.lit(iteration))
    return picked, labels.unionByName(batch.select(*labels.columns))


def retrieve(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that are positive in the end: the user's label, or the model's where there is none."""
    return state.user_labels(scored, labels).filter("final = 1")


@dataclass(frozen=True)
class Run:
    """One of many explorations at a time: a learner by name, how it is fitted, and the seed of its draws."""

    learner: str
    fit: Callable[[np.ndarray, np.ndarray], object]
    seed: int

    @property
    def name(self) -> str:
        return f"{self.learner}:{self.seed}"


PASS = "run int, tp long, fp long, tn long, fn long, rank double, h string, id {kind}, label double, x array<double>"


def scoring_pass(pool: DataFrame, truth: DataFrame, models: list[tuple[object, int, set]], k: int) -> DataFrame:
    """For every model (a learner, the seed of its ties, ids that are labelled already), in one pass over the pool: a row with how many rows it
    gets right and wrong (id null), and the k open rows of least rank of each task. Counting is done inside the block; models go with the tasks,
    as they are as large as their labels."""
    schema = PASS.format(kind=dict(pool.dtypes)["id"])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(models), 4), np.int64)
        best: list[list[tuple]] = [[] for _ in models]
        for batch in batches:
            for at in range(0, batch.num_rows, blocks.ROWS):
                part = batch.slice(at, blocks.ROWS)
                there, x = blocks.matrix(part.column(1))
                if not len(x):
                    continue
                ids = [v for v, ok in zip(part.column(0).to_pylist(), there) if ok]
                y = part.column(2).to_numpy(zero_copy_only=False)[there] == 1
                for m, (model, seed, known) in enumerate(models):
                    pred, _, rank = model.score_block(x)
                    yes, rank = np.asarray(pred) == 1, np.asarray(rank, float)
                    counts[m] += [(y & yes).sum(), (~y & yes).sum(), (~y & ~yes).sum(), (y & ~yes).sum()]
                    if not k:
                        continue
                    if known:
                        rank = np.where([i in known for i in ids], np.inf, rank)
                    least = min(k, len(rank))
                    bound = np.partition(rank, least - 1)[least - 1]
                    if len(best[m]) == k:
                        bound = min(bound, best[m][-1][0])
                    near = [(float(rank[i]), hashlib.md5(f"{seed}:{ids[i]}".encode()).hexdigest(), ids[i], float(y[i]), x[i].tolist()) for i in np.flatnonzero((rank <= bound) & (rank < np.inf))]
                    best[m] = sorted(best[m] + near, key=lambda r: r[:3])[:k]
        rows = [(m, None, None, None, None, *r) for m, own in enumerate(best) for r in own]
        rows += [(m, *c, None, None, None, None, None) for m, c in enumerate(counts.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), arrow.types)] if rows else [pa.array([], t) for t in arrow.types], schema=arrow)

    return pool.select("id", "x").join(truth.select("id", F.col("label").cast("double").alias("label")), "id").mapInArrow(run, schema)


def evaluate(passed: DataFrame) -> DataFrame:
    """(run, tp, fp, tn, fn, accuracy, precision, recall, fscore) of a scoring pass; x / 0 is 0."""
    sums = passed.filter("id is null").groupBy("run").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")))
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return sums.select("run", "tp", "fp", "tn", "fn", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("fscore"))


def _first_of_each(truth: DataFrame, seed: int) -> DataFrame:
    return sampling.stratified(truth, 1, 1, seed)


def explore_many(pool: DataFrame, truth: DataFrame, runs: list[Run], rounds: int, k: int = 1, sampler: Callable[[DataFrame, int], DataFrame] = _first_of_each, noise: Callable[[DataFrame], DataFrame] | None = None, measures: dict[str, Callable[[dict], float]] | None = None, stop: Callable[[dict], bool] | None = None) -> DataFrame:
    """(learner, run, iter, key, value, seq, callback_time): the log of many explorations side by side, each with its own labels, from one row of either class
    on. Every round is one pass over the pool for all runs together: it evaluates each run's model and picks the k rows that it asks next. Labels are
    a few rows a run and stay with the driver, as do counts and picks; rows of the pool don't.

    Its parts can be replaced. sampler: (truth, seed) -> the rows (id, label) that a run starts from. noise: labels (id, label) as they are asked ->
    labels as they are learnt. measures: further scores by name, of a run's scores so far (tp, fp, tn, fn, accuracy, ...). stop: of all scores of a
    round, whether the run ends with it."""
    said = noise or (lambda asked: asked)
    labels: list[dict] = []
    for run in runs:
        first = said(sampler(truth, run.seed).select("id", "label")).join(pool.select("id", "x"), "id").collect()
        labels.append({r.id: (r.x, float(r.label)) for r in first})
    log, going = [], list(range(len(runs)))
    for iteration in range(rounds + 1):
        if not going:
            break
        models = []
        for r in going:
            ids = sorted(labels[r])
            models.append((runs[r].fit(np.array([labels[r][i][0] for i in ids], float), np.array([labels[r][i][1] for i in ids])), runs[r].seed, set(ids)))
        passed = scoring_pass(pool, truth, models, k if iteration < rounds else 0).persist()
        try:
            scores = {r.run: r.asDict() for r in evaluate(passed).collect()}
            place = F.row_number().over(Window.partitionBy("run").orderBy("rank", "h", "id"))
            picked = passed.filter("id is not null").withColumn("place", place).filter(F.col("place") <= k).select("run", "id", "label", "x")
            if noise is not None:
                picked = picked.drop("label").join(said(picked.select("id", "label").distinct()).select("id", "label"), "id")
            picks = picked.select("run", "id", "label", "x").collect()
        finally:
            passed.unpersist()
        for r in picks:
            labels[going[r.run]][r.id] = (r.x, float(r.label))
        ended = set()
        for m, r in enumerate(going):
            values = {key: float(scores[m][key]) for key in ("tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "fscore")}
            for name, measure in (measures or {}).items():
                values[name] = float(measure(values))
            for key, value in values.items():
                log.append((runs[r].learner, runs[r].name, iteration, key, value, len(log), 0.0))
            if stop is not None and stop(values):
                ended.add(r)
        going = [r for r in going if r not in ended]
    return pool.sparkSession.createDataFrame(log, "learner string, run string, iter int, key string, value double, seq long, callback_time double")


def fit_tasks(labels: DataFrame, pool: DataFrame, truth: DataFrame, c: float = 10.0) -> DataFrame:
    """(task, scores): a linear model for every task of labels (task, x, y), fitted in parallel, one group a task; then all tasks are evaluated in
    one pass over the pool. truth: (id, label)."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(group["x"].tolist(), float), group["y"].to_numpy(float)
        return pd.DataFrame({"task": [group["task"].iloc[0]], "w": [blocks.fit_laplace(x, y, 1 / c).mode.tolist()]})

    models = sorted(labels.select("task", "x", "y").groupBy("task").applyInPandas(fit, "task string, w array<double>").collect(), key=lambda r: r.task)
    votes = [(blocks.VersionSpace(np.array([r.w])), 0, set()) for r in models]  # few numbers each
    names = F.array(*(F.lit(r.task) for r in models))
    return evaluate(scoring_pass(pool, truth, votes, 0)).select(F.get(names, F.col("run")).alias("task"), F.col("tp").alias("true_positive"), F.col("fp").alias("false_positive"), F.col("fn").alias("false_negative"), "fscore")


# Extension points: a learner is any object with score_block (operators.blocks); a connector is a function of
# the array column; a callback, sampler, stop rule or noise injector is a function from DataFrame to DataFrame.
Connector = Callable[[Column], Column]
Step = Callable[[DataFrame], DataFrame]


def run_steps(rows: DataFrame, *steps: Step) -> DataFrame:
    for step in steps:
        rows = step(rows)
    return rows
