"""Which rows are labelled, inferred or unknown. The pool is never rewritten: the state is a table
state(id, state) of the rows that aren't unknown, and labels(id, label, partial, iter, pos) of those labelled.

Joins to labels and state are equi-joins on id without hints: both can grow to the pool's size (inferred
rows), so Spark broadcasts them only while their measured size allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELED, INFERRED, UNKNOWN = "labeled", "inferred", "unknown"


def with_state(pool: DataFrame, state: DataFrame) -> DataFrame:
    return pool.join(state.select("id", "state"), "id", "left").withColumn("state", F.coalesce("state", F.lit(UNKNOWN)))


def view(pool: DataFrame, state: DataFrame, which: str) -> DataFrame:
    """Rows that are labeled, inferred, unknown, or unlabeled (inferred or unknown)."""
    if which in (LABELED, INFERRED):
        return pool.join(state.filter(F.col("state") == which).select("id"), "id", "left_semi")
    if which == UNKNOWN:
        return pool.join(state.select("id"), "id", "left_anti")
    if which == "unlabeled":
        return pool.join(state.filter(F.col("state") == LABELED).select("id"), "id", "left_anti")
    raise ValueError(f"no such view: {which}")


def sizes(pool: DataFrame, state: DataFrame) -> DataFrame:
    """(state, n): three rows."""
    return with_state(pool, state).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def label_summary(labels: DataFrame) -> DataFrame:
    """One row: n_labels, n_positive, both_classes, selectivity (percent)."""
    n, pos = F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))
    return labels.agg(n.alias("n_labels"), pos.cast("long").alias("n_positive"), ((pos > 0) & (pos < n)).alias("both_classes"), F.round(F.when(n > 0, 100.0 * pos / n), 6).alias("selectivity"))


def lookup(pool: DataFrame, wanted: DataFrame, check: bool = True) -> DataFrame:
    """Rows of the pool for wanted(id, pos), in the order of pos; unknown ids raise."""
    if check and (missing := wanted.join(pool.select("id"), "id", "left_anti").select("id").take(5)):
        raise ValueError(f"unknown ids: {[r.id for r in missing]}")
    return pool.join(wanted.select("id", "pos"), "id").orderBy("pos")


def label_selected(selected: DataFrame, truth: DataFrame) -> DataFrame:
    """(id, label, partial) of the selected ids."""
    return truth.join(selected.select("id"), "id", "left_semi")


def _refuse(ids: DataFrame, state: DataFrame, which: str) -> None:
    if found := ids.select("id").join(state.filter(F.col("state") == which), "id", "left_semi").take(5):
        raise ValueError(f"already {which}: {[r.id for r in found]}")


def move_to_labeled(state: DataFrame, labels: DataFrame, batch: DataFrame, iteration: int, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """The state and labels after a batch (id, label, partial); it becomes the last one."""
    if check:
        _refuse(batch, state, LABELED)
    moved = batch.select("id", F.lit(LABELED).alias("state"))
    return state.join(batch.select("id"), "id", "left_anti").unionByName(moved), labels.unionByName(batch.withColumn("iter", F.lit(iteration)), allowMissingColumns=True)


def move_to_inferred(state: DataFrame, ids: DataFrame, check: bool = True) -> DataFrame:
    """From unknown, or back from labelled."""
    if check:
        _refuse(ids, state, INFERRED)
    return state.join(ids.select("id"), "id", "left_anti").unionByName(ids.select("id", F.lit(INFERRED).alias("state")))


def move_to_unknown(state: DataFrame, ids: DataFrame) -> DataFrame:
    return state.join(ids.select("id"), "id", "left_anti")


def remove_inferred(state: DataFrame) -> DataFrame:
    return state.filter(F.col("state") != INFERRED)


def training_set(pool: DataFrame, labels: DataFrame, last: bool = False, partial: bool = False) -> DataFrame:
    """(id, x, y): all labelled rows, or those of the last batch; y is the label or the partial labels."""
    chosen = labels
    if last:
        chosen = labels.join(labels.agg(F.max("iter").alias("iter")), "iter", "left_semi")
    return pool.select("id", "x").join(chosen.select("id", F.col("partial" if partial else "label").alias("y")), "id")


def user_labels(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """The user's label where there is one, the model's pred elsewhere."""
    return scored.join(labels.select("id", "label"), "id", "left").withColumn("final", F.coalesce("label", "pred")).drop("label")


def concat_labels(*parts: DataFrame) -> DataFrame:
    """Labels one batch after another; iter tells the batches apart."""
    out = parts[0].withColumn("iter", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("iter", F.lit(k)))
    return out
