"""Metrics over whole pools (one pass each) and over logs of many runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORES = ("true_positive", "false_positive", "true_negative", "false_negative", "accuracy", "precision", "recall", "fscore")


def classification_metrics(rows: DataFrame, scores: tuple[str, ...] = SCORES, by: tuple[str, ...] = (), prefix: str = "", label: str = "label", pred: str = "pred") -> DataFrame:
    """The named scores of (label, pred), per group of by; x / 0 is 0."""
    if unknown := set(scores) - set(SCORES):
        raise ValueError(f"unknown scores: {sorted(unknown)}")
    y, p = F.col(label) == 1, F.col(pred) == 1
    counts = rows.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def share(a: Column, b: Column) -> Column:
        return F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1).otherwise(b))

    values = dict(zip(SCORES, (tp, fp, tn, fn, share(tp + tn, tp + fp + tn + fn), share(tp, tp + fp), share(tp, tp + fn), share(2 * tp, 2 * tp + fp + fn))))
    return counts.select(*by, *(values[s].alias(prefix + s) for s in scores))


def three_set_metric(rows: DataFrame, pred: str = "pred") -> DataFrame:
    """#1 / (#1 + #0.5), a lower bound of the F-score; null where neither occurs."""
    one, half = F.count_if(F.col(pred) == 1), F.count_if(F.col(pred) == 0.5)
    return rows.agg(F.when(one + half > 0, one / F.when(one + half > 0, one + half)).alias("tsm"))


def prediction_entropy(rows: DataFrame, proba: str = "proba") -> DataFrame:
    """Mean of -p ln p - (1 - p) ln(1 - p), with 0 ln 0 = 0."""
    p = F.col(proba)
    inside = (p > 0) & (p < 1)
    q = F.when(inside, p).otherwise(F.lit(0.5))
    return rows.agg(F.avg(F.when(inside, -q * F.log(q) - (1 - q) * F.log(1 - q)).otherwise(0.0)).alias("entropy"))


def deduplicate_log(log: DataFrame, by: tuple[str, ...] = ("run", "iter", "key")) -> DataFrame:
    """What a key says that was logged more than once: the last value, their sum, the list of all."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"])
    return log.groupBy(*by).agg(F.max_by("value", "seq").alias("overwrite"), F.sum("value").alias("total"), listed.alias("append"))


def learning_curves(log: DataFrame, keys: list[str]) -> DataFrame:
    """(learner, iter, one column a key): means over runs, of iterations where callbacks ran."""
    return log.filter("callback_time is not null").groupBy("learner", "iter").pivot("key", keys).agg(F.avg("value"))


def thin(log: DataFrame, skip: int) -> DataFrame:
    """Iterations 1, 1 + skip, ... and the last of each run."""
    return log.withColumn("last_iter", F.max("iter").over(Window.partitionBy("run"))).filter(((F.col("iter") - 1) % skip == 0) | (F.col("iter") == F.col("last_iter"))).drop("last_iter")


def stop_point(log: DataFrame, max_iter: int, metric: str, threshold: float) -> DataFrame:
    """Iterations up to the first that stops: past max_iter, a metric at its threshold (a missing one
    never stops), or nothing left without a label. (max_iter + 1 iterations run.)"""
    stops = (F.col("iter") > max_iter) | F.coalesce(F.col(metric) >= threshold, F.lit(False)) | F.coalesce(F.col("n_unlabeled") == 0, F.lit(False))
    first = F.min(F.when(stops, F.col("iter"))).over(Window.partitionBy("run"))
    return log.withColumn("stop_iter", first).filter(F.col("stop_iter").isNull() | (F.col("iter") <= F.col("stop_iter")))


def repeats_in_a_row(log: DataFrame, value: str, stable_count: int) -> DataFrame:
    """How many times in a row the value has repeated, and whether that is stable_count or more."""
    w = Window.partitionBy("run").orderBy("iter")
    marked = log.withColumn("_new", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w))
    repeats = F.row_number().over(Window.partitionBy("run", "_island").orderBy("iter")) - 1
    return marked.withColumn("repeats", repeats.cast("long")).withColumn("stable", F.col("repeats") >= stable_count).drop("_new", "_island")
