"""Conjunctive inference: what final labels say about the values of each subspace.

A positive row makes all its values positive. A negative row with exactly one value that isn't positive makes that one negative; with several,
one of which another row has made negative, it is explained and says nothing more; with none it contradicts the positive rows. So negative
values never make others negative: a second round would find nothing, and the fixpoint is one set of joins, whatever the number of
labelled rows. A row is negative in the end if one of its values is, unknown if one is unknown, else positive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .polytope import category_label


def infer_values(labels: DataFrame, columns: list[str]) -> DataFrame:
    """(k, v, known): values that the labels (id, label, columns) decide. Rows are reduced to their distinct combinations of values first. A null
    counts as a value of its own, but isn't returned. A negative row whose values are all positive raises."""
    cells = F.array(*(F.col(c).cast("string") for c in columns))
    rows = labels.select(F.col("label").cast("double").alias("label"), cells.alias("r")).filter("label is not null").distinct()
    cell = lambda of: rows.filter(F.col("label") == of).select("r", F.posexplode("r").alias("k", "v"))
    positive = cell(1.0).select("k", "v").distinct()
    same = (F.col("a.k") == F.col("b.k")) & F.col("a.v").eqNullSafe(F.col("b.v"))
    met = cell(0.0).alias("a").join(positive.withColumn("yes", F.lit(True)).alias("b"), same, "left").select("a.r", F.struct("a.k", "a.v").alias("cell"), F.col("yes").isNull().alias("open"))
    open_cells = met.groupBy("r").agg(F.count_if("open").alias("n"), F.min(F.when(F.col("open"), F.col("cell"))).alias("cell"))
    if open_cells.filter("n = 0").limit(1).count():
        raise ValueError("a negative row has positive values only")
    negative = open_cells.filter("n = 1").select("cell.k", "cell.v").distinct()
    return positive.withColumn("known", F.lit(1.0)).unionByName(negative.withColumn("known", F.lit(0.0))).filter("v is not null")


def predict(pool: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """The pool with partial (array) and pred, their least."""
    out = pool
    for k, c in enumerate(columns):
        model = known.filter(F.col("k") == k).select(F.col("v").alias(f"_v{k}"), "known")
        out = category_label(out.withColumn(f"_v{k}", F.col(c).cast("string")), model, f"_v{k}", f"_p{k}").drop(f"_v{k}")
    parts = [F.col(f"_p{k}") for k in range(len(columns))]
    return out.withColumn("partial", F.array(*parts)).withColumn("pred", F.array_min("partial")).drop(*(f"_p{k}" for k in range(len(columns))))
