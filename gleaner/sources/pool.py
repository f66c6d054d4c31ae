"""Pools, labels and models: reading, checking and writing them."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import shared_folder


def load_pool(table: DataFrame, features: list[str | Column], key: str | None = None, order: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, x array<double>) and the columns in keep. Without a key there is no row order: then order, a
    list of sort columns, must be stated, and rows are numbered from 0 along it, which is one global sort; ties
    are broken by x and the columns in keep."""
    x = F.array(*(f if isinstance(f, Column) else F.col(f) for f in features)).cast("array<double>").alias("x")
    if key is not None:
        return table.select(F.col(key).alias("id"), x, *keep)
    if not order:
        raise ValueError("a pool needs a key column, or a stated order to number its rows along")
    # One range-partitioned, sorted run is written once with each row's place (partition, number in it); ids are
    # the numbers shifted by the sizes of the partitions before. Nothing is computed twice, so no second
    # sampling of ranges can disagree with the first, and no task sees more than its own partition.
    spark = table.sparkSession
    places = [F.col(c).alias(f"_order{k}") for k, c in enumerate(order)]
    rows = table.select(x, *keep, *places)
    ties = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind and not c.startswith("_order")]
    first = [f"_order{k}" for k in range(len(order))]
    placed = rows.repartitionByRange(*first).sortWithinPartitions(*first, *ties).withColumn("_place", F.monotonically_increasing_id()).drop(*first)
    path = f"{shared_folder(spark)}/pool-{uuid.uuid4().hex}"
    placed.write.parquet(path)
    written = spark.read.schema(placed.schema).parquet(path)
    part = F.shiftright("_place", 33)  # a monotonic id is the partition, then 33 bits of the row's number in it
    sizes = written.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # one row a partition
    before = np.concatenate([[0], np.cumsum([r.n for r in sizes])]).tolist()
    shifts = spark.createDataFrame([(r["_part"], int(n)) for r, n in zip(sizes, before)], "_part long, _shift long")
    numbered = written.withColumn("_part", part).join(F.broadcast(shifts), "_part")
    return numbered.select((F.col("_shift") + F.col("_place").bitwiseAND((1 << 33) - 1)).alias("id"), "x", *keep)


def pool_report(pool: DataFrame) -> DataFrame:
    """One row: n_rows, n_ids, n_bad (rows with a missing or non-finite value), min_dim, max_dim."""
    bad = F.col("x").isNull() | F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return pool.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.count_if(bad).alias("n_bad"), F.min(F.size("x")).cast("long").alias("min_dim"), F.max(F.size("x")).cast("long").alias("max_dim"))


def check_pool(pool: DataFrame) -> None:
    """Raises unless ids are unique, values finite and all rows of one length."""
    r = pool_report(pool).first()
    if r.n_rows != r.n_ids or r.n_bad or (r.n_rows and r.min_dim != r.max_dim):
        raise ValueError(f"not a pool: {r.asDict()}")


def load_labels(table: DataFrame, label: str | Column, partial: list[str | Column] | None = None, key: str = "id", check: bool = True) -> DataFrame:
    """(id, label, partial array<double>); partial defaults to [label]. Labels other than 0 and 1, or
    partial labels of unequal number, raise."""
    y = (label if isinstance(label, Column) else F.col(label)).cast("double")
    parts = F.array(*(p if isinstance(p, Column) else F.col(p) for p in partial)).cast("array<double>") if partial else F.array(y)
    out = table.select(F.col(key).alias("id"), y.alias("label"), parts.alias("partial"))
    if check:
        wrong = ~F.coalesce(F.col("label").isin(0.0, 1.0), F.lit(False)) | F.exists("partial", lambda v: ~F.coalesce(v.isin(0.0, 1.0), F.lit(False)))
        r = out.agg(F.count_if(wrong).alias("bad"), F.min(F.size("partial")).alias("a"), F.max(F.size("partial")).alias("b")).first()
        if r.bad or r.a != r.b:
            raise ValueError(f"labels must be 0 or 1, partial labels equally many: {r.asDict()}")
    return out


def export_labels(labels: DataFrame, noisy: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (a group of by): labeled_indexes, labels, partial_labels, in order of id; keys of noisy
    labels are prefixed."""
    rows = F.array_sort(F.collect_list(F.struct("id", "label", "partial")))
    p = "noisy_" if noisy else ""
    return labels.groupBy(*by).agg(rows.alias("r")).select(*by, F.col("r.id").alias("labeled_indexes"), F.col("r.label").alias(f"{p}labels"), F.col("r.partial").alias(f"{p}partial_labels"))


def model_table(spark: SparkSession, bias: np.ndarray, weights: np.ndarray) -> DataFrame:
    """A linear model as rows (k, bias, w array<double>)."""
    rows = [(k, float(b), [float(v) for v in w]) for k, (b, w) in enumerate(zip(np.atleast_1d(bias), np.atleast_2d(weights)))]
    return spark.createDataFrame(rows, "k int, bias double, w array<double>")


def save_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bias (K,) and weights (K, d): a model's few rows."""
    rows = spark.read.parquet(path).orderBy("k").collect()
    return np.array([r.bias for r in rows]), np.array([r.w for r in rows])
