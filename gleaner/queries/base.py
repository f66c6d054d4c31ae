"""Pools for the registered queries, from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import digest
from ..sources.pool import load_pool

SEED = 7
#: A factorized linear model for the event pool: biases and weights of two subspaces.
BIAS, WEIGHTS = [4.0, 3.0], [[-8.0, 0.0], [0.0, -6.0]]

SQL = """WITH pool AS (SELECT event_id AS id, value / 100 AS x0, hour(ts) / 24 AS x1, user_id, event_type AS cat,
    (value < 50)::INT::DOUBLE AS p0, (hour(ts) < 12)::INT::DOUBLE AS p1, (value < 50 AND hour(ts) < 12)::INT::DOUBLE AS y, md5('7:' || event_id) AS h FROM events),
lab AS (SELECT *, row_number() OVER (ORDER BY h, id) - 1 AS pos FROM (SELECT * FROM pool ORDER BY h, id LIMIT 60)),
inf AS (SELECT * FROM pool ORDER BY h, id LIMIT 200 OFFSET 60),
st AS (SELECT id, 'labeled' AS state FROM lab UNION ALL SELECT id, 'inferred' FROM inf),
sc AS (SELECT *, 1 / (1 + exp(-(4 - 8 * x0))) AS q0, 1 / (1 + exp(-(3 - 6 * x1))) AS q1, 1 / (1 + exp(-(4 - 8 * x0))) / (1 + exp(-(3 - 6 * x1))) AS proba FROM pool)
"""

VECTORS_SQL = """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, (label = 3)::INT::DOUBLE AS y, md5('7:' || vec_id) AS h FROM embeddings),
lab AS (SELECT *, row_number() OVER (ORDER BY h, id) - 1 AS pos FROM (SELECT * FROM v ORDER BY h, id LIMIT 40)),
refs AS (SELECT id AS rid, x AS z, pos AS ref, CASE WHEN pos % 2 = 0 THEN 1 ELSE -1 END AS dual FROM lab WHERE pos < 8)
"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pool(spark: SparkSession, d: str) -> DataFrame:
    """Events: id, x = [value / 100, hour / 24], user_id, cat, partial, y: value under 50 and before noon."""
    t = table(spark, d, "events").withColumn("p0", (F.col("value") < 50).cast("double")).withColumn("p1", (F.hour("ts") < 12).cast("double"))
    t = t.withColumn("cat", F.col("event_type")).withColumn("partial", F.array("p0", "p1")).withColumn("y", F.least("p0", "p1"))
    return load_pool(t, [F.col("value") / 100, F.hour("ts") / 24], "event_id", keep=("user_id", "cat", "partial", "y"))


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first n in hash order, with their position."""
    ids = rows.orderBy(digest(SEED, "id"), "id").limit(n)
    from pyspark.sql import Window

    return ids.withColumn("pos", F.row_number().over(Window.orderBy(digest(SEED, "id"), "id")) - 1)  # n rows


def labels(spark: SparkSession, d: str, n: int = 60) -> DataFrame:
    """(id, label, partial, pos, iter): the first n events, in batches of ten."""
    return first_rows(pool(spark, d), n).select("id", F.col("y").alias("label"), "partial", "pos", F.floor(F.col("pos") / 10).cast("int").alias("iter"))


def state(spark: SparkSession, d: str) -> DataFrame:
    """60 labelled and 200 inferred events."""
    first = first_rows(pool(spark, d), 260)
    return first.select("id", F.when(F.col("pos") < 60, "labeled").otherwise("inferred").alias("state"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings: id, x, y: label 3."""
    t = table(spark, d, "embeddings").withColumn("y", (F.col("label") == 3).cast("double"))
    return t.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "y")
