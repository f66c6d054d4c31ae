"""Scan of L1-regularised logistic models over interaction features: F-score and surviving pairs."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import interaction_pairs, interactions
from .metrics import classification_metrics


def scan(rows: DataFrame, dim: int, cs: list[float], tol: float = 1e-6, max_iter: int = 50) -> DataFrame:
    """(c, fscore, n_pairs, pairs "i-j,...") for each inverse strength c. rows: (x, y); one cached pass of
    features, Spark's own distributed solver for each c."""
    spark = rows.sparkSession
    data = rows.select(array_to_vector(interactions("x", dim)).alias("features"), F.col("y").cast("double").alias("label")).persist()
    try:
        n, out = data.count(), []
        for c in cs:
            model = LogisticRegression(elasticNetParam=1.0, regParam=1.0 / (c * max(n, 1)), maxIter=max_iter).fit(data)
            score = classification_metrics(model.transform(data), ("fscore",), pred="prediction").first()[0]
            pairs = interaction_pairs(model.coefficients.toArray(), tol)
            out.append((float(c), round(float(score), 6), len(pairs), ",".join(f"{i}-{j}" for i, j in pairs)))
        return spark.createDataFrame(out, "c double, fscore double, n_pairs int, pairs string")
    finally:
        data.unpersist()
