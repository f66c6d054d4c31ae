"""Two-stage models: structured attributes first, text attributes only where the first stage says yes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_stage(scored: DataFrame, text: Column | Callable[[DataFrame], DataFrame], value: str = "pred") -> DataFrame:
    """scored: (id, pred, ...) by the structured model, with final added: the text model's value in rows with pred = 1, the
    structured value in the others. text is a column of the rows, or a function that gets the rows with pred = 1 and
    returns them with its value in a column "text" (blocks, say); either way one pass without a join. Repeated ids are rows of
    their own; a null text value leaves the structured one."""
    if isinstance(text, Column):
        return scored.withColumn("final", F.when(F.col("pred") == 1, F.coalesce(text, F.col(value))).otherwise(F.col(value)))
    yes = text(scored.filter("pred = 1")).withColumn("final", F.coalesce("text", F.col(value))).drop("text")
    return yes.unionByName(scored.filter("pred <> 1 or pred is null").withColumn("final", F.col(value)))


def training_rows(labels: DataFrame, switch_iter: int) -> DataFrame:
    """Labelled rows (id, pos, partial) that the text model learns from: text label 1, or one of the first
    two, or from position switch_iter on."""
    return labels.filter((F.element_at("partial", -1) == 1) | (F.col("pos") <= 1) | (F.col("pos") >= switch_iter))


def structured_negatives(unknown: DataFrame) -> DataFrame:
    """(id, state) of unknown rows that the structured model refuses: they become inferred."""
    return unknown.filter("pred = 0").select("id", F.lit("inferred").alias("state"))
