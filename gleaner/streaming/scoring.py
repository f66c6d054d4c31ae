"""Scoring rows as they arrive. Scorers keep no state, so they work on a streaming pool as they do on a
stored one; only rows that a model can't decide, or that it wants, go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def score_stream(stream: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The stream with columns added, which are expressions over x."""
    return stream.select("*", *(c.alias(n) for n, c in columns.items()))


def start(scored: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Writes a scored stream to Parquet, each row once; restarts go on from the checkpoint."""
    writer = scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
