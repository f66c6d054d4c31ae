"""Reproducible randomness: an order and a uniform number that depend on a seed and a key only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, *keys: Column | str) -> Column:
    """md5 of "seed:key[:key...]": the same in every engine and under any partitioning."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)).cast("binary"))


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from the first eight hexadecimal digits of digest()."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
