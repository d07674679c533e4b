"""Deterministic pseudo-random numbers that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from md5 of the seed and the columns, written as text."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols]).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))
