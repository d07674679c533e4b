"""Windows and the way back to points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import haloed


def _ordered(by=("series_id",)):
    return Window.partitionBy(*by).orderBy("t")


def windows(df: DataFrame, length: int) -> DataFrame:
    """(series_id, start, w): every window of min(length, n) points, channel-major.
    ``t`` counts without gaps.  Chunks of a series borrow the points that their last windows
    reach, so a long series is many tasks' work."""
    length = max(1, length)
    chunks = haloed(df, 1, length - 1)
    w = _ordered(("series_id", "_c"))
    held = F.collect_list("x").over(w.rowsBetween(0, length - 1))
    out = chunks.select("series_id", F.col("t").alias("start"), held.alias("w"), F.lag("t").over(w).isNull().alias("_first"), "_own")
    out = out.where(F.col("_own") & ((F.size("w") == length) | F.col("_first"))).drop("_first", "_own")
    if df.schema["x"].dataType.typeName() == "array":
        channel = F.transform(F.sequence(F.lit(0), F.size(F.get("w", F.lit(0))) - 1), lambda c: F.transform("w", lambda v: F.get(v, c)))
        out = out.withColumn("w", F.flatten(channel))
    return out


def strided_starts(counts: DataFrame, length: int, stride: int) -> DataFrame:
    """(series_id, start): every stride-th window and the last one, from (series_id, n)."""
    last = F.greatest(F.col("n") - length, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), F.lit(stride).cast("bigint")), F.array(last.cast("bigint"))))
    return counts.select("series_id", F.explode(starts).alias("start"))


def strided_windows(df: DataFrame, length: int, stride: int) -> DataFrame:
    """W02."""
    counts = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return windows(df, length).join(strided_starts(counts, length, stride), ["series_id", "start"])


def patches(df: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """Windows at given starts; ``w`` is null where one leaves the series."""
    return starts.join(windows(df, length).where(F.size("w") >= length), ["series_id", "start"], "left")


def overlap_pairs(df: DataFrame, length: int, deltas: list[int], trim: int = 0) -> DataFrame:
    """(series_id, start, delta, a, b): windows at start and start + delta and, of
    both, the part that they have in common (less ``trim`` points at either end).  Eligible
    starts leave room for the greatest delta."""
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    wide = df.select("series_id", F.col("t").alias("start"), F.collect_list("x").over(_ordered().rowsBetween(0, length + max(deltas) - 1)).alias("w"), n.alias("_n"))
    wide = wide.where(F.col("start") <= F.col("_n") - length - max(deltas))
    out = wide.select("series_id", "start", F.explode(F.array(*[F.lit(d) for d in deltas])).alias("delta"), "w")
    common = length - F.col("delta") - 2 * trim
    first = F.slice("w", F.col("delta") + 1 + trim, common)  # of the window at start
    second = F.slice(F.slice("w", F.col("delta") + 1, F.lit(length)), F.lit(1 + trim), common)
    return out.select("series_id", "start", "delta", first.alias("a"), second.alias("b"))


def to_points(scores: DataFrame, length: int, points: DataFrame) -> DataFrame:
    """The mean score of the windows over each point; null where there is none.
    ``scores`` has (series_id, start, score), ``points`` (series_id, t).  Chunks borrow the
    windows that start before them."""
    held = points.select("series_id", "t").join(scores.withColumnRenamed("start", "t"), ["series_id", "t"], "left")
    mean = F.avg("score").over(_ordered(("series_id", "_c")).rangeBetween(-(length - 1), 0))
    return haloed(held, length - 1, 0).select("series_id", "t", mean.alias("score"), "_own").where("_own").drop("_own")


def tokens_to_points(tokens: DataFrame) -> DataFrame:
    """(series_id, t, score) from windows (series_id, start, scores of each place)."""
    flat = tokens.select("series_id", "start", F.posexplode("scores").alias("pos", "score"))
    return flat.groupBy("series_id", (F.col("start") + F.col("pos")).alias("t")).agg(F.avg("score").alias("score"))


def uncovered(points: DataFrame, scored: DataFrame) -> DataFrame:
    """Points without a score."""
    return points.select("series_id", "t").join(scored, ["series_id", "t"], "left_anti")


def pad_to_points(scores: DataFrame, length: int, points: DataFrame) -> DataFrame:
    """Each window's score at its centre, the ends repeated: ceil((length-1)/2)
    points on the left and floor((length-1)/2) on the right."""
    left = -(-(length - 1) // 2)
    last = scores.groupBy("series_id").agg(F.max("start").alias("_last"))
    at = points.select("series_id", "t").join(last, "series_id").withColumn("start", F.greatest(F.lit(0), F.least(F.col("t") - left, F.col("_last"))))
    return at.join(scores, ["series_id", "start"]).select("series_id", "t", "score")


def acf(df: DataFrame, nlags: int = 400, head: int = 20000) -> DataFrame:
    """(series_id, lag, r) of the first ``head`` points, biased, one mean.
    By the Fourier transform, so the time hardly depends on ``nlags``."""

    @F.pandas_udf("array<double>")
    def correlated(x: pd.Series) -> pd.Series:
        out = []
        for a in x:
            d = np.asarray(a, float)
            d = d - d.mean()
            f = np.fft.rfft(d, 1 << (len(d) + nlags).bit_length())  # padded: no lag wraps around
            top = np.fft.irfft(f.real**2 + f.imag**2)[: min(nlags + 1, len(d))]
            out.append(top / top[0] if top[0] > 0 else [None] * len(top))
        return pd.Series(out)

    part = df.where(F.col("t") < head).groupBy("series_id")
    arrays = part.agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("a"))  # at most ``head`` numbers
    return arrays.select("series_id", F.posexplode(correlated("a")).alias("lag", "r"))


def local_maxima(curve: DataFrame, first: int = 3) -> DataFrame:
    """Strict local maxima of an autocorrelation from lag ``first`` on."""
    w = Window.partitionBy("series_id").orderBy("lag")
    part = curve.where(F.col("lag") >= first)
    return part.withColumn("_a", F.lag("r").over(w)).withColumn("_b", F.lead("r").over(w)).where((F.col("r") > F.col("_a")) & (F.col("r") > F.col("_b"))).drop("_a", "_b")


def period(df: DataFrame, rank: int = 1, fallback: int = 125) -> DataFrame:
    """(series_id, length): the lag of the rank-th highest local maximum, if it lies
    in 3..300 behind lag 3, else ``fallback``."""
    ranked = local_maxima(acf(df)).withColumn("_k", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("r"), "lag"))).where(F.col("_k") == rank)
    best = ranked.select("series_id", F.when((F.col("lag") - 3).between(3, 300), F.col("lag")).alias("_lag"))
    return df.select("series_id").distinct().join(best, "series_id", "left").select("series_id", F.coalesce("_lag", F.lit(fallback)).alias("length"))


def estimate_window(df: DataFrame) -> DataFrame:
    """The highest local maximum's lag, else 125; 100 for several channels."""
    if df.schema["x"].dataType.typeName() == "array":
        return df.select("series_id").distinct().withColumn("length", F.lit(100))
    return period(df, 1)


def window_rule(method: Column, track: Column, period: Column) -> Column:
    """The window length of a detector: for one channel the period; for many 40
    (KMeansAD), 100 (IForest) or 1."""
    return F.when(track == "U", period).when(method == "KMeansAD", 40).when(method == "IForest", 100).otherwise(1)
