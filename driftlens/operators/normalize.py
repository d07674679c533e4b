"""Scalers, softmax and augmentation over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import sanitize
from ..functions.sampling import uniform


def _scale(std):
    return F.when(std < 1e-8, 1.0).otherwise(std)


def fit_scaler(df: DataFrame, by: list[str] = ["series_id"], col: str = "x") -> DataFrame:  # noqa: B006
    """(by, ch, mean, std) of each channel, population deviation."""
    if df.schema[col].dataType.typeName() != "array":
        return df.groupBy(*by).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))
    flat = df.select(*by, F.posexplode(col).alias("ch", "value"))
    return flat.groupBy(*by, "ch").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def apply_scaler(df: DataFrame, scaler: DataFrame, by: list[str] = ["series_id"], col: str = "x") -> DataFrame:  # noqa: B006
    """(value - mean) / std with deviations below 1e-8 as 1; what is not finite is 0.
    The scaler joins by key; one row of arrays a series, so it is small beside the series."""
    if df.schema[col].dataType.typeName() != "array":
        z = (F.col(col) - F.col("mean")) / _scale(F.col("std"))
        return df.join(scaler, by).withColumn(col, sanitize(z, 0.0, 0.0)).drop("mean", "std")
    packed = scaler.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ch", "mean", _scale(F.col("std")).alias("std")))).alias("_s"))
    z = F.zip_with(col, "_s", lambda v, s: sanitize((v - s["mean"]) / s["std"], 0.0, 0.0))
    return df.join(packed, by).withColumn(col, z).drop("_s")


def position_scaler(train: DataFrame, query: DataFrame, by: list[str] = ["series_id"], col: str = "w") -> DataFrame:  # noqa: B006
    """Standardise each place of a window by the training windows' places."""
    return apply_scaler(query, fit_scaler(train, by, col), by, col)


def softmax(df: DataFrame, col: str, by: list[str], temperature: float = 1.0, out: str = "softmax") -> DataFrame:
    """Over the rows of a group, as stable as subtracting the greatest makes it."""
    w = Window.partitionBy(*by)
    e = F.exp((F.col(col) - F.max(col).over(w)) * temperature)
    return df.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def noise_augment(df: DataFrame, sigma_max: float, parts: int, ratios: list[float], seed: str, by: list[str], col: str = "w") -> DataFrame:
    """For each row and ratio a copy with Gaussian noise.  Places are shuffled and
    dealt into ``parts`` bands; band g has deviations in [g, g+1) * sigma_max / parts; a
    place keeps its noise with probability ``ratio``.  A row shuffles its own places, so rows
    stay in their task."""
    keys = [F.col(b) for b in by]
    u = lambda name, pos=F.col("pos"): uniform(seed + name, *keys, F.col("ratio"), pos)
    shuffled = F.array_sort(F.transform(col, lambda x, i: F.struct(u("order", i).alias("o"), i.alias("pos"), x.alias("value"))))
    flat = df.select(*by, col, F.explode(F.array(*[F.lit(r) for r in ratios])).alias("ratio"))
    flat = flat.select(*by, "ratio", F.size(col).alias("_n"), F.posexplode(shuffled).alias("_r", "_e"))
    flat = flat.select(*by, "ratio", "_e.pos", "_e.value", F.floor(F.col("_r") * parts / F.col("_n")).alias("_band"))
    sigma = (F.col("_band") + u("sigma")) * sigma_max / parts
    gauss = F.sqrt(-2 * F.ln(1 - u("a"))) * F.cos(2 * 3.141592653589793 * u("b"))
    noise = F.when(u("keep") < F.col("ratio"), sigma * gauss).otherwise(0.0)
    return flat.select(*by, "ratio", "pos", "value", noise.alias("noise"))


def noise_targets(noisy: DataFrame, by: list[str], ratio: float | None = None) -> DataFrame:
    """(by, ratio, pos, value, target): clean places have target 0, noisy ones the
    size of their noise; ratio 0 is the clean row.  Copies of a row share its clean places:
    with ``ratio``, which every row has one copy of, they are taken from that copy, else all
    copies are compared."""
    target = lambda r, value, target: F.struct(r.alias("ratio"), "pos", value.alias("value"), target.alias("target"))
    clean, own = target(F.lit(0.0), F.col("value"), F.lit(0.0)), target(F.col("ratio"), F.col("value") + F.col("noise"), F.abs("noise"))
    if ratio is None:
        return noisy.select(*by, clean.alias("_t")).distinct().unionByName(noisy.select(*by, own.alias("_t"))).select(*by, "_t.*")
    both = F.when(F.col("ratio") == ratio, F.array(clean, own)).otherwise(F.array(own))
    return noisy.select(*by, F.explode(both).alias("_t")).select(*by, "_t.*")
