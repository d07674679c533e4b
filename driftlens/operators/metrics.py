"""Evaluation metrics (M01-M09) over rows (by, score, label) or (by, t, score, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import sanitize
from ..sources.scratch import dropped, written
from . import ranges
from .buffers import areas
from .ranges import haloed, longest, numbered_runs, running
from .records import METRICS, finite
from .sweep import every_range_f1

BY = ["series_id"]


def score_curve(df: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, score, tp, fp, pos, neg): predictions of at least each distinct score.
    Equal scores are added up before anything is sorted; many distinct scores are sorted
    and summed up by ranges."""
    return ranked(df, by).drop("p", "m")


def ranked(df: DataFrame, by: list[str] = BY) -> DataFrame:
    """M01 with the points ``p`` (label 1) and ``m`` (label 0) of each score itself: the one
    ranking that all metrics of a series share."""
    g = df.groupBy(*by, "score").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("_n")).select(*by, "score", "p", (F.col("_n") - F.col("p")).alias("m"))
    out = running(g, by, [F.desc("score")], {"tp": F.col("p"), "fp": F.col("m")})
    return out.select(*by, "score", "tp", "fp", F.col("tp_all").alias("pos"), F.col("fp_all").alias("neg"), "p", "m")


def curve_metrics(curve: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, auc_roc, auc_pr, best_f1); null without both kinds of labels."""
    c = curve
    if "p" not in curve.columns:
        w = Window.partitionBy(*by).orderBy(F.desc("score"))
        own = lambda n: F.col(n) - F.coalesce(F.lag(n).over(w), F.lit(0))
        c = curve.withColumn("p", own("tp")).withColumn("m", own("fp"))
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.try_divide("tp", "pos")
    both = F.max(F.col("pos") * F.col("neg")) > 0
    roc = F.try_divide(F.sum(F.col("m") * (2 * F.col("tp") - F.col("p")) / 2.0), F.max(F.col("pos") * F.col("neg")))
    pr = F.sum(F.try_divide("p", "pos") * precision)
    f1 = F.max(2 * precision * recall / (precision + recall + 1e-5))
    return c.groupBy(*by).agg(F.when(both, roc).alias("auc_roc"), F.when(both, pr).alias("auc_pr"), F.when(both, f1).alias("best_f1"))


def segments(df: DataFrame, by: list[str] = BY, col: str = "label") -> DataFrame:
    """(by, segment, s, e): maximal runs of 1, numbered from 1 in order of time."""
    return numbered_runs(df.where(F.col(col) == 1), by)


def thresholds(curve: DataFrame, count: int, by: list[str] = BY) -> DataFrame:
    """(by, thr, k): the distinct scores at ``count`` evenly spaced ranks, numbered from the
    highest.  A score of the curve holds the ranks from those above it up to its own last;
    rank floor(k (n - 1) / (count - 1)) is among them for some k or not (``is_threshold``)."""
    hit = curve.where(is_threshold(count)).select(*by, F.col("score").alias("thr"))
    return hit.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("thr"))))


def is_threshold(count: int) -> Column:
    """Whether the score of a row of ``ranked`` is one of ``count`` ``thresholds``."""
    above, last, n1 = F.col("tp") + F.col("fp") - F.col("p") - F.col("m"), F.col("tp") + F.col("fp"), F.greatest(F.col("pos") + F.col("neg") - 1, F.lit(1))
    least = F.ceil(above * (count - 1) / n1)  # the first k whose rank is not above
    return (least <= count - 1) & (F.floor(least * n1 / (count - 1)) < last)


def placed(df: DataFrame, counts: dict[str, int], by: list[str] = BY) -> DataFrame:
    """The points (by, t, score, label) with their place in their series' ranking: for each
    name of ``counts`` the number, from 1, of the first of so many thresholds that the score
    reaches (null: of none).  One point of each score (``first``) also has its row of
    ``ranked``.  A series of at most LONG points is ranked by one task as it stands; in longer
    ones scores are added up, ranked by ranges and joined."""
    long, keep = longest(df, by) > ranges.LONG, ["tp", "fp", "pos", "neg", "p", "m"]
    df, w = df.select(*by, "t", "score", "label"), Window.partitionBy(*by)
    if long:
        one = written(ranked(df, by).withColumn("first", F.lit(True)), "ranking")
    else:
        down, before = w.orderBy(F.desc("score")), w.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
        one = df.select("*", F.sum("label").over(down).alias("tp"), F.count(F.lit(1)).over(down).alias("_last"), F.sum("label").over(w).alias("pos"), F.count(F.lit(1)).over(w).alias("_n"), F.coalesce(F.sum("label").over(before), F.lit(0)).alias("_tp"), (F.row_number().over(down) - 1).alias("_at"), (F.rank().over(down) - 1).alias("_above"))
        one = one.withColumns({"first": F.col("_at") == F.col("_above"), "fp": F.col("_last") - F.col("tp"), "neg": F.col("_n") - F.col("pos"), "p": F.col("tp") - F.col("_tp")})
        one = one.withColumn("m", F.col("_last") - F.col("_above") - F.col("p")).drop("_last", "_n", "_tp", "_at", "_above")
    # a score among the thresholds is as many as there are down to it, others the next one
    hits = {f"_{n}": is_threshold(c) & F.col("first") & F.col("score").isNotNull() for n, c in counts.items()}
    one = one.withColumns(hits)
    sums = {n: F.col(f"_{n}").cast("int") for n in counts}
    if long:
        one = running(one, by, [F.desc("score")], sums, True).drop("_r")
    else:
        one = one.select("*", *[F.sum(c).over(w.orderBy(F.desc("score"))).alias(n) for n, c in sums.items()], *[F.sum(c).over(w).alias(f"{n}_all") for n, c in sums.items()])
    for n, c in counts.items():
        k = F.col(n) + F.when(is_threshold(c), 0).otherwise(1)
        one = one.withColumn(n, F.when(F.col("score").isNotNull() & (k <= F.col(f"{n}_all")), k.cast("int")))
    if not long:
        own = [F.when(F.col("first"), F.col(c)).alias(c) for c in keep]
        return one.select(*by, "t", "score", "label", *counts, "first", *own)
    curve = written(one.select(*by, "score", *counts, *keep), "curve")
    points = df.join(curve.select(*by, "score", *counts), [*by, "score"], "left").select(*by, "t", "score", "label", *counts, F.lit(False).alias("first"), *[F.lit(None).cast("bigint").alias(c) for c in keep])
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    return points.unionByName(curve.select(*by, none("t", df.schema["t"].dataType), "score", none("label", df.schema["label"].dataType), *counts, F.lit(True).alias("first"), *keep))


def range_f1(df: DataFrame, count: int = 20, alpha: float = 0.2, by: list[str] = BY) -> DataFrame:
    """(by, range_f1): range precision and recall with flat bias and reciprocal
    cardinality, the best over ``count`` score quantiles.

    A point counts from the first threshold that its score reaches, so these levels stand for
    scores and all their thresholds are swept (``every_range_f1``): points are multiplied by
    no threshold, and no task holds a series.  Below the last threshold a point never counts."""
    return level_range_f1(placed(df, {"level": count}, by), alpha, by)


def level_range_f1(points: DataFrame, alpha: float, by: list[str]) -> DataFrame:
    levels = points.where("t IS NOT NULL").select(*by, "t", "label", (-F.col("level").cast("double")).alias("score"))
    return every_range_f1(levels, alpha, by).select(*by, "range_f1")


def near_segments(df: DataFrame, reach: int, by: list[str] = BY) -> DataFrame:
    """The points of df outside segments, at most ``reach`` from one: ``d``, the distance from
    the nearest segment, and ``edge``, its nearest point (the earlier one on ties).  Chunks
    borrow ``reach`` points at either end; ``by`` is the series."""
    held = haloed(df, reach, reach)
    w = Window.partitionBy(*by, "_c")
    hit = F.when(F.col("label") == 1, F.col("t"))
    back, ahead = F.last(hit, ignorenulls=True).over(w.orderBy("t")), F.last(hit, ignorenulls=True).over(w.orderBy(F.desc("t")))
    d = held.withColumn("_b", back).withColumn("_a", ahead).where(F.col("_own") & (F.col("label") != 1))
    d = d.withColumn("d", F.least(F.col("t") - F.col("_b"), F.col("_a") - F.col("t"))).where(F.col("d") <= reach)
    return d.withColumn("edge", F.when(F.col("t") - F.col("_b") == F.col("d"), F.col("_b")).otherwise(F.col("_a"))).drop("_b", "_a", "_c", "_own")


def vus(df: DataFrame, length: int, count: int = 250, by: list[str] = BY) -> DataFrame:
    """(by, vus_roc, vus_pr): range areas averaged over buffers 0..length.

    A sweep: every point falls between two thresholds once, and only those within length / 2
    of a segment vary with the buffer.  A chunk of a series counts its points by (threshold,
    distance) and the segments of each widening by the first threshold that reaches them;
    counts, not points, meet buffers (``buffers.areas``)."""
    return areas(placed(df, {"k": count}, by).where("t IS NOT NULL"), length, count, by)


def evaluate(df: DataFrame, length: int = 10, count: int = 250, by: list[str] = BY) -> DataFrame:
    """All six metrics of each series, and whether all are finite numbers.  Scores that
    are not finite are replaced first (F06); one ranking serves all metrics."""
    df = written(df.select(*by, "t", sanitize(F.col("score")).alias("score"), "label"), "scores")
    points = written(placed(df, {"k": count, "level": 20}, by), "placed")
    dropped(df)
    out = curve_metrics(points.where("first"), by).join(level_range_f1(points, 0.2, by), by, "left").join(areas(points.where("t IS NOT NULL"), length, count, by), by, "left")
    return out.select(*by, *METRICS, finite(*METRICS).alias("finite"))


def series_profile(df: DataFrame, meta: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, points, channels, prefix_anomalies)."""
    channels = F.max(F.size("x")) if df.schema["x"].dataType.typeName() == "array" else F.lit(1)
    held = df.join(meta.select("series_id", "train_index"), "series_id")
    inside = (F.col("t") < F.col("train_index")) & (F.col("label") == 1)
    return held.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), channels.alias("channels"), F.count_if(inside).alias("prefix_anomalies"))
