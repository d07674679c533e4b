"""From series to point scores and metrics, in one plan for all series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import evaluate
from ..operators.normalize import apply_scaler, fit_scaler
from ..operators.prefix import prefix
from ..operators.window import to_points, windows
from ..sources.scratch import written
from ..sources.series import meta_of
from .registry import State, detector


#: Series whose scaler goes to every task.
FEW = 1 << 16


def windowed(series: DataFrame, meta: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Training and query windows (series_id, q, v) of scaled series; the scaler and the
    training windows come from the prefix only."""
    points = series.select("series_id", "t", "x")
    scaler = fit_scaler(prefix(points, meta))
    # left to itself Spark may send the points to the scaler, whose few rows are one task
    scaler = F.broadcast(scaler) if meta.count() <= FEW else scaler.hint("shuffle_hash")
    scaled = apply_scaler(points, scaler)
    w = windows(scaled, length).select("series_id", F.col("start").alias("q"), F.col("w").alias("v"))
    train = w.join(meta.select("series_id", "train_index"), "series_id").where(F.col("q") + length <= F.col("train_index")).drop("train_index")
    return train, w


def point_scores(series: DataFrame, method: str = "knn", length: int = 4) -> DataFrame:
    """(series_id, t, score); labels are not read."""
    meta = meta_of(series)
    train, query = windowed(series, meta, length)
    scored = detector(method)(train, query).select("series_id", F.col("q").alias("start"), "score")
    return to_points(scored, length, series)


def fit_detector(series: DataFrame, folder: str, method: str = "knn", length: int = 4) -> None:
    """Learn a detector from each series' training half and write all that it has learnt to
    ``folder``: the scaler, the detector's tables and a table with its name and length, last,
    so that a folder with it is whole.  An existing folder is never written over."""
    spark = series.sparkSession
    train, _ = windowed(series, meta_of(series), length)
    fit_scaler(prefix(series.select("series_id", "t", "x"), meta_of(series))).write.parquet(f"{folder}/scaler")
    state = detector(method).fit(train)
    for name, table in state.items():
        table.write.parquet(f"{folder}/state/{name}")
    spark.range(1).select(F.lit(method).alias("method"), F.lit(length).alias("length"), F.lit(",".join(sorted(state))).alias("tables")).write.parquet(f"{folder}/about")


def fitted(spark: SparkSession, folder: str) -> tuple[str, int, DataFrame, State]:
    """(method, length, scaler, state) as ``fit_detector`` wrote them."""
    about = spark.read.parquet(f"{folder}/about").first()
    return about.method, about.length, spark.read.parquet(f"{folder}/scaler"), {n: spark.read.parquet(f"{folder}/state/{n}") for n in about.tables.split(",")}


def score_fitted(series: DataFrame, folder: str) -> DataFrame:
    """(series_id, t, score) of any points of the series that were learnt, the same as in
    ``point_scores`` if they are the same points; nothing is learnt again.  Series that were
    not learnt have no scores."""
    method, length, scaler, state = fitted(series.sparkSession, folder)
    scaled = apply_scaler(series.select("series_id", "t", "x"), scaler)
    w = windows(scaled, length).select("series_id", F.col("start").alias("q"), F.col("w").alias("v"))
    scored = detector(method).score(state, w).select("series_id", F.col("q").alias("start"), "score")
    known = series.select("series_id", "t").join(scaler.select("series_id").distinct(), "series_id", "left_semi")
    return to_points(scored, length, known)


def detect_and_evaluate(series: DataFrame, method: str = "knn", length: int = 4, buffer: int = 10, count: int = 250) -> DataFrame:
    """(series_id, the six metrics, finite): labels join the finished scores.  The series and
    the scores are written first, as windows, neighbours and metrics read them several times."""
    series = written(series.select("series_id", "t", "x", "label"), "series")
    scored = written(point_scores(series, method, length), "scores")
    held = scored.join(series.select("series_id", "t", "label"), ["series_id", "t"]).withColumn("score", F.round("score", 9))
    return evaluate(held, buffer, count)
