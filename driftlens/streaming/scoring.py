"""Scoring a stream with scalers and detectors that were fitted in batch (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.detect import fitted
from ..plans.registry import detector


def score_stream(events: DataFrame, scaler: DataFrame, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """(series_id, window, n, score): the mean absolute z-score of each series' values in
    each window of event time.  ``events`` is a stream (series_id, ts, x); ``scaler`` a
    table (series_id, mean, std)."""
    z = F.abs((F.col("x") - F.col("mean")) / F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")))
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).join(scaler, "series_id").groupBy("series_id", F.window("ts", window)).agg(F.count(F.lit(1)).alias("n"), F.avg(z).alias("score"))


def score_windows(stream: DataFrame, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Score a stream of scaled windows (series_id, q, v) from the tables that
    ``fit_detector`` wrote to ``folder``.  Each batch goes to its own folder ``out/batch=n``,
    which a repeated batch writes over, so a restart neither loses nor doubles scores."""
    method, _, _, state = fitted(stream.sparkSession, folder)

    def score(batch: DataFrame, n: int) -> None:
        detector(method).score(state, batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
