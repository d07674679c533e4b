"""Detectors that learn once and score later, from tables, in batch and in a stream."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from driftlens.plans import detect, registry
from driftlens.sources import series as S
from driftlens.streaming.scoring import score_windows


@pytest.fixture(scope="module")
def points(spark):
    rnd = np.random.default_rng(4)
    rows = [(s, t, float(np.sin(t / 3) + rnd.normal() / 9 + (9 if (s, t) == ("a", 70) else 0))) for s in "ab" for t in range(90)]
    return spark.createDataFrame(rows, "series_id string, t bigint, x double").repartition(3)


@pytest.mark.parametrize("method", [m for m in registry.detectors() if not m.endswith("_many")])
def test_learnt_once_scored_twice(spark, points, tmp_path, method):
    folder = f"{tmp_path}/{method}"
    detect.fit_detector(points, folder, method, 4)
    collect = lambda df: {(r.series_id, r.t): r.score for r in df.collect()}
    want = collect(detect.point_scores(points, method, 4))
    for _ in range(2):
        got = collect(detect.score_fitted(points, folder))
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    more = spark.createDataFrame([("new", 0, 1.0)], points.schema)
    assert collect(detect.score_fitted(more, folder)) == {}
    with pytest.raises(AnalysisException, match="(?i)already exists"):
        detect.fit_detector(points, folder, method, 4)


def test_a_stream_is_scored_from_the_same_tables(spark, points, tmp_path):
    folder = f"{tmp_path}/fitted"
    detect.fit_detector(points, folder, "kmeans", 4)
    _, w = detect.windowed(points, S.meta_of(points), 4)
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for i in range(3):
        w.where(F.col("q") % 3 == i).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(w.schema).option("maxFilesPerTrigger", 1).parquet(source)
    score_windows(stream, folder, out, f"{tmp_path}/state").awaitTermination()
    got = {(r.series_id, r.q): r.score for r in spark.read.parquet(out).collect()}
    method, _, _, state = detect.fitted(spark, folder)
    want = {(r.series_id, r.q): r.score for r in registry.detector(method).score(state, w).collect()}
    assert got == pytest.approx(want)
    assert spark.read.parquet(out).select("batch").distinct().count() >= 3
    # a second run finds nothing new
    score_windows(stream, folder, out, f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(out).count() == len(want)


def test_detectors_of_one_function_still_work(spark, points):
    registry.register_detector("first", lambda train, query: query.select("series_id", "q", F.lit(1.0).alias("score")))
    try:
        assert {r.score for r in detect.point_scores(points, "first", 4).collect()} == {1.0}
    finally:
        registry._DETECTORS.pop("first")
