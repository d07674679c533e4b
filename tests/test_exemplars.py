"""Short series are covered, split and remembered by one task each, as by tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_buffers import widest_shuffle

from driftlens.operators import axes, cluster
from driftlens.sources import series as S

SCHEMA = "series_id string, q bigint, v array<double>"


def frame(spark, series):
    return spark.createDataFrame([(s, i, v.tolist()) for s, x in series.items() for i, v in enumerate(x)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def drawn():
    rng = np.random.default_rng(3)
    return {"a": rng.normal(size=(61, 3)), "b": np.ones((9, 3)), "c": rng.normal(size=(1, 3)), "d": np.r_[np.full((1, 3), np.nan), rng.normal(size=(20, 3))]}


def test_one_task_gives_what_tables_give(spark, monkeypatch, drawn):
    """Cover, balls and exemplars; rows without distances belong nowhere."""
    df = frame(spark, {s: drawn[s] for s in "abc"})

    def found(small):
        monkeypatch.setattr(cluster, "SMALL", small)
        cover = {(r.series_id, r.q): r.m for r in cluster.coarse_cover(df, rounds=2).collect()}
        balls = {(r.series_id, r.q): r.m for r in cluster.granular_partition(df).collect()}
        members = df.withColumn("m", F.col("q") % 7)
        kept = {(r.series_id, r.m): (r.q, tuple(r.u)) for r in cluster.exemplar_memory(members).collect()}
        return cover, balls, kept

    assert found(1 << 14) == found(9)  # all short, one long


def test_rows_that_are_no_numbers_are_in_no_ball(spark, drawn):
    got = {r.q for r in cluster.coarse_cover(frame(spark, {"d": drawn["d"]})).collect()}
    assert got == set(range(1, 21))


def test_coordinates_in_one_task_equal_blocks(spark, monkeypatch, drawn):
    train = frame(spark, {"a": drawn["a"], "b": drawn["b"]})
    comps = cluster.principal_components(train, 0.8)
    asked = frame(spark, {s: drawn[s] for s in "abc"})

    def found():
        return {(r.series_id, r.q): r.v for r in cluster.pca_project(comps, asked).collect()}

    one = found()
    monkeypatch.setattr(axes, "WHOLE", 0)
    blocks = found()
    assert one.keys() == blocks.keys() and len(one) == 70  # c has no components
    assert all(np.allclose(one[k], blocks[k], atol=1e-12) for k in one)


def test_equal_series_have_equal_scores(spark):
    """Balls of two are ties, which last digits of sums decide."""
    rng = np.random.default_rng(4)
    one = rng.normal(size=60)
    points = spark.createDataFrame([(s, t, float(x)) for s in range(300) for t, x in enumerate(one)], "series_id bigint, t bigint, x double").repartition(5)
    scored = cluster.exemplar_points(points, S.meta_of(points), 8, variance=0.95)
    apart = scored.groupBy("t").agg((F.max("score") - F.min("score")).alias("d"), F.count("score").alias("n")).collect()
    assert len(apart) == 60 and all(r.d == 0 and r.n == 300 for r in apart)


def test_fitting_shuffles_rows_few_times(spark):
    """Rounds of the cover and splits are no shuffles of their own."""
    rows = spark.range(3_000).select((F.col("id") % 60).alias("series_id"), F.col("id").alias("q"), F.array(F.rand(1), F.rand(2)).alias("v"))
    assert widest_shuffle(spark, lambda: cluster.granular_partition(rows).collect()) <= 3_000
