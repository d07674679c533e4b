"""Covers to convergence and balls that are split in rounds over tables."""

import numpy as np
import pytest

from driftlens.operators import cluster


def rows_of(spark, series):
    rows = [(s, int(i), v.tolist()) for s, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, q bigint, v array<double>").repartition(3)


def blobs(rng, n, at, width=0.1):
    return np.concatenate([rng.normal(c, width, (n, 3)) for c in at])


def balls(df, **kw):
    out = {}
    for r in cluster.granular_partition(df, **kw).collect():
        out.setdefault((r.series_id, r.m), set()).add(r.q)
    return out


@pytest.mark.parametrize("small", [8, 1 << 14])
def test_frontier_gives_the_same_balls(spark, monkeypatch, small):
    """All balls in rounds, large ones only, or none: a plain recursion finds the same."""
    monkeypatch.setattr(cluster, "SMALL", small)
    rng = np.random.default_rng(1)
    series = {"a": blobs(rng, 20, (0, 4, 9)), "b": np.ones((17, 3)), "c": blobs(rng, 2, (0,))}
    got = balls(rows_of(spark, series), k=1, rounds=1)
    for s, x in series.items():
        want = [set(b.tolist()) for b in cluster.refine(x)]
        assert [got[s, m] for m in range(len(want))] == want
        assert sum(k[0] == s for k in got) == len(want)


def test_many_equal_rows_are_one_ball(spark, monkeypatch):
    monkeypatch.setattr(cluster, "SMALL", 1000)
    df = spark.range(200_000).selectExpr("'a' AS series_id", "id AS q", "array(1.0D, 2.0D) AS v")
    parts = cluster.granular_partition(df, k=3, rounds=1).groupBy("m").count().collect()
    assert [(r.m, r["count"]) for r in parts] == [(0, 200_000)]


@pytest.mark.parametrize("small", [1, 1 << 14])
def test_too_many_rounds_fail(spark, monkeypatch, small):
    monkeypatch.setattr(cluster, "SMALL", small)
    x = blobs(np.random.default_rng(2), 20, (0, 4, 9, 20))
    assert len(cluster.refine(x)) >= 4
    with pytest.raises(Exception, match=cluster.DIVERGES):
        balls(rows_of(spark, {"a": x}), k=1, rounds=1, most=1 if small == 1 else 2)


def test_cover_goes_on_until_nothing_moves(spark):
    rng = np.random.default_rng(3)
    x = blobs(rng, 40, (0, 1, 3), 0.5)
    df = rows_of(spark, {"a": x})
    got = {r.q: r.m for r in cluster.coarse_cover(df, 6, None).collect()}
    k, n = 6, len(x)
    seeds = [next(r for r in range(n) if r * k // n == m) for m in range(k)]
    centers, label = x[seeds], None
    while True:
        now = ((x[:, None] - centers) ** 2).sum(2).argmin(1)
        if label is not None and (now == label).all():
            break
        label = now
        centers = np.array([x[label == m].mean(0) for m in range(k)])
    assert [got[i] for i in range(n)] == label.tolist()
