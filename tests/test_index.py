"""The pivot index against brute force: ties, duplicates, clusters, several series."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_buffers import widest_shuffle

from driftlens.functions.arrays import dot, squared_distance
from driftlens.operators import neighbors, ranges


def brute(q, m, k, skip):
    """(q, m, d2) of the k nearest, ties by number."""
    out = set()
    for i, v in q:
        d = sorted((float(((np.array(v) - np.array(u)) ** 2).sum()), j) for j, u in m if not (skip and i == j))
        out |= {(i, j, round(x, 9)) for x, j in d[:k]}
    return out


def frames(spark, series):
    q = [(s, i, v) for s, (qs, _) in series.items() for i, v in qs]
    m = [(s, j, u) for s, (_, ms) in series.items() for j, u in ms]
    return spark.createDataFrame(q, "series_id string, q int, v array<double>").repartition(3), spark.createDataFrame(m, "series_id string, m int, u array<double>").repartition(3)


@pytest.mark.parametrize("k,skip,long", [(1, False, 1 << 20), (3, True, 5), (9, False, 5), (200, False, 1 << 20)])
def test_index_gives_the_nearest(spark, monkeypatch, k, skip, long):
    monkeypatch.setattr(neighbors, "BLOCK", 8)
    monkeypatch.setattr(ranges, "LONG", long)
    rng = np.random.default_rng(k)
    grid = lambda n: [(i, rng.integers(0, 4, 3).astype(float).tolist()) for i in range(n)]
    far = lambda n: [(i, (rng.normal(size=3) * 0.1 + 50 * (i % 5)).tolist()) for i in range(n)]
    series = {"grid": (grid(40), grid(60)), "far": (far(30), far(70)), "equal": ([(i, [1.0, 1.0, 1.0]) for i in range(20)], [(i, [1.0, 1.0, 1.0]) for i in range(25)]), "small": (grid(3), grid(2)), "one": (grid(5), grid(1))}
    q, m = frames(spark, series)
    got = {}
    for r in neighbors.nearest(q, m, k, skip_self=skip).collect():
        got.setdefault(r.series_id, set()).add((r.q, r.m, round(r.d2, 9)))
    for s, (qs, ms) in series.items():
        assert got.get(s, set()) == brute(qs, ms, k, skip), s


def test_index_of_unit_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6, 8))[np.arange(150) % 6] + rng.normal(size=(150, 8)) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, m = frames(spark, {"a": (list(enumerate(x[:70].tolist())), list(enumerate(x[70:].tolist())))})
    got = {r.q: r.score for r in neighbors.topk_mean(q, m, 3).collect()}
    d = np.sort(np.maximum(0, 2 - 2 * x[:70] @ x[70:].T), axis=1)[:, :3].mean(1)
    assert np.allclose([got[i] for i in range(70)], d)


def test_index_skips_what_is_far(spark, monkeypatch):
    """Ten distant clusters: most pairs never meet, and the report says so."""
    monkeypatch.setattr(neighbors, "BLOCK", 50)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(10, 4)) * 100, 60, 0) + rng.normal(size=(600, 4))
    q, m = frames(spark, {"a": (list(enumerate(x.tolist())), list(enumerate(x.tolist())))})
    r = neighbors.Index(q, m, 5).report.first()
    assert r.pairs == 600 * 600 and r.compared < 0.4 * r.pairs
    assert r.compared >= 600 * 5


def test_pairs_are_no_rows_for_centres(spark, monkeypatch):
    q, m = frames(spark, {"a": ([(i, [float(i)]) for i in range(100)], [(j, [30.0 * j]) for j in range(4)])})
    plan = neighbors.assign(q, m)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    assert neighbors.min_center_distance(q, m).agg(F.max("score")).first()[0] == 15.0


def test_pairs_of_odd_vectors_come_in_batches(spark):
    """J01 and J02 against the sum over a row: the same digits, and null where a vector is
    null, holds a null or is longer than the other; no batch of a task holds a whole block."""
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=5).tolist() for _ in range(40)] + [None, [1.0, None, 0.0, 0.0, 0.0], [1.0, 2.0], [], [float("nan")] * 5, [float("inf")] * 5]
    q = spark.createDataFrame([(i % 2, i, v) for i, v in enumerate(vectors)], "series_id int, q bigint, v array<double>")
    m = q.where("q % 3 < 2").selectExpr("series_id", "q AS m", "v AS u")
    for unit in (False, True):
        d2 = F.greatest(F.lit(0.0), 2 - 2 * dot(F.col("v"), F.col("u"))) if unit else squared_distance(F.col("v"), F.col("u"))
        key = lambda r: (r.series_id, r.q, r.m, repr(r.d2))
        want = sorted(map(key, q.join(m, "series_id").select("series_id", "q", "m", d2.alias("d2")).collect()))
        found = neighbors.pairwise(q, m, unit=unit)
        assert sorted(map(key, found.collect())) == want and len(want) > 600
        # pairs are made of blocks: no join whose rows are pairs
        assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_copies_grow_as_rows_where_all_pairs_are_rows(spark, monkeypatch):
    """Twice the rows are four times the pairs, in as many tasks and twice the copies."""
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    monkeypatch.setattr(neighbors, "FEWEST", 1, raising=False)
    rng = np.random.default_rng(4)
    for n in (300, 600):
        x = rng.normal(size=(2 * n, 3)).astype(np.float32)
        q = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)] + [(None, -1, [0.0] * 3), (2, -2, [0.0] * 3)], "series_id int, q bigint, v array<float>")
        m = q.where(f"(q < {n} AND series_id = 1) OR series_id IS NULL").selectExpr("series_id", "q AS m", "v AS u")
        found = {}

        def pairs():
            found.update({(r.series_id, r.q, r.m): r.d2 for r in neighbors.pairwise(q, m).collect()})  # noqa: B023

        assert widest_shuffle(spark, pairs) <= 6 * 3 * n
        y = x.astype(float)
        d = y[:, None] - y[None, :n]
        want = (d[..., 0] ** 2 + d[..., 1] ** 2) + d[..., 2] ** 2
        assert found == {(1, i, j): want[i, j] for i in range(2 * n) for j in range(n)}
        rows = q.where("series_id = 1").withColumn("v", F.col("v").cast("array<double>"))
        density = []
        assert widest_shuffle(spark, lambda: density.append(neighbors.pair_density(rows, 0.5).first().density)) <= 10 * 2 * n  # noqa: B023
        d = ((y[:, None] - y) ** 2).sum(2)
        assert density[0] == pytest.approx((d * np.exp(-0.5 * d)).sum())


def test_rounding_is_sparks(spark):
    d = [0.0, 0.5, 1.00005, 1.00015, 2.5e-5, 0.99995, 4.5e-5, 1.00005 - 2e-16, 3e17, float("inf"), 12.34565, 1e-300]
    want = [r.x for r in spark.createDataFrame([(x,) for x in d], "x double").select(F.round("x", 4).alias("x")).collect()]
    assert neighbors._rounded(np.array([d]), 4)[0].tolist() == want


def test_products_round_as_sums_in_order(monkeypatch):
    """Distances near a half of the last place, large vectors and numbers that are none."""
    rng = np.random.default_rng(6)
    q, m = rng.normal(size=(50, 12)), rng.normal(size=(12, 70))
    q /= np.linalg.norm(q, axis=1)[:, None]
    m /= np.linalg.norm(m, axis=0)
    q[:20] = np.round(q[:20], 3)
    m[:, :30] = np.round(m[:, :30], 3)
    q[0], m[:, 0] = 0, 0
    odd = q.copy()
    odd[3, 2], odd[4, 1] = np.nan, np.inf
    near = np.zeros((40, 12))  # 2 - 2 * s is a half of the sixth place, or a digit beside it
    near[:, :3] = [[0.3, 0.4 + 5e-7 * (i + 0.5), 0.2 + 1e-16 * i] for i in range(40)]
    ones = np.zeros((12, 40))
    ones[:3] = 1.0
    for a, b in ((q, m), (1e3 * q, m), (1e9 * q, 1e3 * m), (1e200 * q, 1e200 * m), (odd, m), (near, ones), (q[:0], m)):
        for places in (4, 6):
            with np.errstate(all="ignore"):
                assert np.array_equal(neighbors._unit_rounded(a, b, places), neighbors._rounded(neighbors._unit(a, b), places), equal_nan=True)
    exact, summed = neighbors._rounded, []
    monkeypatch.setattr(neighbors, "_rounded", lambda d, places: summed.append(d.size) or exact(d, places))
    neighbors._unit_rounded(q[20:], m[:, 30:], 6)
    assert sum(summed) < 0.01 * q.shape[0] * m.shape[1]
    neighbors._unit_rounded(near, ones, 6)
    assert sum(summed) >= 1
