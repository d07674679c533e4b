"""Components of wide rows, and scores of models, against plain recomputations."""

import json

import numpy as np
import pytest

from driftlens import queries
from driftlens.operators import axes, cluster

SCHEMA = "series_id string, q bigint, v array<double>"


def frame(spark, **series):
    return spark.createDataFrame([(s, i, v.tolist()) for s, x in series.items() for i, v in enumerate(x)], SCHEMA).repartition(3)


def plain(x):
    std = x.std(0)
    std[std < 1e-8] = 1
    z = (x - x.mean(0)) / std
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    order = np.argsort(values)[::-1]
    vectors = vectors[:, order].T
    vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
    return x.mean(0), std, np.maximum(values[order], 0) / values.sum(), vectors


def plain_score(query, mean, std, share, comp):
    z = (query - mean) / std
    return np.array([sum(np.linalg.norm(v - c) / max(s, 1e-12) for c, s in zip(comp, share)) for v in z])


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(cluster, "WIDE", 8)
    monkeypatch.setattr(axes, "PANEL", 72)
    monkeypatch.setattr(axes, "PIECE", 40)
    monkeypatch.setattr(axes, "ASKED", 600)


def test_wide_rows_in_panels_equal_one_matrix(spark, narrow):
    rng = np.random.default_rng(5)
    a = rng.normal(0, 1, (300, 18)) @ rng.normal(0, 1, (18, 18))
    b = rng.normal(0, 1, (150, 12)) * np.arange(1, 13)
    c = rng.normal(0, 1, (60, 5))
    df = frame(spark, a=a, b=b, c=c)
    got = cluster.principal_components(df).collect()
    for name, x in (("a", a), ("b", b), ("c", c)):
        mean, std, share, comp = plain(x)
        rows = sorted((r for r in got if r.series_id == name), key=lambda r: r.c)
        assert [r.c for r in rows] == list(range(x.shape[1]))
        assert np.allclose([r.share for r in rows], share, rtol=1e-9, atol=1e-13)
        assert np.allclose([r.comp for r in rows], comp, atol=1e-7)
        assert np.allclose(rows[0].mean, mean) and np.allclose(rows[0].std, std)
    assert axes.PANEL // 18 < 18 / 4  # six blocks, so five rounds a sweep


def test_wide_scores_and_coordinates_equal_plain_ones(spark, narrow):
    rng = np.random.default_rng(6)
    a, c = rng.normal(0, 1, (200, 12)) @ rng.normal(0, 1, (12, 12)), rng.normal(0, 1, (60, 5))
    df = frame(spark, a=a, c=c)
    for variance in (None, 0.6):
        comps = cluster.principal_components(df, variance)
        scores = {(r.series_id, r.q): r.score for r in cluster.pca_distance(comps, df).collect()}
        along = {(r.series_id, r.q): r.v for r in cluster.pca_project(comps, df).collect()}
        assert len(scores) == 260 and len(along) == 260
        for name, x in (("a", a), ("c", c)):
            mean, std, share, comp = plain(x)
            k = len(share) if variance is None else int(np.searchsorted(np.cumsum(share), variance)) + 1
            assert np.allclose([scores[name, i] for i in range(len(x))], plain_score(x, mean, std, share[:k], comp[:k]), rtol=1e-7)
            assert np.allclose([along[name, i] for i in range(len(x))], (x - mean) / std @ comp[:k].T, atol=1e-6)


def test_fewer_rows_than_columns_and_constant_columns(spark, narrow):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (10, 16))
    x[:, 3] = 2.5
    df = frame(spark, a=np.r_[x, x])
    rows = cluster.principal_components(df).orderBy("c").collect()
    mean, std, share, _ = plain(np.r_[x, x])
    comp = np.array([r.comp for r in rows])
    z = (np.r_[x, x] - mean) / std
    assert np.allclose([r.share for r in rows], share, atol=1e-12)
    assert np.allclose(comp @ comp.T, np.eye(16), atol=1e-10)
    assert np.allclose(comp @ (z.T @ z / 20) @ comp.T, np.diag(share * 15), atol=1e-9)


def test_a_query_that_is_a_component_is_at_distance_zero(spark):
    comps = spark.createDataFrame([("a", 0, 1.0, [0.0, 0.0], [1.0, 1.0], [0.6, 0.8])], "series_id string, c int, share double, mean array<double>, std array<double>, comp array<double>")
    asked = frame(spark, a=np.array([[0.6, 0.8], [0.6, 0.8 + 1e-9], [0.0, 0.0]]))
    got = {r.q: r.score for r in cluster.pca_distance(comps, asked).collect()}
    assert got[0] == 0 and got[1] == pytest.approx(1e-9, rel=1e-6) and got[2] == pytest.approx(1)
    assert cluster.pca_distance(comps.where("c < 0"), asked).count() == 0


def test_no_rows_have_no_components(spark, narrow):
    assert cluster.principal_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_forest_scores_equal_a_walk_down_its_trees(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(0, 1, (90, 4)), np.repeat(rng.normal(0, 1, (3, 2)), 10, 0)
    df = frame(spark, a=a, b=b)
    forest = cluster.grow_forest(df, trees=12, psi=32)
    grown = {}
    for r in forest.collect():
        grown.setdefault(r.series_id, []).append((json.loads(r.grown), r.psi))

    def length(n):
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def walk(node, v):
        return node[0] if len(node) == 1 else 1 + walk(node[2] if v[node[0]] < node[1] else node[3], v)

    def levels(node):
        return 0 if len(node) == 1 else 1 + max(levels(node[2]), levels(node[3]))

    got = {(r.series_id, r.q): r.score for r in cluster.forest_score(forest, df).collect()}
    for name, x in (("a", a), ("b", b)):
        assert len(grown[name]) == 12 and all(levels(t) <= 5 for t, _ in grown[name])
        psi = max(p for _, p in grown[name])
        assert psi == min(32, len(x))
        for i, v in enumerate(x):
            mean = np.mean([walk(t, v) for t, _ in grown[name]])
            assert got[name, i] == pytest.approx(2 ** (-mean / length(psi)) - 0.5, rel=1e-12)


def test_c02_over_the_given_tables(spark, sf_dir):
    """The query's rows are few, so one task has a series; windows of four events of a user."""
    value = {}
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("user_id", "ts", "event_id").collect():
        value.setdefault(r.user_id, []).append(r.value)
    want = {}
    for s, x in value.items():
        w = np.array([x[i : i + 4] for i in range(len(x) - 3)])
        known = w[: max(0, len(x) // 2 - 3)]
        if len(known):
            mean, std, share, comp = plain(known)
            k = int(np.searchsorted(np.cumsum(share), 0.25)) + 1
            want |= {(s, i): v for i, v in enumerate(plain_score(w, mean, std, share[:k], comp[:k]))}
    got = {(r.series_id, r.q): r.score for r in queries.QUERIES["c02_pca_score"](spark, sf_dir).collect()}
    assert want and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, rel=1e-6) for k, v in want.items())


def test_rows_without_numbers_have_components(spark):
    """The same ones, whatever partitions they come in."""
    x = np.random.default_rng(8).normal(0, 1, (40, 5))
    numbered = frame(spark, a=x, b=2 * x)
    got = {n: {(r.series_id, r.c): (r.share, r.comp) for r in cluster.principal_components(numbered.drop("q").repartition(n)).collect()} for n in (1, 7)}
    want = {(r.series_id, r.c): r.comp for r in cluster.principal_components(numbered).collect()}
    assert got[1] == got[7] and got[1].keys() == want.keys()
    assert all(np.allclose(got[1][k][1], want[k], atol=1e-9) for k in want)
