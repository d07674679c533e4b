"""Series longer than a task: chunks, ranges and the sweep against plain recomputations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.operators import metrics, ranges, window
from driftlens.sources import series


@pytest.fixture(params=[(1, 4), (1 << 20, 1 << 16)], ids=["ranges", "whole"])
def sizes(request, monkeypatch):
    monkeypatch.setattr(ranges, "LONG", request.param[0])
    monkeypatch.setattr(ranges, "CHUNK", request.param[1])


def points(spark, lengths, seed=0, label=0.2):
    rnd = np.random.default_rng(seed)
    rows = [(s, t, float(np.round(rnd.normal(), 1)), int(rnd.random() < label)) for s, n in lengths.items() for t in range(n)]
    return rows, spark.createDataFrame(rows, "series_id string, t bigint, score double, label int").repartition(3)


def test_numbers_and_running_sums(spark, sizes):
    rnd = np.random.default_rng(1)
    rows = [(None if i % 5 == 0 else "ab"[i % 2], int(rnd.integers(0, 9)), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o int, i int").repartition(4)
    got = {r.i: (r._r, r.s, r.s_all) for r in ranges.running(df, ["g"], ["o", "i"], {"s": F.col("i")}).collect()}
    for g in (None, "a", "b"):
        up = 0
        mine = sorted((o, i) for h, o, i in rows if h == g)
        for r, (_, i) in enumerate(mine):
            up += i
            assert got[i] == (r, up, sum(i for _, i in mine))
    placed = series.series_from_table(df, "g", ["o", "i"], {"x": F.col("i")})
    assert sorted((str(r.series_id), r.t) for r in placed.collect()) == sorted((str(g), got[i][0]) for g, _, i in rows)


@pytest.mark.parametrize("length", [1, 3, 7])
def test_windows_and_the_way_back(spark, sizes, length):
    rows, df = points(spark, {"a": 41, "b": 4, "c": 1, "d": 8})
    got = {(r.series_id, r.start): r.w for r in window.windows(df.withColumnRenamed("score", "x"), length).collect()}
    want = {}
    for s in "abcd":
        x = [r[2] for r in rows if r[0] == s]
        n = min(length, len(x))
        want |= {(s, i): x[i : i + n] for i in range(len(x) - n + 1)}
    assert got == want
    scores = df.where("t % 3 = 0").select("series_id", F.col("t").alias("start"), "score")
    back = {(r.series_id, r.t): r.score for r in window.to_points(scores, length, df).collect()}
    for s, t, _, _ in rows:
        held = [r[2] for r in rows if r[0] == s and r[1] % 3 == 0 and t - length < r[1] <= t]
        assert (back[s, t] is None) == (not held) and (not held or abs(back[s, t] - sum(held) / len(held)) < 1e-12)


def runs_of(labels):
    out, s = [], None
    for t, y in enumerate([*labels, 0]):
        if y and s is None:
            s = t
        elif not y and s is not None:
            out.append((s, t - 1))
            s = None
    return out


@pytest.mark.parametrize("label", [0.0, 0.2, 0.8, 1.0])
def test_segments_cross_chunks(spark, sizes, label):
    rows, df = points(spark, {"a": 60, "b": 9}, 3, label)
    got = sorted((r.series_id, r.segment, r.s, r.e) for r in metrics.segments(df).collect())
    assert got == sorted((s, i, *run) for s in "ab" for i, run in enumerate(runs_of([r[3] for r in rows if r[0] == s]), 1))


def plain_vus(score, label, length, count):
    """Range areas by their definition, every buffer and threshold on its own."""
    n, seg = len(score), runs_of(label)
    order = sorted(score, reverse=True)
    thr = sorted({order[math.floor(k * (n - 1) / (count - 1))] for k in range(count)}, reverse=True)
    roc, pr = [], []
    for b in range(length + 1):
        d = [min((max(s - t, t - e, 0) for s, e in seg), default=math.inf) for t in range(n)]
        soft = [1.0 if x == 0 else math.sqrt(1 - x / b) if x <= b / 2 else 0.0 for x in d]
        ext = runs_of([x > 0 for x in soft])
        p = (sum(label) + sum(soft)) / 2
        before, area_roc, area_pr = (0.0, 0.0), 0.0, 0.0
        for h in thr:
            hit = [x >= h for x in score]
            tp, pred = sum(s for s, x in zip(soft, hit) if x), sum(hit)
            exist = sum(any(hit[s : e + 1]) for s, e in ext) / len(ext)
            tpr, fpr = min(tp / p, 1.0) * exist, (pred - tp) / (n - p)
            area_roc += (fpr - before[1]) * (tpr + before[0]) / 2
            area_pr += (tpr - before[0]) * tp / pred
            before = tpr, fpr
        roc.append(area_roc)
        pr.append(area_pr)
    return sum(roc) / len(roc), sum(pr) / len(pr)


@pytest.mark.parametrize("length,count,label", [(100, 250, 0.004), (10, 6, 0.1), (5, 40, 0.5), (0, 9, 0.3)])
def test_sweep_against_its_definition(spark, sizes, length, count, label):
    rows, df = points(spark, {"a": 500, "b": 70, "c": 30}, length, label)
    df = df.withColumn("label", F.when(F.col("t") == 20, 1).otherwise(F.col("label")))
    got = {r.series_id: (r.vus_roc, r.vus_pr) for r in metrics.vus(df, length, count).collect()}
    for s in "abc":
        mine = [r for r in rows if r[0] == s]
        want = plain_vus([r[2] for r in mine], [1 if r[1] == 20 else r[3] for r in mine], length, count)
        assert np.allclose(got[s], want, atol=1e-9), (s, got[s], want)


def test_far_points_do_not_meet_buffers(spark):
    """What is multiplied by buffers is counted by threshold and distance before."""
    t = spark.range(20_000).select(F.lit("a").alias("series_id"), F.col("id").alias("t"), F.rand(1).alias("score"), (F.col("id") == 9_000).cast("int").alias("label"))
    assert metrics.near_segments(t, 50).count() == 100


@pytest.mark.parametrize("count", [2, 5, 250])
def test_thresholds_are_evenly_spaced_ranks(spark, sizes, count):
    rows, df = points(spark, {"a": 77, "b": 5, "c": 1}, 9)
    got = metrics.thresholds(metrics.ranked(df), count).collect()
    for s in "abc":
        order = sorted((r[2] for r in rows if r[0] == s), reverse=True)
        want = sorted({order[math.floor(k * (len(order) - 1) / (count - 1))] for k in range(count)}, reverse=True)
        assert [r.thr for r in sorted((r for r in got if r.series_id == s), key=lambda r: r.k)] == want


def test_draws_find_their_balls(spark):
    """Each draw takes the ball whose share of the weights it falls in."""
    from driftlens.functions.sampling import uniform
    from driftlens.operators import prefix

    members = spark.createDataFrame([("a", b, 10 * b + i) for b in range(5) for i in range(b * b + 1)], "series_id string, ball bigint, row bigint")
    got = {r.draw: (r.ball, r.row) for r in prefix.tempered_sample(members, 0.5, 400, "t", ["series_id"]).collect()}
    size = [b * b + 1 for b in range(5)]
    ends = np.cumsum(np.sqrt(size)) / np.sqrt(size).sum()
    for r in spark.range(1, 401).select(F.col("id").cast("int").alias("i"), uniform("tball", F.lit("a"), F.col("id")).alias("u"), uniform("trow", F.lit("a"), F.col("id")).alias("v")).collect():
        b = int(np.searchsorted(ends, r.u, "right"))
        assert got[r.i] == (b, 10 * b + int(r.v * size[b]))


def test_scores_are_written_once_a_series(spark, tmp_path):
    from driftlens.operators import records

    df = spark.range(900).selectExpr("id % 3 AS series_id", "id AS t", "1.0D AS score").repartition(8)
    records.write_scores(df, str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("series_id=*/*.parquet"))) == 3
