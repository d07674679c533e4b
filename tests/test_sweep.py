"""Range F1 over every score against a plain recomputation at each threshold."""

import numpy as np
import pyarrow as pa
import pytest

from driftlens.operators import metrics, ranges, sweep


def runs(flags):
    out, s = [], None
    for t, y in enumerate([*flags, False]):
        if y and s is None:
            s = t
        elif not y and s is not None:
            out.append((s, t - 1))
            s = None
    return out


def plain(scores, labels, alpha=0.2):
    real = runs([y == 1 for y in labels])
    known = {x for x in scores if x is not None}
    if not real or not known:
        return None
    best = 0.0
    for thr in known:
        found = runs([x is not None and x >= thr for x in scores])

        def part(one, others):
            met = [min(one[1], o[1]) - max(one[0], o[0]) + 1 for o in others if o[0] <= one[1] and o[1] >= one[0]]
            return sum(met) / (one[1] - one[0] + 1) / max(1, len(met)), bool(met)

        recall = np.mean([alpha * hit + (1 - alpha) * share for share, hit in (part(r, found) for r in real)])
        precision = np.mean([part(p, real)[0] for p in found])
        if recall + precision > 0:
            best = max(best, 2 * recall * precision / (recall + precision))
    return best


@pytest.mark.parametrize("sizes", [(1, 4), (1 << 20, 1 << 16)], ids=["ranges", "whole"])
def test_every_threshold(spark, monkeypatch, sizes):
    monkeypatch.setattr(ranges, "LONG", sizes[0])
    monkeypatch.setattr(ranges, "CHUNK", sizes[1])
    rnd = np.random.default_rng(5)
    series = {
        "ties": ([float(x) for x in rnd.integers(0, 4, 90)], rnd.random(90) < 0.3),
        "rising": ([float(x) for x in range(60)], rnd.random(60) < 0.5),
        "falling": ([float(-x) for x in range(60)], rnd.random(60) < 0.5),
        "waves": ([round(float(np.sin(t / 3) + rnd.normal() / 5), 2) for t in range(110)], np.arange(110) % 19 < 6),
        "gaps": ([None if rnd.random() < 0.2 else float(rnd.integers(0, 9)) for _ in range(70)], rnd.random(70) < 0.4),
        "equal": ([1.0] * 33, np.arange(33) % 5 == 0),
        "one": ([2.0], [1]),
        "all": ([float(x) for x in rnd.normal(size=40)], np.ones(40)),
        "none": ([float(x) for x in rnd.normal(size=20)], np.zeros(20)),
        "unscored": ([None] * 9, np.ones(9)),
    }
    rows = [(n, t, x, int(y)) for n, (xs, ys) in series.items() for t, (x, y) in enumerate(zip(xs, ys))]
    df = spark.createDataFrame(rows, "series_id string, t bigint, score double, label int").repartition(5)
    got = {r.series_id: r for r in sweep.every_range_f1(df).collect()}
    want = {n: plain(xs, [int(y) for y in ys]) for n, (xs, ys) in series.items()}
    assert set(got) == {n for n, f in want.items() if f is not None}
    for n, r in got.items():
        assert abs(r.range_f1 - want[n]) < 1e-9, n
    # quantiles can only find less
    for r in metrics.range_f1(df.where("series_id IN ('ties', 'waves')")).collect():
        assert r.range_f1 <= got[r.series_id].range_f1 + 1e-9
    assert sweep.every_range_f1(df.where("false")).count() == 0


def test_matching_short_and_long_chunks_in_batches(spark, monkeypatch):
    """Points of many chunks are matched in one batch and of one chunk across batches; range F1
    at quantiles sweeps levels and multiplies points by no threshold."""
    rng = np.random.default_rng(5)
    s = rng.integers(0, 6, 400).astype(float).tolist()
    new = [i % 50 == 0 or i in (7, 391) for i in range(400)]
    before, behind, first = sweep._smaller(s, new)
    group = np.cumsum(new)
    for i, x in enumerate(s):
        lower = [j for j in range(400) if group[j] == group[i] and s[j] < x]
        back, ahead = max((j for j in lower if j < i), default=-1), min((j for j in lower if j > i), default=-1)
        assert (before[i], behind[i]) == (back, ahead)
        assert first[i] == (not any(s[j] == x and group[j] == group[i] and j > back for j in range(i)))
    monkeypatch.setattr(sweep, "MATCHED", 8)
    batches = [pa.RecordBatch.from_pydict({"_g": list(g)}) for g in ([], [1] * 5, [1] * 20, [2, 2, 3], [3] * 9, [4], [5] * 40, [6])]
    cut = list(sweep._whole_groups(iter(batches)))
    assert [g for rows, _ in cut for g in rows.column("_g").to_pylist()] == [1] * 25 + [2] * 2 + [3] * 10 + [4] + [5] * 40 + [6]
    assert sum(int(n.sum()) for _, n in cut) == 6 and len(cut) > 1
    df = spark.range(40).selectExpr("id DIV 20 AS series_id", "id % 20 AS t", "CAST(hash(id) % 5 AS double) AS score", "CAST(id % 7 < 2 AS int) AS label")
    got = metrics.range_f1(df)
    assert "thr" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 2
