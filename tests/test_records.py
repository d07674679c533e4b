"""Keys by structure, fingerprints by ranges, correlations by the Fourier transform."""

import json

import numpy as np
import pytest
from pyspark.errors import PySparkException

from driftlens.operators import records, window


def walk(value, path="$"):
    if isinstance(value, dict):
        for k, v in value.items():
            yield k, f"{path}.{k}"
            yield from walk(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")


def test_keys_at_any_depth(spark):
    deep = 7
    for _ in range(12):
        deep = [{"w": deep}]
    values = [
        {"k": 1, "a": {"k": {"k": None}}},
        {"note": '"k": 1', "b": [1, [2, {"k": [{"k": 0}]}]]},
        [], {}, 5, "k", None, deep, {"a": {"b": {"c": {"scores": []}}}},
    ]
    texts = [(i, json.dumps(v)) for i, v in enumerate(values)]
    odd = [(100, None), (101, ""), (102, '{"k": 1'), (103, '{"a": {"k": 1}, "a": 2}')]
    df = spark.createDataFrame(texts + odd, "pos int, value string")  # names that the walk uses too
    got = sorted((r.pos, r.key, r.path or "") for r in records.key_paths(df, ["pos"], "value", ["k", "w", "scores"]).collect())
    want = [(i, k, p) for i, v in enumerate(values) for k, p in walk(v) if k in ("k", "w", "scores")]
    assert got == sorted(want + [(102, "k", ""), (103, "k", "")])
    assert records.key_paths(df.where("false"), ["pos"], "value", ["k"]).count() == 0


def test_fingerprints_by_ranges(spark):
    rows = [(i, None if i % 7 == 0 else f"v{i % 5}") for i in range(500)]
    make = lambda r, n: records.freeze_ranges(spark.createDataFrame(r, "id int, v string").repartition(n), ["id"], 16)
    a, b = make(rows, 3), make(rows[::-1], 7)
    assert records.changed_ranges(a, b).count() == 0
    assert records.freeze_root(a).collect() == records.freeze_root(b).collect()
    assert records.freeze_root(a).first().n == 500
    for other in ([*rows[:77], (77, "new"), *rows[78:]], rows[:-1], rows + rows[-1:]):
        c = make(other, 4)
        changed = records.changed_ranges(c, a).collect()
        assert len(changed) == 1
        assert changed[0].n - changed[0].n_old == len(other) - len(rows)
        assert records.freeze_root(c).first().fingerprint != records.freeze_root(a).first().fingerprint
    assert len(records.changed_ranges(a, make([(1, "x")], 1).where("false")).collect()) == 16


def test_several_locks_are_none(spark):
    new = spark.createDataFrame([("f", 1)], "fingerprint string, n bigint")
    lock = lambda *f: spark.createDataFrame([(x,) for x in f], "fingerprint string")
    assert records.check_lock(new, lock("f", "f")).first().fingerprint == "f"
    assert records.check_lock(new, lock("f").where("false")).first().fingerprint == "f"
    for old in (lock("g"), lock("f", "g")):
        with pytest.raises(PySparkException, match="lock"):
            records.check_lock(new, old).collect()


@pytest.mark.parametrize("nlags", [3, 400])
def test_correlations(spark, nlags):
    rnd = np.random.default_rng(2)
    series = {"long": np.sin(np.arange(1000) / 9) + rnd.normal(size=1000) + 1e3, "short": rnd.normal(size=5), "one": np.ones(1), "flat": np.ones(50)}
    df = spark.createDataFrame([(s, t, float(x)) for s, xs in series.items() for t, x in enumerate(xs)], "series_id string, t bigint, x double")
    got = {(r.series_id, r.lag): r.r for r in window.acf(df, nlags).collect()}
    assert len(got) == sum(min(nlags + 1, len(x)) for x in series.values())
    for (s, k), r in got.items():
        d = series[s] - series[s].mean()
        if d @ d == 0:
            assert r is None
        else:
            assert abs(r - d[: len(d) - k] @ d[k:] / (d @ d)) < 1e-9


def test_key_diff_meets_in_parts(spark, monkeypatch):
    """A06 as EXCEPT both ways: keys twice, nulls, and as many parts as keys ask for."""
    monkeypatch.setattr(records, "KEYS", 4)
    e = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), (None, 2), ("c", 3), (None, None)], "m string, f int")
    s = spark.createDataFrame([("c", 3), ("b", None), ("d", 4), ("d", 4), (None, 9)], "m string, f int")
    out = records.key_diff(e, s, ["m", "f"])
    want = {(*k, "missing") for k in set(map(tuple, e.collect())) - set(map(tuple, s.collect()))} | {(*k, "unexpected") for k in set(map(tuple, s.collect())) - set(map(tuple, e.collect()))}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want) == 5
    assert out.rdd.getNumPartitions() == 3
