"""The library's queries against their SQL, and properties where there is no SQL."""

import json
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftlens import queries
from driftlens.operators import normalize
from driftlens.operators import cluster, metrics, neighbors, prefix, records, window
from driftlens.plans import detect, registry
from driftlens.sources import series

@pytest.fixture(scope="module")
def con(sf_tables):
    con = duckdb.connect()
    for t, path in sf_tables.items():
        con.sql(f"create view {t} as select * from '{path}'")
    return con


@pytest.fixture(scope="module")
def sf_tables():
    return {t: f"/root/testdata/sf0.001/{t}.parquet" for t in ("events", "documents", "embeddings", "labels", "orders", "customer", "nation", "part")}


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, con, name):
    want = con.sql(queries.ORACLES[name])
    rows, names = want.fetchall(), want.columns
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(plain(tuple(r))) for r in got.select(*names).collect()) == sorted(repr(plain(r)) for r in rows)


def test_blocks_give_the_nearest(spark, monkeypatch):
    """Neighbours found block by block are those of brute force, ties by number."""
    monkeypatch.setattr(neighbors, "BLOCK", 7)
    monkeypatch.setattr(neighbors, "PAIRS", 20)
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 3, (30, 2)).astype(float), rng.integers(0, 3, (25, 2)).astype(float)
    q = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)] + [("b", 1, [0.0, 0.0])], "series_id string, q bigint, v array<double>")
    m = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(y)], "series_id string, m bigint, u array<double>")
    got: dict = {}
    for r in neighbors.nearest(q, m, 4).orderBy("q", "place").collect():
        got.setdefault(r.q, []).append((r.d2, r.m))
    assert got == {i: sorted((float(((v - u) ** 2).sum()), j) for j, u in enumerate(y))[:4] for i, v in enumerate(x)}
    density = neighbors.pair_density(q.where("series_id = 'a'"), 0.5).collect()[0].density
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert density == pytest.approx((d * np.exp(-0.5 * d)).sum())


def test_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(1)
    rows = [("a", i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (300, 3)))] + [("a", 999, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "series_id string, q bigint, v array<double>")
    scores = {r.q: r.score for r in cluster.iforest(df.where("q < 300"), df, 50).collect()}
    assert len(scores) == 301 and max(scores, key=scores.get) == 999


def test_components_and_projection(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (80, 4)) @ rng.normal(0, 1, (4, 4))
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "series_id string, q bigint, v array<double>").repartition(3)
    z = (x - x.mean(0)) / x.std(0)
    values = np.sort(np.linalg.eigvalsh(z.T @ z / len(z)))[::-1]
    comps = cluster.principal_components(df).orderBy("c").collect()
    assert [r.share for r in comps] == pytest.approx((values / values.sum()).tolist())
    got = {r.q: r.v for r in cluster.pca_project(cluster.principal_components(df, 0.999999), df).collect()}
    want = z @ np.array([r.comp for r in comps]).T
    assert all(got[i] == pytest.approx(want[i].tolist()) for i in range(80))


def test_split_in_two_follows_the_matrix_form(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(0, 1, (20, 3)), rng.normal(3, 1, (15, 3))]
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "series_id string, q bigint, v array<double>")
    assert [r.side for r in cluster.two_means_split(df).orderBy("q").collect()] == cluster.two_means(x).tolist()


def test_infinite_metrics_are_not_finite(spark):
    df = spark.createDataFrame([(float("inf"),) * 6, (0.5,) * 6, (float("nan"),) * 6], records.METRICS)
    assert [r[0] for r in df.select(records.finite(*records.METRICS)).collect()] == [False, True, False]


def test_lines_of_a_large_csv_keep_their_order(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        (tmp_path / "a.csv").write_text("x,label\n" + "".join(f"{i},0\n" for i in range(3000)))
        rows = series.scan_series(spark, str(tmp_path / "a.csv"))
        assert rows.count() == 3000 and all(r.x == [float(r.t)] for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_locks_and_what_is_left(spark):
    lock = records.freeze(spark.createDataFrame([("a", 1)], "dataset string, trial int"))
    other = records.freeze(spark.createDataFrame([("a", 2)], "dataset string, trial int"))
    assert records.check_lock(lock, lock).count() == 1 and records.check_lock(lock, lock.limit(0)).count() == 1
    with pytest.raises(Exception, match="lock has changed"):
        records.check_lock(lock, other).collect()
    files = spark.createDataFrame([("f", "U", "a"), ("g", "U", "b")], "file string, track string, dataset string")
    bound = spark.createDataFrame([("U", "a", 1)], "track string, dataset string, config int")
    assert [r.file for r in records.unbound(files, bound).collect()] == ["g"]
    assert [r.dataset for r in series.empty_subsets(files, ["a", "z"]).collect()] == ["z"]
    points = spark.createDataFrame([("s", i) for i in range(3)], "series_id string, t bigint")
    assert [r.t for r in window.uncovered(points, points.where("t < 2")).collect()] == [2]


def test_constant_scores_stay_constant(spark):
    scores = spark.createDataFrame([("a", i, 2.5) for i in range(7)], "series_id string, start bigint, score double")
    points = spark.createDataFrame([("a", i) for i in range(10)], "series_id string, t bigint")
    assert {r.score for r in window.to_points(scores, 4, points).collect()} == {2.5}


def test_negated_scores_mirror_the_area(spark):
    rnd = random.Random(1)
    rows = [("a", rnd.random(), rnd.randint(0, 1)) for _ in range(200)]
    area = lambda sign: metrics.curve_metrics(metrics.score_curve(spark.createDataFrame([(k, sign * s, y) for k, s, y in rows], "series_id string, score double, label int"))).collect()[0].auc_roc
    assert area(1) + area(-1) == pytest.approx(1)


def test_perfect_ranking(spark):
    df = spark.createDataFrame([("a", float(i), int(i > 7)) for i in range(10)], "series_id string, score double, label int")
    r = metrics.curve_metrics(metrics.score_curve(df)).collect()[0]
    assert (r.auc_roc, r.auc_pr) == (1, 1) and r.best_f1 == pytest.approx(2 / (2 + 1e-5))


def test_refined_balls_are_a_partition():
    rng = np.random.default_rng(0)
    rows = np.r_[rng.normal(0, 0.1, (30, 3)), rng.normal(5, 0.1, (30, 3))]
    balls = cluster.refine(rows)
    assert sorted(np.concatenate(balls).tolist()) == list(range(60)) and len(balls) >= 2
    assert all(b.max() < 30 or b.min() >= 30 for b in balls)


@pytest.mark.parametrize("name", registry.detectors())
def test_detectors_are_label_blind(spark, sf_dir, name):
    u = series.u_small(spark, sf_dir).where("series_id < 3")
    scores = detect.point_scores(u, name)
    prefix.assert_label_blind(scores)
    assert scores.where("score is null").count() == 0


def test_label_blind_check_fails(spark, sf_dir):
    with pytest.raises(ValueError):
        prefix.assert_label_blind(series.u_small(spark, sf_dir).where("label = 1"))


def test_labels_do_not_hide(spark, tmp_path):
    """Wide plans, new names, conditions, joins, unions and Python functions."""
    wide = ", ".join(f"id + {i} AS c{i}" for i in range(40))
    spark.range(20).selectExpr("id", *wide.split(", "), "id % 2 AS label", "id AS my_label", "array(id) AS xs").write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    blind = df.drop("label")
    same = lambda batches: batches
    reading = [
        df, df.select(*[f"c{i}" for i in range(40)], "label"), df.selectExpr("label AS y"), df.selectExpr("Label + 1 AS y").where("y > 1"), df.where("label = 1").select("id"), df.orderBy("label").select("id"),
        df.groupBy("label").agg(F.sum("id").alias("s")).select("s"), df.groupBy("id").agg(F.max("label").alias("s")), df.join(df.select("id", F.col("label").alias("y")), "id").select("y"), blind.join(df.where("label = 1").select("id"), "id"),
        blind.select("id").union(df.select("label")), df.select("id", "label").mapInArrow(same, "id bigint, y bigint").select("y"), df.select(F.row_number().over(Window.partitionBy("label").orderBy("id"))), df.select(F.explode(F.array("label"))), df.dropDuplicates(["label"]).select("id"),
    ]
    for i, d in enumerate(reading):
        with pytest.raises(ValueError):
            prefix.assert_label_blind(d)
            print("not caught", i)
    for d in (blind, df.select("my_label"), df.withColumn("y", F.col("label") + 1).select("id", "c39"), df.withColumn("r", F.row_number().over(Window.orderBy("id"))).drop("label"), df.select("label", F.explode("xs").alias("x")).select("x"), blind.mapInArrow(same, blind.schema), df.where("my_label = 1").select("id"), df.select("id", "label").groupBy("id").count()):
        prefix.assert_label_blind(d)


def test_files(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    name = "001_DEMO_id_1_Sensor_tr_2_1st_3.csv"
    (tmp_path / "csv" / name).write_text("a,b,Label\n1,2,0\n3,4,0\n5,6,1\n")
    path = str(tmp_path / "csv")
    assert [(r.t, r.x) for r in series.scan_series(spark, path).orderBy("t").collect()] == [(0, [1, 2]), (1, [3, 4]), (2, [5, 6])]
    assert [r.label for r in series.scan_labels(spark, path).orderBy("t").collect()] == [0, 0, 1]
    (tmp_path / "m.json").write_text(json.dumps({"files": [name, name, "x"]}))
    assert series.scan_json_manifest(spark, str(tmp_path / "m.json")).count() == 2
    assert records.hash_files(spark, path).count() == 1
    assert records.audit_artifacts(spark, path, [".csv"]).count() == 1


def test_records_on_disk(spark, sf_dir, tmp_path):
    u = series.units(spark, sf_dir).limit(20).cache()
    out = str(tmp_path / "units")
    records.write_units(u, out)
    records.write_units(u, out)
    assert spark.read.parquet(out).count() == 20
    with pytest.raises(ValueError):
        records.write_units(u.withColumn("seed", u.seed + 1), out)
    records.write_reports(u, str(tmp_path / "reports"))
    (tmp_path / "tree" / "knn").mkdir(parents=True)
    (tmp_path / "tree" / "knn" / "a.json").write_text(json.dumps({"method": "knn", "track": "U", "dataset": "D", "file": "a", "seed": 2026, "metrics": {"vus_pr": 0.5}}))
    assert records.scan_units(spark, str(tmp_path / "tree")).collect()[0].vus_pr == 0.5


def test_streaming_score(spark, sf_dir):
    from pyspark.sql import functions as F

    from driftlens.operators.normalize import fit_scaler
    from driftlens.streaming.scoring import score_stream

    events = series.table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), "ts", F.col("value").alias("x"))
    scaler = fit_scaler(events)
    raw = spark.readStream.schema(series.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    q = score_stream(raw.select(F.col("user_id").alias("series_id"), "ts", F.col("value").alias("x")), scaler, "1 day").writeStream.format("memory").outputMode("complete").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from scored").collect()[0][0] == events.count()


def test_noise_targets_stay_in_their_task(spark):
    """Rows shuffle their own places; clean places come from one copy, as from all."""
    rows = spark.createDataFrame([(i, [float(i), 1.0, None, 4.0, 4.0][: i % 6]) for i in range(12)] + [(99, None)], "q int, w array<double>")
    noisy = normalize.noise_augment(rows, 2.0, 2, [0.25, 0.75], "n", ["q"])
    lean = normalize.noise_targets(noisy, ["q"], 0.25)
    key = lambda r: repr(tuple(r))
    every = normalize.noise_targets(noisy, ["q"])
    assert sorted(map(key, lean.collect())) == sorted(map(key, every.collect())) and lean.columns == every.columns
    plan = lean._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
