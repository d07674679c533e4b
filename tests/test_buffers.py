"""Metrics of many short series: what they shuffle, and scores that are missing."""

from pyspark.sql import functions as F

from driftlens.operators import metrics


def widest_shuffle(spark, job) -> int:
    """The most rows that one stage of the job gives to a shuffle."""
    doubles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def rows() -> dict:
        it, out = spark._jsc.sc().statusStore().stageList(None, False, False, doubles, None).iterator(), {}
        while it.hasNext():
            x = it.next()
            out[x.stageId()] = x.shuffleWriteRecords()
        return out

    before = rows()
    job()
    return max(n for stage, n in rows().items() if stage not in before)


def series(spark, count: int, length: int):
    t = spark.range(count * length).select(F.floor(F.col("id") / length).alias("series_id"), (F.col("id") % length).alias("t"), F.rand(3).alias("score"))
    return t.withColumn("label", (F.pmod(F.xxhash64("series_id", "t"), F.lit(5)) == 0).cast("int"))


def test_buffers_multiply_no_rows(spark):
    """Every point is a threshold here, and there are eleven buffers."""
    df = series(spark, 40, 60)
    assert widest_shuffle(spark, lambda: metrics.evaluate(df).collect()) <= 2 * 40 * 60


def test_points_without_a_score(spark):
    """They count among points and segments and reach no threshold."""
    df = series(spark, 3, 50).withColumn("score", F.when((F.col("series_id") == 0) | ((F.col("series_id") == 1) & (F.col("t") % 10 == 9)), None).otherwise(F.col("score")))
    df = df.withColumn("label", F.when(F.col("t") % 10 == 9, 0).when(F.col("t") % 10 == 3, 1).otherwise(F.col("label")))
    got = {r.series_id: r for r in metrics.vus(df, 0, 250).collect()}
    # without buffers a point without a score is as one below all others
    low = {r.series_id: r for r in metrics.vus(df.withColumn("score", F.coalesce("score", F.lit(-1.0))), 0, 250).collect()}
    assert got[0].vus_roc is None and got[0].vus_pr is None
    assert abs(got[2].vus_roc - low[2].vus_roc) < 1e-12 and abs(got[2].vus_pr - low[2].vus_pr) < 1e-12
    assert got[1].vus_roc < low[1].vus_roc and abs(got[1].vus_pr - low[1].vus_pr) < 1e-12
