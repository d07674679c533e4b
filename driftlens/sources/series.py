"""Series from files and tables (S01-S06), and the series that the queries use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranges import running


def _label_of(columns: list[str], label: str | None) -> str:
    if label:
        return label
    named = [c for c in columns if c.strip().lower() == "label"]
    return named[-1] if named else columns[-1]


def _read_wide(spark: SparkSession, path: str, folder: bool = False) -> DataFrame:
    """All lines with file and place in the file.  A CSV has no time column: lines are
    numbered inside each block of a file that one task reads in order, and go on from the
    lines of the blocks before it, so no task sorts a whole file (S01)."""
    rows = spark.read.option("header", True).csv(path, enforceSchema=False)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    sizes = rows.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_path", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_path", "_block").orderBy("_at")) - 1
    rows = rows.withColumn("_own", own).join(sizes, ["_path", "_block"])
    return rows.withColumn("file", F.element_at(F.split("_path", "/"), -2 if folder else -1)).withColumn("t", (F.col("_base") + F.col("_own")).cast("bigint")).drop("_path", "_block", "_at", "_own", "_base")


def scan_series(spark: SparkSession, path: str, label_col: str | None = None, folder: bool = False) -> DataFrame:
    """(series_id, t, x) of wide CSVs; the label column is never selected.  A series is
    named after its file, or after the folder that its only file is in."""
    rows = _read_wide(spark, path, folder)
    names = [c for c in rows.columns if c not in ("file", "t")]
    label = _label_of(names, label_col)
    return rows.select(F.col("file").alias("series_id"), "t", F.array(*[F.col(f"`{c}`").cast("double") for c in names if c != label]).alias("x"))


def scan_labels(spark: SparkSession, path: str, label_col: str | None = None, folder: bool = False) -> DataFrame:
    """(series_id, t, label); a label other than 0 or 1 fails the job."""
    rows = _read_wide(spark, path, folder)
    label = F.col(f"`{_label_of([c for c in rows.columns if c not in ('file', 't')], label_col)}`").cast("double")
    ok = label.isin(0.0, 1.0)
    return rows.select(F.col("file").alias("series_id"), "t", F.when(ok, label.cast("int")).otherwise(F.raise_error(F.lit("labels must be 0 or 1")).cast("int")).alias("label"))


def series_from_table(df: DataFrame, key: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Rows of any table as series, t counting from 0 in the given order.  A long series
    is put in order by many tasks."""
    by = [f"_o{i}" for i in range(len(order))]
    rows = df.select(F.col(key).alias("series_id"), *[F.col(c).alias(o) for c, o in zip(order, by)], *[c.alias(n) for n, c in values.items()])
    return running(rows, ["series_id"], by, {}).select("series_id", F.col("_r").alias("t"), *values)


def parse_series_name(name: Column) -> dict[str, Column]:
    """Dataset, train boundary and first anomaly from <i>_<DATASET>_id_<k>_<Domain>_tr_<N>_1st_<M>.csv;
    null where the name has none."""
    number = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit("")).cast("bigint")
    return {"dataset": F.get(F.split(name, "_"), 1), "train_index": number(r"_tr_(\d+)(?:_|\.|$)"), "first_anomaly": number(r"_1st_(\d+)(?:_|\.|$)")}


def scan_manifest(files: DataFrame, targets: list[str]) -> DataFrame:
    """Files (track, split, file_name) of the wanted datasets; a file named twice in
    one track and split gets ``duplicate``."""
    w = Window.partitionBy("track", "split", "file_name")
    return files.withColumn("duplicate", F.count(F.lit(1)).over(w) > 1).withColumn("dataset", F.get(F.split("file_name", "_"), 1)).where(F.col("dataset").isin(*targets))


def empty_subsets(manifest: DataFrame, targets: list[str]) -> DataFrame:
    """Wanted datasets without a file."""
    want = manifest.sparkSession.createDataFrame([(t,) for t in targets], "dataset string")
    return want.join(manifest, "dataset", "left_anti")


def scan_json_manifest(spark: SparkSession, path: str, key: str = "files", multi_line: bool = True) -> DataFrame:
    """The distinct file names listed under ``key`` in JSON documents."""
    schema = T.StructType([T.StructField(key, T.ArrayType(T.StringType()))])
    return spark.read.schema(schema).json(path, multiLine=multi_line).select(F.explode(key).alias("file_name")).distinct()


# ---- the series and records that the queries are run on ----


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def u_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each user."""
    e = table(spark, sf_dir, "events")
    return series_from_table(e, "user_id", ["ts", "event_id"], {"x": F.col("value"), "label": (F.col("event_type") == "error").cast("int")})


def u_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long series for each type of event; label: among the greatest hundredth."""
    e = table(spark, sf_dir, "events")
    s = series_from_table(e, "event_type", ["ts", "event_id"], {"x": F.col("value")})
    ranked = running(s, ["series_id"], [F.desc("x"), "t"], {"n": F.lit(1)})
    return ranked.select("series_id", "t", "x", (F.col("_r") < F.ceil(F.col("n_all") / 100)).cast("int").alias("label"))


def m_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten series of five channels: values of each hour and type, 0 where there are none."""
    e = table(spark, sf_dir, "events")
    hour = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 3600).cast("bigint")
    e = e.select((F.col("user_id") % 10).alias("series_id"), hour.alias("t"), "event_type", "value")
    wide = e.groupBy("series_id", "t").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.sum("value"))
    grid = e.select("series_id").distinct().select("series_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(719).cast("bigint"))).alias("t"))
    x = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in ["click", "error", "purchase", "signup", "view"]])
    return grid.join(wide, ["series_id", "t"], "left").select("series_id", "t", x.alias("x"))


def meta_of(series: DataFrame) -> DataFrame:
    """(series_id, n, train_index): the first half of each series is for training."""
    return series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).select("series_id", "n", F.floor(F.col("n") / 2).cast("bigint").alias("train_index"))


def vectors(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    """(vec_id, series_id, v, is_train): embeddings, a series for each label; the first
    half of a label's vectors is for training.  ``v`` is of doubles, or as it is ``stored``."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("series_id"), F.col("embedding").alias("v"))
    w = Window.partitionBy("series_id")
    v = F.col("v") if stored else F.col("v").cast("array<double>").alias("v")
    return e.select("vec_id", "series_id", v, (F.row_number().over(w.orderBy("vec_id")) <= F.count(F.lit(1)).over(w) / 2).alias("is_train"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result records, as many as orders (FIXTURES.md)."""
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    values = [((cents * i) % 1000 / 1000.0).alias(m) for i, m in enumerate(METRICS, 1)]
    return j.select(
        F.col("o_orderpriority").alias("method"), F.when(F.col("n_regionkey") < 3, "U").otherwise("M").alias("track"), F.col("n_name").alias("dataset"),
        F.col("o_orderkey").cast("string").alias("file"), F.lit(2026).alias("seed"), *values, F.when(F.col("o_orderkey") % 97 == 0, "failed").alias("error"),
    )


METRICS = ["vus_pr", "vus_roc", "range_f1", "auc_pr", "auc_roc", "best_f1"]
