"""What the text operators need of the cluster: the shared folder, bounded Arrow batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder

#: Rows and bytes an Arrow batch holds at most (one longer text makes a batch of its own).
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 26


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table written in the shared folder: lineage ends there, and a lost
    executor costs a read of files, not a new computation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._cut_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES bytes, so that long texts do
    not add up.  A plan reads these settings when it runs, so they stay set; smaller ones of
    the session are left as they are."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id, text); other columns, whatever their names, are left behind."""
    bounded_batches(df.sparkSession)
    return df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].alias("text"))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo the number of folds (null: -1)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(-1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
