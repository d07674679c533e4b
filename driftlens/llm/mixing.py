"""Operator 4, mixing sources to target weights.

A document's size is its number of words (``[^\\x20\\x09-\\x0D]+``; null text: 0).
Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3 ... and share all sizes by
weight; no target exceeds three times its source's size, and the excess goes to the others
by weight until none is above (the water level below).  Each document is taken floor(rate)
times, rate being target over source size, and once more if the hash of its id and the
seed falls below the rate's fraction.

The water level has a closed form over the sources sorted by how soon they fill, so the
work on sources is one aggregate and two windows over one row a source.  Sources are
broadcast only if counted to be few (``BROADCAST_SOURCES``); else their join shuffles, and
Spark splits a hot source.  An empty table gives an empty mix; sources without words have
target 0 and rate 0.  Null ids hash like a word of their own; repeated rows are drawn alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS, LIMIT, SEED, BROADCAST_SOURCES = (1, 2, 3), 3, "mix-1", 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, target) from rows (source, size).  Both windows run over one
    row a source, after the aggregate."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int")
    per = per.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1).alias("weight"))
    # sources fill up in order of size / weight; those up to some point are full, the rest
    # share what is left.  Full is a source if its limit lies below the level that all
    # sources from it on would share.
    fills = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
        F.coalesce(F.sum(F.col("source_size") * limit).over(before), F.lit(0.0)).alias("filled"),
        F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
    )
    level = (F.col("total") - F.col("filled")) / F.col("open_weight")
    per = per.select("*", level.alias("level"), (F.col("source_size") * limit <= level * F.col("weight")).alias("full"))
    final = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(Window.partitionBy())["level"]
    return per.select("source", "source_size", F.when(F.col("full"), F.col("source_size") * float(limit)).otherwise(final * F.col("weight")).alias("target"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that only the id and the seed decide."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, limit: float = LIMIT, seed: str = SEED) -> DataFrame:
    """The rows of docs (with a column ``size``) with source_size, target and copies."""
    aim = targets(docs.select("source", "size"), weights, limit).withColumnRenamed("source", "aim_source")
    if docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        aim = F.broadcast(aim)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = docs.join(aim, docs["source"].eqNullSafe(F.col("aim_source"))).withColumn("rate", rate)
    copies = F.floor("rate") + F.when(draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("bigint")).drop("aim_source")


def measure_mix(df: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each document."""
    docs = df.select(df["doc_id"].alias("doc_id"), df["source"].alias("source"), word_count(df["text"]).alias("size"))
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(df: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of df as often as it is taken, with its number ``copy``
    from 0 (a column of that name in df gives way to it)."""
    cols = [c for c in df.columns if c.lower() != "copy"]
    docs = df.select(df["doc_id"].alias("doc_id"), df["source"].alias("source"), word_count(df["text"]).alias("size"), F.struct(*[df[c] for c in cols]).alias("row"))
    taken = plan(docs, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy")).select(*[F.col("row")[c].alias(c) for c in cols], "copy")
