"""Order and running sums in groups that are longer than a task.

Where rows know their place ``t`` (0, 1, ... without gaps), a series falls into chunks of
``CHUNK`` points; a chunk borrows the points beyond its edges that its frames reach, and what
earlier chunks add up to comes from one row a chunk.  Where the order has yet to be found,
rows are sorted by ranges of (group, order), so that many tasks share a group, and written
with their place in their range; one row a range gives what lies before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows of a group that one task puts in order, and points of a chunk.
LONG, CHUNK = 1 << 20, 1 << 16


def longest(df: DataFrame, by: list[str]) -> int:
    """Rows of the longest group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def beside(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that takes null keys as equal; ``other`` gives its further columns."""
    renamed = other.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in other.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & df[k].eqNullSafe(renamed[f"_key{i}"])
    return df.join(renamed, on, "left").drop(*[f"_key{i}" for i in range(len(keys))])


def running(df: DataFrame, by: list[str], order: list, sums: dict[str, Column], long: bool | None = None) -> DataFrame:
    """The rows with ``_r``, their place from 0 in their group's order, and for each name of
    ``sums`` the sum up to and with the row and, as ``<name>_all``, the group's.  Groups of
    at most LONG rows are ordered by one task each, longer ones by ranges."""
    w = Window.partitionBy(*by)
    if not (longest(df, by) > LONG if long is None else long):
        up = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", (F.row_number().over(w.orderBy(*order)) - 1).cast("bigint").alias("_r"), *[F.sum(c).over(up).alias(n) for n, c in sums.items()], *[F.sum(c).over(w).alias(f"{n}_all") for n, c in sums.items()])
    placed = written(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    held = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())])
    before = w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    held = held.select(*by, "_part", (zero("_n") - F.col("_from")).alias("_shift"), *[zero(f"_s{i}").alias(f"_b{i}") for i in range(len(sums))], *[F.sum(f"_s{i}").over(w).alias(f"{n}_all") for i, n in enumerate(sums)])
    inside = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = beside(placed.select("*", *[F.sum(c).over(inside).alias(f"_l{i}") for i, c in enumerate(sums.values())]), held, [*by, "_part"])
    return out.select(*df.columns, (F.col("_at") + F.col("_shift")).alias("_r"), *[(F.col(f"_b{i}") + F.col(f"_l{i}")).alias(n) for i, n in enumerate(sums)], *[f"{n}_all" for n in sums])


def chunk(t: str | Column = "t", size: int | None = None) -> Column:
    return F.floor((F.col(t) if isinstance(t, str) else t) / (size or CHUNK))


def chunk_size(before: int, after: int) -> int:
    return max(CHUNK, 8 * (before + after))


def haloed(df: DataFrame, before: int, after: int) -> DataFrame:
    """The points of every chunk with the ``before`` points ahead of its first and ``after``
    behind its last: columns ``_c`` (the chunk) and ``_own`` (whether the point is its own).
    Chunks are at least eight times as long as what they borrow, so few points are copied."""
    size = chunk_size(before, after)
    first, last = F.greatest(chunk(F.col("t") - after, size), F.lit(0)), chunk(F.col("t") + before, size)
    out = df.withColumn("_c", F.explode(F.sequence(first, last)))
    return out.withColumn("_own", F.col("_c") == chunk("t", size))


def numbered_runs(df: DataFrame, by: list[str], least: dict[str, Column] | None = None) -> DataFrame:
    """(by, segment, s, e): maximal runs of the points of df (by, t), numbered from 1 in each
    group; further columns hold the least of ``least`` in a run.  Runs are found chunk by
    chunk; those that touch a chunk's edge are joined with their neighbours', at most two a
    chunk, and numbers go on from the runs that start in earlier chunks."""
    least = least or {}
    w = Window.partitionBy(*by, "_c").orderBy("t")
    one = df.select(*by, "t", *[c.alias(n) for n, c in least.items()], chunk().alias("_c"))
    runs = one.withColumn("_g", F.col("t") - F.row_number().over(w)).groupBy(*by, "_c", "_g").agg(F.min("t").alias("s"), F.max("t").alias("e"), *[F.min(n).alias(n) for n in least])
    edge = (F.col("s") % CHUNK == 0) | (F.col("e") % CHUNK == CHUNK - 1)
    w = Window.partitionBy(*by).orderBy("s")
    touching = runs.where(edge).withColumn("_new", F.coalesce(F.col("s") != F.lag("e").over(w) + 1, F.lit(True)))
    touching = touching.withColumn("_g", F.sum(F.col("_new").cast("int")).over(w)).groupBy(*by, "_g").agg(F.min("s").alias("s"), F.max("e").alias("e"), *[F.min(n).alias(n) for n in least])
    cols = [*by, "s", "e", *least]
    whole = runs.where(~edge).select(*cols).unionByName(touching.select(*cols)).withColumn("_c", chunk("s"))
    per = whole.groupBy(*by, "_c").agg(F.count(F.lit(1)).alias("_n"))
    base = per.select(*by, "_c", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(*by, "_c").orderBy("s"))
    out = beside(whole.withColumn("_own", own), base, [*by, "_c"])
    return out.select(*by, (F.col("_base") + F.col("_own")).cast("int").alias("segment"), "s", "e", *least)
