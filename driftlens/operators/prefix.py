"""Filters, checks and samples."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sampling import uniform


def prefix(df: DataFrame, meta: DataFrame) -> DataFrame:
    """the training prefix t < train_index of each series, whatever its labels."""
    return df.join(meta.select("series_id", "train_index"), "series_id").where(F.col("t") < F.col("train_index")).drop("train_index")


def check_prefix(meta: DataFrame, minimum: int = 1, allow_full: bool = False) -> DataFrame:
    """series whose boundary is missing, below the minimum or not inside the series."""
    top = F.col("train_index") > F.col("n") if allow_full else F.col("train_index") >= F.col("n")
    return meta.where(F.col("train_index").isNull() | (F.col("train_index") < minimum) | top)


def select_subsets(df: DataFrame, targets: list[str], col: str = "dataset") -> DataFrame:
    """F03."""
    return df.where(F.col(col).isin(*targets))


def drop_incomplete(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """rows without nulls."""
    return df.na.drop(subset=cols)


def non_finite(df: DataFrame, col: str = "x") -> DataFrame:
    """the rows that a finite-values check rejects (null counts as not finite)."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    is_array = df.schema[col].dataType.typeName() == "array"
    return df.where(F.coalesce(F.exists(col, bad), F.lit(True)) if is_array else bad(F.col(col)))


def even_sample(df: DataFrame, m: int, order: list[str], by: list[str], mode: str = "floor") -> DataFrame:
    """F07 (floor) and F08 (rint): m evenly spaced rows of each group; places that round
    to the same row count once.  Groups with at most m rows stay whole."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).withColumn("_n", n)
    # row r is chosen if some i in 0..m-1 lands on it; only i near r*(m-1)/(n-1) can
    near = F.floor(F.col("_r") * (m - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    land = (lambda i: F.floor(i * (F.col("_n") - 1) / (m - 1))) if mode == "floor" else (lambda i: F.bround(i * (F.col("_n") - 1) / (m - 1)))
    hit = F.lit(False)
    for d in (-1, 0, 1, 2):
        i = near + d
        hit = hit | (i.between(0, m - 1) & (land(i) == F.col("_r")))
    return ranked.where((F.col("_n") <= m) | hit).drop("_r", "_n")


def sample_rows(df: DataFrame, size: int, seed: str, key: Column, by: list[str]) -> DataFrame:
    """``size`` rows of each group: without replacement if it has as many, else
    ``size`` draws with replacement (a row then comes ``draws`` times)."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("_u", uniform(seed, key)).withColumn("_r", F.row_number().over(w.orderBy("_u", key))).withColumn("_n", F.count(F.lit(1)).over(w))
    enough = ranked.where((F.col("_n") >= size) & (F.col("_r") <= size)).withColumn("draws", F.lit(1).cast("bigint"))
    few = ranked.where(F.col("_n") < size)
    draws = few.select(*by, "_n").distinct().select(*by, "_n", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("_i"))
    draws = draws.select(*by, (F.floor(uniform(seed, *[F.col(b) for b in by], F.col("_i")) * F.col("_n")) + 1).cast("int").alias("_r")).groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("draws"))
    return enough.unionByName(few.join(draws, [*by, "_r"])).drop("_u", "_r", "_n")


def tempered_sample(members: DataFrame, power: float, size: int, seed: str, by: list[str]) -> DataFrame:
    """(by, draw, ball, member): a ball with probability proportional to its size to
    the power, then a member of it, with replacement.  ``members`` has (by, ball, row)."""
    balls = members.groupBy(*by, "ball").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    weight = F.pow("n", F.lit(power))
    up = F.sum(weight).over(w.orderBy("ball").rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(w)
    balls = balls.withColumn("_hi", up)
    keys = [F.col(b) for b in by]
    draws = members.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(1), F.lit(size))).alias("draw"))
    draws = draws.withColumn("_u", uniform(seed + "ball", *keys, F.col("draw"))).withColumn("_v", uniform(seed + "row", *keys, F.col("draw")))
    # draws and the balls' upper ends in one order: a draw's ball is the next end above it
    ends = balls.select(*by, F.col("_hi").alias("_u"), F.lit(0).alias("_kind"), F.lit(None).cast("int").alias("draw"), F.lit(None).cast("double").alias("_v"), "ball", "n")
    both = ends.unionByName(draws.select(*by, "_u", F.lit(1).alias("_kind"), "draw", "_v", F.lit(None).cast(balls.schema["ball"].dataType).alias("ball"), F.lit(None).cast("bigint").alias("n")))
    down = w.orderBy(F.desc("_u"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("ball", F.last("ball", ignorenulls=True).over(down)).withColumn("n", F.last("n", ignorenulls=True).over(down)).where("_kind = 1 AND ball IS NOT NULL")
    hit = hit.withColumn("_p", (F.floor(F.col("_v") * F.col("n")) + 1).cast("int"))
    placed = members.withColumn("_p", F.row_number().over(Window.partitionBy(*by, "ball").orderBy("row")))
    return hit.join(placed, [*by, "ball", "_p"]).select(*by, "draw", "ball", "row")


def ordered_split(df: DataFrame, order: list[str], by: list[str], fraction: float = 0.8) -> DataFrame:
    """``is_train`` for the first round(fraction * n) rows (half to even), between 1
    and n - 1."""
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    cut = F.greatest(F.lit(1), F.least(n - 1, F.bround(n * fraction).cast("bigint")))
    return df.withColumn("is_train", F.row_number().over(w.orderBy(*order)) <= cut)


def smallest_per_group(df: DataFrame, by: str, size: str, name: str, eligible: Column) -> DataFrame:
    """the smallest eligible row of each group, the first name on ties."""
    return df.where(eligible).groupBy(by).agg(F.min_by(name, F.struct(size, name)).alias(name), F.min(size).alias(size))


def slice_list(df: DataFrame, order: list[str], offset: int, limit: int | None) -> DataFrame:
    """F13."""
    out = df.orderBy(*order).offset(offset)
    return out if limit is None else out.limit(limit)


def assert_label_blind(df: DataFrame, label: str = "label") -> None:
    """fail if a scoring result depends on the label column.

    The analysed plan's attributes are followed by identity, not by the plan's text.  Those
    with exactly the label's name carry it, and so does what is computed from them.  The
    check fails if one reaches the result, or if a condition, a grouping, an order or a key
    anywhere below uses one; a label that is only carried along and dropped does no harm.
    A label that was written to a table under another name cannot be told."""
    sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    same = (lambda n: n == label) if sensitive else (lambda n: n.lower() == label.lower())
    tainted: set[int] = set()

    def columns(seq) -> list[tuple[str, int]]:
        """(name, id) of attributes, which write themselves as name#id."""
        parts = seq.mkString("\x01").split("\x01") if seq.size() else []
        found = [re.fullmatch(r"(.*)#(\d+)\D*.*?", p, re.DOTALL) for p in parts]
        return [(m[1], int(m[2])) for m in found]

    def used(expression) -> bool:
        return any(i in tainted for _, i in columns(expression.references().toSeq()))

    def walk(plan) -> list[int]:
        """Ids of the plan's columns; its inputs are walked first."""
        each = lambda seq: [seq.apply(i) for i in range(seq.size())]
        below = [walk(p) for p in each(plan.children())]
        kind, output = plan.getClass().getSimpleName(), columns(plan.output())
        out, passed = [i for _, i in output], {i for b in below for i in b}
        tainted.update(i for n, i in output if same(n))
        opaque = bool(re.search("Arrow|Pandas|Python|MapPartitions|MapElements|MapGroups|CoGroup", kind))  # a function sees whole rows
        made: set[int] = set()
        conditions = [plan.groupingExpressions()] if kind == "Aggregate" else []
        for e in each(plan.expressions()):
            if e.getClass().getSimpleName() == "Alias":
                own = columns(e.toAttribute().references().toSeq())[0][1]
                made.add(own)
                if used(e):
                    tainted.add(own)
            elif below and kind not in ("Project", "Aggregate", "Generate") and not opaque and used(e):
                raise ValueError(f"the plan reads {label}")
        if any(used(g) for c in conditions for g in each(c)):
            raise ValueError(f"the plan reads {label}")
        if kind == "Union":
            tainted.update(i for b in below for i, other in zip(out, b) if other in tainted)
        elif (opaque and not tainted.isdisjoint(passed)) or (kind == "Generate" and used(plan.generator())):
            tainted.update(i for i in out if i not in passed | made)
        return out

    if not tainted.isdisjoint(walk(df._jdf.queryExecution().analyzed())):
        raise ValueError(f"the plan reads {label}")
