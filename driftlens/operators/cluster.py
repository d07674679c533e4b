"""Clustering and model operators (C01-C15).  Rows are (by, q, v): a number and a vector."""

from __future__ import annotations

import functools
import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import l2_normalize, revin, squared_distance
from ..sources.scratch import written
from . import axes
from .neighbors import BY, PAIRS, _groups, _rounded, assign, topk_mean
from .ranges import longest
from .window import to_points, windows


def vector_mean(rows: DataFrame, keys: list[str], col: str = "v") -> DataFrame:
    """(keys, center) by place, to 12 decimals; one shuffle of partial sums.  Partial sums meet
    in any order, which changes last digits; left in, they would decide near ties and make
    two runs over the same rows differ."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col(col))))
    return rows.groupBy(*keys).agg(mean.alias("center")).withColumn("center", steady("center"))


def steady(col: str):
    """An array to 12 decimals."""
    return F.transform(col, lambda x: F.round(x, 12))


def clean_clusters(members: DataFrame, parents: DataFrame, by: list[str] = BY) -> DataFrame:
    """Balls (by, m, q, v) after a split of the balls ``parents`` (by, m, q, v): rows
    (by, m, side, q, v).  A side without rows is no ball; a ball that a split has left
    whole, or whose sides both hold all of it, is not split and keeps side 0."""
    n = parents.groupBy(*by, "m").agg(F.count(F.lit(1)).alias("_n"))
    sides = members.groupBy(*by, "m", "side").agg(F.count_distinct("q").alias("_c"))
    failed = sides.join(n, [*by, "m"]).groupBy(*by, "m").agg(F.bool_or(F.col("_c") == F.col("_n")).alias("_failed"))
    out = members.join(failed, [*by, "m"])
    side = F.when(F.col("_failed"), 0).otherwise(F.col("side")).alias("side")
    return out.select(*by, "m", side, "q", "v").dropDuplicates([*by, "m", "side", "q"])


def even_seeds(rows: DataFrame, k: int | None, by: list[str] = BY) -> DataFrame:
    """(by, m, u): k evenly spaced rows (k = floor(sqrt(n)) if not given) as first centres."""
    w = Window.partitionBy(*by)
    kk = F.least(F.lit(k) if k else F.floor(F.sqrt("_n")), F.col("_n")).cast("int")
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy("q")) - 1).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_k", kk)
    m = F.floor(F.col("_r") * F.col("_k") / F.col("_n")).cast("int")
    first = F.ceil(m * F.col("_n") / F.col("_k")) == F.col("_r")
    return ranked.where(first).select(*by, m.alias("m"), F.col("v").alias("u"))


#: Lloyd's steps at most where they go on until no centre moves.
MOST_STEPS = 200
#: Rows of the longest series, or largest ball, that one task covers or splits to the end.
SMALL = 1 << 14


def _parted(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of series of at most SMALL rows, and those of longer ones, if there are any."""
    if longest(rows, by) <= SMALL:
        return rows, None
    long = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SMALL).select(*by)
    long = written(long, "long")
    return rows.join(long, by, "left_anti"), rows.join(long, by)


def _one_task_each(rows: DataFrame, cell: list[str], *more: str) -> DataFrame:
    """Rows of a cell in one task, in the order of their numbers, as ``_groups`` reads them."""
    dealt = rows.select(*cell, *more, F.xxhash64(*cell).alias("_g"), F.lit(1).alias("_side"), F.col("q").alias("_id"), F.col("v").alias("_v"))
    return dealt.repartition(*cell).sortWithinPartitions(*cell, "_id")


def _named(rows: pa.Table, by: list[str], m: np.ndarray) -> pa.Table:
    """(by, q, v, m) of the rows of one series; those with a negative number go."""
    out = rows.select([*by, "_id", "_v"]).rename_columns([*by, "q", "v"]).append_column("m", pa.array(m, pa.int64()))
    return out if m.min(initial=0) >= 0 else out.filter(pa.array(m >= 0))


def _centers(x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and means of clusters as ``vector_mean`` has them, rows added one after another."""
    order = np.argsort(m, kind="stable")
    names, first, n = np.unique(m[order], return_index=True, return_counts=True)
    out = x[order[first]]
    for j in range(1, n.max(initial=0)):
        more = n > j
        out[more] += (x[order[first[more] + j]] - out[more]) / (j + 1)
    return names, _rounded(out, 12)


def cover(x: np.ndarray, k: int | None = None, rounds: int | None = 3) -> np.ndarray:
    """C03 on one small matrix: the number of each row's centre, -1 for rows whose distances
    are no numbers."""
    n = len(x)
    k = min(k or math.isqrt(n), n)
    names, centers = np.arange(k), x[-(-np.arange(k) * n // k)]

    def own() -> np.ndarray:
        out, step = np.full(n, -1), max(1, PAIRS // max(1, centers.size))
        for lo in range(0, n if len(centers) else 0, step):
            d = ((x[lo : lo + step, None] - centers) ** 2).sum(2)
            d[~np.isfinite(d)] = np.inf
            out[lo : lo + step] = np.where(d.min(1) < np.inf, names[d.argmin(1)], -1)
        return out

    for _ in range(MOST_STEPS if rounds is None else rounds):
        m, before = own(), (names, centers)
        names, centers = _centers(x[m >= 0], m[m >= 0])
        if np.array_equal(before[0], names) and np.array_equal(before[1], centers):
            break
    return own()


def coarse_cover(rows: DataFrame, k: int | None = None, rounds: int | None = 3, by: list[str] = BY) -> DataFrame:
    """(by, q, v, m) after ``rounds`` of Lloyd's steps from evenly spaced seeds, or, with
    None, as many as move a centre (MOST_STEPS at most); centres that lose all rows go (C10).
    A series of at most SMALL rows is covered by one task; of longer ones the rows and each
    round's centres are written, so no round repeats what led to them."""
    rows = written(rows.select(*by, "q", "v"), "rows")
    short, rows = _parted(rows, by)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return axes.batched(_named(t, by, cover(x, k, rounds)) for t, _, _, x in _groups(batches))

    covered = _one_task_each(short, by).mapInArrow(whole, f"{axes._schema(short, [*by, 'q', 'v'])}, m bigint")
    if rows is None:
        return covered
    centers = written(even_seeds(rows, k, by), "centers")
    own = lambda c: rows.join(assign(rows, c, by).select(*by, "q", "m"), [*by, "q"])
    for _ in range(MOST_STEPS if rounds is None else rounds):
        before, centers = centers, written(vector_mean(own(centers), [*by, "m"]).withColumnRenamed("center", "u"), "centers")
        if rounds is None and not before.join(centers.withColumnRenamed("u", "_u"), [*by, "m"], "left").where(~F.col("u").eqNullSafe(F.col("_u"))).head(1):
            break
    return covered.unionByName(own(centers).withColumn("m", F.col("m").cast("bigint")))


def kmeans_centers(train: DataFrame, k: int = 10, rounds: int | None = 10, by: list[str] = BY) -> DataFrame:
    """C01, learnt part: (by, m, u), min(k, n) centres after ``rounds`` of Lloyd's steps."""
    return vector_mean(coarse_cover(train, k, rounds, by), [*by, "m"]).withColumnRenamed("center", "u")


def kmeans_distance(centers: DataFrame, query: DataFrame, by: list[str] = BY) -> DataFrame:
    return assign(query, centers, by).select(*by, "q", F.sqrt("d2").alias("score"))


def kmeans_score(train: DataFrame, query: DataFrame, k: int = 10, rounds: int = 10, by: list[str] = BY) -> DataFrame:
    """Distance to the assigned centre, min(k, n) centres fitted on the training rows
    by ``rounds`` of Lloyd's steps."""
    return kmeans_distance(kmeans_centers(train, k, rounds, by), query, by)


def two_means(rows: np.ndarray, steps: int = 12) -> np.ndarray:
    """C04 on one small matrix: the row farthest from the mean, the one farthest from
    that, then Lloyd's steps; lowest index on ties.  0/1 for each row."""
    gaps = lambda c: np.add.reduce((rows - c) ** 2, 1)
    a = rows[gaps(_mean(rows)).argmax()]
    b = rows[gaps(a).argmax()]
    side = None
    for _ in range(steps):
        now = gaps(b) < gaps(a)
        if side is not None and (now == side).all():
            break
        side = now
        n = np.count_nonzero(side)
        if n in (0, len(side)):
            break
        a, b = _mean(rows[~side]), _mean(rows[side])
    return side.astype(int)


def _mean(x: np.ndarray) -> np.ndarray:
    return np.add.reduce(x, 0) / len(x)


def two_means_split(rows: DataFrame, by: list[str] = BY, steps: int = 12) -> DataFrame:
    """C04 as tables, for balls of any size: (by, q, v, side) by the two farthest seeds, then
    Lloyd's steps, each an aggregate and a join; a side that loses all rows ends the steps."""
    mean = vector_mean(rows, by)
    d = rows.join(mean, by).withColumn("_d", squared_distance(F.col("v"), F.col("center")))
    first = d.groupBy(*by).agg(F.max_by("v", F.struct("_d", -F.col("q"))).alias("a"))
    d = rows.join(first, by).withColumn("_d", squared_distance(F.col("v"), F.col("a")))
    centers = d.groupBy(*by).agg(F.max_by("v", F.struct("_d", -F.col("q"))).alias("b"), F.first("a").alias("a"))
    nearer = (squared_distance(F.col("v"), F.col("b")) < squared_distance(F.col("v"), F.col("a"))).cast("int")
    sided = lambda: rows.join(centers, by).select(*by, "q", "v", nearer.alias("side"), "a", "b")
    center = vector_to_array(Summarizer.mean(array_to_vector(F.col("v"))))
    for _ in range(steps - 1):  # only the centres go from step to step
        means = sided().groupBy(*by, "side").agg(center.alias("c"), F.first("a").alias("a"), F.first("b").alias("b"))
        of = lambda side: F.max(F.when(F.col("side") == side, F.col("c")))
        both = means.groupBy(*by).agg(of(0).alias("a1"), of(1).alias("b1"), F.first("a").alias("a"), F.first("b").alias("b"))
        ends = F.col("a1").isNull() | F.col("b1").isNull()
        centers = both.select(*by, F.when(ends, F.col("a")).otherwise(F.col("a1")).alias("a"), F.when(ends, F.col("b")).otherwise(F.col("b1")).alias("b"))
    return sided().drop("a", "b")


def ball_sse(members: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, m, n, dim, sse) of balls (by, m, q, v)."""
    centers = vector_mean(members, [*by, "m"])
    return members.join(centers, [*by, "m"]).groupBy(*by, "m").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.sum(squared_distance(F.col("v"), F.col("center"))).alias("sse"))


def bic(n, dim, sse, balls: int):
    """n*d*ln(sse/(n*d)) + p*ln(max(2, n)), p = d+1 or 2(d+1)+1."""
    p = dim + 1 if balls == 1 else 2 * (dim + 1) + 1
    return n * dim * F.ln(F.greatest(sse, F.lit(1e-12)) / (n * dim)) + p * F.ln(F.greatest(F.lit(2), n))


def bic_improves(parent: DataFrame, children: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, parent_bic, child_bic, improves) from ``ball_sse`` of one ball and two."""
    p = parent.select(*by, bic(F.col("n"), F.col("dim"), F.col("sse"), 1).alias("parent_bic"))
    c = children.groupBy(*by).agg(F.sum("n").alias("n"), F.max("dim").alias("dim"), F.sum("sse").alias("sse"))
    c = c.select(*by, bic(F.col("n"), F.col("dim"), F.col("sse"), 2).alias("child_bic"))
    return p.join(c, by).withColumn("improves", F.col("child_bic") + 1e-9 < F.col("parent_bic"))


def _np_bic(n: int, dim: int, sse: float, balls: int) -> float:
    p = dim + 1 if balls == 1 else 2 * (dim + 1) + 1
    return n * dim * math.log(max(sse, 1e-12) / (n * dim)) + p * math.log(max(2, n))


def refine(rows: np.ndarray, min_ball: int = 4, rounds: int = 64, depth: int = 0) -> list[np.ndarray]:
    """C07 on the rows of one ball that ``depth`` splits have made: split while the criterion
    improves; members are never dropped; balls in the order of their least member.  A split
    in the last round means that splitting does not end, and fails."""
    sse = lambda x: float(((x - _mean(x)) ** 2).sum())
    done, todo = [], [(np.arange(len(rows)), depth, None)]
    while todo:
        at, deep, own = todo.pop()
        if len(at) >= min_ball:
            x = rows[at]
            side = two_means(x)
            parts = [at[side == 0], at[side == 1]]
            if min(map(len, parts)) >= max(2, min_ball // 4):
                held = [sse(rows[p]) for p in parts]
                if _np_bic(len(at), x.shape[1], sum(held), 2) + 1e-9 < _np_bic(len(at), x.shape[1], sse(x) if own is None else own, 1):
                    if deep + 1 >= rounds:
                        raise ValueError(DIVERGES)
                    todo += [(p, deep + 1, e) for p, e in zip(parts, held)]
                    continue
        done.append(at)
    return sorted(done, key=lambda p: p[0])


DIVERGES = "granular splitting did not converge"


def granular_partition(rows: DataFrame, k: int | None = None, rounds: int | None = 3, by: list[str] = BY, min_ball: int = 4, most: int = 64) -> DataFrame:
    """(by, q, v, m): the balls of a coarse cover, split while the criterion improves and
    numbered from 0 in the order of their least members.

    A series of at most SMALL rows is one task's, cover and balls.  Of longer ones, balls of
    more than SMALL rows are a frontier, one table of all of them: a round splits
    every ball in two by aggregates and joins (C04), weighs the sums of either side (C05,
    C06) and writes what has been split for the next round.  Smaller balls are split to the
    end by one task each.  Fails if the ``most``-th round still splits."""
    short, rows = _parted(written(rows.select(*by, "q", "v"), "rows"), by)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def split(x: np.ndarray) -> np.ndarray:
            m, names = cover(x, k, rounds), np.full(len(x), -1)
            cells = [np.flatnonzero(m == c) for c in np.unique(m[m >= 0])]
            found = [at[part] for at in cells for part in refine(x[at], min_ball, most)]
            for i, at in enumerate(sorted(found, key=lambda at: at[0])):
                names[at] = i
            return names

        return axes.batched(_named(t, by, split(x)) for t, _, _, x in _groups(batches))

    balls = _one_task_each(short, by).mapInArrow(whole, f"{axes._schema(short, [*by, 'q', 'v'])}, m bigint")
    return balls if rows is None else balls.unionByName(_frontier(rows, k, rounds, by, min_ball, most))


def _frontier(rows: DataFrame, k: int | None, rounds: int | None, by: list[str], min_ball: int, most: int) -> DataFrame:
    """``granular_partition`` of series of any length."""
    covered = coarse_cover(rows, k, rounds, by)
    cell = [*by, "_ball"]
    open_ = written(covered.select(*by, "q", "v", F.concat(F.col("m").cast("string"), F.lit(":")).alias("_ball")), "balls")
    small, done = [], []
    for depth in range(most + 1):
        size = open_.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
        large = written(size.where(F.col("_n") > SMALL).select(*cell), "large")
        small.append(open_.join(large, cell, "left_anti").withColumn("_depth", F.lit(depth)))
        if not large.head(1):
            break
        big = written(open_.join(large, cell), "frontier")
        sides = written(two_means_split(big, cell), "sides")
        one, two = ball_sse(sides.select(*cell, "q", "v").withColumn("m", F.lit(0)), cell), ball_sse(sides.withColumnRenamed("side", "m"), cell)
        enough = two.groupBy(*cell).agg(((F.count(F.lit(1)) == 2) & (F.min("n") >= max(2, min_ball // 4))).alias("_enough"))
        better = written(bic_improves(one, two, cell).join(enough, cell).where(F.col("improves") & F.col("_enough")).select(*cell), "better")
        if better.head(1) and depth + 1 >= most:
            raise ValueError(DIVERGES)
        done.append(sides.join(better, cell, "left_anti").select(*by, "q", "v", "_ball"))
        open_ = written(sides.join(better, cell).select(*by, "q", "v", F.concat("_ball", F.col("side").cast("string")).alias("_ball")), "balls")
    cols = [*by, "q", "v", "_ball"]
    rest = _one_task_each(functools.reduce(DataFrame.unionByName, small), cell, "_depth")
    schema = axes._schema(open_, cols)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for rows, _, _, x in _groups(batches):
            names = np.zeros(len(x), np.int64)
            for i, at in enumerate(refine(x, min_ball, most, rows.column("_depth")[0].as_py())):
                names[at] = i
            ball = rows.column("_ball")[0].as_py()
            yield rows.select([*by, "_id", "_v"]).rename_columns([*by, "q", "v"]).append_column("_ball", pa.array([f"{ball}.{i}" for i in names.tolist()]))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return axes.batched(parts(batches))

    frames = [rest.mapInArrow(split, schema), *done]
    named = written(functools.reduce(DataFrame.unionByName, frames), "balls")
    first = named.groupBy(*cell).agg(F.min("q").alias("_first"))
    order = first.withColumn("m", F.row_number().over(Window.partitionBy(*by).orderBy("_first", "_ball")).cast("bigint") - 1)
    return named.join(order.select(*cell, "m"), cell).select(*by, "q", "v", "m")


def exemplar_memory(members: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, m, q, u): the member nearest to its ball's mean, as a unit vector.  A series of
    at most SMALL rows is one task's, so means are added up in the order of its rows: the two
    members of a ball of two are as near, and last digits say which one is kept."""
    short, long = _parted(members, by)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for rows, _, _, x in _groups(batches):
            m = np.asarray(rows.column("m"))
            names, centers = _centers(x, m)
            gap, d = (x - centers[np.searchsorted(names, m)]) ** 2, np.zeros(len(x))
            for place in gap.T:  # one after another, as ``squared_distance`` does
                d += place
            order = np.lexsort((d, m))
            yield rows.select([*by, "m", "_id", "_v"]).take(pa.array(order[np.unique(m[order], return_index=True)[1]])).rename_columns([*by, "m", "q", "v"])

    kept = _one_task_each(short, by, "m").mapInArrow(lambda batches: axes.batched(found(batches)), axes._schema(short, [*by, "m", "q", "v"]))
    if long is not None:
        centers = vector_mean(long, [*by, "m"])
        d = long.join(centers, [*by, "m"]).withColumn("_d", squared_distance(F.col("v"), F.col("center")))
        best = d.groupBy(*by, "m").agg(F.min_by(F.struct("q", "v"), F.struct("_d", "q")).alias("_e"))
        kept = kept.unionByName(best.select(*by, "m", F.col("_e.q").alias("q"), F.col("_e.v").alias("v")))
    return kept.select(*by, "m", "q", l2_normalize(F.col("v")).alias("u"))


def normalize_balls(members: DataFrame, detect: float, least: int = 8, by: list[str] = BY) -> DataFrame:
    """Balls of more than ``least`` rows; ``split`` marks those whose radius exceeds
    2 * detect; the largest ball of a series stays if none would."""
    centers = vector_mean(members, [*by, "m"])
    r = F.max(F.sqrt(squared_distance(F.col("v"), F.col("center"))))
    balls = members.join(centers, [*by, "m"]).groupBy(*by, "m").agg(F.count(F.lit(1)).alias("n"), r.alias("radius"))
    w = Window.partitionBy(*by)
    kept = balls.withColumn("_best", F.max("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "m")))
    kept = kept.where((F.col("n") > least) | ((F.col("_best") <= least) & (F.col("_r") == 1)))
    return kept.select(*by, "m", "n", "radius", (F.col("radius") > 2 * detect).alias("split"))


def center_memory(rows: DataFrame, k: int, rounds: int = 3, by: list[str] = BY) -> DataFrame:
    """C11: k cluster centres (by, slot, u); the last one repeats if there are fewer."""
    centers = vector_mean(coarse_cover(rows, k, rounds, by), [*by, "m"])
    w = Window.partitionBy(*by)
    ranked = centers.withColumn("_r", F.row_number().over(w.orderBy("m"))).withColumn("_n", F.count(F.lit(1)).over(w))
    fill = F.when(F.col("_r") == F.col("_n"), F.sequence(F.col("_r"), F.greatest(F.col("_r"), F.lit(k)))).otherwise(F.array(F.col("_r")))
    return ranked.select(*by, F.explode(fill).alias("slot"), F.col("center").alias("u"))


def partition_stats(before: DataFrame, after: DataFrame, by: list[str] = BY) -> DataFrame:
    """C14: (by, rows, initial_k, final_k, memory_ratio)."""
    a = before.groupBy(*by).agg(F.count_distinct("m").alias("initial_k"))
    b = after.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("m").alias("final_k"))
    return a.join(b, by).select(*by, "rows", "initial_k", "final_k", (F.col("final_k") / F.col("rows")).alias("memory_ratio"))


def cross_correlation(left: DataFrame, right: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, on_diagonal, off_diagonal) of the correlation of standardised places of
    left (by, q, v) and right (by, q, v): mean squared distance from the identity."""
    w = Window.partitionBy(*by, "i")
    z = (F.col("x") - F.avg("x").over(w)) / (F.stddev_pop("x").over(w) + 1e-4)
    part = lambda df: df.select(*by, "q", F.posexplode("v").alias("i", "x")).select(*by, "q", "i", z.alias("z"))
    c = part(left).join(part(right).withColumnsRenamed({"i": "j", "z": "y"}), [*by, "q"]).groupBy(*by, "i", "j").agg(F.avg(F.col("z") * F.col("y")).alias("c"))
    on, off = F.when(F.col("i") == F.col("j"), F.pow(F.col("c") - 1, 2)), F.when(F.col("i") != F.col("j"), F.col("c") * F.col("c"))
    return c.groupBy(*by).agg(F.avg(on).alias("on_diagonal"), F.avg(off).alias("off_diagonal"))


#: Numbers of sums or components that leave a Python worker at once, and columns of the
#: widest rows whose matrix of products one task holds.
HELD, WIDE = 1 << 21, 1 << 10


def principal_components(train: DataFrame, variance: float | None = None, by: list[str] = BY) -> DataFrame:
    """(by, c, share, mean, std, comp): components of the standardised training rows, as
    many as hold ``variance`` (all if not given), their greatest loading positive.  Series of
    more than WIDE columns go through ``axes`` in panels (mean and std in the row of c = 0
    alone); of others one matrix is one task's, and of few numbers the rows too, in the order of
    their numbers q (of their vectors where they have none).  Written, since scores read it several times."""
    if "q" not in train.columns:
        train = train.withColumn("q", F.xxhash64("v"))
    most = train.select(F.max(F.size("v"))).first()[0] or 0
    if most <= WIDE and most * longest(train, by) <= axes.WHOLE:
        return written(_whole_components(train, variance, by), "axes")
    if most <= WIDE:
        return written(_small_components(train, variance, by), "axes")
    wide = axes.wide_components(train.where(F.size("v") > WIDE), variance, by)
    return written(wide.unionByName(_small_components(train.where(F.size("v") <= WIDE), variance, by)), "axes")


def _small_components(train: DataFrame, variance: float | None, by: list[str]) -> DataFrame:
    """Each batch adds up its products of vectors; a d x d matrix leaves it, whatever its
    rows."""

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, heads, sums = np.stack(b["v"].to_numpy()) if len(b) else np.zeros((0, 0)), [], []
            for at in b.groupby(by, sort=False, dropna=False).indices.values():
                y = x[at]
                heads.append(at[0])
                sums.append(np.r_[len(y), y.sum(0), (y.T @ y).ravel()].tolist())
                if len(sums) * (x.shape[1] + 1) ** 2 > HELD:
                    yield b[by].iloc[heads].assign(s=sums)
                    heads, sums = [], []
            yield b[by].iloc[heads].assign(s=sums)

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in train.select(*by).schema.fields)
    sums = train.select(*by, "v").mapInPandas(added, f"{keys}, s array<double>").groupBy(*by).agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held, n = [], 0
            for i in range(len(b)):
                share, mean, std, comp = _fitted(np.asarray(b["s"].iloc[i]), variance)
                k = len(share)
                held.append((np.full(k, i), np.arange(k), share, [mean.tolist()] * k, [std.tolist()] * k, comp.tolist()))
                n += k * len(mean)
                if n > HELD or i + 1 == len(b):
                    at, c, share, mean, std, comp = (list(itertools.chain.from_iterable(x)) for x in zip(*held, strict=True))
                    yield b[by].iloc[at].reset_index(drop=True).assign(c=np.array(c, np.int32), share=share, mean=mean, std=std, comp=comp)
                    held, n = [], 0

    return sums.mapInPandas(fit, f"{keys}, c int, share double, mean array<double>, std array<double>, comp array<double>")


def _fitted(s: np.ndarray, variance: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(share, mean, std, comp) from a series' count, sums and sums of products."""
    d = int(round((-1 + np.sqrt(1 + 4 * (len(s) - 1))) / 2))
    mean = s[1 : d + 1] / s[0]
    cov = s[d + 1 :].reshape(d, d) / s[0] - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 0))
    std[std < 1e-8] = 1.0
    values, vectors = np.linalg.eigh(cov / np.outer(std, std))
    order = np.argsort(values)[::-1]
    share, comp = np.maximum(values[order], 0) / max(values.sum(), 1e-12), vectors[:, order].T
    sign = np.sign(comp[np.arange(d), np.abs(comp).argmax(1)])
    comp = comp * np.where(sign == 0, 1, sign)[:, None]
    k = d if variance is None else min(d, int(np.searchsorted(np.cumsum(share), variance) + 1))
    return share[:k], mean, std, comp[:k]


def _whole_components(train: DataFrame, variance: float | None, by: list[str]) -> DataFrame:
    """``_small_components`` of short series, one task each: rows are added up in the order of
    their numbers, so equal series have equal components."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for rows, _, _, x in _groups(batches):
            share, *rest = _fitted(np.r_[len(x), x.sum(0), (x.T @ x).ravel()], variance)
            k, d = len(share), x.shape[1]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.broadcast_to(a, (k, d)).ravel()), d).cast(pa.list_(pa.float64())) for a in rest]
            out = rows.select(by).take(pa.array(np.zeros(k, np.int64)))
            for name, column in zip(("c", "share", "mean", "std", "comp"), (pa.array(np.arange(k), pa.int32()), pa.array(share), *lists)):
                out = out.append_column(name, column)
            yield out

    keys = axes._schema(train, by)
    return _one_task_each(train, by).mapInArrow(lambda batches: axes.batched(found(batches)), f"{keys}, c int, share double, mean array<double>, std array<double>, comp array<double>")


def pca_score(train: DataFrame, query: DataFrame, variance: float | None = None, by: list[str] = BY) -> DataFrame:
    """Sum over components of the distance to them over their shares (1e-12 at least)."""
    return pca_distance(principal_components(train, variance, by), query, by)


def pca_distance(components: DataFrame, query: DataFrame, by: list[str] = BY) -> DataFrame:
    return axes.distance_sums(components, query, by)


def pca_project(components: DataFrame, rows: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, q, v): rows as their coordinates along ``principal_components``."""
    return axes.coordinates(components, rows, by)


def _path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _tree(x: np.ndarray, rng: np.random.Generator, features: np.ndarray, limit: int) -> list:
    if limit == 0 or len(x) <= 1:
        return [_path(len(x))]
    f = int(rng.choice(features))
    lo, hi = x[:, f].min(), x[:, f].max()
    if lo == hi:
        return [_path(len(x))]
    cut = float(rng.uniform(lo, hi))
    return [f, cut, _tree(x[x[:, f] < cut], rng, features, limit - 1), _tree(x[x[:, f] >= cut], rng, features, limit - 1)]


def _depth(tree: list, x: np.ndarray, at: np.ndarray, depth: int, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[at] = depth + tree[0]
    elif len(at):
        left = x[at, tree[0]] < tree[1]
        _depth(tree[2], x, at[left], depth + 1, out)
        _depth(tree[3], x, at[~left], depth + 1, out)


#: Queries of a series that one task scores with all its trees.
SCORED = 1 << 16


def iforest(train: DataFrame, query: DataFrame, trees: int = 150, share: float = 1.0, psi: int = 256, seed: int = 2026, by: list[str] = BY) -> DataFrame:
    """2 ** (-mean path / c(psi)) - 0.5."""
    return forest_score(grow_forest(train, trees, share, psi, seed, by), query, by)


def grow_forest(train: DataFrame, trees: int = 150, share: float = 1.0, psi: int = 256, seed: int = 2026, by: list[str] = BY) -> DataFrame:
    """C12, learnt part: (by, grown, psi), a row a tree.  A group is one tree's hashed sample
    of at most ``psi`` rows."""
    w = Window.partitionBy(*by)
    ranked = train.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    ranked = ranked.withColumn("_h", F.xxhash64("q", "tree", F.lit(seed))).where((F.pmod("_h", F.lit(1 << 30)) / (1 << 30)) < 4.0 * psi / F.col("_n"))
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "tree").orderBy("_h", "q"))).where(F.col("_r") <= psi)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in train.select(*by).schema.fields)

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part.sort_values("_r")["v"].to_numpy())
        rng = np.random.default_rng([seed, int(part["tree"].iloc[0])])
        features = rng.permutation(x.shape[1])[: max(1, round(share * x.shape[1]))]
        tree = _tree(x, rng, features, int(np.ceil(np.log2(max(2, min(psi, len(x)))))))
        return part[by].head(1).assign(grown=json.dumps(tree), psi=len(x))

    return ranked.select(*by, "tree", "_r", "v").groupBy(*by, "tree").applyInPandas(grow, f"{schema}, grown string, psi int")


def forest_score(forest: DataFrame, query: DataFrame, by: list[str] = BY) -> DataFrame:
    """C12 of queries under ``grow_forest``'s trees.  Queries of a series are dealt into parts
    of about ``SCORED`` rows; the forest goes to each part once, not to each row."""
    parts = query.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / SCORED).cast("int").alias("_parts"))
    dealt = query.join(parts, by).select(*by, "q", "v", F.pmod(F.xxhash64("q"), F.col("_parts")).cast("int").alias("_part"))
    sent = forest.join(parts, by).select(*by, "grown", "psi", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    names = [*by, "q"]

    def score(rows: pd.DataFrame, grown: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(grown):
            return rows[names].head(0).assign(score=0.0)
        x, total = np.stack(rows["v"].to_numpy()), np.zeros(len(rows))
        for t in sorted(grown["grown"]):
            d = np.zeros(len(x))
            _depth(json.loads(t), x, np.arange(len(x)), 0, d)
            total += d
        return rows[names].assign(score=2 ** (-total / len(grown) / max(_path(int(grown["psi"].max())), 1e-12)) - 0.5)

    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in query.select(*names).schema.fields)
    return dealt.groupBy(*by, "_part").cogroup(sent.groupBy(*by, "_part")).applyInPandas(score, f"{out_schema}, score double")


def exemplar_detector(train: DataFrame, query: DataFrame, k: int = 3, variance: float | None = None, channels: int = 1, by: list[str] = BY) -> DataFrame:
    """C15 on patches (by, q, v): (by, q, score).  Each patch is normalised by channel
    and, if ``variance`` is given, projected on the training patches' components; unit
    vectors, granular balls of the training ones, exemplars, and the mean of the k least unit
    distances."""
    return exemplar_score(exemplar_fit(train, variance, channels, by), query, k, channels, by)


def exemplar_fit(train: DataFrame, variance: float | None = None, channels: int = 1, by: list[str] = BY) -> dict[str, DataFrame]:
    """C15, learnt part: ``memory`` (by, m, u) and, where patches are projected, ``axes``."""
    learnt, fitted = written(train.select(*by, "q", revin(F.col("v"), channels).alias("v")), "patches"), {}
    if variance is not None:
        fitted["axes"] = principal_components(learnt, variance, by)
        learnt = pca_project(fitted["axes"], learnt, by)
    unit = learnt.select(*by, "q", l2_normalize(F.col("v")).alias("v")).withColumn("v", steady("v"))
    members = written(granular_partition(unit, by=by), "members")
    return fitted | {"memory": written(exemplar_memory(members, by).select(*by, "m", "u"), "memory")}


def exemplar_score(fitted: dict[str, DataFrame], query: DataFrame, k: int = 3, channels: int = 1, by: list[str] = BY) -> DataFrame:
    """C15 of patches against ``exemplar_fit``'s tables."""
    asked = query.select(*by, "q", revin(F.col("v"), channels).alias("v"))
    if "axes" in fitted:
        asked = pca_project(fitted["axes"], asked, by)
    asked = written(asked.select(*by, "q", l2_normalize(F.col("v")).alias("v")), "asked")
    return topk_mean(asked, fitted["memory"], k, by)


def exemplar_points(series: DataFrame, meta: DataFrame, length: int, k: int = 3, variance: float | None = None) -> DataFrame:
    """C15 from points to points: (series_id, t, score) of series (series_id, t, x); patches
    that end in the prefix are learnt from.  Patches stand where the learned encoder's
    vectors would; everything behind it is the same."""
    sample = series.schema["x"].dataType
    channels = 1 if sample.typeName() != "array" else series.select(F.max(F.size("x"))).first()[0] or 1
    series = written(series.select("series_id", "t", "x"), "series")
    patches = written(windows(series, length).select("series_id", F.col("start").alias("q"), F.col("w").alias("v")), "patches")
    train = patches.join(meta.select("series_id", "train_index"), "series_id").where(F.col("q") + length <= F.col("train_index")).drop("train_index")
    scored = exemplar_detector(train, patches, k, variance, channels).select("series_id", F.col("q").alias("start"), "score")
    return to_points(scored, length, series)
