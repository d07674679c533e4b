"""Range F1 over every distinct score (M05 without quantiles).

As the threshold falls, predicted segments appear at a peak, grow and merge.  A predicted
segment is a stretch between two points with smaller scores than all inside, so a series has
at most one for each point, and each lives from its least score down to the greater of the two
beside it.  What it adds to the precision is known from running sums at its ends, and what a
real segment adds to the recall from its own points and pairs of neighbours.  Both become
changes at scores, added up from the highest score down; no threshold meets any point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import ranges
from .ranges import beside, chunk, haloed, running

#: Points of many short chunks that are matched at once.
MATCHED = 1 << 16
#: What a point tells the segments that end beside it.
_SIDE = {"t": "bigint", "score": "double", "a": "bigint", "b": "bigint", "start": "boolean", "label": "int", "on": "boolean"}


def enclosed(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows with ``prev`` and ``next``, the nearest points on either side with a smaller
    score (null: none), and ``first``: no earlier point before the one in ``prev`` has the same
    score.  Each chunk finds what it holds; points that have no smaller one on a side within
    their chunk (few, but for series that rise or fall throughout) are matched among
    themselves, a series a task."""
    side = ", ".join(f"{n}: {t}" for n, t in _SIDE.items())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", prev struct<{side}>, next struct<{side}>, first boolean"

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, new in _whole_groups(batches):
            s = np.asarray(rows.column("score").fill_null(-np.inf))
            s = np.where(np.isnan(s), -np.inf, s)
            before, behind, first = _smaller(s.tolist(), new.tolist())
            points = pa.StructArray.from_arrays([rows.column(c).combine_chunks() for c in _SIDE], list(_SIDE))
            pick = lambda at: points.take(pa.array(at, mask=at < 0))
            whole = rows.drop_columns("_g").append_column("prev", pick(before)).append_column("next", pick(behind)).append_column("first", pa.array(first))
            yield from whole.to_batches(max_chunksize=MATCHED)

    def matched(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.withColumn("_g", F.xxhash64(*keys)).repartition(*keys).sortWithinPartitions(*keys, "t").mapInArrow(match, schema)

    inside = written(matched(df, [*by, "_c"]), "enclosed")
    apart = F.col("prev").isNull() | F.col("next").isNull()
    across = matched(inside.where(apart).select(*df.columns), by)
    across = across.select(*by, "t", F.col("prev").alias("_prev"), F.col("next").alias("_next"), F.col("first").alias("_first"))
    held = beside(inside.where(apart), across, [*by, "t"])
    held = held.select(*df.columns, F.coalesce("prev", "_prev").alias("prev"), F.coalesce("next", "_next").alias("next"), (F.col("first") & F.coalesce("_first", F.lit(True))).alias("first"))
    return inside.where(~apart).unionByName(held)


def _smaller(s: list[float], new: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each number the places of the nearest smaller ones before and behind it in its
    group (-1: none), and whether none like it stands between; ``new`` marks first rows."""
    before, behind, first, stack = [-1] * len(s), [-1] * len(s), [True] * len(s), []
    for i, x in enumerate(s):
        if new[i]:
            stack = []
        while stack and s[stack[-1]] > x:
            behind[stack.pop()] = i
        if stack:
            top = stack[-1]
            if s[top] == x:
                before[i], first[i] = before[top], False
            else:
                before[i] = top
        stack.append(i)
    return np.array(before), np.array(behind), np.array(first)


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole groups, about ``least`` (MATCHED) at a time, and where groups begin."""
    least = least or MATCHED
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        rows = pa.Table.from_batches(held)
        g = np.asarray(rows.column("_g"))
        new = np.r_[True, g[1:] != g[:-1]]
        end = len(g) if last else int(np.flatnonzero(new)[-1])
        held[:] = rows.slice(end).combine_chunks().to_batches() if end < len(g) else []
        if end:
            yield rows.slice(0, end), new[:end]

    wait = least
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= wait:
            yield from cut(False)
            wait = least + 2 * sum(map(len, held))  # a long group is not gone through for each batch
    if held:
        yield from cut(True)


def every_range_f1(df: DataFrame, alpha: float = 0.2, by: list[str] | None = None) -> DataFrame:
    """M05 over all thresholds: (by, range_f1, threshold), the best over every distinct score
    and the highest score that reaches it.  Rows are (by, t, score, label).

    Points without a score are in no predicted segment.  Series without a point of label 1
    or without any score have no row, as in ``range_f1``; infinite scores and NaN are F06's
    to replace first."""
    by = by or ["series_id"]
    long = ranges.longest(df, by) > ranges.LONG
    placed = running(df.select(*by, "t", F.col("score").cast("double").alias("score"), F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label")), by, ["t"], {"a": F.col("label").cast("bigint")}, long)
    placed = placed.select(*by, F.col("_r").alias("t"), "score", "label", "a", F.col("a_all").alias("a1"))
    w = Window.partitionBy(*by, "_c").orderBy("t")
    held = haloed(placed, 1, 1)
    real, ahead = F.col("label") == 1, F.lead("score").over(w)
    held = held.withColumns({"start": real & (F.coalesce(F.lag("label").over(w), F.lit(0)) != 1), "on": real & (F.coalesce(F.lead("label").over(w), F.lit(0)) == 1), "pair": F.when(F.col("score").isNotNull() & ahead.isNotNull(), F.least("score", ahead))})
    held = running(held.where("_own").drop("_c", "_own"), by, ["t"], {"b": F.col("start").cast("bigint"), "n": F.lit(1).cast("bigint")}, long).drop("_r", "n")
    held = written(held, "sweep")

    # real segments: hit points and, one less for each hit pair, their pieces
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    own = held.where(real).select(*by, "b", "score", F.when(F.col("score").isNull(), zero).otherwise(one).alias("c"), F.when(F.col("score").isNull(), zero).otherwise(one).alias("k"), one.alias("l"), F.col("start").cast("bigint").alias("m"))
    pairs = held.where(F.col("on") & F.col("pair").isNotNull()).select(*by, "b", F.col("pair").alias("score"), zero.alias("c"), (-one).alias("k"), zero.alias("l"), zero.alias("m"))
    steps = own.unionByName(pairs).groupBy(*by, "b", "score").agg(*[F.sum(c).alias(f"_{c}") for c in "cklm"])
    steps = running(steps, [*by, "b"], [F.desc("score")], {c: F.col(f"_{c}") for c in "ckl"}, long)
    part = lambda c, k: F.when(k > 0, alpha + (1 - alpha) * c / (F.col("l_all") * k)).otherwise(0.0)
    recalls = steps.select(*by, "score", (part(F.col("c"), F.col("k")) - part(F.col("c") - F.col("_c"), F.col("k") - F.col("_k"))).alias("r"), F.lit(0.0).alias("p"), zero.alias("k"), F.col("_m").alias("m"))

    # predicted segments: real points in them, over their length and the real segments met
    near = enclosed(held.select(*by, "t", "score", "label", "a", "b", "start", "on", "a1", "n_all", "b_all", chunk().alias("_c")), by).where("first AND score IS NOT NULL")
    prev, nxt = (lambda c, d: F.coalesce(F.col(f"prev.{c}"), d)), (lambda c, d: F.coalesce(F.col(f"next.{c}"), d))
    inside = nxt("a", F.col("a1")) - nxt("label", F.lit(0)) - prev("a", zero)
    met = nxt("b", F.col("b_all")) - nxt("start", F.lit(False)).cast("bigint") - prev("b", zero) + prev("on", F.lit(False)).cast("bigint")
    size = nxt("t", F.col("n_all")) - prev("t", F.lit(-1).cast("bigint")) - 1
    ends = F.greatest("prev.score", "next.score")  # the greater one, null if there is none
    live = near.select(*by, "score", ends.alias("_end"), (inside / (size * F.greatest(met, one))).alias("p"))
    change = F.explode(F.array(F.struct("score", F.lit(1).cast("bigint").alias("k")), F.struct(F.col("_end").alias("score"), F.lit(-1).cast("bigint").alias("k"))))
    live = live.select(*by, "p", change.alias("_x")).where("_x.score IS NOT NULL")
    precisions = live.select(*by, "_x.score", F.lit(0.0).alias("r"), (F.col("p") * F.col("_x.k")).alias("p"), F.col("_x.k").alias("k"), zero.alias("m"))

    changes = recalls.unionByName(precisions).groupBy(*by, "score").agg(*[F.sum(c).alias(f"_{c}") for c in "rpkm"])
    curve = running(changes, by, [F.desc("score")], {c: F.col(f"_{c}") for c in "rpkm"}, long).where("score IS NOT NULL AND k > 0 AND m_all > 0")
    curve = curve.select(*by, "score", (F.col("r") / F.col("m_all")).alias("r"), (F.col("p") / F.col("k")).alias("p"))
    best = F.max(F.struct(F.when(F.col("r") + F.col("p") > 1e-12, 2 * F.col("r") * F.col("p") / (F.col("r") + F.col("p"))).otherwise(0.0).alias("f"), "score"))
    return curve.groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b.f").alias("range_f1"), F.col("_b.score").alias("threshold"))
