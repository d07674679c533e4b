"""Range areas over thresholds and buffers (M06): counts by chunk, areas by series.

A chunk of a series becomes one row: its points counted by (threshold, distance from the
nearest segment), and for each widening 0..length / 2 its segments counted by the first
threshold that reaches a point of theirs.  Segments that touch the chunk's edges wait for
their neighbours, at most two a widening.  A series adds up its chunks' counts and weighs them
for each buffer; thresholds x buffers are a matrix that no rows are made of.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import chunk_size, haloed
from .sweep import _whole_groups

#: No threshold, among first ones; chunks' rows that are added up at once.
NEVER, ADDED = 1 << 20, 1 << 8
_COUNTS = {"cells": "array<int>", "points": "array<int>", "runs": "array<int>", "segments": "array<int>", "open": "array<int>"}


def _schema(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema.fields)


def _lists(group: np.ndarray, values: np.ndarray, groups: int) -> pa.ListArray:
    """Values in the order of their groups as one list a group."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(group, minlength=groups))], pa.int32()), pa.array(values, pa.int32()))


def _counted(keys: np.ndarray, width: int, groups: int) -> tuple[pa.ListArray, pa.ListArray]:
    """Of keys group * width + x the different x of each group and how often they occur."""
    at, n = np.unique(keys, return_counts=True)
    return _lists(at // width, at % width, groups), _lists(at // width, n, groups)


def chunk_counts(points: DataFrame, reach: int, count: int, by: list[str]) -> DataFrame:
    """(by, _c, cells, points, runs, segments, open) of points (by, t, label, k): cells are
    k * (reach + 2) + d with d = reach + 1 beyond reach and k = 0 for none, runs
    k * (reach + 1) + widening, open ones 4 * run + 2 if it touches the chunk's first point
    + 1 if its last."""
    size = chunk_size(reach, reach)
    held = haloed(points.select(*by, "t", "label", "k"), reach, reach).withColumn("_g", F.xxhash64(*by, "_c"))
    held = held.repartition(*by, "_c").sortWithinPartitions(*by, "_c", "t")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, new in _whole_groups(batches):
            take = lambda c, none=0: np.asarray(rows.column(c).fill_null(none))
            t, real, k, own = take("t"), take("label") == 1, take("k"), take("_own", False)
            g, i = np.cumsum(new) - 1, np.arange(len(t))
            edge = np.r_[np.flatnonzero(new), len(t)]
            back = np.maximum.accumulate(np.where(real, i, -1))
            ahead = np.minimum.accumulate(np.where(real, i, len(t))[::-1])[::-1]
            d = np.full(len(t), reach + 1)
            for at, inside in ((back, back >= edge[g]), (ahead, ahead < edge[g + 1])):
                d[inside] = np.minimum(d[inside], np.abs(t[inside] - t[at[inside]]))
            # groups that only borrow have no row
            heads, g = np.unique(g[own], return_inverse=True)
            t, k, d, groups = t[own], k[own], d[own], len(heads)
            cells = _counted((g * (count + 1) + k) * (reach + 2) + d, (count + 1) * (reach + 2), groups)
            closed, open_of, opened = [], [], []
            for h in range(reach + 1):
                at = np.flatnonzero(d <= h)
                if not len(at):
                    continue
                starts = np.flatnonzero(np.r_[True, (t[at][1:] != t[at][:-1] + 1) | (g[at][1:] != g[at][:-1])])
                ends = np.r_[starts[1:], len(at)] - 1
                best = np.minimum.reduceat(np.where(k[at] > 0, k[at], NEVER), starts)
                first, last = t[at[starts]] % size == 0, t[at[ends]] % size == size - 1
                of, run = g[at[starts]], best * (reach + 1) + h
                touches = first | last
                inner = ~touches & (best < NEVER)
                closed.append(of[inner] * (count + 1) * (reach + 1) + run[inner])
                open_of.append(of[touches])
                opened.append(4 * run[touches] + 2 * first[touches] + last[touches])
            none = np.zeros(0, np.int64)
            runs = _counted(np.concatenate([none, *closed]), (count + 1) * (reach + 1), groups)
            of = np.concatenate([none, *open_of])
            order = np.argsort(of, kind="stable")
            opens = _lists(of[order], np.concatenate([none, *opened])[order], groups)
            named = rows.select([*by, "_c"]).take(pa.array(edge[heads])).combine_chunks()
            whole = pa.table([*named.columns, *cells, *runs, opens], names=[*named.column_names, *_COUNTS])
            yield from whole.to_batches(max_chunksize=ADDED)

    arrays = ", ".join(f"{n} {t}" for n, t in _COUNTS.items())
    return held.mapInArrow(counts, f"{_schema(points, by)}, _c bigint, {arrays}")


def _joined(opens: list[tuple[int, np.ndarray]], reach: int, size: int, total: np.ndarray) -> None:
    """Add the runs that touch edges of chunks to ``total`` (threshold, widening)."""
    live: dict[int, tuple[int, int]] = {}  # widening: chunk up to whose end a run goes, its least threshold

    def close(h: int) -> None:
        _, best = live.pop(h)
        if best < NEVER:
            total[best, h] += 1

    for c, codes in opens:
        for code in sorted(codes.tolist(), key=lambda x: -(x & 2)):  # at the first point before others
            run, first, last = code >> 2, code & 2, code & 1
            best, h = divmod(run, reach + 1)
            if h in live:
                if first and live[h][0] == c - 1:
                    best = min(best, live.pop(h)[1])
                else:
                    close(h)
            live[h] = (c, best)
            if not last:
                close(h)
    for h in list(live):
        close(h)


def areas(points: DataFrame, length: int, count: int, by: list[str]) -> DataFrame:
    """(by, vus_roc, vus_pr) of points (by, t, label, k), k the first of ``count`` thresholds
    at most that a point's score reaches (null: none).  A series without a point of label 1,
    or whose segments have no scores, has nulls."""
    reach, size = length // 2, chunk_size(length // 2, length // 2)
    d, b = np.arange(reach + 1)[:, None], np.arange(length + 1)
    soft = np.sqrt(np.where(b >= 2 * d, 1 - d / np.maximum(b, 1), 0))
    soft[0] = 1

    def of(n: np.ndarray, e: np.ndarray) -> tuple[float | None, float | None]:
        """From points (threshold, distance) and first-reached segments (threshold, widening)."""
        most, every, near = int(np.flatnonzero(n.any(1)).max(initial=0)), n.sum(0), n[1:, :-1]
        tp, pred = np.cumsum(near[:most] @ soft, 0), np.cumsum(n[1 : most + 1].sum(1))[:, None]
        p = every[0] + every[1:-1] @ soft[1:] / 2
        runs, rest = e.sum(0), every.sum() - p
        if not most or not runs.all():
            return None, None
        tpr = np.minimum(tp / p, 1) * (np.cumsum(e[1 : most + 1], 0) / runs)[:, b // 2]
        rise = np.diff(tpr, axis=0, prepend=0)
        pr = (rise * (tp / pred)).sum(0).mean()
        if not (rest != 0).any():
            return None, float(pr)
        fpr = ((pred - tp) / np.where(rest, rest, 1))[:, rest != 0]
        tpr, rise = tpr[:, rest != 0], rise[:, rest != 0]
        return float((np.diff(fpr, axis=0, prepend=0) * (tpr - rise / 2)).sum(0).mean()), float(pr)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, new in _whole_groups(batches, ADDED):
            edge = np.r_[np.flatnonzero(new), len(rows)]
            lists = {c: rows.column(c).combine_chunks() for c in _COUNTS}
            lists = {c: (np.asarray(a.offsets), np.asarray(a.values)) for c, a in lists.items()}
            part = lambda c, lo, hi: lists[c][1][lists[c][0][lo] : lists[c][0][hi]]
            chunk, out = np.asarray(rows.column("_c")), []
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                n, e = (np.bincount(part(keys, lo, hi), part(times, lo, hi), minlength=(count + 1) * width).reshape(-1, width) for keys, times, width in (("cells", "points", reach + 2), ("runs", "segments", reach + 1)))
                _joined([(chunk[i], part("open", i, i + 1)) for i in range(lo, hi)], reach, size, e)
                out.append(of(n, e))
            roc, pr = zip(*out)
            named = rows.select(by).take(pa.array(edge[:-1])).combine_chunks()
            yield from pa.table([*named.columns, pa.array(roc, pa.float64()), pa.array(pr, pa.float64())], names=[*by, "vus_roc", "vus_pr"]).to_batches()

    held = chunk_counts(points, reach, count, by).withColumn("_g", F.xxhash64(*by)).repartition(*by).sortWithinPartitions(*by, "_c")
    return held.mapInArrow(added, f"{_schema(points, by)}, vus_roc double, vus_pr double")
