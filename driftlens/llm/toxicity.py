"""Operator 10, toxicity by character n-grams scaled with naive Bayes ratios.

Features are the distinct n-grams (3 to 5 letters and blanks, lower case) of a text,
hashed to 2**18 slots.  Each slot's log ratio between the shares of toxic and of other
labelled texts that have it scales it, each text's features are brought to length 1, and a
linear classifier is trained on them by accelerated gradient steps.  One text in ``CHECKED``
of the sample takes no part in that; these texts, weighted back to the labels' true shares,
give the slope of the logistic scale from the weighted sum to the score, and the sum that
parts them best (by F1), which scores 0.5.

Fitted on a bounded sample of about ``PER_CLASS`` texts a class (``fitting``), which the
executors turn into a written table of slots in ``GROUPS`` groups.  Class counts and each
gradient are added up there: the driver gets a vector a group, not rows.  Texts without a
letter have no features: their score is that of the constant alone.  With one kind of
labels only (or none) every score is that kind's share (or 0.5).  Rows with null ids get a
score too and are not held out; repeated rows repeat; other columns, whatever their names,
are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fitting import labelled_sample, logistic, sigmoid
from .shared import cut, fold, forget, texts
from .symbols import symbols
from .textkit import Rolling, column, pieces

ORDERS, BITS, PER_CLASS, DAMPING, ROUNDS, GROUPS, CHECKED = (3, 4, 5), 18, 3000, 1e-4, 80, 6, 4


def slots(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct slots of each text, in no order."""
    s, start = symbols(data, off, 1)
    roll = Rolling(s.astype(np.uint64) + np.uint64(1))
    every = [(roll.every(n) ^ np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - BITS) for n in ORDERS]
    seen = np.zeros(1 << BITS, bool)
    for a, b in zip(start[:-1], start[1:]):
        if b - a <= 2:  # two blanks: no letter
            yield np.empty(0, np.int64)
        elif b - a < 5000:
            yield np.unique(np.concatenate([h[a : max(a, b - n + 1)] for n, h in zip(ORDERS, every)])).astype(np.int64)
        else:
            for n, h in zip(ORDERS, every):
                seen[h[a : b - n + 1]] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slots of a batch one text after another, how many each has, and the labels."""
    each = [np.frombuffer(r, np.int32) for r in column(batch, "slots").to_pylist()]
    return np.concatenate(each) if each else np.zeros(0, np.int32), np.array([len(r) for r in each], np.int64), np.asarray(column(batch, "y"))


def _added(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The sum of each text's values; 0 for those without any."""
    out, filled = np.zeros(len(lens)), np.flatnonzero(lens)
    if len(filled):
        out[filled] = np.add.reduceat(values, (np.cumsum(lens) - lens)[filled], dtype=float)
    return out


def added(rows: DataFrame, vector) -> list[np.ndarray]:
    """``vector(batch)`` of rows (part, y, slots, ...), added up by group on the executors;
    one array a group, in the groups' order."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            part = np.asarray(column(batch, "part"))
            for p in np.unique(part):
                sums[p] = sums.get(p, 0) + vector(batch.filter(pa.array(part == p)))
        for p, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["part", "v"])

    got = rows.mapInArrow(emit, "part int, v binary").collect()  # GROUPS vectors, or as many as tasks share a group
    return [np.frombuffer(r["v"], float) for r in sorted(got, key=lambda r: (r["part"], bytes(r["v"])))]


def _scaled(ratio: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """What brings each text's features to length 1."""
    x = ratio[flat]
    return 1 / np.maximum(np.sqrt(_added(x * x, lens)), 1e-9)


def train(rows: DataFrame, kinds: dict[int, int]) -> dict:
    """The ratio of each slot, its weight (ratio times linear weight) and the constant, from
    rows (part, y, slots) of which ``kinds`` has the number of each class."""
    size, spark = 1 << BITS, rows.sparkSession.sparkContext

    def seen(batch: pa.RecordBatch) -> np.ndarray:
        flat, lens, y = _rows(batch)
        own = np.repeat(y, lens)
        return np.concatenate([np.bincount(flat[own == k], minlength=size) for k in (1, 0)]).astype(float)

    p, q = (c + 1.0 for c in np.split(sum(added(rows, seen)), 2))
    ratio = np.log((p / (kinds[1] + 2)) / (q / (kinds[0] + 2)))
    shared = spark.broadcast(ratio.astype(np.float32))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, lens, _ = _rows(batch)
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in ("part", "y", "slots")), pa.array(_scaled(shared.value, flat, lens))], names=["part", "y", "slots", "scale"])

    rows = cut(rows.mapInArrow(scaled, "part int, y int, slots binary, scale double"), "scaled")
    w = v = np.zeros(size)
    b = c = 0.0
    pace, steep = 1.0, 0.5 + DAMPING  # rows and their constant have length 1, the classes' weights add up to 1
    for _ in range(ROUNDS):
        now = spark.broadcast((ratio * v).astype(np.float32))

        def gradient(batch: pa.RecordBatch, now=now, c=c) -> np.ndarray:
            flat, lens, y = _rows(batch)
            scale = np.asarray(column(batch, "scale"))
            # both classes weigh the same in training
            e = (sigmoid(_added(now.value[flat], lens) * scale + c) - y) * np.where(y == 1, 0.5 / kinds[1], 0.5 / kinds[0])
            return np.r_[np.bincount(flat, np.repeat(e * scale, lens), minlength=size), e.sum()]

        total = sum(added(rows, gradient))
        now.destroy()
        w1, b1 = v - (ratio * total[:-1] + DAMPING * v) / steep, c - total[-1] / steep
        later = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        v, c = w1 + (pace - 1) / later * (w1 - w), b1 + (pace - 1) / later * (b1 - b)
        w, b, pace = w1, b1, later
    forget(rows)
    return {"ratio": ratio.astype(np.float32), "weights": (w * ratio).astype(np.float32), "constant": b}


def margins(model: dict, flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
    return _added(model["weights"][flat], lens) * _scaled(model["ratio"], flat, lens) + model["constant"]


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", per_class: int = PER_CLASS, **cols) -> dict:
    known = labels.where(keep).where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("y")).count().collect()
    n = {r["y"]: r["count"] for r in known}
    if not n.get(0) or not n.get(1):
        return {"share": n.get(1, 0) / sum(n.values()) if n else 0.5}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in pieces(batch):
                rows = [r.astype(np.int32).tobytes() for r in slots(data, off)]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "y"), pa.array(rows, pa.binary())], names=["doc_id", "y", "slots"])

    found = labelled_sample(docs, labels, label, keep, per_class, **cols).mapInArrow(emit, "doc_id bigint, y int, slots binary")
    part = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(GROUPS)).cast("int")
    checked = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(CHECKED)) == 0
    rows = cut(found.withColumns({"part": part, "checked": checked}).repartition(GROUPS, "part").sortWithinPartitions("part", "doc_id"), "slots")
    own = rows.where(~F.col("checked")).select("part", "y", "slots")
    sizes = {r["y"]: r for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("slots")).alias("size")).collect()}  # two rows
    if len(sizes) < 2 or not sum(r["size"] for r in sizes.values()):
        return {"share": n[1] / (n[0] + n[1])}
    model = train(own, {y: r["n"] for y, r in sizes.items()})

    def margin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, lens, y = _rows(batch)
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(margins(model, flat, lens))], names=["y", "m"])

    got = rows.where("checked").mapInArrow(margin, "y int, m double").toArrow()  # a fifth of the sample, two numbers a row
    forget(rows)
    y, m = np.asarray(got.column("y")), np.asarray(got.column("m"))
    if len(np.unique(y)) < 2:
        return model | {"scale": (1.0, 0.0)}
    weight = np.where(y == 1, n[1] / (y == 1).sum(), n[0] / (y == 0).sum())
    slope = max(1e-3, logistic(m[:, None], y, weight * len(y) / weight.sum())[0])
    return model | {"scale": (slope, -slope * _best_limit(m, y, weight))}


def _best_limit(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The margin that parts the texts with the best F1 of the label 1: halfway between the
    last text above it and the first one below."""
    order = np.argsort(-m)
    m, hit, said = m[order], np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (said + hit[-1])
    f1[:-1][m[1:] == m[:-1]] = -1  # equal margins cannot be parted
    k = int(f1.argmax())
    return float(m[k] + m[min(k + 1, len(m) - 1)]) / 2


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; score is the probability of the label 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # two megabytes, whatever the corpus

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, data, off in pieces(batch):
                if "weights" in m:
                    each = list(slots(data, off))
                    x = margins(m, np.concatenate(each), np.array([len(r) for r in each], np.int64))
                    p = sigmoid(m["scale"][0] * x + m["scale"][1])
                else:
                    p = np.full(len(part), m["share"], float)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return texts(df, id_col, text_col).mapInArrow(emit, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted): learnt from labels outside fold 0."""
    out = score(docs, fit(docs, labels, fold("doc_id", folds) != 0))
    return out.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
