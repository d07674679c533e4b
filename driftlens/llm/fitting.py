"""Bounded labelled samples and the logistic scale of the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

#: Bytes of the longest text that a classifier is fitted on.
LONGEST = 1 << 16


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, per_class: int, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(doc_id, y, text): about ``per_class`` rows of each class 0 and 1, chosen by a hash
    of the id; whole texts of at most ``longest`` bytes, so the sample is bounded in rows
    and bytes.  ``keep`` is a condition on ``doc_id``, say a fold.  An id labelled twice
    counts once, with its larger label; an id with several rows gives its least text; null
    ids, labels and texts do not count.  The sample's size, not the corpus's, bounds what is
    broadcast and returned."""
    bounded_batches(docs.sparkSession)
    known = (
        labels.select(labels[id_col].cast("bigint").alias("doc_id"), labels[label].cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .where(keep)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.when(F.col("y") == 1, F.lit(per_class / max(1, n.get(1, 0)))).otherwise(F.lit(per_class / max(1, n.get(0, 0))))
    chosen = known.where(unit < share)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).where(F.octet_length("text") <= longest)
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last for the constant) of a slightly damped logistic regression, by
    Newton's method on a few columns."""
    z = np.c_[x, np.ones(len(x))]
    scale = np.maximum(np.abs(z).max(0), 1e-9) if len(z) else np.ones(z.shape[1])
    z = z / scale
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = sigmoid(z @ w)
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(h, z.T @ (weight * (p - y)) + 1e-2 * w)
    return w / scale


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
