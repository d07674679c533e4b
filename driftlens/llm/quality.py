"""Operator 1, quality by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts.  A
text is cut into blocks of ``BLOCK`` bytes (all of it, the last one longer by a short rest); each block is compressed with
either dictionary, and the normalised difference of the two sizes says which side it
resembles.  The differences of the whole text, of its worst block and of its worst
quarter become a score by a logistic scale fitted on labelled texts that the
dictionaries have not seen.

Fitted on a bounded sample: about ``PER_CLASS`` texts of each label (``fitting``: at most
``LONGEST`` bytes each), half for the dictionaries and half for the scale, weighted back to
the labels' true shares.  Null and empty texts are one empty block.  A kind with
a single text gives it to both halves.  With labels or sampled texts of one kind only (or
none), every score is the share of label 1 (or 0.5).  Rows with null ids get a score too and are not held out; repeated
rows repeat; other columns, whatever their names, are ignored.  An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fitting import labelled_sample, logistic, sigmoid
from .shared import fold, texts
from .textkit import column, pieces

BLOCK, DICTIONARY, LEVEL, PER_CLASS = 256, 32768, 3, 3000


def _blocks(text: bytes) -> list[bytes]:
    """Blocks of BLOCK bytes; a rest of less than half of that goes with the last one."""
    n = max(1, (len(text) + BLOCK // 2) // BLOCK)
    return [text[i * BLOCK : (i + 1) * BLOCK if i < n - 1 else len(text)] for i in range(n)]


class Compressors:
    """Compressed sizes with either dictionary; made once in each task."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False) for d in (good, bad)]

    def features(self, text: bytes) -> tuple[float, float, float]:
        blocks = _blocks(text)
        good, bad = (np.array([len(c.compress(b)) for b in blocks], float) for c in self.pair)
        each = (bad - good) / (bad + good)
        worst = np.sort(each)[: max(1, len(each) // 4)]
        return (bad.sum() - good.sum()) / (bad.sum() + good.sum()), worst[0], worst.mean()


def _dictionary(samples: list[bytes]) -> bytes:
    blocks = [b for t in samples for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        return (b"".join(blocks) or b"\0" * 8)[-DICTIONARY:]


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", per_class: int = PER_CLASS, **cols) -> dict:
    """The model: two dictionaries and the weights of the scale."""
    known = labels.where(keep).where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("y")).count().collect()
    n = {r["y"]: r["count"] for r in known}
    if not n.get(0) or not n.get(1):
        return {"share": n.get(1, 0) / sum(n.values()) if n else 0.5}
    sample = labelled_sample(docs, labels, label, keep, per_class, **cols).toArrow()
    order = np.argsort(np.asarray(sample.column("doc_id")), kind="stable")
    y = np.asarray(sample.column("y"))[order]
    raw = [sample.column("text")[int(i)].as_py().encode() for i in order]
    if not (y == 1).any() or not (y == 0).any():
        return {"share": n[1] / (n[0] + n[1])}
    half, rest = np.empty(len(raw), bool), np.ones(len(raw), bool)  # of either kind
    for k in (0, 1):
        half[y == k] = np.arange((y == k).sum()) % 2 == 0
        rest[y == k] = ~half[y == k] | ((y == k).sum() == 1)
    parts = [_dictionary([raw[i] for i in np.flatnonzero(half & (y == k))]) for k in (1, 0)]
    c, rest = Compressors(*parts), np.flatnonzero(rest)
    x = np.array([c.features(raw[i]) for i in rest]).reshape(len(rest), 3)
    weight = np.where(y[rest] == 1, n[1] / max(1, (y[rest] == 1).sum()), n[0] / max(1, (y[rest] == 0).sum()))
    return {"good": parts[0], "bad": parts[1], "weights": logistic(x, y[rest], weight * len(rest) / weight.sum())}


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; score is the probability of the label 1."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressors(model["good"], model["bad"]) if "good" in model else None
        for batch in batches:
            for part, data, off in pieces(batch):
                if c:
                    raw = data.tobytes()
                    x = np.array([c.features(raw[a:b]) for a, b in zip(off[:-1], off[1:])])
                    p = sigmoid(x @ model["weights"][:-1] + model["weights"][-1])
                else:
                    p = np.full(len(part), model["share"], float)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return texts(df, id_col, text_col).mapInArrow(emit, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted): learnt from labels outside fold 0."""
    model = fit(docs, labels, fold("doc_id", folds) != 0)
    out = score(docs, model)
    return out.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
