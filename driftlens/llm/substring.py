"""Operator 2, substring dedup by fixed-block anchors (words).

Texts that may share windows are brought together by ``repeats``.  Among them, the
non-overlapping blocks of ``window // 2`` words are indexed, each block hash once with the
least document that has it; every rolling window of as many words is probed.  A window of
``window`` words always holds a whole block, so only windows around hits are extended to
``window`` words; equal ones are late behind their first document, and adjacent late
windows join to maximal repeats.  Nothing is removed that the blocks have not found.

Null text: no words.  Texts shorter than a window, rows without an id and the first copy
of everything stay whole.  Rows that repeat an id count as one document.  Empty input
gives an empty result; other input columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import late_spans, removed
from .shared import texts
from .textkit import BYTE_VALUE, Rolling, column, ragged, words

WINDOW, GRAM = 50, 5


def resolve(doc: np.ndarray, bodies: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Late windows among the bodies (words with one space between): (body, window in it),
    and how many windows each body has."""
    off = np.frombuffer(bodies.buffers()[1], np.int64, len(bodies) + 1, bodies.offset * 8)
    data = np.frombuffer(bodies.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    lo, hi, first = words(data, off)
    roll = Rolling(Rolling(BYTE_VALUE[data]).spans(lo, hi))
    n, half = np.diff(first), window // 2
    seg = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(seg)) - first[seg]

    # the index: blocks at 0, half, 2*half ... of each segment, with their least document
    short = roll.every(half)
    probe = np.flatnonzero(place[: len(short)] + half <= n[seg[: len(short)]])
    block = probe[place[probe] % half == 0]
    order = np.lexsort((doc[seg[block]], short[block]))
    keys, at, back = np.unique(short[block][order], return_index=True, return_inverse=True)
    least = doc[seg[block[order]]][at]

    # the probes: every rolling window; a hit is one whose block stands in an earlier document
    hash_ = short[probe]
    slot = np.minimum(np.searchsorted(keys, hash_), max(0, len(keys) - 1))
    found = (keys[slot] == hash_) if len(keys) else np.zeros(len(probe), bool)
    hit = found & (least[slot] < doc[seg[probe]])
    wanted = np.zeros(len(keys), bool)
    wanted[slot[hit]] = True
    sources = block[order][wanted[back]]

    # extension: full windows around hits and around the blocks that were hit
    around = np.unique(ragged(np.r_[probe[hit], sources] - half, np.full(hit.sum() + len(sources), half + 1))[0])
    around = around[(around >= 0) & (around < len(roll.sums) - window)]
    around = around[place[around] + window <= n[seg[around]]]
    full = roll.spans(around, around + window)
    d = doc[seg[around]]
    order = np.lexsort((d, full))
    new = np.r_[True, full[order][1:] != full[order][:-1]][: len(order)]
    late = np.zeros(len(around), bool)
    if len(order):
        late[order] = d[order] > d[order][new][np.cumsum(new) - 1]
    return seg[around[late]], place[around[late]], np.maximum(0, n - window + 1)


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The texts with their late windows: see ``repeats.late_spans``; units are words."""
    return late_spans(texts(df, id_col, text_col), "word", window, GRAM, resolve)


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256): what stays of each document, its
    words joined by one space.  Words are stretches without ``[\\x20\\x09-\\x0D]``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, u, gone in removed("word", window, batches):
            kept, cut = [], np.r_[0, np.cumsum(gone)]
            for a, b in zip(u.first[:-1], u.first[1:]):
                w = a + np.flatnonzero(~gone[a:b])
                at, owner = ragged(u.lo[w], u.hi[w] - u.lo[w] + 1)
                out = u.data[np.minimum(at, len(u.data) - 1)]
                if len(out):
                    out[np.r_[owner[1:] != owner[:-1], True]] = 0x20
                kept.append(out[:-1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), pa.array(np.diff(u.first)), pa.array(np.diff(cut[u.first])), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    return repeated_spans(df, id_col, text_col, window).mapInArrow(emit, "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string")
