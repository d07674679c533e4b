"""Operator 8, benchmark decontamination by Wu-Manber search.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became lower case.  A
pattern is ``WINDOW`` consecutive words of a benchmark item, or all words of a shorter one,
with a blank around each word; documents are brought to the same form, so a pattern occurs
where its words stand in a row.  Patterns are searched by length class, each with a table
of shifts: the block of bytes that ends at a place says how far the next possible end of
any pattern lies.  Where the shift is 0, the block's hash bucket names the patterns to
compare with directly.  Many stretches of a piece of texts are searched side by side.

The benchmark is read in parts of about ``PART_BYTES`` of text (longer items are parts of
their own), one after another: the driver holds one part at a time, sends its tables as a
broadcast, and the documents, with what earlier parts hit, are written to the shared folder
before the next part.  Null texts have no words and no hits; items without words are no
patterns; items without an id hit but are not named; an item that stands twice counts
once.  Rows without an id and repeated rows are rows like others; other columns, whatever
their names, are ignored (``find``) or kept as they were (``drop_contaminated``).  An empty
benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, cut, forget
from .textkit import column, covered, mix, pieces, ragged, words

WINDOW, PART_BYTES, LANE = 10, 2 << 20, 512

IS_BREAK = np.zeros(256, bool)
IS_BREAK[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
IS_BREAK[0x41:0x5B] = False  # A-Z, which are read as a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def plain(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as lower-case words, one blank behind each and one before each text; where
    each word starts in that, and the first word of each text (and their count)."""
    lo, hi, first = words(data, off, IS_BREAK)
    text = np.searchsorted(first, np.arange(len(lo)), side="right") - 1
    at, owner = ragged(lo, hi - lo)
    out = np.full(len(at) + len(lo) + len(off) - 1, 0x20, np.uint8)
    out[np.arange(len(at)) + owner + text[owner] + 1] = LOWER[data[at]]
    n = hi - lo
    return out, np.cumsum(n) - n + np.arange(len(lo)) + text + 1, first


def patterns_of(text: str | None, window: int = WINDOW) -> set[bytes]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    out, start, _ = plain(raw, np.array([0, len(raw)]))
    if not len(start):
        return set()
    edge = np.r_[start, len(out)]
    n = min(window, len(start))
    return {out[edge[i] - 1 : edge[i + n]].tobytes() for i in range(len(start) - n + 1)}


class Search:
    """The tables of one length class."""

    def __init__(self, patterns: list[bytes], numbers: list[int]):
        self.m = min(map(len, patterns))
        self.b = min(8, self.m)
        self.bits = 20
        self.mask = np.uint64((1 << 8 * self.b) - 1)
        self.shift = np.full(1 << self.bits, self.m - self.b + 1, np.int32)
        self.patterns, self.numbers = patterns, numbers
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(len(patterns), self.m).astype(np.uint64)
        self.bucket: dict[int, list[int]] = {}
        for j in range(self.b, self.m + 1):
            block = np.zeros(len(patterns), np.uint64)
            for k in range(self.b):
                block |= heads[:, j - self.b + k] << np.uint64(8 * k)
            np.minimum.at(self.shift, self._slot(block), self.m - j)
        for i, v in enumerate(block.tolist()):  # the last blocks
            self.bucket.setdefault(v, []).append(i)

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (mix(block) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, text: np.ndarray, wide: np.ndarray) -> tuple[list[int], list[int]]:
        """(starts, pattern numbers) of all occurrences; ``wide`` has eight bytes a place."""
        n = len(text)
        lanes = np.arange(self.m, n + 1, LANE)
        end = np.minimum(lanes + LANE, n + 1)
        at, where, which, raw = lanes.copy(), [], [], text.tobytes()
        while len(at):
            block = wide[at - self.b] & self.mask
            step = self.shift[self._slot(block)]
            for e, v in zip(at[step == 0].tolist(), block[step == 0].tolist()):
                for i in self.bucket.get(v, ()):
                    p = self.patterns[i]
                    if raw.startswith(p, e - self.m):
                        where.append(e - self.m)
                        which.append(self.numbers[i])
            at = at + np.maximum(step, 1)
            on = at < end
            at, end = at[on], end[on]
        return where, which


class Matcher:
    """All patterns of one part of the benchmark."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        known: dict[bytes, set] = {}
        for name, text in items:
            for p in patterns_of(text, window):
                known.setdefault(p, set()).add(name)
        every = sorted(known)
        self.names = [sorted(x for x in known[p] if x is not None) for p in every]
        self.lengths = np.array([p.count(b" ") - 1 for p in every], np.int64)  # in words
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(every):
            classes.setdefault(min(5, len(p).bit_length()), []).append(i)  # 16 bytes and more together
        self.classes = [Search([every[i] for i in c], c) for _, c in sorted(classes.items())]

    def scan(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set]]:
        """The first word of each text (and their count), the first and behind-last words
        of all occurrences, and the items found in each text."""
        text, start, first = plain(data, off)
        padded = np.r_[text, np.zeros(8, np.uint8)]
        wide = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,)).copy()
        found: list[set] = [set() for _ in range(len(off) - 1)]
        lo, hi = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for c in self.classes:
            where, which = c.find(text, wide)
            if where:
                w, which = np.searchsorted(start, np.array(where) + 1), np.array(which)
                lo.append(w)
                hi.append(w + self.lengths[which])
                doc = np.searchsorted(first, w, side="right") - 1
                for d, k in np.unique(np.c_[doc, which], axis=0).tolist():
                    found[d].update(self.names[k])
        return first, np.concatenate(lo), np.concatenate(hi), found


def _parts(benchmark: DataFrame) -> Iterator[tuple[list, bool]]:
    """The benchmark's (item, text) in parts of about PART_BYTES each, and whether a part
    is the last one.  One part at a time is on the driver."""
    items = benchmark.select(benchmark["item_id"].cast("string").alias("item"), benchmark["text"].alias("text"))
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0
    n = 1 + total // PART_BYTES
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield [(r["item"], r["text"]) for r in part.collect()], i == n - 1  # about PART_BYTES


_FOUND = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>"
_SPANS = "array<struct<lo:bigint,hi:bigint>>"
_SPANS_ARROW = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items): items are the sorted ids whose patterns occur."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    for items, last in _parts(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Matcher(items, window))

        def emit(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in batches:
                for part, data, off in pieces(batch):
                    first, lo, hi, found = m.scan(data, off)
                    if "spans" in part.schema.names:  # what earlier parts of the benchmark hit
                        old = column(part, "spans")
                        base = np.repeat(first[:-1], np.diff(np.asarray(old.offsets)))
                        lo, hi = np.r_[lo, np.asarray(old.flatten().field("lo")) + base], np.r_[hi, np.asarray(old.flatten().field("hi")) + base]
                        for f, x in zip(found, column(part, "items").to_pylist()):
                            f.update(x)
                    named = pa.array([sorted(f) for f in found], pa.list_(pa.string()))
                    if last:
                        hit = np.diff(np.r_[0, np.cumsum(covered(lo, hi, int(first[-1])))][first])
                        yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(np.diff(first)), pa.array(hit), named], names=["doc_id", "n_words", "n_hit", "items"])
                        continue
                    doc = np.searchsorted(first, lo, side="right") - 1
                    spans: list[list] = [[] for _ in range(len(part))]
                    for d, a, b in zip(doc.tolist(), (lo - first[doc]).tolist(), (hi - first[doc]).tolist()):
                        spans[d].append({"lo": a, "hi": b})
                    yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "text"), pa.array(spans, _SPANS_ARROW), named], names=["doc_id", "text", "spans", "items"])

        found = rows.mapInArrow(emit, _FOUND if last else f"doc_id bigint, text string, spans {_SPANS}, items array<string>")
        if last:
            return found
        rows, before = cut(found, "searched"), rows
        forget(before)
        shared.destroy()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without any hit, all columns as they were."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{[n.lower() for n in names].index('text')}"
    for items, last in _parts(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Matcher(items, window))

        def emit(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in batches:
                for part, data, off in pieces(batch, text):
                    first, lo, _, _ = m.scan(data, off)
                    doc = np.searchsorted(first, lo, side="right") - 1
                    yield part.filter(pa.array(np.bincount(doc, minlength=len(part))[: len(part)] == 0))

        clean = rows.mapInArrow(emit, rows.schema)
        if last:
            return clean.toDF(*names)
        rows, before = cut(clean, "clean"), rows
        forget(before)
        shared.destroy()
