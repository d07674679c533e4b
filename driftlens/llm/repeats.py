"""Finding stretches of text that an earlier document already has.

Common ground of the word-wise (``substring``) and the byte-wise (``suffixes``) operator.
A *window* is ``window`` consecutive units (words or bytes) of one document; it is *late*
if the same window also starts in a document with a smaller id.  All late windows, and no
others, are found by the operator's own ``resolve`` (blocks, suffix arrays); what stands
here only brings together texts that may share windows:

1. Texts are sorted by a sketch (the least hash of 24 bytes in a row), so most copies of a
   text become neighbours, and ``resolve`` finds the late windows inside each piece of
   some megabytes.  A group of copies, however large, leaves one text a piece.
2. The windows left are cut into runs with the same minimiser (``textkit.Runs``).  Equal
   windows have equal minimisers; a run is shuffled as its minimiser (its *anchor*) and its
   document.  Anchors of one document only need nothing more.
3. Runs under anchors of several documents are fetched from the texts and dealt by anchor;
   ``resolve`` finds the late windows in bounded shards of whole anchors.  Under anchors
   with more than ``HOT`` rows every window is dealt by its own hash; a group that is longer
   than a shard is resolved in the order of its documents, and what is first in one part of
   it is carried on to the next.

In both places bodies that are the same byte for byte enter as two, the first document's and
the next one's, which stands for all later ones: they are late alike.

Documents without an id take part in nothing and keep all their units.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import BLOCK, BYTE_VALUE, Rolling, Runs, column, covered, mix, pieces, ragged, words

#: Rows under one anchor from which its windows are dealt one by one.
HOT = 1 << 14
#: Bytes of segments that are resolved at once.
SHARD_BYTES, LONG_KEY = 1 << 21, 8

#: Spans are numbers ``start << 20 | n``: the late windows start at units start .. start+n-1.
_LONGEST = (1 << 20) - 1
_HELD = "doc_id bigint, twin int, packed binary, spans array<bigint>"
_RUN = "anchor bigint, doc_id bigint"
_OPEN = "key bigint, doc_id bigint, twin int, start int, body binary"
_LATE = "doc_id bigint, twin int, at bigint"
_ANCHOR_BITS = np.uint64(48)


class Units:
    """One piece of texts as units: values to compare and the bytes each unit takes."""

    def __init__(self, unit: str, data: np.ndarray, off: np.ndarray):
        self.data, self.unit, self.first = data, unit, off
        if unit == "word":
            self.lo, self.hi, self.first = words(data, off)

    @functools.cached_property
    def values(self) -> np.ndarray:
        each = BYTE_VALUE[self.data]
        return each if self.unit == "byte" else Rolling(each).spans(self.lo, self.hi)

    def bodies(self, a: np.ndarray, b: np.ndarray) -> pa.Array:
        """Units a..b-1 of each pair (b > a) as bytes; words with one space between."""
        at, owner = ragged(a, b - a)
        if self.unit == "word":
            n = self.hi[at] - self.lo[at] + 1
            n[np.cumsum(b - a) - 1] -= 1  # no space behind the last word
            size = np.add.reduceat(n, np.cumsum(b - a) - (b - a)) if len(a) else n
            byte, word = ragged(self.lo[at], n)
            out = np.where(byte < self.hi[at][word], self.data[np.minimum(byte, len(self.data) - 1)], np.uint8(0x20))
        else:
            out, size = self.data[at], b - a
        off = np.r_[0, np.cumsum(size)].astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(out, np.uint8))])


def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one: they are shuffled once, and weigh half."""
    c = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        text = column(batch, "text").cast(pa.binary())
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([c.compress(t) if t else None for t in text.to_pylist()], pa.binary())], names=["doc_id", "packed"])


def texts_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with its packed texts opened, as ``text``."""
    d = zstandard.ZstdDecompressor()
    text = pa.array([d.decompress(t) if t else None for t in column(batch, "packed").to_pylist()], pa.binary())
    at = batch.schema.get_field_index("packed")
    return pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(batch.columns)], names=["text" if i == at else n for i, n in enumerate(batch.schema.names)])


def _spans(at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places as spans: (span, owner); a span stays with one owner."""
    new = np.r_[True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)][: len(at)]
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(at)])
    part, stretch = ragged(np.zeros(len(n), np.int64), -(-n // _LONGEST))  # none counts more than fits
    return (at[first][stretch] + part * _LONGEST << 20) | np.minimum(_LONGEST, n[stretch] - part * _LONGEST), owner[first][stretch]


def _late(spans: pa.Array, first: np.ndarray, n: int) -> np.ndarray:
    """For each of n units of a piece, whether a late window starts there."""
    lens = np.diff(np.asarray(spans.offsets))
    lens[~np.asarray(spans.is_valid())] = 0
    at, owner = np.asarray(spans.flatten()), np.repeat(np.arange(len(lens)), lens)
    start = (at >> 20) + first[owner]
    return covered(start, start + (at & _LONGEST), n)


def _shared(anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows have an anchor that another document has too."""
    order = np.argsort(anchor)
    a, d = anchor[order], doc[order]
    edge = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])
    out = np.zeros(len(a), bool)
    if len(a):
        out[order] = np.repeat(np.minimum.reduceat(d, edge) < np.maximum.reduceat(d, edge), np.diff(np.r_[edge, len(a)]))
    return out


def stretches(r: Runs, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs ``own``, those whose anchors two documents have, neighbours put together:
    first and last window of each stretch, and its text.  No other window can be late."""
    own = own[_shared(r.anchor[own], ids[r.doc[own]])]
    first, last, doc = r.first[own], r.last[own], r.doc[own]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (first[1:] != last[:-1] + 1)][: len(own)]
    return first[new], last[np.r_[new[1:], True][: len(own)]], doc[new]


def _two_of_each(body: pa.Array, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bodies enter a shard, and for each body the place of the one that stands for
    it: of bodies that are the same byte for byte, the first document's stands for that
    document, and the next document's for all others."""
    off = np.frombuffer(body.buffers()[1], np.int64, len(body) + 1, body.offset * 8)
    data = np.frombuffer(body.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    n = np.diff(off)
    h = Rolling(BYTE_VALUE[data]).spans(off[:-1], off[1:])
    order = np.lexsort((doc, h))
    same = np.zeros(len(order), bool)  # as the one before it in this order
    a, b = order[:-1], order[1:]
    alike = np.flatnonzero((h[a] == h[b]) & (n[a] == n[b]))
    if len(alike):
        left, owner = ragged(off[a[alike]], n[a[alike]])
        right = ragged(off[b[alike]], n[b[alike]])[0]
        same[alike + 1] = np.bincount(owner, data[left] != data[right], minlength=len(alike)) == 0
    group = np.cumsum(~same) - 1
    d = doc[order]
    later = d > d[np.flatnonzero(~same)][group]
    new = ~same | (later & ~np.r_[False, later[:-1] & (group[1:] == group[:-1])])
    stands_for = np.empty(len(order), np.int64)
    stands_for[order] = np.cumsum(new) - 1
    return order[new], stands_for


def _resolved(resolve: Callable, doc: np.ndarray, body: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(spans, body of each, which bodies have a window that is not late) of bodies."""
    enters, stands_for = _two_of_each(body, doc)
    seg, at, windows = resolve(doc[enters], body.take(pa.array(enters)), window)
    spans, owner = _spans(at, seg)
    first = np.searchsorted(owner, np.arange(len(enters) + 1))
    each, row = ragged(first[stands_for], np.diff(first)[stands_for])
    return spans[each], row, (np.bincount(seg, minlength=len(enters)) < windows)[stands_for]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, packed, sketch): the least hash of 24 bytes in a row of each text."""
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    for batch in batches:
        for part, data, off in pieces(batch, size=BLOCK):
            sketch = np.zeros(len(part), np.int64)
            a, b = off[:-1], off[1:] - 23
            has = np.flatnonzero(b > a)
            if len(has):
                wide = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
                n = len(data) - 23
                h = wide[:n] * odd[0] + wide[8 : 8 + n] * odd[1] + wide[16 : 16 + n] * odd[2]
                h ^= h >> np.uint64(32)
                h *= odd[0]
                edges = np.c_[a[has], np.minimum(b[has], n - 1)].ravel()  # bytes between texts fall into the odd stretches
                sketch[has] = np.minimum(np.minimum.reduceat(h, edges)[::2], h[b[has] - 1]).view(np.int64)
            packed = next(packed_texts(iter([part])))
            yield pa.RecordBatch.from_arrays([*packed.columns, pa.array(sketch)], names=["doc_id", "packed", "sketch"])


def _ids(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The documents' ids, and which rows have one."""
    ids = column(part, "doc_id")
    return np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid())


def _near(unit: str, window: int, gram: int, resolve: Callable) -> Callable:
    """Late windows inside pieces: only stretches of runs whose anchors two documents of
    the piece share can have any."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = column(batch, "packed")
            opened, done = texts_of(batch), 0
            for part, data, off in pieces(opened, size=SHARD_BYTES):
                u, (ids, has) = Units(unit, data, off), _ids(part)
                r = Runs(u.values, u.first[:-1], u.first[1:], window, gram, _LONGEST)
                a, b, d = stretches(r, ids, np.flatnonzero(has[r.doc]))
                spans, owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(a):
                    spans, row, _ = _resolved(resolve, ids[d], u.bodies(a, b + window), window)
                    spans, owner = spans + (a[row] - u.first[d[row]] << 20), d[row]
                twin = np.array([zlib.crc32(data[a:b]) for a, b in zip(off[:-1], off[1:])], np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(part) + 1)), pa.int32()), pa.array(spans))
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(twin), packed.slice(done, len(part)), lists], names=["doc_id", "twin", "packed", "spans"])
                done += len(part)

    return emit


def _left(part: pa.RecordBatch, u: Units, window: int, gram: int) -> tuple[Runs, np.ndarray]:
    """The runs of a piece, and which windows are not known to be late (with an end)."""
    r = Runs(u.values, u.first[:-1], u.first[1:], window, gram, _LONGEST)
    n = int(u.first[-1])
    return r, np.r_[~_late(column(part, "spans"), u.first, n), False]


def _names(anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Anchors and their texts' rows as one number: a batch has ``BATCH_ROWS`` rows at most."""
    return anchor | row.astype(np.uint64) << _ANCHOR_BITS


def _runs(unit: str, window: int, gram: int) -> Callable:
    """A row (anchor, document) for each run with a window left."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in pieces(texts_of(batch)):
                u, (ids, has) = Units(unit, data, off), _ids(part)
                r, left = _left(part, u, window, gram)
                count = np.r_[np.int32(0), np.cumsum(left, dtype=np.int32)]
                own = has[r.doc] & (count[r.last + 1] > count[r.first])
                name = np.sort(_names(r.anchor[own] >> np.uint64(64) - _ANCHOR_BITS, r.doc[own]))
                name = name[np.r_[True, name[1:] != name[:-1]][: len(name)]]
                anchor, doc = name & (np.uint64(1) << _ANCHOR_BITS) - np.uint64(1), (name >> _ANCHOR_BITS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(ids[doc])], names=["anchor", "doc_id"])

    return emit


def _fetch(unit: str, window: int, gram: int) -> Callable:
    """Bodies of the windows left under the anchors asked for; those of hot anchors (their
    complements are asked for) window by window."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(column(batch, "asked")), 0), 0))
            for part, data, off in pieces(texts_of(batch)):
                u, (ids, _), asked = Units(unit, data, off), _ids(part), column(part, "asked")
                r, left = _left(part, u, window, gram)
                flat = np.asarray(asked.flatten())
                owner = np.repeat(np.arange(len(part)), np.diff(np.asarray(asked.offsets)))
                wanted = _names(np.where(flat < 0, ~flat, flat).view(np.uint64), owner)
                order = np.argsort(wanted)
                anchor = r.anchor >> np.uint64(64) - _ANCHOR_BITS
                mine = _names(anchor, r.doc)
                at = order[np.minimum(np.searchsorted(wanted[order], mine), len(order) - 1)]
                run = np.flatnonzero(wanted[at] == mine)
                hot = flat[at[run]] < 0
                # the windows left of these runs, in stretches; those of hot anchors alone
                p, k = ragged(r.first[run], r.last[run] - r.first[run] + 1)
                p, k = p[left[p]], k[left[p]]
                new = np.r_[True, (p[1:] != p[:-1] + 1) | (k[1:] != k[:-1])][: len(p)] | hot[k]
                a, n = p[new], np.diff(np.r_[np.flatnonzero(new), len(p)])
                k = k[new]
                key, doc = anchor[run[k]], r.doc[run[k]]
                key, alone = mix(key), hot[k]
                if alone.any():
                    key[alone] = r.roll.spans(a[alone], a[alone] + window)
                twin = np.asarray(column(part, "twin"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ids[doc]), pa.array(twin[doc]), pa.array((a - u.first[doc]).astype(np.int32)), u.bodies(a, a + n + window - 1).cast(pa.binary())],
                    names=["key", "doc_id", "twin", "start", "body"],
                )

    return emit


def _shards(resolve: Callable, window: int) -> Callable:
    """Feed whole keys, about SHARD_BYTES at once, to ``resolve(docs, bodies, window)``,
    which returns (segment, window in it) of late windows, ascending, and the number of
    windows of each segment.  Of a key that goes on for ``LONG_KEY`` shards, only segments
    with a window that is not late are carried on."""

    def run(held: list[pa.Table]) -> tuple[pa.RecordBatch, pa.Table]:
        t = pa.concat_tables(held).combine_chunks()
        doc, start, twin, key = (np.asarray(t.column(c)) for c in ("doc_id", "start", "twin", "key"))
        body = pa.concat_arrays([c.cast(pa.large_binary()) for c in t.column("body").chunks])
        spans, row, unsettled = _resolved(resolve, doc, body, window)
        out = pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(twin[row]), pa.array(spans + (start[row].astype(np.int64) << 20))], names=["doc_id", "twin", "at"])
        return out, t.filter(pa.array(unsettled & (key == key[-1])))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, LONG_KEY * SHARD_BYTES
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                t = pa.Table.from_batches([batch.slice(lo, 4096)])
                if size >= SHARD_BYTES:
                    key = np.asarray(t.column("key"))
                    edge = np.flatnonzero(np.r_[held[-1].column("key")[-1].as_py(), key[:-1]] != key)
                    if len(edge):
                        yield run([*held, t.slice(0, int(edge[0]))])[0]
                        held, size, most, t = [], 0, LONG_KEY * SHARD_BYTES, t.slice(int(edge[0]))
                    elif size >= most:
                        late, rest = run(held)
                        yield late
                        held, size = [rest], rest.nbytes
                        most = max(most, 2 * size)  # if little was late, wait longer the next time
                held.append(t)
                size += t.nbytes
        if any(len(t) for t in held):
            yield run(held)[0]

    return emit


def late_spans(docs: DataFrame, unit: str, window: int, gram: int, resolve: Callable) -> DataFrame:
    """(doc_id, twin, packed, spans, found) of docs (doc_id, text): spans and found are the
    late windows; ``removed`` reads them.  Texts travel compressed (``texts_of`` opens
    them).  ``twin`` tells apart texts that stand under one id."""
    sketched = docs.mapInArrow(_sketched, "doc_id bigint, packed binary, sketch bigint")
    near = sketched.repartitionByRange("sketch", "doc_id").sortWithinPartitions("sketch", "doc_id").drop("sketch")
    held = near.mapInArrow(_near(unit, window, gram, resolve), _HELD).repartition("doc_id")
    anchor = Window.partitionBy("anchor")
    asked = F.when(F.count(F.lit(1)).over(anchor) > HOT, F.bitwise_not("anchor")).otherwise(F.col("anchor"))
    seen = held.mapInArrow(_runs(unit, window, gram), _RUN).repartition("anchor")
    seen = seen.select("doc_id", asked.alias("asked"), (F.min("doc_id").over(anchor) < F.max("doc_id").over(anchor)).alias("shared"))
    marks = seen.where("shared").groupBy("doc_id").agg(F.collect_list("asked").alias("asked"))
    found = (
        held.join(marks, "doc_id", "left")  # an inner join would filter below the exchange that all uses of held share
        .mapInArrow(_fetch(unit, window, gram), _OPEN)
        .repartition("key")
        .sortWithinPartitions("key", "doc_id")
        .mapInArrow(_shards(resolve, window), _LATE)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("twin", "at")).alias("found"))
    )
    return held.join(found, "doc_id", "left")


def removed(unit: str, window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Units, np.ndarray]]:
    """Pieces of ``late_spans`` with, for each unit, whether a late window covers it."""
    for batch in batches:
        for part, data, off in pieces(texts_of(batch)):
            u = Units(unit, data, off)
            starts = _late(column(part, "spans"), u.first, int(u.first[-1]))
            found = column(part, "found")
            lens = np.diff(np.asarray(found.offsets))
            lens[~np.asarray(found.is_valid())] = 0
            owner, flat = np.repeat(np.arange(len(lens)), lens), found.flatten()
            own = np.asarray(flat.field("twin")) == np.asarray(column(part, "twin"))[owner]
            at, owner = np.asarray(flat.field("at"))[own], owner[own]
            start = (at >> 20) + u.first[owner]
            starts |= covered(start, start + (at & _LONGEST), int(u.first[-1]))
            p = np.flatnonzero(starts)
            edge = np.r_[True, p[1:] != p[:-1] + 1][: len(p)]
            yield part, u, covered(p[edge], p[np.r_[edge[1:], True][: len(p)]] + window, int(u.first[-1]))
