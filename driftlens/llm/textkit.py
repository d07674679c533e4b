"""Array helpers shared by the text operators: they work on one bounded piece of a
partition at a time and know nothing of Spark.

A *piece* is a run of rows whose texts together hold about ``PIECE_BYTES`` bytes (one
longer text makes a piece of its own, so texts are always whole).  Texts are UTF-8
bytes; null counts as empty.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
BLOCK = 1 << 18  # units of whole texts whose windows are hashed at once: arrays of 2 MB stay in a cache
_U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: ``[\x20\x09-\x0D]``: the separators of words, and what is stripped from lines.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A random 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_BASE, _INVERSE):
        p = np.full(size + 1, base, _U)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n at least."""
    size = 1 << max(BLOCK.bit_length(), int(n).bit_length())
    return _powers(size)


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values from one prefix sum."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values))
        self.sums = np.zeros(len(values) + 1, _U)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """The hash of each window of this length, in order of their starts."""
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length : length + n] - self.sums[:n]) * self.down[:n])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of values[start:end] for each pair; lengths count too."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U) * _U(_BASE))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each window of w values."""
    if len(x) < w:
        return x[:0]
    step = 1
    while step * 2 <= w:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (w - step)], x[w - step :]) if w > step else x


class Runs:
    """Runs of consecutive windows of ``window`` units that share a minimiser.

    The minimiser of a window is the least hash of the ``gram``-unit stretches in it, so
    equal windows have equal minimisers wherever they stand.  A run is a maximal row of
    windows of one document with the same minimiser (``longest`` at most).
    """

    def __init__(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, gram: int, longest: int = 1 << 40):
        self.values = values
        found, lo = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U))], 0
        while lo < len(starts):
            a = starts[lo]
            hi = max(lo + 1, int(np.searchsorted(starts, a + BLOCK, side="right")) - 1)
            first, last, anchor = self._of(values[a : ends[hi - 1]], starts[lo:hi] - a, ends[lo:hi] - a, window, gram, longest)
            found.append((first + a, last + a, anchor))
            lo = hi
        self.first, self.last, self.anchor = (np.concatenate(x) for x in zip(*found))  # of the windows of each run
        self.doc = np.searchsorted(starts, self.first, side="right") - 1

    @functools.cached_property
    def roll(self) -> Rolling:
        return Rolling(self.values)

    @staticmethod
    def _of(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, gram: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        least = sliding_min(Rolling(values).every(gram), window - gram + 1)
        n = len(least)
        inside = np.zeros(n + 1, np.int8)  # +1 where a document's windows begin, -1 behind them
        has = ends - starts >= window
        np.add.at(inside, starts[has], 1)
        np.add.at(inside, ends[has] - window + 1, -1)
        inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
        first = inside.copy()
        first[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
        at = np.flatnonzero(first)
        long = np.flatnonzero(np.diff(np.r_[at, n]) > longest)  # cut into stretches of that many
        for i in long:
            more = np.arange(at[i] + longest, at[i + 1] if i + 1 < len(at) else n, longest)
            first[more[inside[more]]] = True
        last = inside.copy()
        last[:-1] &= first[1:] | ~inside[1:]
        at = np.flatnonzero(first)
        return at, np.flatnonzero(last), least[at]


def pieces(batch: pa.RecordBatch, text: str = "text", size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch with the bytes of their texts and each text's offsets."""
    col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).fill_null(b"")
    if not len(col):
        return
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
        yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def words(data: np.ndarray, off: np.ndarray, is_break: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of the texts starts and ends (bytes), and the first word of each
    text (one more entry: their count). Words never cross texts."""
    gap = is_break[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True  # a text's first byte begins a new word
    inner = ~gap
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = gap[:-1]
    start = np.flatnonzero(inner & (before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = True
    after[:-1] = gap[1:]
    end = np.flatnonzero(inner & (after | cut[1:])) + 1
    return start, end, np.searchsorted(start, off)


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n units lie in some [start, end)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:n], dtype=np.int32) > 0


def ragged(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers first[i] .. first[i]+count[i]-1, and i beside each."""
    owner = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return np.asarray(first)[owner] + at, owner
