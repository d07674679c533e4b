"""Operator 3, suffix-array dedup (bytes).

Texts that may share windows are brought together by ``repeats`` in shards of about a
megabyte; stretches without a longer minimiser in common with another document's are left
out, as no window of theirs can be late.  Each shard's suffix array is made by induced sorting: suffixes are classified as
smaller or larger than the next one, the leftmost-smaller substrings are sorted by one
induction and named, the sequence of names is sorted by recursion, and a second induction
fills in all other suffixes.  Inductions over bytes run a bucket of equal first bytes at a
time on whole arrays.  The names are as many as a shard has different substrings, so in
the recursion (``ranks``) buckets of one symbol would not pay: substrings are sorted by
their packed symbols, and each other suffix by the symbols before the next leftmost-smaller
substring and by that one's rank.  The common prefixes come in text order (permuted),
compared only where the preceding bytes differ and one less than the neighbour's elsewhere.
Nothing is removed that a suffix array has not found.

Segments end in separators that differ from each other, so matches never cross texts.
Null text: no bytes.  Texts shorter than a window, rows without an id and the first copy
of everything stay whole.  Rows that repeat an id count as one document; empty input gives
an empty result; other input columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import late_spans, removed, stretches
from .shared import texts
from .textkit import BYTE_VALUE, Rolling, Runs, column, mix, ragged

WINDOW, GRAM = 50, 24
LONG_GRAM = 44  # bytes of the minimisers that are compared before a suffix array is made
_SEPARATOR = 1  # symbols: 0 the end of all, 1 separators, byte + 2
LONGEST_RISE = 64  # a longer stretch of rising or falling names is ranked by doubling


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the last is)."""
    n = len(s)
    change = s[1:] != s[:-1]
    differs = np.flatnonzero(change)
    rises = s[differs] < s[differs + 1]
    smaller = np.ones(n, bool)
    smaller[:-1] = rises[np.minimum(np.cumsum(change, dtype=np.int32) - change, len(differs) - 1)]
    # separators differ by place: each is smaller than the byte or separator behind it
    smaller[s <= _SEPARATOR] = True
    return smaller


def _deal(where: list[list[np.ndarray]], items: np.ndarray, symbols: np.ndarray) -> None:
    """Append the items to the lists of their symbols, keeping their order."""
    order = np.argsort(symbols, kind="stable")
    symbols, items = symbols[order], items[order]
    a = 0
    for b in [*(np.flatnonzero(symbols[1:] != symbols[:-1]) + 1).tolist(), len(symbols)]:
        where[symbols[a]].append(items[a:b])
        a = b


def _waves(where: list[list[np.ndarray]], c: int, s: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """All of bucket c, which is led by what was dealt to it; those it induces itself
    come wave by wave, what it induces elsewhere is dealt out."""
    wave = np.concatenate(where[c]) if where[c] else np.empty(0, np.int32)
    got = [wave]
    while len(wave):
        before = wave[wave > 0] - 1
        before = before[wanted[before]]
        symbols = s[before]
        other = symbols != c
        if other.any():
            _deal(where, before[other], symbols[other])
        wave = before[~other]
        got.append(wave)
    return np.concatenate(got)


def induce(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller ones (``seeds``) in order."""
    top = int(s.max()) + 1
    empty = np.empty(0, np.int32)
    starts = [[] for _ in range(top)]
    _deal(starts, seeds, s[seeds])
    larger = ~smaller
    where: list = [[] for _ in range(top)]
    large = []
    for c in range(top):
        large.append(_waves(where, c, s, larger))
        seed = np.concatenate(starts[c]) if starts[c] else empty
        before = seed[seed > 0] - 1
        before = before[larger[before]]
        if len(before):
            _deal(where, before, s[before])
    where = [[] for _ in range(top)]
    small = [empty] * top
    for c in range(top - 1, _SEPARATOR, -1):
        small[c] = _waves(where, c, s, smaller)[::-1]
        before = large[c][::-1]
        before = before[before > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _deal(where, before, s[before])
    for c in range(min(top, _SEPARATOR + 1)):
        small[c] = np.flatnonzero(s == c).astype(np.int32)  # by place
    return np.concatenate([x for c in range(top) for x in (large[c], small[c])])


def _seed_names(s: np.ndarray, smaller: np.ndarray, is_seed: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A number for each leftmost-smaller substring (up to the next seed, included), in the
    order that one induction sorts them in; equal substrings get equal numbers."""
    order = induce(s, smaller, seeds)
    order = order[is_seed[order]]
    values = mix(s.astype(np.uint64) + np.uint64(1))
    apart = s == _SEPARATOR
    values[apart] = mix(np.flatnonzero(apart).astype(np.uint64) + np.uint64(1 << 40))
    place = np.zeros(len(s), np.int32)
    place[seeds] = np.arange(len(seeds))
    end = np.r_[seeds[1:], len(s) - 1] + 1
    hashes = Rolling(values).spans(seeds.astype(np.int64), end.astype(np.int64))
    k = place[order]
    name = np.empty(len(seeds), np.int64)
    name[k] = np.cumsum(np.r_[0, hashes[k][1:] != hashes[k][:-1]])
    return name


def _rank(k: np.ndarray) -> np.ndarray:
    """The rank of each number among the distinct ones."""
    order = np.argsort(k)
    k = k[order]
    new = np.zeros(len(k), bool)
    np.not_equal(k[1:], k[:-1], out=new[1:])
    out = np.empty(len(k), np.int64)
    out[order] = np.cumsum(new)
    return out


def ranks(x: np.ndarray) -> np.ndarray:
    """The rank of each suffix of a sequence of small numbers >= 0; the end is least.

    Recursive: runs of one number become one number; then the leftmost-smaller substrings
    are sorted, the sequence of their names is ranked in turn, and each other suffix is
    placed by what lies before the next such substring and by that one's rank."""
    n = len(x)
    count = np.bincount(x)
    if not n or count.max() == 1:
        return np.cumsum(count)[x] - 1
    head = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    if len(head) < n:
        run = np.repeat(np.arange(len(head)), np.diff(np.r_[head, n]))
        left = np.r_[head[1:], n][run] - np.arange(n)  # of the run
        behind = np.r_[x[head[1:]], -1][run]
        rising, most = behind > x, int(left.max()) + 1
        key = _rank((x * 2 + rising) * (2 * most) + np.where(rising, most - left, most + left))
        return _rank(key * (len(head) + 1) + np.r_[ranks(key[head])[1:] + 1, 0][run])
    rising = np.r_[x[:-1] < x[1:], False]
    is_seed = np.r_[False, rising[1:] & ~rising[:-1]]
    seeds, place = np.flatnonzero(is_seed), np.arange(n)
    nth = np.cumsum(is_seed)  # the next seed behind each place
    last = np.r_[seeds, n - 1][nth]
    if (last - place).max(initial=0) >= LONGEST_RISE:
        return _doubled(x)
    name = _named(2 * x + rising + 1, last)
    return _rank(name * (len(seeds) + 1) + np.r_[ranks(name[seeds]) + 1, 0][nth]) if len(seeds) else name


def _named(e: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The rank of e[i] .. e[last[i]] among the distinct ones.  No one leads another, so what
    ends in a column of packed symbols needs no further one."""
    n = len(e)
    bits = int(e.max()).bit_length()
    each = 63 // bits

    def packed(at: np.ndarray, lo: int) -> np.ndarray:
        col = np.zeros(len(at), np.int64)
        for k in range(lo, lo + each):
            col = (col << bits) | np.where(at + k <= last[at], e[np.minimum(at + k, n - 1)], 0)
        return col

    place = np.arange(n)
    first = packed(place, 0)
    order = np.argsort(first)
    first = first[order]
    new = np.r_[True, first[1:] != first[:-1]]
    name = np.empty(n, np.int64)
    name[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # with room for finer names
    lo, on = each, np.flatnonzero(last - place >= each)
    while len(on):
        col = packed(on, lo)
        by = np.lexsort((col, name[on]))
        g, x = name[on][by], col[by]
        group = np.r_[True, g[1:] != g[:-1]]
        finer = group | np.r_[True, x[1:] != x[:-1]]
        name[on[by]] = g + np.flatnonzero(finer)[np.cumsum(finer) - 1] - np.flatnonzero(group)[np.cumsum(group) - 1]
        lo += each
        on = on[last[on] - on >= lo]
    there = np.zeros(n, np.int64)
    there[name] = 1
    return np.cumsum(there)[name] - 1


def _doubled(x: np.ndarray) -> np.ndarray:
    """``ranks`` by doubling, for sequences that rise and fall in very long stretches."""
    rank, step = _rank(x), 1
    while rank.max() < len(x) - 1:
        rank = _rank(rank * (len(x) + 1) + np.r_[rank[step:] + 1, np.zeros(min(step, len(x)), np.int64)])
        step *= 2
    return rank


def _sorted_seeds(name: np.ndarray) -> np.ndarray:
    """The seeds (by number) in the order of the suffixes of the sequence of their names.
    A name that occurs once decides every comparison that reaches it, so only stretches of
    names that occur twice or more, each with the name behind it, are ranked."""
    twice = np.bincount(name)[name] > 1
    rank = np.zeros(len(name), np.int64)
    kept = twice.copy()
    kept[1:] |= twice[:-1]
    rank[kept] = ranks(name[kept])
    return np.argsort(name * (len(name) + 1) + rank)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffixes of s in order; s ends with its only 0, and each 1 in it counts as
    larger than the 1s before it."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int32)
    smaller = classify(s)
    is_seed = np.zeros(n, bool)
    is_seed[1:] = smaller[1:] & ~smaller[:-1]
    seeds = np.flatnonzero(is_seed).astype(np.int32)
    if len(seeds) > 1:
        seeds = seeds[_sorted_seeds(_seed_names(s, smaller, is_seed, seeds))]
    return induce(s, smaller, seeds)


def common_prefixes(data: np.ndarray, room: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the text, how many bytes its suffix shares with the one before
    it in order, at most ``room`` of either: the bytes left in its segment."""
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    p = np.arange(n, dtype=np.int32)
    q = before
    # reducible: the bytes in front are equal too, and both within their segments
    easy = (p > 0) & (q > 0)
    easy[1:] &= (data[:-1] == data[q[1:] - 1]) & (room[:-1] > 1) & (room[q[1:] - 1] > 1)
    shared = np.zeros(n, np.int32)
    at = np.flatnonzero(~easy & (q >= 0))
    limit = np.minimum(room[at], room[q[at]])
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    wide = np.ndarray((n + 8,), "<u8", padded, strides=(1,)).copy()  # eight bytes from each place on
    live, k, words = np.flatnonzero(limit > 0), 0, 1
    one, two, most = at[live], q[at[live]].astype(np.int64), limit[live]
    length = np.zeros(len(at), np.int64)
    while len(live):  # the fewer are left, the more words of each at once
        ahead = np.arange(k, k + 8 * words, 8)
        i, j = one[:, None] + ahead, two[:, None] + ahead
        if words > 1:  # the later words may lie behind the end
            i, j = np.minimum(i, n), np.minimum(j, n)
        x = (wide[i] ^ wide[j]).ravel()
        some = row = np.flatnonzero(x)
        if words > 1:
            row = some // words
            head = np.r_[True, row[1:] != row[:-1]][: len(row)]
            some, row = some[head], row[head]
        low = x[some] & (~x[some] + np.uint64(1))
        same = np.full(len(live), 8 * words)
        same[row] = some % words * 8 + ((low.astype(np.float64).view(np.int64) >> 52) - 1023 >> 3)  # by the exponent
        length[live] = k + same
        k += 8 * words
        on = most > k
        on[row] = False
        live, one, two, most = live[on], one[on], two[on], most[on]
        words = max(1, min(2 * words, 4096 // max(1, len(live))))
    shared[at] = np.minimum(length, limit)
    source = np.maximum.accumulate(np.where(easy, 0, p))
    return np.where(easy, np.maximum(0, shared[source] - (p - source)), shared)


def _late_windows(doc: np.ndarray, data: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Late windows among the segments, by one suffix array over all of them: (segment,
    window in it), ascending."""
    lens = np.diff(off)
    owner = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    at = np.arange(len(data), dtype=np.int32) + owner  # a separator behind each segment
    s = np.full(len(data) + len(lens) + 1, _SEPARATOR, np.int16)
    s[at] = data.astype(np.int16) + 2
    s[-1] = 0
    room = np.zeros(len(s), np.int32)
    room[at] = off[1:][owner] - np.arange(len(data))
    seg = np.full(len(s), -1, np.int32)
    seg[at] = owner
    order = suffix_array(s)
    raw = np.zeros(len(s), np.uint8)
    raw[at] = data
    shared = common_prefixes(raw, room, order)
    order = order[room[order] >= window]  # an order of whole windows; equal ones stay adjacent
    new = shared[order] < window
    new[:1] = True
    d = doc[seg[order]]
    late = np.zeros(len(s), bool)
    late[order] = d > np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1] if len(order) else False
    late = np.flatnonzero(late)
    return seg[late], lens[seg[late]] - room[late]


def resolve(doc: np.ndarray, bodies: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Late windows among the bodies: (body, window in it), and how many windows each body
    has.  Bodies meet by short minimisers; only the stretches that also share a long one
    with another document's, as equal windows do, go into the suffix array."""
    off = np.frombuffer(bodies.buffers()[1], np.int64, len(bodies) + 1, bodies.offset * 8)
    data = np.frombuffer(bodies.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    windows = np.maximum(0, np.diff(off) - window + 1)
    r = Runs(BYTE_VALUE[data], off[:-1], off[1:], window, max(1, window * LONG_GRAM // WINDOW))
    a, b, body = stretches(r, doc, np.arange(len(r.doc)))
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), windows
    lens = b - a + window
    seg, at = _late_windows(doc[body], data[ragged(a, lens)[0]], np.r_[0, np.cumsum(lens)], window)
    return body[seg], at + (a - off[body])[seg], windows


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The texts with their late windows: see ``repeats.late_spans``; units are bytes."""
    return late_spans(texts(df, id_col, text_col), "byte", window, GRAM, resolve)


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256): the bytes that stay, put
    together.  ``kept`` is binary: a cut can fall inside a character."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, u, gone in removed("byte", window, batches):
            kept = [u.data[a:b][~gone[a:b]].tobytes() for a, b in zip(u.first[:-1], u.first[1:])]
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            heads = u.first[:-1][np.diff(u.first) > 0]
            begins[heads] = gone[heads]
            cut, spans = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(begins)]
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), pa.array(np.diff(u.first)), pa.array(np.diff(cut[u.first])), pa.array(np.diff(spans[u.first])), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return repeated_spans(df, id_col, text_col, window).mapInArrow(emit, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
