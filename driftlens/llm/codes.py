"""Vector code compression (operator 12): member-resident Lloyd.

A vector's components become integers ``floor(scale * x)``, cut into equal parts, each with
a codebook of its own.  Parts live in groups (position, entry, salt); the salt is the run of
rows that a vector was read in, so a group holds at most ``RUN`` members even if one entry
takes all vectors.  Each round the groups' owners add up their resident members, the sums
(entries x components numbers in all) make the next codebooks, and every owner looks for
its members' nearest entries again.  Members that stay are not shuffled; those whose entry
changes are packed by new entry and go to their new owner in the next shuffle.

Rows whose vector is null or holds null or non-finite components are dropped.  The vector of
the smallest kept id says how many components count; a vector of another length keeps its
row, with null code and error.  If the parts do not divide the components, zeros are added
at the end.  The first entries are the kept rows with the smallest ids (null ids last, equal
ids by their vectors); fewer rows give fewer entries.  Repeated rows count each.  Integers
are exact: beyond 2^62 they are held at that bound, and an error beyond 2^63 - 1 is that
number.  An empty table gives no rows.  Other columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, cut
from .tiles import unusable

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of a run, as a power of two: the members that an owner holds at most.
RUN_BITS = 13
_MOST, _LONG = 1 << 62, (1 << 63) - 1
_STATE = "position int, entry int, salt bigint, members binary, vectors binary, width int, moved boolean, errors binary"


@dataclass
class Compressed:
    """rows (vec_id, label, codes array<int>, error); codebooks[part, entry, place] as ints."""

    rows: DataFrame
    codebooks: np.ndarray
    moves: list[int]


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> Compressed:
    """The codes of all usable vectors after ``rounds`` of Lloyd's steps and a last assignment;
    ``moves`` counts the parts that changed entry in each round."""
    bounded_batches(df.sparkSession)
    v = F.transform(df[vec_col], lambda x: x.cast("double"))
    label = df[label_col] if label_col else F.lit(None).cast("int")
    kept = df.select(df[id_col].cast("bigint").alias("vec_id"), label.alias("label"), v.alias("v")).where(F.col("v").isNotNull() & ~F.coalesce(F.exists("v", unusable), F.lit(False)))
    base = cut(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
    in_order = base.orderBy(F.asc_nulls_last("vec_id"), "v").select("v")
    d = next((len(r.v) for r in in_order.limit(1).collect()), None)
    if d is None:
        return Compressed(base.select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("bigint").alias("error")), np.zeros((parts, 0, 0), object), [])
    first = [r.v for r in in_order.where(F.size("v") == d).limit(entries).collect()]  # ``entries`` rows
    wide = -(-d // parts)
    books = np.array([padded(x, parts * wide, scale) for x in first], dtype=object).reshape(len(first), parts, wide).transpose(1, 0, 2)
    out = base.where(F.size("v") == d).select("row", "v").mapInArrow(_first(books, d, scale), _STATE).repartition("position", "entry", "salt").persist(StorageLevel.DISK_ONLY)
    state, held, moves = out, [out], []
    owners = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(rounds):
        books, moved = _next(books, state)
        moves.append(moved)
        out = state.mapInArrow(_again(books), _STATE).persist(StorageLevel.DISK_ONLY)
        held.append(out)
        state = out.where(~F.col("moved")).union(out.where("moved").repartition("position", "entry", "salt")).coalesce(owners)
    codes = [F.max(F.when(F.col("position") == p, F.col("entry"))) for p in range(parts)]
    error = F.least(F.sum("error"), F.lit(Decimal(_LONG))).cast("bigint")
    coded = cut(out.mapInArrow(_members, "row bigint, position int, entry int, error decimal(20,0)").groupBy("row").agg(F.array(*codes).alias("codes"), error.alias("error")), "codes")
    for df in held:
        df.unpersist()
    return Compressed(base.drop("v").join(coded, "row", "left").drop("row"), books, moves)


def padded(x: list[float], size: int, scale: float) -> list[int]:
    """floor(scale * x) exactly, with zeros up to ``size``."""
    return [_floor(y, scale) for y in x] + [0] * (size - len(x))


def _floor(y: float, scale: float) -> int:
    z = y * scale
    return max(-_MOST, min(_MOST, int(np.floor(z)) if np.isfinite(z) else _MOST * int(np.sign(z))))


def code_text(codes: str = "codes"):
    """Two hex digits an index, in part order."""
    return F.array_join(F.transform(codes, lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def label_errors(rows: DataFrame) -> DataFrame:
    """The rows and ``label_error``: the error of all rows with an equal label (null: one label)."""
    per = rows.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    return rows.join(per.withColumnRenamed("label", "_l"), F.col("label").eqNullSafe(F.col("_l"))).drop("_l")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (the lower of equal ones) and the squared distance, exact:
    in doubles while every number is below 2^53, else in Python's integers."""
    most = max(int(np.abs(x).max(initial=0)), max((abs(int(e)) for e in book.ravel()), default=0))
    if max(1, x.shape[1]) * (2 * most) ** 2 < 1 << 52:
        a, b = x.astype(np.float64), book.astype(np.float64)
        far = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        at = far.argmin(1)
        return at, far[np.arange(len(x)), at].astype(np.int64)
    far = ((x.astype(object)[:, None] - book[None]) ** 2).sum(2)
    at = far.argmin(1)
    return at, np.array([min(e, _LONG) for e in far[np.arange(len(x)), at]], np.int64)


def _pack(position: int, salt: np.ndarray, members: np.ndarray, x: np.ndarray, was: np.ndarray | None, book: np.ndarray) -> Iterator[tuple]:
    """State rows of parts at a position: one for each entry, salt and whether they moved."""
    at, error = nearest(x, book)
    moved = np.ones(len(at), bool) if was is None else at != was
    key = np.lexsort((moved, at, salt))
    ends = np.flatnonzero(np.r_[True, (np.diff(salt[key]) != 0) | (np.diff(at[key]) != 0) | (np.diff(moved[key].astype(int)) != 0), True]) if len(key) else np.zeros(1, int)
    for s, e in zip(ends, ends[1:], strict=False):
        k = key[s:e]
        y = x[k] if np.abs(x[k]).max(initial=0) >= 1 << 31 else x[k].astype(np.int32)
        yield position, int(at[k[0]]), int(salt[k[0]]), members[k].astype(np.uint16).tobytes(), y.tobytes(), x.shape[1], bool(moved[k[0]]), error[k].tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.bool_(), pa.binary())
    names = [c.split()[0] for c in _STATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _unpack(b: pa.RecordBatch) -> Iterator[tuple]:
    """(position, entry, salt, members, vectors) of each state row."""
    for p, e, s, m, v, w in zip(*(b.column(c).to_pylist() for c in ("position", "entry", "salt", "members", "vectors", "width")), strict=True):
        m = np.frombuffer(m, np.uint16)
        v = np.frombuffer(v, np.int64 if w and len(v) == 8 * w * len(m) else np.int32).reshape(len(m), w)
        yield p, e, s, m, v.astype(np.int64)


def _first(books: np.ndarray, d: int, scale: float):
    """All parts of the rows read, with their nearest entries."""
    parts, wide = books.shape[0], books.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, n = b.column("row").to_numpy(), len(b)
            z = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, d) * scale
            x = np.zeros((n, parts * wide), np.int64)
            x[:, :d] = np.clip(np.floor(z), -(2.0**62), 2.0**62).astype(np.int64)
            x = x.reshape(n, parts, wide)
            rows = [r for p in range(parts) for r in _pack(p, row >> RUN_BITS, row & ((1 << RUN_BITS) - 1), x[:, p], None, books[p])]
            yield _batch(rows)

    return assign


def _again(books: np.ndarray):
    """The owners' members and their nearest entries in the new codebooks."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[int, list[tuple]] = {}
            for p, e, s, m, v in _unpack(b):
                by.setdefault(p, []).append((np.full(len(m), s), m, v, np.full(len(m), e)))
            yield _batch([r for p, held in by.items() for r in _pack(p, *(np.concatenate(c) for c in zip(*held, strict=True)), books[p])])

    return assign


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (position, entry, place, total) for each sum of a task; place -1 counts members,
    -2 those that have come since the last round."""
    total: dict[tuple[int, int], list[int]] = {}
    for b in batches:
        for (p, e, _, m, v), moved in zip(_unpack(b), b.column("moved").to_pylist(), strict=True):
            exact = v.astype(object) if np.abs(v).max(initial=0) >= 1 << 48 else v
            new = [len(m) * moved, len(m), *(int(s) for s in exact.sum(0))]
            total[p, e] = [x + y for x, y in zip(total.get((p, e), [0] * len(new)), new, strict=True)]
    rows = [(p, e, i - 2, x) for (p, e), t in total.items() for i, x in enumerate(t)]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0))
    yield pa.RecordBatch.from_arrays([pa.array([Decimal(r[i]) if i == 3 else r[i] for r in rows], k) for i, k in enumerate(kinds)], ["position", "entry", "place", "total"])


def _next(books: np.ndarray, state: DataFrame) -> tuple[np.ndarray, int]:
    """Each entry becomes floor(sum / count) of its members, one without members stays; and
    how many parts have moved."""
    sums = state.mapInArrow(_sums, "position int, entry int, place int, total decimal(38,0)").groupBy("position", "entry", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
    found = {(r.position, r.entry, r.place): int(r.total) for r in sums.collect()}  # entries x components
    books = books.copy()
    for p, e, i in found:
        if i >= 0:
            books[p, e, i] = found[p, e, i] // found[p, e, -1]
    return books, sum(x for (_, _, i), x in found.items() if i == -2)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every part of the state as a row."""
    for b in batches:
        for (p, e, s, m, _), error in zip(_unpack(b), b.column("errors").to_pylist(), strict=True):
            exact = pa.array(np.frombuffer(error, np.int64)).cast(pa.decimal128(20, 0))
            yield pa.RecordBatch.from_arrays([pa.array((s << RUN_BITS) + m.astype(np.int64)), pa.array(np.full(len(m), p, np.int32)), pa.array(np.full(len(m), e, np.int32)), exact], ["row", "position", "entry", "error"])
