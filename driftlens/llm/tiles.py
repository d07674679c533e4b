"""Embedding near-dedup (operator 11): PCA-ordered tiled comparison.

Equal vectors become one class first, so copies never meet.  The unit vectors of the
classes are turned into the basis of their principal components (largest first, fitted on
all of them) and cut into blocks between quantiles of the first component.  Pairs of blocks
whose boxes in the leading components are too far apart are left out; every other pair is
one row, which one call compares tile by tile: products over the leading components plus
the product of the suffix norms bound the cosine from above, most tiles and pairs stop
there, the others go on over further components.  Cosines within ``SLACK`` of the threshold
are computed again from the vectors as given.  A pair of blocks yields, for each vector
with links, their number and the root of its part of the links' forest, so the links
themselves are never rows however dense a group is.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
nor do vectors of different lengths.  Rows that repeat a ``vec_id`` are vectors of their own
and give a row each.  A row without a ``vec_id`` takes part, is never kept, and names no
component; a component of such rows alone has id null.  An empty table gives no rows.
Other columns are left behind.  Classes are told apart by two 64-bit hashes of the vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .components import components
from .shared import bounded_batches, cut, forget

THRESHOLD = 0.9
#: Bytes of a block's vectors as doubles; a call holds a few blocks.
BLOCK_BYTES = 1 << 23
#: Vectors at a side of a tile.
TILE = 1024
#: More than any rounding error of a product, and the leading components of the boxes.
SLACK, BOX = 1e-9, 8
_NO_ID = (1 << 63) - 1


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row a vector, links at cosine >= threshold."""
    bounded_batches(df.sparkSession)
    rows = _rows(df, id_col, vec_col)
    classes = cut(rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")).withColumn("first", F.coalesce("first", F.lit(_NO_ID))), "vectors")
    found = linked(classes, threshold)
    node = F.struct("first", "h1", "h2")
    edges = found.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b"))
    parts = components(edges).select(F.col("id.h1").alias("h1"), F.col("id.h2").alias("h2"), F.col("class.first").alias("least"))
    links = found.groupBy(F.col("node.h1").alias("h1"), F.col("node.h2").alias("h2")).agg(F.sum("links").alias("links"))
    known = cut(
        classes.select("h1", "h2", "n", "first").join(links, ["h1", "h2"], "left").join(parts, ["h1", "h2"], "left")
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "first").alias("least"))
        .where((F.col("n_links") > 0) | (F.col("least") != F.col("first"))),
        "linked",
    )
    forget(found, classes)
    out = rows.drop("v").join(known, ["h1", "h2"], "left")
    component = F.when(F.col("least").isNull(), F.col("vec_id")).otherwise(F.nullif("least", F.lit(_NO_ID)))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v, h1, h2): the hashes of usable vectors, null for the others."""
    kind = "float" if isinstance(df.schema[vec_col].dataType.elementType, FloatType) else "double"
    rows = df.select(df[id_col].cast("bigint").alias("vec_id"), F.transform(df[vec_col], lambda x: x.cast(kind) + F.lit(0.0).cast(kind)).alias("v"))
    usable = F.col("v").isNotNull() & F.coalesce(~F.exists("v", unusable) & F.exists("v", lambda x: x != 0), F.lit(False))
    return rows.select("vec_id", "v", F.when(usable, F.xxhash64("v")).alias("h1"), F.when(usable, F.xxhash64(F.lit(11), "v")).alias("h2"))


def unusable(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def linked(classes: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) of the classes (first, h1, h2, n, v) with links to others: for each
    pair of blocks how many vectors a class meets and a class that it is joined with; nodes
    and roots are (first, h1, h2).  A table in the shared folder."""
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first()
    basis, head = principal_axes(classes, size.d, threshold)
    least = math.ceil(math.sqrt(6 * classes.sparkSession.sparkContext.defaultParallelism))
    g = max(1, math.ceil(size.n * size.d * 8 / BLOCK_BYTES), min(least, size.n // TILE))
    blocks = cut(_blocks(classes, basis, g), "blocks")
    pairs = block_pairs(blocks.select("block", "low", "high"), g, threshold)
    many = max(1, min(g * (g // 2 + 1), 1 << 14))
    held = blocks.drop("low", "high")
    dealt = pairs.repartition(many, "home", "guest").join(held.toDF("guest", *(f"g_{c}" for c in held.columns[1:])), "guest").join(held.withColumnRenamed("block", "home"), "home")
    node = "struct<first:bigint,h1:bigint,h2:bigint>"
    out = cut(dealt.mapInArrow(_comparer(basis, head, threshold), f"node {node}, links bigint, root {node}"), "links")
    forget(blocks)
    return out


def principal_axes(classes: DataFrame, d: int, threshold: float) -> tuple[np.ndarray, int]:
    """The orthonormal basis of the unit vectors' second moments, largest first, and how
    many leading components leave two average vectors below the threshold.  Sums of all
    tasks are added up by Spark; d (d + 1) / 2 numbers reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            x, _ = _matrix(b.column("v"), d)
            total += x.T @ x
        at = np.flatnonzero(np.triu(np.ones((d, d), bool)))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["cell", "x"])

    sums = classes.select("v").mapInArrow(moments, "cell bigint, x double").groupBy("cell").agg(F.sum("x").alias("x")).toArrow()
    second = np.zeros(d * d)
    second[sums["cell"].to_numpy()] = sums["x"].to_numpy()
    second = np.triu(second.reshape(d, d)) + np.triu(second.reshape(d, d), 1).T
    weight, axes = np.linalg.eigh(second)
    weight, axes = np.maximum(weight[::-1], 0), axes[:, ::-1]
    left = 1 - np.cumsum(weight) / max(weight.sum(), 1e-300)
    return np.ascontiguousarray(axes), int(min(d, 1 + np.argmax(left <= 0.75 * max(threshold, 0.1))))


def _matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows (shorter ones end in zeros), and their lengths in components."""
    x = np.zeros((len(column), d))
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x[np.arange(d) < size[:, None]] = flat
    x /= np.maximum(np.abs(x).max(1, initial=0), 1e-308)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None], size


def _blocks(classes: DataFrame, basis: np.ndarray, g: int) -> DataFrame:
    """One row a block: ids, weights, vectors, and the box of the leading components."""
    d = len(basis)

    def spread(b: pa.RecordBatch) -> np.ndarray:
        """The first component; equal ones lie a hair apart, by their hashes."""
        return _matrix(b.column("v"), d)[0] @ basis[:, 0] + b.column("h1").to_numpy() * 2.0**-63 * SLACK

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(spread(b))], ["x"])

    cuts = np.zeros(0)
    if g > 1:
        cuts = np.array(classes.select("v", "h1").mapInArrow(place, "x double").approxQuantile("x", [i / g for i in range(1, g)], 0.1 / g))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.searchsorted(cuts, spread(b)).astype(np.int32))], [*b.schema.names, "block"])

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        v = t["v"].combine_chunks()
        lead = _matrix(v, d)[0] @ basis[:, :BOX]
        flat = v.flatten().to_numpy(zero_copy_only=False)
        binary = [t[c].to_numpy().tobytes() for c in ("first", "h1", "h2", "n")] + [v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32).tobytes(), flat.tobytes()]
        return pa.Table.from_pydict({"block": t["block"][:1], "wide": [flat.dtype.itemsize], **{f: [x] for f, x in zip(_FIELDS, binary, strict=True)}, "low": [lead.min(0)], "high": [lead.max(0)]}).cast(pa.schema([*_PACKED, ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))

    schema = classes.select("first", "h1", "h2", "n", "v").withColumn("block", F.lit(0)).schema
    rows = classes.select("first", "h1", "h2", "n", "v").mapInArrow(deal, schema)
    return rows.groupBy("block").applyInArrow(pack, "block int, wide int, first binary, h1 binary, h2 binary, n binary, sizes binary, v binary, low array<double>, high array<double>")


_FIELDS = ("first", "h1", "h2", "n", "sizes", "v")
_PACKED = [("block", pa.int32()), ("wide", pa.int32()), *((f, pa.binary()) for f in _FIELDS)]


def block_pairs(boxes: DataFrame, g: int, threshold: float) -> DataFrame:
    """(home, guest): each unordered pair of blocks once, a block with itself too, half of a
    block's pairs at home; not those whose boxes keep any two vectors below the threshold."""
    steps = F.sequence(F.lit(0), F.lit(g // 2))
    met = boxes.select(F.col("block").alias("home"), F.col("low").alias("l0"), F.col("high").alias("h0"), F.explode(steps).alias("step"))
    met = met.where(~((F.col("step") * 2 == g) & (F.col("home") >= g // 2)) | (F.col("step") == 0)).withColumn("guest", (F.col("home") + F.col("step")) % g)
    met = met.join(boxes.toDF("guest", "l1", "h1"), "guest")
    gaps = F.zip_with(F.zip_with("l0", "h1", lambda a, b: a - b), F.zip_with("l1", "h0", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    return met.where(apart <= 2 - 2 * threshold + 1e-6).select("home", "guest")


class Block:
    """A block's vectors: unit, in the basis, their norms beyond each stop."""

    def __init__(self, row: dict, side: str, basis: np.ndarray, stops: list[int]):
        d = len(basis)
        self.first, self.h1, self.h2, n = (np.frombuffer(row[f"{side}{c}"], np.int64) for c in ("first", "h1", "h2", "n"))
        self.n, self.size = n.astype(np.float64), np.frombuffer(row[f"{side}sizes"], np.int32)
        flat = pa.array(np.frombuffer(row[f"{side}v"], np.float32 if row[f"{side}wide"] == 4 else np.float64))
        self.unit, _ = _matrix(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(self.size)].astype(np.int32)), flat), d)
        self.x = self.unit @ basis
        tail = np.sqrt(np.maximum(np.cumsum((self.x**2)[:, ::-1], 1)[:, ::-1], 0))
        self.tails = [tail[:, k] if k < d else np.zeros(len(self.x)) for k in stops]
        self.head = np.ascontiguousarray(np.c_[self.x[:, : stops[0]], self.tails[0]])


def tile_links(a: Block, b: Block, stops: list[int], threshold: float, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of the vectors at the threshold or above, tile by tile; each pair
    once if both are one block."""
    least = threshold - SLACK
    for p in range(0, len(a.x), tile):
        for q in range(p if a is b else 0, len(b.x), tile):
            near = a.head[p : p + tile] @ b.head[q : q + tile].T >= least
            if a is b and p == q:
                near = np.triu(near, 1)
            many = np.count_nonzero(near)
            if not many:
                continue
            if many > near.size // 16:
                full = a.x[p : p + tile] @ b.x[q : q + tile].T
                i, j = np.nonzero(near & (full >= least))
                s = full[i, j]
                i, j = i + p, j + q
            else:
                i, j = np.nonzero(near)
                i, j = i + p, j + q
                s = np.einsum("ij,ij->i", a.x[i, : stops[0]], b.x[j, : stops[0]])
                for k, (lo, hi) in enumerate(zip(stops, stops[1:], strict=False), 1):
                    s += np.einsum("ij,ij->i", a.x[i, lo:hi], b.x[j, lo:hi])
                    on = s + a.tails[k][i] * b.tails[k][j] >= least
                    i, j, s = i[on], j[on], s[on]
            close = np.flatnonzero(np.abs(s - threshold) <= SLACK)
            s[close] = np.einsum("ij,ij->i", a.unit[i[close]], b.unit[j[close]])
            on = (s >= threshold) & (a.size[i] == b.size[j])
            if on.any():
                yield i[on], j[on]


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i and j; every place points at its tree's least."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _comparer(basis: np.ndarray, head: int, threshold: float):
    d, tile = len(basis), TILE
    stops = sorted({head, *(min(d, head * m) for m in (2, 4)), d})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[int, Block] | None = None
        for batch in batches:
            for r in range(len(batch)):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                if kept is None or kept[0] != row["home"]:
                    kept = row["home"], Block(row, "", basis, stops)
                a = kept[1]
                b = a if row["home"] == row["guest"] else Block(row, "g_", basis, stops)
                shift = 0 if a is b else len(a.x)
                total = shift + len(b.x)
                root, links = np.arange(total), np.zeros(total)
                for i, j in tile_links(a, b, stops, threshold, tile):
                    links[: len(a.x)] += np.bincount(i, b.n[j], len(a.x))
                    links[shift:] += np.bincount(j, a.n[i], len(b.x))
                    unite(root, i, j + shift)
                at = np.flatnonzero(links)
                names = {c: np.r_[getattr(a, c), getattr(b, c)] if shift else getattr(a, c) for c in ("first", "h1", "h2")}
                node, up = (pa.StructArray.from_arrays([pa.array(x[w]) for x in names.values()], list(names)) for w in (at, root[at]))
                yield pa.RecordBatch.from_arrays([node, pa.array(links[at].astype(np.int64)), up], ["node", "links", "root"])

    return compare
