"""Merkle dataset manifest (operator 13): checkpoint and recompute.

A row's leaf is the hash of its fields; each tree (a language) orders its leaves, and runs
of two nodes become the hash of their digests until one node is left, the tree's root.
Only every ``SPAN``-th level is written: a task climbs an aligned subtree of 2^SPAN nodes
from one written level to the next and keeps nothing in between.  Proofs go from the top
down: a task takes an aligned subtree's stored nodes and the proof of its root, makes the
missing nodes again, emits each stored node's siblings below the root's, and discards them.
The trees' roots are the leaves of a last tree, built by the same functions.

Rows without a tree's name form the first tree.  Rows that repeat an id follow one another
by their leaves, rows without an id come first in their tree.  An empty table has no trees,
no proofs and root null.  Columns beyond the fields are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, cut, forget

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels from one written table to the next; a subtree has 2^SPAN nodes.
SPAN = 10
_PATH = "array<struct<side:int,digest:string>>"


@dataclass
class Forest:
    """Written levels (tree, pos, digest) of many trees, SPAN levels apart; the first holds
    the leaves and their other columns, the last one node a tree."""

    levels: list[DataFrame]
    extra: list[str]
    span: int


@dataclass
class Manifest:
    forest: Forest
    top: Forest
    root: str | None


def leaf(df: DataFrame, fields=FIELDS, changed: dict[str, Column] | None = None) -> Column:
    """The hash of the fields: ``-`` for null, else the UTF-8 byte count, ``:``, the value."""
    parts = []
    for f in fields:
        text = (changed or {}).get(f, df[f]).cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def build(docs: DataFrame, tree: str = "lang", order: str = "doc_id", fields=FIELDS, span: int | None = None, **extra: Column) -> Manifest:
    """Hash every row, order and number each tree's leaves, write the levels.  ``extra`` are
    further digests (hex) to keep beside the leaves, say of tampered rows."""
    bounded_batches(docs.sparkSession)
    span = span or SPAN
    name = F.when(docs[tree].isNull(), "").otherwise(F.concat(F.lit("+"), docs[tree].cast("string")))
    hashed = docs.select(name.alias("tree"), docs[order].alias("id"), F.unhex(leaf(docs, fields)).alias("digest"), *[F.unhex(c).alias(n) for n, c in extra.items()])
    rows = cut(hashed, "leaves")
    forest = _climbed(_numbered(rows, ["id", "digest"]), ["id", *extra], span)
    forget(rows)
    roots = forest.levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest")
    top = _climbed(_numbered(roots, ["id"]), ["id"], span)
    root = top.levels[-1].select(F.lower(F.hex("digest")).alias("h")).head(1)  # one tree, one node
    return Manifest(forest, top, root[0].h if root else None)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows and ``pos``, their place in their tree: sorted by ranges, written with places
    in their partition, then moved by what earlier partitions hold of the tree."""
    sorted_ = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = cut(sorted_.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33).alias("_part")
    held = placed.groupBy("tree", part).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.select("tree", "_part", (before - F.col("_from")).alias("_shift"))
    out = placed.withColumn("_part", part).join(offsets, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift"))
    level = cut(out.drop("_part", "_at", "_shift"), "level")
    forget(placed)
    return level


def _subtrees(level: DataFrame, extra: list[str], span: int) -> DataFrame:
    """(tree, g, nodes): the stored nodes of each aligned subtree, in order."""
    g = F.shiftright("pos", span).alias("g")
    return level.groupBy("tree", g).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", *extra))).alias("nodes"))


def _climbed(leaves: DataFrame, extra: list[str], span: int) -> Forest:
    levels = [leaves]
    while levels[-1].where("pos > 0").head(1):
        nodes = _subtrees(levels[-1], [], span).select("tree", F.col("g").alias("pos"), F.col("nodes.digest").alias("digests"))
        levels.append(cut(nodes.mapInArrow(_tops(span), "tree string, pos bigint, digest binary"), "level"))
    return Forest(levels, extra, span)


def climb(digests: list[str], g: int, span: int = SPAN) -> list[list[str]]:
    """All levels of an aligned subtree, its stored nodes first.  The tree's only subtree ends
    where one node is left; others end ``span`` levels up."""
    levels = [digests]
    while len(levels) <= span and (g or len(levels[-1]) > 1):
        low = levels[-1]
        levels.append([hashlib.sha256("".join(low[i : i + 2]).encode()).hexdigest() for i in range(0, len(low), 2)])
    return levels


def _tops(span: int):
    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [bytes.fromhex(climb([x.hex() for x in d], g, span)[-1][0]) for g, d in zip(b.column("pos").to_pylist(), b.column("digests").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("pos"), pa.array(found, pa.binary())], ["tree", "pos", "digest"])

    return tops


def prove(manifest: Manifest) -> DataFrame:
    """(tree, pos, id, digest, ..., subroot, path): one row a leaf.  ``path`` has an entry for
    each level up to the manifest's root: ``side`` -1 for a sibling on the left, 1 on the
    right, 0 for none."""
    start = manifest.top.levels[-1].select("tree", "pos", F.lit(None).cast(_PATH).alias("path"), F.lit(None).cast("binary").alias("subroot"))
    tops = _proofs(manifest.top, start.withColumn("path", F.array().cast(_PATH)))
    roots = manifest.forest.levels[-1]
    paths = roots.join(tops.select(F.col("id").alias("tree"), "path"), "tree").select("tree", "pos", "path", F.col("digest").alias("subroot"))
    return _proofs(manifest.forest, paths)


def _proofs(forest: Forest, paths: DataFrame) -> DataFrame:
    """The paths of the last level's nodes carried down to the first level's."""
    if len(forest.levels) == 1:
        return forest.levels[0].join(paths, ["tree", "pos"])
    for k in range(len(forest.levels) - 2, -1, -1):
        level, extra = forest.levels[k], forest.extra if k == 0 else []
        kept = [c for c in ("pos", "digest", *extra)]
        joined = _subtrees(level, extra, forest.span).join(paths.select("tree", F.col("pos").alias("g"), "path", "subroot"), ["tree", "g"])
        fields = ", ".join(f"{c} {level.schema[c].dataType.simpleString()}" for c in kept)
        paths = joined.mapInArrow(_siblings(kept, forest.span), f"tree string, subroot binary, {fields}, path {_PATH}")
    return paths


def _siblings(kept: list[str], span: int):
    """Each stored node of a subtree with its siblings, level by level, then its root's."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                nodes = b.column("nodes")[r].values
                n, g = len(nodes), b.column("g")[r].as_py()
                levels = climb([x.hex() for x in nodes.field("digest").to_pylist()], g, span)
                sides, found = [], []
                for up, level in enumerate(levels[:-1]):
                    at = np.arange(n) >> up
                    there = (at ^ 1) < len(level)
                    sides.append(np.where(there, np.where(at & 1, -1, 1), 0))
                    found.append(pa.array(level).take(pa.array(at ^ 1, mask=~there)))
                path = b.column("path")[r].values
                above = len(path)
                own, deep = len(sides), len(sides) + above
                side = np.concatenate([*sides, np.repeat(path.field("side").to_numpy(zero_copy_only=False), n)]) if deep else np.zeros(0, int)
                digest = pa.concat_arrays([*found, path.field("digest").take(pa.array(np.repeat(np.arange(above), n)))]).take(pa.array(np.arange(deep * n).reshape(deep, n).T.ravel())) if deep else pa.array([], pa.string())
                flat = pa.StructArray.from_arrays([pa.array(side.reshape(deep, n).T.ravel().astype(np.int32)), digest.cast(pa.string())], ["side", "digest"])
                paths = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * deep).astype(np.int32)), flat)
                same = np.zeros(n, np.int32)
                yield pa.RecordBatch.from_arrays([*(pa.array([b.column(c)[r].as_py()], b.schema.field(c).type).take(pa.array(same)) for c in ("tree", "subroot")), *(nodes.field(c) for c in kept), paths], ["tree", "subroot", *kept, "path"])

    return expand


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf (hex) and its siblings give."""
    sibling = lambda s, side: F.when(s["side"] == side, s["digest"]).otherwise("")
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(sibling(s, -1), h, sibling(s, 1)).cast("binary"), 256))


def siblings_sha256(path: str = "path") -> Column:
    """The hash of a proof's siblings, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["digest"]), "").cast("binary"), 256)
