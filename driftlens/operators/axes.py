"""Principal components of rows that are too wide for one task, and rows against components
(C02, C15).

The matrix of products of ``d`` standardised columns is dealt into panels, the columns of one
block against all of them; no task holds more than two.  It is made diagonal by rotations of
pairs of blocks (Jacobi's method): a block's row in the table is W = G V beside V, a pair's
own corner V'W is solved in one task, and both blocks are turned by its vectors.  In a sweep
every block meets every other once; each round is a shuffle by pairs, written before the next
one, and sweeps go on until no pair has anything left to turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written

#: Numbers of a panel (d rows, one block of columns), and of what leaves a worker at once.
PANEL, PIECE = 3 << 20, 1 << 17
#: Rows whose products one task adds up, as a multiple of d.
RUN = 4
#: What is left beside the diagonal, squared and relative, when sweeps end; sweeps at most.
LEFT, SWEEPS = 1e-20, 40
#: Numbers of the queries of one run that meet a block of components, and of those that meet
#: all components of their series in one task.
ASKED, WHOLE = 1 << 24, 1 << 22
#: Bytes of the batches that short series leave a worker in.
SENT = 1 << 22


def _schema(df: DataFrame, cols: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*cols).schema.fields)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(whether it opens a group, rows of one group ``_g``): batches cut where groups end."""
    last = None
    for batch in batches:
        g = np.asarray(batch.column(batch.schema.get_field_index("_g")))
        edge = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)] if len(g) else np.zeros(1, int)
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            yield last is None or g[lo] != last, batch.slice(lo, hi - lo)
            last = g[lo]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One group after another, each held whole."""
    held: list[pa.RecordBatch] = []
    for opens, rows in _split(batches):
        if opens and held:
            yield pa.Table.from_batches(held)
            held = []
        held.append(rows)
    if held:
        yield pa.Table.from_batches(held)


def batched(parts: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Tables of few rows each as batches of about SENT bytes."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part.nbytes
        if size > SENT:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _grouped(rows: DataFrame, keys: list[str], *then: str) -> DataFrame:
    """Rows of a group in one task, one after another, numbered ``_g``."""
    return rows.withColumn("_g", F.xxhash64(*keys)).repartition(*keys).sortWithinPartitions(*keys, *then)


def column_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mean, std) by place; a std below 1e-8 is 1."""
    s = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector("v"))
    out = rows.groupBy(*by).agg(s.alias("s")).select(*by, F.col("s.count").alias("n"), vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("_v"))
    std = F.transform("_v", lambda x: F.sqrt(x * (F.col("n") - 1) / F.col("n")))
    return out.select(*by, "n", "mean", F.transform(std, lambda x: F.when(x < 1e-8, 1.0).otherwise(x)).alias("std"))


def standardised():
    return F.zip_with(F.zip_with("v", "mean", lambda x, m: x - m), "std", lambda x, s: x / s)


def _panels(rows: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """(by, d, blocks, block, at, data): the matrix of products as panels, in pieces of whole
    columns, each column of W followed by the same column of V (the identity)."""
    d = F.size("mean")
    blocks = (2 * F.ceil(d / (2 * F.greatest(F.lit(1), F.floor(F.lit(PANEL) / d))))).cast("int")
    runs = F.greatest(F.lit(1), F.floor(F.col("n") / (RUN * d))).cast("int")
    sized = stats.select(*by, "n", "mean", "std", d.alias("d"), blocks.alias("blocks"), runs.alias("_runs"))
    one = rows.withColumn("_id", F.monotonically_increasing_id()).join(sized, by)  # of written rows
    z = one.select(*by, "n", "d", "blocks", F.pmod(F.xxhash64("_id"), F.col("_runs")).alias("_run"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), standardised().alias("z"))
    names = [*by, "d", "blocks", "block", "at", "data"]
    schema = f"{_schema(rows, by)}, d int, blocks int, block int, at int, data binary"

    def pieces(head: pa.RecordBatch, columns: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
        step = max(1, PIECE // columns.shape[1])
        for i in range(0, len(columns), step):
            kept = [head.column(c) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([first + i], pa.int32()), pa.array([columns[i : i + step].tobytes()], pa.binary())], names=names)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = panel = None
        for opens, part in _split(batches):
            if opens:
                if head is not None:
                    yield from pieces(head, panel, lo)
                head = part.slice(0, 1)
                d, blocks, block = (head.column(c)[0].as_py() for c in ("d", "blocks", "block"))
                width = -(-d // blocks)
                lo, hi = min(d, block * width), min(d, (block + 1) * width)
                panel = np.zeros((hi - lo, d))
            x = _vectors(part.column("z"))
            panel += x[:, lo:hi].T @ x / head.column("n")[0].as_py()
        if head is not None:
            yield from pieces(head, panel, lo)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = total = None

        def done() -> Iterator[pa.RecordBatch]:
            first, d = head.column("at")[0].as_py(), head.column("d")[0].as_py()
            axes = np.zeros_like(total)
            axes[np.arange(len(total)), first + np.arange(len(total))] = 1
            yield from pieces(head, np.hstack([total, axes]), first)

        for opens, part in _split(batches):
            if opens:
                if head is not None:
                    yield from done()
                head, total = part.slice(0, 1), 0
            for data in part.column("data"):
                total = total + np.frombuffer(data.as_buffer()).reshape(-1, head.column("d")[0].as_py())
        if head is not None:
            yield from done()

    sums = _grouped(z, [*by, "block", "_run"]).mapInArrow(products, schema)
    return _grouped(sums, [*by, "block", "at"]).mapInArrow(added, schema)


def _turned(state: DataFrame, turn: int, by: list[str]) -> DataFrame:
    """``state`` after round ``turn`` of a tournament: block i meets the block j with
    i + j = 2 * turn modulo blocks - 1, the one that would meet itself meets the last."""
    m = F.col("blocks") - 1
    other = F.when(F.col("block") == m, turn % m).otherwise(F.pmod(2 * turn - F.col("block"), m))
    other = F.when((F.col("block") != m) & (other == F.col("block")), m).otherwise(other)
    names = [*by, "d", "blocks", "block", "at", "data"]

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            d = t.column("d")[0].as_py()
            parts = [np.frombuffer(x.as_buffer()).reshape(-1, 2 * d) for x in t.column("data")]
            edge = np.cumsum([0, *map(len, parts)])
            x = np.vstack(parts)
            corner = x[:, d:] @ x[:, :d].T
            corner = (corner + corner.T) / 2
            beside = corner - np.diag(np.diag(corner))
            off, total = float((beside**2).sum()), float((corner**2).sum())
            if off > 0:
                x = np.linalg.eigh(corner)[1][:, ::-1].T @ x
            for i, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
                kept = [t.column(c).slice(i, 1).combine_chunks() for c in names[:-1]]
                kept = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in kept]
                weighed = [pa.array([v if i == 0 else 0.0]) for v in (off, total)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([x[lo:hi].tobytes()], pa.binary()), *weighed], names=[*names, "off", "total"])

    dealt = state.select(*names).withColumn("_pair", F.least("block", other))
    return _grouped(dealt, [*by, "_pair"], "block", "at").mapInArrow(rotate, f"{_schema(state, names)}, off double, total double")


def wide_components(train: DataFrame, variance: float | None, by: list[str]) -> DataFrame:
    """``principal_components`` in panels and rotations; fails after SWEEPS sweeps."""
    rows = written(train.select(*by, "v"), "rows")
    stats = written(column_stats(rows, by), "stats")
    state = written(_panels(rows, stats, by), "panels")
    rounds = (state.agg(F.max("blocks")).first()[0] or 2) - 1
    for _ in range(SWEEPS):
        left = {}
        for turn in range(rounds):
            before, state = state, written(_turned(state, turn, by), "panels")
            dropped(before)
            for r in state.groupBy(F.xxhash64(*by).alias("g")).agg(F.sum("off").alias("off"), F.sum("total").alias("total")).toLocalIterator():
                old = left.get(r["g"], (0.0, 0.0))
                left[r["g"]] = (old[0] + r["off"], old[1] + r["total"])
        if rounds == 1 or all(off <= LEFT * total for off, total in left.values()):
            break
    else:
        raise ValueError("rotations did not converge")

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                d = one.column("d")[0].as_py()
                x = np.frombuffer(one.column("data")[0].as_buffer()).reshape(-1, 2 * d)
                w, v = x[:, :d], x[:, d:]
                sign = np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
                at = one.column("at")[0].as_py() + np.arange(len(v))
                comp = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * d, pa.int32()), pa.array((v * sign).ravel()))
                kept = [pa.concat_arrays([one.column(c)] * len(v)) for c in by]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(at, pa.int32()), pa.array((w * v).sum(1)), comp], names=[*by, "at", "value", "comp"])

    found = written(state.select(*by, "d", "at", "data").mapInArrow(columns, f"{_schema(state, by)}, at int, value double, comp array<double>"), "components")
    dropped(state, rows)
    every, falling = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.desc("value"), "at")
    share = F.greatest("value", F.lit(0.0)) / F.greatest(F.sum("value").over(every), F.lit(1e-12))
    ranked = found.select(*by, "at", "value", (F.row_number().over(falling) - 1).alias("c"), share.alias("share"))
    if variance is not None:
        earlier = F.coalesce(F.sum("share").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        ranked = ranked.withColumn("_before", earlier).where(F.col("_before") < variance)
    first = lambda c: F.when(F.col("c") == 0, F.col(c)).alias(c)
    return found.select(*by, "at", "comp").join(ranked, [*by, "at"]).join(stats, by).select(*by, "c", "share", first("mean"), first("std"), "comp")


def _met(components: DataFrame, query: DataFrame, by: list[str], each, out: str) -> DataFrame:
    """(by, q, block, x) with x = ``each`` (vectors, components, shares) of the standardised
    queries of a run and a block of components; products of matrices, so pairs are no rows."""
    first = components.where("c = 0").select(*by, "mean", "std")
    d = F.greatest(F.lit(1), F.size("mean"))
    per = F.greatest(F.lit(1), F.floor(F.lit(PANEL) / d)).cast("int")
    runs = F.ceil(F.col("_n") * d / ASKED).cast("int")
    held = components.groupBy(*by).agg(F.count(F.lit(1)).alias("_k"))
    asked = query.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sized = first.join(held, by).join(asked, by).select(*by, "mean", "std", per.alias("_per"), runs.alias("_runs"), F.ceil(F.col("_k") / per).cast("int").alias("_blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kind = query.schema["q"].dataType
    sent = components.select(*by, "c", "share", "comp").join(sized.drop("mean", "std"), by)
    sent = sent.select(*by, F.floor(F.col("c") / F.col("_per")).cast("int").alias("block"), every("_runs").alias("_run"), F.col("c").alias("_c"), F.lit(None).cast(kind).alias("q"), "share", F.col("comp").alias("v"))
    dealt = query.select(*by, "q", "v").join(sized, by)
    dealt = dealt.select(*by, every("_blocks").alias("block"), F.pmod(F.xxhash64("q"), F.col("_runs")).cast("int").alias("_run"), F.lit(1 << 30).alias("_c"), "q", F.lit(0.0).alias("share"), standardised().alias("v"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, shares, c, s = [], [], None, None
        for opens, rows in _split(batches):
            if opens:
                axes, shares, c = [], [], None
            n = int(np.count_nonzero(np.asarray(rows.column("_c")) < 1 << 30))
            if n:
                axes.append(_vectors(rows.column("v").slice(0, n)))
                shares.append(np.asarray(rows.column("share"))[:n])
            rows = rows.slice(n)
            if not len(rows):
                continue
            if c is None:
                c, s = np.vstack(axes), np.concatenate(shares)
            x = _vectors(rows.column("v"))
            step = max(1, PANEL // len(c))
            for i in range(0, len(x), step):
                some = rows.slice(i, step)
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in (*by, "q", "block")), each(x[i : i + step], c, s)], names=[*by, "q", "block", "x"])

    joined = sent.unionByName(dealt)
    return _grouped(joined, [*by, "block", "_run"], "_c").mapInArrow(meet, f"{_schema(query, [*by, 'q'])}, block int, x {out}")


def distance_sums(components: DataFrame, query: DataFrame, by: list[str]) -> DataFrame:
    """(by, q, score): distances to the components over their shares, added up."""

    def each(x: np.ndarray, c: np.ndarray, share: np.ndarray) -> pa.Array:
        both = (x * x).sum(1)[:, None] + (c * c).sum(1)
        d2 = both - 2 * x @ c.T
        for i, j in np.argwhere(d2 < 1e-6 * both):  # digits are lost there
            d2[i, j] = ((x[i] - c[j]) ** 2).sum()
        return pa.array(np.sqrt(d2) @ (1 / np.maximum(share, 1e-12)))

    return _met(components, query, by, each, "double").groupBy(*by, "q").agg(F.sum("x").alias("score"))


def _beside(components: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """``coordinates`` where a series' rows and components are few: both go to one task as they
    are, behind the mean (-2) and the std (-1)."""
    first, kind = components.where("c = 0"), rows.schema["q"].dataType
    part = lambda df, c, v: df.select(*by, c.alias("_c"), F.lit(None).cast(kind).alias("q"), F.col(v).alias("v"))
    sent = part(first, F.lit(-2), "mean").unionByName(part(first, F.lit(-1), "std")).unionByName(part(components, F.col("c"), "comp"))
    joined = sent.unionByName(rows.select(*by, F.lit(1 << 30).alias("_c"), "q", "v"))

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for t in _whole(batches):
            t = t.combine_chunks()
            n = int(np.count_nonzero(np.asarray(t.column("_c")) < 1 << 30))
            if not 0 < n < len(t):
                continue
            x = _vectors(t.column("v").chunk(0))
            y = (x[n:] - x[0]) / x[1] @ x[2:n].T
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield t.select([*by, "q"]).slice(n).append_column("v", v)

    return _grouped(joined, by, "_c", "q").mapInArrow(lambda batches: batched(along(batches)), f"{_schema(rows, [*by, 'q'])}, v array<double>")


def coordinates(components: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, q, v): rows as their coordinates along the components."""
    count = lambda df: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    d = components.agg(F.coalesce(F.max(F.size("comp")), F.lit(0))).first()[0]
    if count(components) * d <= PANEL and count(rows) * d <= WHOLE:
        return _beside(components, rows, by)

    def each(x: np.ndarray, c: np.ndarray, _: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(c), pa.int32()), pa.array((x @ c.T).ravel()))

    along = F.array_sort(F.collect_list(F.struct("block", "x")))
    return _met(components, rows, by, each, "array<double>").groupBy(*by, "q").agg(F.flatten(F.transform(along, lambda s: s["x"])).alias("v"))
