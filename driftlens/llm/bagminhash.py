"""Operator 6, near-duplicates by BagMinHash.

A text is the multiset of its runs of ``SHINGLE`` consecutive words (a text of fewer words
is one shingle); two texts are linked if their multisets' Jaccard similarity, the sum of
least counts over the sum of greatest, is ``SIMILARITY`` or more.

Signatures.  Weights are counts, so they are discretised exactly at the whole numbers.
Each shingle has Poisson processes over the levels [0,1), [1,2), [2,4), [4,8) ... with a
rate equal to the width; a point falls on a random level of its interval and in a random
slot of the signature, and counts if its level lies below the weight.  A slot keeps the
earliest point.  Two multisets agree in a slot with the probability of their weighted
Jaccard similarity.  Points come in order of time, so a process stops once its next point
is later than all slots of its text: few points are made beyond one a shingle.

Links.  Equal texts collapse first.  A slot is kept as one byte; the bytes of each band are
its key, and texts with equal keys share a bucket.  Buckets are worked off in rounds: the
next texts of each bucket lead, and meet those behind them that are in another class still.
Leaders are copied to each ``CHUNK`` of their bucket, so a round moves a row for each text
and one for each leader and chunk; pairs exist only inside a task, and a pair counts only
in the first band that both share, and if their signatures agree in ``SCREEN`` slots or
more.  Pairs that agree in ``LIKELY`` slots leave the task, are verified at once, on the
multisets themselves, and join classes.  Of the others just the two texts are marked, so
many texts that all but resemble each other yield a row each and not one for each pair.
When all buckets are done, the marked texts of a bucket that are in several classes still
meet again, with their multisets, ``BLOCK`` by ``BLOCK``: the task that a pair meets in
verifies it, and only links leave.  Classes are the connected components of verified
links, and named by their least document.

All tables between rounds are written to the shared folder, and deleted when nothing reads
them any more.  Null texts and texts without a word resemble nothing (each its own class);
rows without an id are left out; an id counts once, with the text whose digest is least if
its rows differ.  Other columns, whatever their names, are ignored.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .repeats import packed_texts, texts_of
from .shared import cut, forget, texts
from .textkit import BYTE_VALUE, Rolling, column, mix, pieces, ragged, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: Slots that two texts of the similarity sought agree in, but for 14 cases in 10**6 (the
#: bands miss three in 10**6 of such pairs, fewer the more alike the texts are).
SCREEN = 106
LIKELY = int(SLOTS * SIMILARITY)
#: Texts of a bucket that are met in one task; leaders grow by the factor each round.
CHUNK, FASTER, MOST = 1 << 10, 16, 1 << 12
#: Parts that the texts of one bucket are numbered in.
DEALS = 16
#: Texts of either side that meet in one task with their multisets.
BLOCK = 1 << 9
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of the distinct shingles of each text, sorted."""
    lo, hi, first = words(data, off)
    roll = Rolling(Rolling(BYTE_VALUE[data]).spans(lo, hi))
    n = np.diff(first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), count)
    at = first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    h = roll.spans(at, np.minimum(at + SHINGLE, first[1:][text]))
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])][: len(h)])
    return text[new], h[new], np.diff(np.r_[new, len(h)])


def _uniform(seed: np.ndarray) -> np.ndarray:
    return ((mix(seed) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """For each of n texts, ``slots`` 64-bit values (a row of zeros without shingles)."""
    level = np.zeros(len(weight), np.int64)  # the interval that holds level weight - 1
    big = weight > 1
    level[big] = np.floor(np.log2(weight[big] - 1)).astype(np.int64) + 1
    each = np.repeat(np.arange(len(weight)), level + 1)
    k = np.arange(len(each)) - np.repeat(np.cumsum(level + 1) - level - 1, level + 1)
    doc, top = text[each], weight[each]
    low, width = np.where(k == 0, 0, 1 << np.maximum(k - 1, 0)), np.where(k == 0, 1, 1 << np.maximum(k - 1, 0)).astype(np.float64)
    seed = mix(shingle[each] + k.astype(_U) * _GOLD)
    best, name = np.full((n, slots), np.inf), np.zeros((n, slots), _U)
    latest = np.full(n, np.inf)  # of a text's slots
    time, point = np.zeros(len(each)), 0
    while len(seed):
        point += 1
        s = mix(seed + _U(point * int(_GOLD) & (1 << 64) - 1))
        time = time - np.log(_uniform(s)) / width
        on = time <= latest[doc]
        doc, top, low, width, seed, time, s = doc[on], top[on], low[on], width[on], seed[on], time[on], s[on]
        if not len(seed):
            break
        where = (mix(s ^ _U(0xA5A5A5A5)) % _U(slots)).astype(np.int64)
        inside = low + _uniform(s ^ _U(0x5A5A5A5A00)) * width < top
        d, t, v = doc[inside], time[inside], s[inside]
        flat = d * slots + where[inside]
        np.minimum.at(best.ravel(), flat, t)
        won = best.ravel()[flat] == t
        name.ravel()[flat[won]] = v[won]
        touched = np.flatnonzero(np.bincount(d[won], minlength=n))
        latest[touched] = best[touched].max(1)
    return name


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, off in pieces(batch, size=1 << 22):
            text, h, weight = shingles(data, off)
            sig = signatures(text, h, weight, len(part))
            has = np.bincount(text, minlength=len(part)) > 0
            short = (sig & _U(0xFF)).astype(np.uint8)
            band = np.broadcast_to(np.arange(BANDS), (len(part), BANDS)).astype(np.int64)
            for r in range(ROWS):  # the key is exact: the band's number and its bytes
                band = band << 8 | short[:, r * BANDS : (r + 1) * BANDS]
            bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(has * BANDS)], pa.int32()), pa.array(band[has].ravel()))
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), bands, pa.array([x.tobytes() for x in short], pa.binary())], names=["doc_id", "bands", "sig"])


def _shared(t: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(group's band, leader, those it meets, slots they agree in) as row numbers of whole
    groups (band, chunk) with their leaders first.  A text meets those behind it of other
    classes, if no earlier band has them both and ``SCREEN`` slots agree."""
    band, chunk, lead, label, place = (np.asarray(t.column(c)) for c in ("band", "chunk", "lead", "class", "place"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(t), SLOTS)
    edge = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (chunk[1:] != chunk[:-1])])
    for lo, hi in zip(edge, np.r_[edge[1:], len(band)]):
        first = lo + int(np.count_nonzero(lead[lo:hi]))
        k = int(band[lo] >> 8 * ROWS)
        for i in range(lo, first):
            at = first + np.flatnonzero((label[first:hi] != label[i]) & (place[first:hi] > place[i]))
            same = sig[at] == sig[i]
            n = same.sum(1)
            near = n >= SCREEN
            at, same, n = at[near], same[near], n[near]
            new = ~same.reshape(len(at), ROWS, BANDS).all(1)[:, :k].any(1)
            if new.any():
                yield int(band[lo]), i, at[new], n[new]


def _met(t: pa.Table) -> pa.RecordBatch:
    """Likely pairs (a, b), and a row (a, band) for each text of a doubtful pair."""
    doc = np.asarray(t.column("doc_id"))
    none = [np.zeros(0, np.int64)]
    a, b, marked = [], [], {}
    for band, i, at, n in _shared(t):
        likely = n >= LIKELY
        a.append(np.full(int(likely.sum()), doc[i]))
        b.append(doc[at[likely]])
        if not likely.all():
            marked.setdefault(band, []).extend([doc[i : i + 1], doc[at[~likely]]])
    marked = {band: np.unique(np.concatenate(x)) for band, x in marked.items()}
    a, b, c = np.concatenate(none + a), np.concatenate(none + b), np.concatenate(none + list(marked.values()))
    bands = np.repeat(np.array(list(marked), np.int64), [len(x) for x in marked.values()])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.r_[a, c], pa.int64()), pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(c), pa.int64())]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(bands)])],
        names=["a", "b", "band"],
    )


def _proved(t: pa.Table, similarity: float) -> pa.RecordBatch:
    """Links (a, b) among doubtful pairs, from the bags of whole groups."""
    doc, bags = np.asarray(t.column("doc_id")), [np.frombuffer(x.as_buffer(), _U) for x in t.column("bag")]
    size = np.array([len(x) for x in bags])
    a, b = [], []
    for _, i, at, n in _shared(t):
        least, most = np.minimum(size[at], size[i]), np.maximum(size[at], size[i])
        at = at[(n < LIKELY) & (least >= similarity * most - 1e-6)]
        if len(at):
            every = np.concatenate([bags[j] for j in at])
            hit = bags[i][np.minimum(np.searchsorted(bags[i], every), size[i] - 1)] == every
            same = np.add.reduceat(hit, np.cumsum(size[at]) - size[at], dtype=np.int64)
            at = at[same / (size[at] + size[i] - same) >= similarity]
            a.append(np.full(len(at), doc[i]))
            b.append(doc[at])
    none = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(none + x), pa.int64()) for x in (a, b)], names=["a", "b"])


def _by_group(batches: Iterator[pa.RecordBatch], met: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feed whole groups to ``met``; rows come sorted by group, leaders first."""
    held: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch])
        band, chunk = np.asarray(t.column("band")), np.asarray(t.column("chunk"))
        if held and (held[-1].column("band")[-1].as_py() != band[0] or held[-1].column("chunk")[-1].as_py() != chunk[0]):
            yield met(pa.concat_tables(held).combine_chunks())
            held = []
        edge = np.flatnonzero((band[1:] != band[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        if len(edge):
            yield met(pa.concat_tables([*held, t.slice(0, int(edge[-1]))]).combine_chunks())
            held, t = [], t.slice(int(edge[-1]))
        held.append(t)
    if held:
        yield met(pa.concat_tables(held).combine_chunks())


def _bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The multiset of each text as sorted numbers: a shingle's hash with 0, 1, 2 ... for
    each time that it occurs."""
    for batch in batches:
        for part, data, off in pieces(texts_of(batch)):
            text, h, count = shingles(data, off)
            turn, each = ragged(np.zeros(len(count), np.int64), count)
            bag, owner = mix(h[each] + turn.astype(_U) * _GOLD), text[each]
            order = np.lexsort((bag, owner))
            bag, first = bag[order], np.searchsorted(owner[order], np.arange(len(part) + 1))
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array([bag[i:j].tobytes() for i, j in zip(first, first[1:])], pa.binary())], names=["doc_id", "bag"])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Jaccard similarity of the multisets bag_a and bag_b."""
    for batch in batches:
        j = []
        for x, y in zip(column(batch, "bag_a").to_pylist(), column(batch, "bag_b").to_pylist()):
            both = np.frombuffer(x + y, _U)
            order = np.sort(both)
            same = int(np.count_nonzero(order[1:] == order[:-1]))
            j.append(same / max(1, len(both) - same))
        yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), pa.array(j, pa.float64())], names=["a", "b", "similarity"])


def verify(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs (a, b), from bags (doc_id, bag)."""
    return pairs.select("a", "b").join(bags.toDF("a", "bag_a"), "a").join(bags.toDF("b", "bag_b"), "b").mapInArrow(_overlap, "a bigint, b bigint, similarity double")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, copies): the class's least document, and how many documents have
    the very same text (this one included)."""
    rows = texts(df, id_col, text_col).where("doc_id is not null")
    real = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))  # texts without a word stand alone
    same = F.when(real, F.unhex(F.md5(F.col("text").cast("binary")))).otherwise(F.col("doc_id").cast("string").cast("binary"))
    rows = rows.withColumn("same", same)
    member = rows.groupBy("doc_id").agg(F.min("same").alias("same"))
    group = member.groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    member = cut(member.join(group, "same"), "members")

    # one row for each different text, both times this is read
    lone = member.where("doc_id = first").select("doc_id", "same")
    signed = rows.join(lone, ["doc_id", "same"], "left_semi").select("doc_id", "text").mapInArrow(_sign, "doc_id bigint, bands array<bigint>, sig binary").where(F.size("bands") > 0)
    signed = cut(signed.dropDuplicates(["doc_id"]), "signed")
    parts = [k / DEALS for k in range(1, DEALS)]
    bounds = signed.agg(F.percentile_approx("doc_id", parts, 1000)).first()[0] or []  # DEALS - 1 numbers
    shared = cut(_numbered(signed.select("doc_id", F.explode("bands").alias("band")), bounds).where("size > 1").drop("size"), "shared")
    buckets = cut(shared.join(signed.select("doc_id", "sig"), "doc_id"), "buckets")
    met = shared.select("doc_id").distinct().join(lone, "doc_id")
    packed = rows.join(met, ["doc_id", "same"], "left_semi").select("doc_id", "text").mapInArrow(packed_texts, "doc_id bigint, packed binary").dropDuplicates(["doc_id"])
    bags = cut(packed.mapInArrow(_bag, "doc_id bigint, bag binary"), "bags")
    forget(shared)

    links = classes = marks = None
    at, span = 1, 1  # texts at places at .. at + span - 1 of each bucket lead in this round
    while True:
        behind = cut(_several(_labelled(buckets.where(F.col("place") >= at), classes)), "open")
        if not behind.head(1):
            forget(behind, buckets)
            break
        chunk = F.floor(F.col("place") / CHUNK)
        lead = behind.where(F.col("place") < at + span).withColumn("chunk", F.explode(F.sequence(chunk, F.floor(F.col("size") / CHUNK)))).withColumn("lead", F.lit(True))
        dealt = lead.unionByName(behind.withColumn("chunk", chunk).withColumn("lead", F.lit(False))).drop("size")
        met = cut(_grouped(dealt, _met, "a bigint, b bigint, band bigint"), "met")
        forget(behind)
        links, classes = _joined(met.where("b is not null").select("a", "b"), bags, similarity, links, classes)
        doubtful = met.where("b is null").select("band", F.col("a").alias("doc_id"))
        marks = doubtful if marks is None else marks.union(doubtful)
        at, span = at + span, min(MOST, span * FASTER)
    if marks is not None:
        found = cut(_settled(marks.distinct(), bounds, signed, bags, similarity, classes), "links")
        if found.head(1):
            links = found if links is None else links.union(found)
            classes = components(links)

    forget(bags, signed)
    if classes is None:
        return member.select("doc_id", F.col("first").alias("class_id"), "copies")
    out = member.join(classes.toDF("first", "class"), "first", "left")
    return out.select("doc_id", F.coalesce("class", "first").alias("class_id"), "copies")


def _numbered(df: DataFrame, bounds: list[int]) -> DataFrame:
    """Rows (band, doc_id, ...) with the number ``place`` of each in its band, from 1 in the
    order of ids, and the band's ``size``.  A band's rows are numbered in parts, between
    ``bounds`` of the ids, so no task has to sort all of a large one."""
    deal = sum((F.when(F.col("doc_id") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    dealt = df.withColumn("deal", deal)
    sizes = dealt.groupBy("band", "deal").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("band")
    before = every.orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("band", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(every).alias("size"))
    own = F.row_number().over(Window.partitionBy("band", "deal").orderBy("doc_id"))
    return dealt.withColumn("own", own).join(sizes, ["band", "deal"]).withColumn("place", (F.col("base") + F.col("own")).cast("bigint")).drop("deal", "own", "base")


def _several(df: DataFrame) -> DataFrame:
    """Rows (band, place, class) of the buckets that hold several classes, with the last
    place as ``size``."""
    several = df.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.max("place").alias("size")).where("lo < hi").select("band", "size")
    return df.join(several, "band")


def _grouped(df: DataFrame, met: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``met`` over the groups (band, chunk)."""
    return df.repartition("band", "chunk").sortWithinPartitions("band", "chunk", F.desc("lead")).mapInArrow(lambda batches: _by_group(batches, met), schema)


def _settled(marks: DataFrame, bounds: list[int], signed: DataFrame, bags: DataFrame, similarity: float, classes: DataFrame | None) -> DataFrame:
    """Links (a, b) between marked texts (band, doc_id) of one bucket and two classes."""
    open_ = _several(_numbered(_labelled(marks, classes), bounds).withColumn("place", F.col("place") - 1).drop("size"))
    block = F.floor(F.col("place") / BLOCK)
    full = open_.join(signed.select("doc_id", "sig"), "doc_id").join(bags, "doc_id").withColumn("block", block)
    lead = full.withColumn("other", F.explode(F.sequence("block", F.floor(F.col("size") / BLOCK)))).withColumn("chunk", F.struct("block", "other")).withColumn("lead", F.lit(True))
    rest = full.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), "block"))).withColumn("chunk", F.struct(F.col("other").alias("block"), F.col("block").alias("other"))).withColumn("lead", F.lit(False))
    dealt = lead.unionByName(rest).withColumn("chunk", F.col("chunk.block") * (1 << 31) + F.col("chunk.other")).drop("block", "other", "size")
    return _grouped(dealt, lambda t: _proved(t, similarity), "a bigint, b bigint")


def _labelled(df: DataFrame, classes: DataFrame | None, key: str = "doc_id", name: str = "class") -> DataFrame:
    """df with the class of its key; texts without a link are classes of their own."""
    if classes is None:
        return df.withColumn(name, F.col(key))
    return df.join(classes.toDF(key, "_class"), key, "left").withColumn(name, F.coalesce("_class", key)).drop("_class")


def _joined(pairs: DataFrame, bags: DataFrame, similarity: float, links: DataFrame | None, classes: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """Links and classes with those pairs that prove to be links."""
    found = cut(verify(pairs, bags).where(F.col("similarity") >= similarity).select("a", "b"), "links")
    if not found.head(1):
        return links, classes
    links = found if links is None else links.union(found)
    return links, components(links)


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document is the least of its class; rows without an id
    stay.  All columns as they were."""
    classes = near_duplicates(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("later_id"))
    return docs.join(classes, docs["doc_id"] == F.col("later_id"), "left_anti")
