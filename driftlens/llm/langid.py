"""Operator 9, language identification by Kneser-Ney character models.

For each language, an interpolated Kneser-Ney model of order 4 over lower-case letters
and blanks.  The 4-grams of all training texts are counted on the executors and added up
by Spark; lower orders follow from the distinct 4-grams.  A model is a sorted array of
n-gram hashes for each order with a log probability in each language beside it, found by
the hash's leading bits.  The language with the least cross-entropy a symbol is chosen;
a text is rejected if its cross-entropy lies far above that of training texts in the
same language (``REJECT`` deviations, more for short texts).

No 4-gram is left out.  Discounts, lower orders and their counts are aggregates over the
written table of all 4-grams; a model of more than ``PART_CELLS`` grams times languages is
dealt into parts by a 4-gram's two middle symbols (with them go its contexts and lower
orders), and a task holds one part at a time over a bounded run of texts.

Null texts and texts without a letter are ``und`` with score 0, and rejected; so is
everything if nothing can be learnt.  Rows with a null language are never learnt from, rows
with a null id neither (they are in no fold).  Repeated rows count as often as they stand
there; a language with one text is a class like others; other columns, whatever their
names, are ignored (``identify``) or kept (``keep_identified``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, cut, fold, forget
from .symbols import BLANK, symbols
from .textkit import column, mix, pieces

ORDER, REJECT, SHARPNESS = 4, 8.0, 20.0
#: Probabilities a part of the model holds (grams times languages), and the symbols of the
#: texts held at once while the parts go by.
PART_CELLS, HELD_SYMBOLS = 1 << 21, 1 << 23
WHOLE = (0, 1 << 32)  # the range of ``middle``
_U = np.uint64


def grams(s: np.ndarray, n: int = ORDER) -> np.ndarray:
    """Each window of n symbols as one number, 16 bits a symbol."""
    out = s[: len(s) - n + 1].astype(_U)
    for k in range(1, n):
        out = (out << _U(16)) | s[k : len(s) - n + 1 + k]
    return out


def _mask(n: int) -> np.uint64:
    return _U((1 << 16 * n) - 1)


class Table:
    """Places of keys in an array sorted by their hashes; the leading bits lead there."""

    def __init__(self, keys: np.ndarray):
        h = mix(keys)
        self.order = np.argsort(h)
        self.hash = np.r_[h[self.order], _U(0)] if len(h) else np.zeros(1, _U)
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        edges = np.searchsorted(h[self.order], np.arange(1 << self.bits, dtype=_U) << _U(64 - self.bits))
        self.lead = edges.astype(np.int32)
        self.steps = int(np.diff(np.r_[edges, len(keys)]).max(initial=0))
        self.last = len(self.hash) - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the sorted order, or -1."""
        h = mix(keys)
        at = self.lead[(h >> _U(64 - self.bits)).astype(np.int64)]
        out = np.where((self.hash[at] == h) & (at < self.last), at, -1)
        open_ = np.flatnonzero(out < 0)
        for k in range(1, self.steps):
            here = np.minimum(at[open_] + k, self.last)
            hit = (self.hash[here] == h[open_]) & (here < self.last)
            out[open_[hit]] = here[hit]
            open_ = open_[~hit]
        return out


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def middle(keys: np.ndarray) -> np.ndarray:
    """The third and second symbol of each 4-gram as one number: its place among the parts."""
    return ((keys >> _U(16) & _U(0xFFFF)) << _U(16)) | (keys >> _U(32) & _U(0xFFFF))


def build(langs: list[str], discounts: dict, counts: dict, bigrams: dict, unigrams: dict) -> dict:
    """A part of the model: of each language the part's 4-grams (sorted) and counts, all
    bigrams of its third symbols, all unigrams, and the discount of each order."""
    triples = {x: np.unique(k & _mask(3), return_counts=True) for x, (k, _) in counts.items()}
    alphabet = len(np.unique(np.concatenate([k for k, _ in unigrams.values()]))) + 1
    model = {"langs": langs, "floor": -np.log(alphabet), "orders": []}
    lower_keys, lower = None, None
    for n, level in ((1, unigrams), (2, bigrams), (3, triples), (4, counts)):
        keys = np.unique(np.concatenate([k for k, _ in level.values()]))
        contexts = np.unique(keys >> _U(16))
        prob, back = np.empty((len(langs), len(keys))), np.empty((len(langs), len(contexts)))
        for i, x in enumerate(langs):
            k, c = level[x]
            d = discounts[n, x]
            ctx, at = np.unique(k >> _U(16), return_inverse=True)
            total, kinds = np.bincount(at, c, minlength=len(ctx)), np.bincount(at, minlength=len(ctx))
            all_ = _lookup(ctx, total.astype(float), contexts)
            free = np.where(all_ > 0, d * _lookup(ctx, kinds.astype(float), contexts) / np.maximum(all_, 1), 1.0)
            here = np.searchsorted(contexts, keys >> _U(16))
            below = np.full(len(keys), 1 / alphabet) if n == 1 else lower[i][np.searchsorted(lower_keys, keys & _mask(n - 1))]
            own = np.maximum(_lookup(k, c.astype(float), keys) - d, 0) / np.maximum(all_[here], 1)
            prob[i], back[i] = own + free[here] * below, np.log(free)
        lower_keys, lower = keys, prob
        t, c = Table(keys), Table(contexts)
        model["orders"].append((n, t, np.log(prob[:, t.order]).astype(np.float32), c, back[:, c.order].astype(np.float32)))
    model["orders"].reverse()  # the highest order first
    return model


def log_probabilities(model: dict, keys: np.ndarray, level: int = 0) -> np.ndarray:
    """For each language a row: the log probability of the last symbol of each key."""
    n, table, prob, contexts, back = model["orders"][level]
    at = table.find(keys)
    out = prob[:, at]
    gone = np.flatnonzero(at < 0)
    if len(gone):
        rest = keys[gone]
        deeper = log_probabilities(model, rest & _mask(n - 1), level + 1) if n > 1 else np.full((len(prob), len(rest)), model["floor"], np.float32)
        c = contexts.find(rest >> _U(16))
        out[:, gone] = deeper + np.where(c >= 0, back[:, c], 0)
    return out


def sums(part: dict, s: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The log probabilities a part gives to the symbols of each text, added up; a row for
    each text, a column for each language."""
    if len(s) < ORDER:
        return np.zeros((len(start) - 1, len(part["langs"])))
    g = grams(s)  # the gram at i ends at i + ORDER - 1
    low, high = part["range"]
    a, z = start[:-1], start[1:] - ORDER + 1
    if (low, high) != WHOLE:
        m = middle(g)
        own = np.flatnonzero((m >= low) & (m < high))
        g, a, z = g[own], np.searchsorted(own, a), np.searchsorted(own, z)
    lp = log_probabilities(part, g)
    added = np.zeros((len(lp), lp.shape[1] + 1))
    np.cumsum(lp, axis=1, dtype=np.float64, out=added[:, 1:])
    return (added[:, z] - added[:, a]).T


def count_grams(df: DataFrame) -> DataFrame:
    """(lang, gram, n) over the rows (lang, text) of df, whole texts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(x: str) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held[x]]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([c for _, c in held[x]])).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for x in sorted(held):
                k, c = merged(x)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(k)), pa.array(k.view(np.int64)), pa.array(c)], names=["lang", "gram", "n"])

        size = 0
        for batch in batches:
            for part, data, off in pieces(batch):
                lang = column(part, "lang").to_pylist()
                s, start = symbols(data, off, ORDER - 1)
                g = grams(s)
                for x in set(lang):
                    here = [i for i, y in enumerate(lang) if y == x and start[i + 1] - start[i] > ORDER]
                    if here:
                        own = np.concatenate([g[start[i] : start[i + 1] - ORDER + 1] for i in here])
                        held.setdefault(x, []).append(np.unique(own, return_counts=True))
                        if len(held[x]) > 8:
                            held[x] = [merged(x)]
                        size = sum(len(k) for v in held.values() for k, _ in v)
                if size > 4_000_000:  # bounded memory, whatever the partition holds
                    yield from out()
                    held, size = {}, 0
        yield from out()

    return df.select("lang", "text").mapInArrow(emit, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _by_lang(df: DataFrame, langs: list[str]) -> dict:
    """Of each language the sorted grams of (lang, gram, n) and their counts."""
    got = df.select("lang", "gram", "n").toArrow()
    lang = got.column("lang").combine_chunks().dictionary_encode()
    code, names = np.asarray(lang.indices), lang.dictionary.to_pylist()
    gram, n = np.asarray(got.column("gram")).view(_U), np.asarray(got.column("n"))
    out = {}
    for x in langs:
        here = np.flatnonzero(code == names.index(x)) if x in names else np.empty(0, np.int64)
        here = here[np.argsort(gram[here])]
        out[x] = gram[here], n[here]
    return out


def _lower(df: DataFrame, n: int) -> DataFrame:
    """The n-grams of (lang, gram, n) of the order above, with the number of its kinds."""
    return df.groupBy("lang", F.col("gram").bitwiseAND(F.lit(int(_mask(n)))).alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def fit(train: DataFrame) -> dict | None:
    """The calibrated model from rows (lang, text), its parts broadcast one by one; None if
    there is nothing to learn."""
    spark = train.sparkSession
    bounded_batches(spark)
    train = train.select(train["lang"].alias("lang"), train["text"].alias("text")).where("lang is not null and text is not null")
    all_ = cut(count_grams(train), "grams")
    triples = _lower(all_, 3)
    pairs = cut(_lower(triples, 2), "bigrams")
    singles = _lower(pairs, 1)
    levels = [df.select(F.lit(n).alias("level"), "lang", "n") for n, df in ((4, all_), (3, triples), (2, pairs), (1, singles))]
    stats = levels[0].unionAll(levels[1]).unionAll(levels[2]).unionAll(levels[3]).groupBy("level", "lang")
    stats = stats.agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()  # four rows a language
    if not stats:
        return None
    discounts = {(r["level"], r["lang"]): min(0.9, max(0.1, r["n1"] / (r["n1"] + 2 * r["n2"]))) if r["n1"] else 0.5 for r in stats}
    langs = sorted({r["lang"] for r in stats})
    unigrams = _by_lang(singles, langs)  # at most 2**16 a language
    third, second = (F.shiftrightunsigned("gram", k).bitwiseAND(F.lit(0xFFFF)) for k in (16, 32))
    place = F.shiftleft(third, 16).bitwiseOR(second)
    kinds = all_.select("gram").distinct()
    n_parts = -(-kinds.count() * len(langs) // PART_CELLS)
    edges = [WHOLE[0], WHOLE[1]]
    if n_parts > 1:
        share = [k / n_parts for k in range(1, n_parts)]
        edges = sorted({*edges, *kinds.agg(F.percentile_approx(place, share, max(10_000, 100 * n_parts))).first()[0]})
    parts = []
    for low, high in zip(edges[:-1], edges[1:]):
        own = all_ if n_parts == 1 else all_.where((place >= low) & (place < high))
        below = pairs.where(F.shiftrightunsigned("gram", 16).between(low >> 16, (high - 1) >> 16))
        part = build(langs, discounts, _by_lang(own, langs), _by_lang(below, langs), unigrams)
        parts.append(spark.sparkContext.broadcast(part | {"range": (low, high)}))
    forget(all_, pairs)
    model = {"langs": langs, "parts": parts}
    # a row for each language; each text weighs as much as it has letters
    n, h = F.col("n_letters"), F.col("cross_entropy")
    seen = measured(train, model).groupBy("lang_pred").agg(F.sum(n).alias("n"), F.sum(n * h).alias("s"), F.sum(n * h * h).alias("q")).where("n > 0").collect()
    model["usual"] = {r["lang_pred"]: (r["s"] / r["n"], max(0.0, r["q"] / r["n"] - (r["s"] / r["n"]) ** 2) ** 0.5) for r in seen}
    return model


_ADDED = "lang_pred string, score double, cross_entropy double, n_letters bigint"


def measured(df: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """The rows of df with lang_pred, score, cross_entropy and n_letters."""
    bounded_batches(df.sparkSession)
    langs, shared = (model["langs"], model["parts"]) if model else ([], [])

    def scored(held: list) -> Iterator[pa.RecordBatch]:
        total = [0.0] * len(held)
        for b in shared:
            part = b.value
            for i, (_, s, start) in enumerate(held):
                total[i] = total[i] + sums(part, s, start)
            if len(shared) > 1:
                del part
                vars(b).pop("_value", None)  # one part at a time; it is read again from its file
        for (rows, s, start), t in zip(held, total):
            if model is None:
                pred, sure = ["und"] * len(rows), np.zeros(len(rows))
                least, letters = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
            else:
                letters = np.add.reduceat(s != BLANK, start[:-1]) if len(start) > 1 else np.zeros(0, int)
                h = -t / np.maximum(1, np.diff(start) - ORDER + 1)[:, None]  # nats a symbol
                best, least = h.argmin(1), h.min(1)
                sure = np.where(letters > 0, 1 / np.exp(-SHARPNESS * (h - least[:, None])).sum(1), 0.0)
                pred = [langs[b] if k else "und" for b, k in zip(best, letters)]
            arrays = [*rows.columns, pa.array(pred, pa.string()), pa.array(sure, pa.float64()), pa.array(least, pa.float64()), pa.array(letters.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rows.schema.names, "lang_pred", "score", "cross_entropy", "n_letters"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part, data, off in pieces(batch, text_col):
                held.append((part, *(symbols(data, off, ORDER - 1) if model else (None, None))))
                size += len(data)
                if len(shared) < 2 or size > HELD_SYMBOLS:
                    yield from scored(held)
                    held, size = [], 0
        yield from scored(held)

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(emit, f"{schema}, {_ADDED}")


def rejected(model: dict | None):
    """The condition under which a measured row is rejected."""
    if model is None:
        return F.lit(True)
    limit = F.lit(None).cast("double")
    for x, (mean, dev) in model["usual"].items():
        slack = F.lit(REJECT * max(dev, 0.02)) * (1 + F.sqrt(50 / F.greatest("n_letters", F.lit(1))))
        limit = F.when(F.col("lang_pred") == x, F.lit(mean) + slack).otherwise(limit)
    return (F.col("lang_pred") == "und") | F.coalesce(F.col("cross_entropy") > limit, F.lit(False))


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), learnt outside the held-out fold."""
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["lang"].alias("lang"), docs["text"].alias("text"))
    model = fit(rows.where(~fold("doc_id", folds).isin(held_out, -1)))
    return measured(rows.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "lang_pred", "score", rejected(model).alias("rejected")
    )


def keep_identified(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """The rows of docs whose text is not rejected, all columns as they were."""
    rows = docs.select(docs["doc_id"], docs["lang"], docs["text"])
    model = fit(rows.where(~fold("doc_id", folds).isin(held_out, -1)))
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    scored = measured(inner, model, f"c{[n.lower() for n in names].index('text')}")
    return scored.where(~rejected(model)).select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
