"""Operator 5, line dedup, in DataFrame functions only.

Texts are split at \\n; a line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at
both ends with A-Z in lower case.  Lines are exploded with their places; the distinct (key,
document) pairs are counted by a 128-bit hash of the key; keys of at least ``min_chars``
code points in at least ``min_docs`` documents lose all their lines, and each text is put
together again from the places that are left.  The work is linear in the lines of a text.

Only hashes are shuffled by key; each task adds up its own documents before, and a hot
key's rows meet the few repeated keys in a join that Spark splits when it is skewed.  A
null or empty text is one empty line.  Rows without an id count as one document (no id)
for the counting and lose lines like others; repeated rows count once and all lose their
lines; texts that stand under one id are told apart.  Other columns pass through unchanged;
columns called n_lines or n_dropped give way.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_DOCS, MIN_CHARS = 10, 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, twin, places) from rows (doc_id, twin, text): where the lines stand that
    min_docs documents have."""
    line = docs.select("doc_id", "twin", F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    key = line.select("doc_id", "twin", "place", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    each = key.select("doc_id", "twin", "place", F.xxhash64("key").alias("a"), F.xxhash64(F.lit("line"), F.col("key")).alias("b"))
    often = each.select("doc_id", "a", "b").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("a", "b")
    return each.join(often, ["a", "b"]).groupBy("doc_id", "twin").agg(F.collect_set("place").alias("places"))


def drop_repeated_lines(df: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, counts: bool = True) -> DataFrame:
    """The rows of df with ``text`` without its repeated lines; with ``counts``, n_lines and
    n_dropped behind them (columns of these names in df give way to them)."""
    rest = [c for c in df.columns if not counts or c.lower() not in ("n_lines", "n_dropped")]
    twin = F.xxhash64(df["text"])
    inner = df.select(df["doc_id"].alias("id"), twin.alias("own"), df["text"].alias("body"), F.struct(*[df[c] for c in rest]).alias("row"))
    marks = repeated_lines(df.select(df["doc_id"].alias("doc_id"), twin.alias("twin"), df["text"].alias("text")), min_docs, min_chars)
    held = inner.join(marks, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("twin")), "left")
    held = held.select("row", "places", _lines(F.col("body")).alias("lines")).select("row", "places", "lines", F.size("lines").alias("n"))
    # array_except looks places up in a hash set and keeps their order
    stays = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("places"))
    held = held.select("row", "n", "lines", F.when(F.col("places").isNotNull(), stays).alias("stays"))
    kept = F.when(F.col("stays").isNull(), F.col("lines")).otherwise(F.transform("stays", lambda i: F.col("lines")[i]))
    n_kept = F.coalesce(F.size(F.col("stays")), F.lit(-1))
    held = held.select("row", F.col("n").cast("bigint").alias("n_lines"), F.when(F.col("stays").isNull(), 0).otherwise(F.col("n") - n_kept).cast("bigint").alias("n_dropped"), kept.alias("kept"))
    cols = [F.array_join("kept", "\n").alias(c) if c.lower() == "text" else F.col("row")[c].alias(c) for c in rest]
    return held.select(*cols, "n_lines", "n_dropped") if counts else held.select(*cols)
