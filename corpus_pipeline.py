"""A training-data pipeline of five text operators, each over what the one before kept.

Language ID drops documents it rejects; line dedup takes repeated lines out of the texts
(``n_chars`` follows the text); near-dedup keeps the least document of each class;
decontamination drops documents with a benchmark passage; mixing repeats or leaves out
documents until sources have their target sizes, and adds each copy's number.

Nulls and further columns go through; rows without a text, or with one without a letter,
are rejected by language ID; rows without an id are never near copies; of rows that repeat an
id all stay that the operators keep.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import bagminhash, decontam, langid, lines, mixing
from driftlens.llm.shared import cut, forget, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.drop_repeated_lines(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Language models cannot be written in SQL; tests/llm/test_edges.py holds the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again, and
    deleted when the next stage's are there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = cut(stage(spark, docs, sf_dir), name), docs
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
