"""The corpus pipeline: language identification to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)``, works on every row it is given and returns a
DataFrame that is written as Parquet and read again for the next.  All but the last return
the columns of their input; those that an operator does not use travel under other names,
so that they cannot clash with its results.

Defined results: documents with null or letterless text go in the first stage, as do texts
that look like none of the learned languages; all later stages follow their operators.
Empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxelarium.llm import decontamination, language_id, line_dedup, near_copies, packing
from voxelarium.llm.common import read
from voxelarium.storage import materialise

#: Share of known n-grams, corrected, below which a text is in none of the languages.
MIN_LANGUAGE_SCORE = 0.1

ORACLE_SQL = None


def _apart(docs: DataFrame, used: list[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` on ``docs`` with all columns but ``used`` renamed meanwhile."""
    hidden = {i: f"carried_{i}" for i, c in enumerate(docs.columns) if c not in used}
    names = [hidden.get(i, c) for i, c in enumerate(docs.columns)]
    return step(docs.toDF(*names)).select(*names).toDF(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def step(rows: DataFrame) -> DataFrame:
        judged = language_id.identify(rows)
        return judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))

    return _apart(docs, ["doc_id", "text", "lang"], step)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat across documents; ``n_chars`` follows the text."""

    def step(rows: DataFrame) -> DataFrame:
        out = line_dedup.drop_repeated_lines(rows).withColumn("text", F.col("kept_text"))
        return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in rows.columns else out

    return _apart(docs, ["text", "n_chars"], step)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word Jaccard similarity 0.8 or more."""
    return _apart(docs, ["doc_id", "text"], near_copies.keep_one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    return _apart(docs, ["text"], lambda rows: decontamination.decontaminate(rows, items).filter(~F.col("contaminated")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
