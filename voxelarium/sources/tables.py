"""Readers of label tables, logs and the dataset catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxelarium.operators.history import parse_epoch_lines

LABEL_SCHEMA = (
    "case string, et int, tc int, wt int, wt_volume double, tc_volume double, et_volume double, grade_proxy int"
)


def _checked_labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Label rows by header name, with ``malformed``: the columns whose text is no value of their type."""
    raw = spark.read.option("header", True).csv(path)
    texts = raw.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip().lower()) for c in raw.columns])
    wanted = [field.split() for field in schema.split(", ")]
    absent = [name for name, _ in wanted if name not in texts.columns]
    if absent:
        raise ValueError(f"{path} lacks the columns {', '.join(absent)}")
    bad = [
        F.when((F.col(name) != "") & F.col(name).try_cast(kind).isNull(), F.lit(name)) for name, kind in wanted
    ]
    typed = texts.select(*[F.col(name).try_cast(kind).alias(name) for name, kind in wanted], F.concat_ws(",", *bad).alias("malformed"))
    return typed.withColumnsRenamed({"case": "case_id", "grade_proxy": "label"})


def read_labels(spark: SparkSession, path: str, schema: str = LABEL_SCHEMA) -> DataFrame:
    """Typed label rows of a table with a header, its columns in any order and found by name.

    Names are stripped and lowered.  Rows with a text of the wrong type are not
    among them, see ``malformed_labels``.
    """
    return _checked_labels(spark, path, schema).where("malformed = ''").drop("malformed")


def malformed_labels(spark: SparkSession, path: str, schema: str = LABEL_SCHEMA) -> DataFrame:
    """Case and malformed columns of the rows that ``read_labels`` leaves out."""
    return _checked_labels(spark, path, schema).where("malformed <> ''").select("case_id", "malformed")


def read_epoch_log(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("run"))
    return parse_epoch_lines(lines, "run")


def parse_size(text: Column) -> Column:
    """Number of cases in texts such as ``229+105``, ``~50-100`` (upper end) or ``107``; else NULL."""
    parts = F.split(F.regexp_replace(text, r"[^0-9+\-]", ""), r"\+")
    upper = F.transform(parts, lambda p: F.element_at(F.split(p, "-"), -1).try_cast("bigint"))
    return F.aggregate(upper, F.lit(0).cast("bigint"), lambda a, b: a + b)


def catalogue_ranking(df: DataFrame, ct: int | None = None, mri: int | None = None, timepoints: int = 0) -> DataFrame:
    """Datasets that meet the filters, parsed, with relevance as a number."""
    kept = df
    if ct is not None:
        kept = kept.where(F.col("ct") == ct)
    if mri is not None:
        kept = kept.where(F.col("mri") == mri)
    return kept.where(F.col("timepoints") >= timepoints).withColumns(
        {
            "n_cases": parse_size(F.col("size")),
            "score": F.regexp_extract("relevance", r"^(\d+)/", 1).try_cast("int"),
        }
    )
