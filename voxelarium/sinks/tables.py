"""Writers: tables, labels, quarantine, normalised bricks, JSON records, report lines."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from voxelarium.operators.cohort import dedup_keep_first
from voxelarium.operators.voxels import BRICK_KEYS
from voxelarium.storage import new_folder


def write_table(df: DataFrame, path: str, format: str = "parquet", **options) -> None:
    df.write.mode("overwrite").format(format).options(**options).save(path)


def append_labels(labels: DataFrame, path: str, batch: int) -> None:
    """Append finished label rows with the batch they came in; a repeated batch only adds copies."""
    labels.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("append").parquet(path)


def current_labels(appended: DataFrame, key: str = "case_id") -> DataFrame:
    """One row per case: the copy of the earliest batch."""
    return dedup_keep_first(appended, [key], ["batch"]).drop("batch")


def quarantine(rows: DataFrame, path: str, batch: int = 0) -> None:
    """Failed rows with their batch, one folder per status; rows that are ok are not written."""
    failed = rows.where(F.col("status") != "ok").withColumn("batch", F.lit(batch).cast("bigint"))
    failed.write.mode("append").partitionBy("status").parquet(path)


def current_errors(appended: DataFrame, key: str = "case_id") -> DataFrame:
    """One row per case and status: the copy of the earliest batch."""
    return dedup_keep_first(appended, [key, "status"], ["batch"]).drop("batch")


def write_normalised(bricks: DataFrame, path: str, partitions: int | None = None) -> None:
    """Bricks by modality, clustered by case inside each file.

    Clustering by case as well lets many tasks share a modality and keeps the
    bricks of a volume together.
    """
    keys = ["modality", "case_id"]
    spread = bricks.repartition(partitions, *keys) if partitions else bricks.repartition(*keys)
    ordered = spread.sortWithinPartitions("modality", "case_id", "bx", "by", "bz")
    ordered.write.mode("overwrite").partitionBy("modality").parquet(path)


def bucketed_bricks(bricks: DataFrame, buckets: int, path: str | None = None, keys: Sequence[str] = BRICK_KEYS) -> DataFrame:
    """Bricks written as a table of hash buckets by ``keys`` and read back.

    Tables of the same keys and number of buckets join and aggregate by these keys where
    they lie: no shuffle.  A task writes one whole bucket, so a bucket is one file, sorted
    by the keys.  Without a path the files belong to the surrounding ``scratch``.
    """
    spark = bricks.sparkSession
    name = f"bricks_{uuid.uuid4().hex}"
    spread = bricks.repartition(buckets, *keys)
    writer = spread.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", path or new_folder(spark, "bucketed")).saveAsTable(name)
    return spark.table(name)


def analysis_records(df: DataFrame) -> DataFrame:
    """Nested record of every case: prediction, probability, tumour characteristics."""
    characteristics = [
        "et_volume_voxels",
        "wt_volume_voxels",
        "et_wt_ratio",
        "t1ce_mean",
        "t1ce_max",
        "t1ce_std",
        "has_enhancing",
    ]
    return df.select(
        "case_id",
        F.col("grade_text").alias("prediction"),
        F.col("prob").alias("probability"),
        F.struct(*characteristics).alias("tumor_characteristics"),
    )


def write_json_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report_rows(stats: DataFrame) -> DataFrame:
    """Markdown table lines of the cohort intensity statistics."""
    return stats.select(
        F.col("modality").alias("modality"),
        F.format_string(
            "| %s | %d | %.1f | %.1f | %.1f | %.1f | %.2f%% |",
            "modality",
            "n_cases",
            "mean",
            "std",
            "min",
            "max",
            "positive_pct",
        ).alias("line"),
    )
