"""The test tables seen as scans, masks, labels, scores and run histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxelarium.operators.voxels import explode_bricks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bricks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four modalities of 4x2x2 voxels per case, stored as two 2x2x2 bricks each."""
    part = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("part")
    cut = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("case_id"), "embedding", part)
    return cut.select(
        "case_id",
        F.expr("part div 2").cast("int").alias("modality"),
        (F.col("part") % 2).cast("int").alias("bx"),
        F.lit(0).alias("by"),
        F.lit(0).alias("bz"),
        ((F.col("part") % 2) * 2).cast("int").alias("x0"),
        F.lit(0).alias("y0"),
        F.lit(0).alias("z0"),
        F.lit(2).alias("nx"),
        F.lit(2).alias("ny"),
        F.lit(2).alias("nz"),
        F.slice("embedding", F.col("part") * 8 + 1, F.lit(8)).alias("values"),
    )


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_bricks(bricks(spark, sf_dir))


def with_incomplete(rows: DataFrame, modality: int) -> DataFrame:
    """All ``rows``, and a copy of each case under a negative id without ``modality``."""
    copies = rows.where(F.col("modality") != modality).withColumn("case_id", -1 - F.col("case_id"))
    return rows.unionByName(copies)


def bricks64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 4x4x4 volume per case as four bricks of 1x4x4 (slabs along x)."""
    part = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part")
    cut = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("case_id"), "embedding", part)
    return cut.select(
        "case_id",
        F.lit(0).alias("modality"),
        F.col("part").cast("int").alias("bx"),
        F.lit(0).alias("by"),
        F.lit(0).alias("bz"),
        F.col("part").cast("int").alias("x0"),
        F.lit(0).alias("y0"),
        F.lit(0).alias("z0"),
        F.lit(1).alias("nx"),
        F.lit(4).alias("ny"),
        F.lit(4).alias("nz"),
        F.slice("embedding", F.col("part") * 16 + 1, F.lit(16)).alias("values"),
    )


def vox64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_bricks(bricks64(spark, sf_dir)).drop("modality")


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measurements: patient, day, weekly case, modality, value and key."""
    week = F.floor((F.day("ts") - 1) / 7)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("patient"),
        F.col("ts").cast("date").alias("day"),
        (F.col("user_id") * 100 + week).cast("bigint").alias("case_id"),
        F.col("event_type").alias("modality"),
        "value",
        "event_id",
    )


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as labelled voxels; ``vox`` is not a key, voxels are only counted."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_linenumber").alias("vox"),
        (F.col("l_quantity").cast("int") % 5).alias("label"),
    )


def lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(documents, "doc_id").select(
        F.col("doc_id").alias("case_id"),
        F.col("quality").alias("grade"),
        F.col("n_chars").alias("wt_volume"),
        F.when(F.col("toxic") == 1, F.col("n_chars") % 97).otherwise(0).alias("et_volume"),
    )


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    positive = F.col("event_type").isin("purchase", "signup")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("case_id"),
        F.when(positive, 1).otherwise(0).alias("label"),
        ((F.col("value") - 40.0) / 20.0).alias("logit"),
    )


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("run"), F.day("ts").alias("epoch"))
        .agg(F.round(F.avg("value"), 6).alias("val_loss"))
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases of patients (customers)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("patient")
    )


def case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case names built from orders; the lowest priority plays malformed names."""
    text = F.concat(
        F.lit("BraTS-GLI-"),
        F.lpad(F.col("o_custkey").cast("string"), 5, "0"),
        F.lit("-"),
        F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"),
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("scan_"), F.col("o_orderkey").cast("string")))
        .otherwise(text)
        .alias("name"),
    )
