"""Class weights and the majority baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxelarium.conventions import EFFECTIVE_NUMBER_BETA


def class_counts(df: DataFrame, label: str, classes=(0, 1)) -> DataFrame:
    """Count of every listed class, zero included."""
    wide = df.agg(*[F.count_if(F.col(label) == c).alias(f"n{c}") for c in classes])
    cells = [F.struct(F.lit(c).alias(label), F.col(f"n{c}").alias("n")) for c in classes]
    return wide.select(F.inline(F.array(*cells)))


def inverse_frequency_weights(df: DataFrame, label: str, classes=(0, 1)) -> DataFrame:
    """``N / (k * n_c)``, one for an empty class."""
    counts = class_counts(df, label, classes)
    total = counts.agg(F.sum("n"))
    weight = F.try_divide(total.scalar(), F.col("n") * float(len(classes)))
    return counts.withColumn("weight", F.coalesce(weight, F.lit(1.0)))


def effective_number_weights(
    df: DataFrame, label: str, beta: float = EFFECTIVE_NUMBER_BETA, classes=(0, 1)
) -> DataFrame:
    """Weights proportional to ``(1 - beta) / (1 - beta ** n_c)``, scaled to sum to the class count."""
    counts = class_counts(df, label, classes)
    raw = counts.withColumn(
        "_w", F.try_divide(F.lit(1 - beta), 1 - F.pow(F.lit(beta), F.col("n").cast("double")))
    )
    total = raw.agg(F.sum("_w"))
    return raw.select(label, "n", (F.col("_w") * len(classes) / total.scalar()).alias("weight"))


def majority_baseline(df: DataFrame, label: str, split: str) -> DataFrame:
    """Share of the largest class in every split."""
    counts = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(split).agg(
        F.sum("n").alias("n"), (F.max("n") / F.sum("n")).alias("majority")
    )
