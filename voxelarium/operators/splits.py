"""Splits, folds, balanced batches and leakage audits, repeatable by seeded digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from voxelarium.operators.distributed import hash_to_int, hashed_rank, seeded_hash


def stratified_split(
    df: DataFrame,
    label: str,
    key: str = "case_id",
    train: float = 0.8,
    val: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Column ``split`` with floored class-wise sizes; what is left is the test set."""
    ranked = hashed_rank(df, key, seed, [label])
    n_train = F.floor(F.col("n") * F.lit(train))
    n_val = F.floor(F.col("n") * F.lit(val))
    split = F.when(F.col("rn") <= n_train, "train").when(F.col("rn") <= n_train + n_val, "val")
    return ranked.withColumn("split", split.otherwise("test")).drop("rn", "n")


def random_split(df: DataFrame, key: str = "case_id", val: float = 0.2, seed: int = 42) -> DataFrame:
    """Two-way split of exact size regardless of class."""
    ranked = hashed_rank(df, key, seed)
    keep = F.floor(F.col("n") * F.lit(1 - val))
    return ranked.withColumn("split", F.when(F.col("rn") <= keep, "train").otherwise("val")).drop("rn", "n")


def k_fold(df: DataFrame, k: int, label: str, key: str = "case_id", seed: int = 42) -> DataFrame:
    """Stratified folds that differ by at most one row per class."""
    ranked = hashed_rank(df, key, seed, [label])
    return ranked.withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn", "n")


def group_split(
    df: DataFrame, group: str, train: float = 0.8, val: float = 0.1, seed: int = 42
) -> DataFrame:
    """Split by patient: a digest of the patient alone decides, no shuffle at all."""
    at = hash_to_int(seeded_hash(seed, group)) / F.lit(4294967296.0)
    split = F.when(at < train, "train").when(at < train + val, "val").otherwise("test")
    return df.withColumn("split", split)


def split_leakage(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups with rows in more than one split, and all groups."""
    spread = df.groupBy(group).agg(F.min(split).alias("lo"), F.max(split).alias("hi"))
    return spread.agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("lo") != F.col("hi")).alias("n_leaking")
    )


def balanced_batches(
    df: DataFrame, label: str, size: int, key: str = "case_id", seed: int = 42
) -> DataFrame:
    """Batches of half positives, half negatives drawn with replacement, one epoch long.

    Every slot derives the ordinal it draws from a digest and meets the rows by
    an equi-join on class and ordinal; ``position`` is its shuffled place.
    """
    half = size // 2
    ranked = hashed_rank(df.select(key, label), key, seed, [label])
    totals = df.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col(label) == 1).alias("n1"),
            F.count_if(F.col(label) == 0).alias("n0"),
        )
    )
    # The rows themselves enumerate the slots: ranks of both classes in a row.
    place = F.when(F.col(label) == 1, F.col("rn") - 1).otherwise(F.col("t.n1") + F.col("rn") - 1)
    numbered = ranked.withColumn("t", totals.scalar()).select("t", place.alias("i"))
    slots = numbered.where(F.col("i") < F.floor(F.col("t.n") / size) * size).select(
        "t", F.floor(F.col("i") / size).alias("batch"), (F.col("i") % size).cast("int").alias("slot")
    )
    wanted = F.when(F.col("slot") < half, 1).otherwise(0)
    room = F.when(F.col("slot") < half, F.col("t.n1")).otherwise(F.col("t.n0"))
    draw = hash_to_int(seeded_hash(seed, "batch", "slot"), digits=15)
    slots = slots.where(F.col("slot") < 2 * half).select(
        "batch",
        "slot",
        wanted.alias(label),
        (draw % F.greatest(room, F.lit(1)) + 1).alias("rn"),
        hash_to_int(seeded_hash(seed, "batch", "slot", F.lit("place")), digits=15).alias("position"),
    )
    return slots.join(ranked.select(key, label, "rn"), [label, "rn"]).drop("rn")


def label_leakage(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Does thresholding one feature at zero reproduce the label?"""
    parts = []
    for f in features:
        v = F.col(f)
        parts += [
            F.count_if((v > 0).cast("int") != F.col(label)).alias(f"{f}_mismatch"),
            F.min(F.when(F.col(label) == 0, v)).alias(f"{f}_min0"),
            F.max(F.when(F.col(label) == 0, v)).alias(f"{f}_max0"),
            F.min(F.when(F.col(label) == 1, v)).alias(f"{f}_min1"),
            F.max(F.when(F.col(label) == 1, v)).alias(f"{f}_max1"),
        ]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *parts)
    cells = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col("n"),
            F.col(f"{f}_mismatch").alias("n_mismatch"),
            *[F.col(f"{f}_{e}").cast("double").alias(e) for e in ("min0", "max0", "min1", "max1")],
        )
        for f in features
    ]
    return wide.select(F.inline(F.array(*cells))).withColumn("leaks", F.col("n_mismatch") == 0)
