"""Skewed synthetic voxels: ``python scale_run.py [voxels]``, seconds and shuffled MB per operator.

A third of all bricks belongs to one case and two thirds to one modality.  The
voxels are made on the executors; nothing but counts reaches the driver.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import functions as F

from voxelarium.operators import components, distributed, longitudinal, regions, splits, stats, voxels
from voxelarium.session import local_session
from voxelarium.storage import materialise, scratch

SIDE = 16


def synthetic_bricks(spark, voxel_count: int):
    n = voxel_count // SIDE**3
    ids = spark.range(0, n, 1, 64).select(
        F.expr("if(id % 3 = 0, 0, id div 48)").alias("case_id"),
        F.expr("if(id % 3 < 2, 0, cast(id % 3 as int))").alias("modality"),
        F.expr("cast(id as int)").alias("bx"),
        F.expr("0").alias("by"),
        F.expr("0").alias("bz"),
        F.expr(f"cast(id * {SIDE} as int)").alias("x0"),
        F.expr("0").alias("y0"),
        F.expr("0").alias("z0"),
        *[F.lit(SIDE).alias(f"n{a}") for a in "xyz"],
        "id",
    )
    value = f"transform(sequence(0, {SIDE**3 - 1}), i -> cast(if(hash(id, i) % 5 = 0, 0, hash(i, id) / 2147483647.0) as float))"
    return ids.withColumn("values", F.expr(value)).drop("id")


def shuffled(spark) -> int:
    """Bytes written for shuffles so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def main() -> None:
    wanted = [int(a) for a in sys.argv[1:]] or [10_000_000, 100_000_000]
    spark = local_session()
    for count in wanted:
        bricks = materialise(synthetic_bricks(spark, count), "scale")
        vox = voxels.explode_bricks(bricks)
        mask = voxels.mask_bricks(bricks, 0, 0.0)
        masked = bricks.where("modality = 0")
        seg = vox.select("case_id", F.expr("cast(abs(value) * 5 as int) % 5").alias("label"))
        scores = vox.select(F.monotonically_increasing_id().alias("case_id"), F.expr("int(value > 0.3)").alias("label"))
        cases = bricks.select("case_id").distinct()
        visits = spark.range(0, count, 1, 64).select(
            F.expr("if(id % 3 = 0, 0, id % 100000)").alias("patient"),
            F.expr("timestamp_seconds(1700000000 + pmod(hash(id), 2592000))").alias("ts"),
            F.expr("cast(id % 100 as double)").alias("value"),
        )
        jobs = {
            "case_stats": lambda: stats.case_stats(vox),
            "cohort moments": lambda: stats.finalise_moments(
                stats.merge_moments(stats.moments(vox, ["modality", "case_id"]), ["modality"]), ["modality"]
            ),
            "exact percentiles": lambda: distributed.exact_percentiles(
                bricks, ["modality"], "values", [0.01, 0.5, 0.99, 0.995], packed=True
            ),
            "sketched percentiles": lambda: stats.approximate_percentiles(vox, ["modality"], {"p50": 0.5}),
            "histogram": lambda: stats.histogram(vox, ["modality"], 100),
            "ctn_normalize": lambda: voxels.ctn_normalize(masked, mask),
            "region_volumes": lambda: regions.region_volumes(seg, {"core": [2, 3], "edema": [1]}),
            "stratified_split": lambda: splits.stratified_split(scores, "label"),
            "brain components": lambda: components.brain_component(masked, 0.0, (0, SIDE, SIDE))[1],
            "patches": lambda: voxels.extract_patches(
                bricks, voxels.patch_offsets(cases, (SIDE * 48, SIDE, SIDE), 8, 50), 8, (SIDE, SIDE, SIDE)
            ),
            "sessions": lambda: longitudinal.session_activity(visits, 6),
        }
        for name, job in jobs.items():
            start, before = time.perf_counter(), shuffled(spark)
            with scratch(spark):
                job().write.format("noop").mode("overwrite").save()
            seconds, megabytes = time.perf_counter() - start, (shuffled(spark) - before) / 1e6
            print(f"{count:>12,} voxels  {name:<22} {seconds:7.1f} s {megabytes:9.1f} MB shuffled", flush=True)


if __name__ == "__main__":
    main()
