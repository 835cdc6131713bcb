"""From segmentation labels to region volumes, presence and labels.

``seg`` is ``case_id, label`` with a row per voxel, or with a column ``voxels`` of counts,
as ``label_histogram`` makes them from bricks.  A mask without any label above zero is a
case like all others: its background counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import Column, DataFrame, functions as F

from voxelarium.conventions import LABEL_NAMES, VOXEL_SPACING
from voxelarium.operators.distributed import exact_percentiles
from voxelarium.storage import materialise


def label_name(label: Column, names: Mapping[int, str] = LABEL_NAMES) -> Column:
    """Display name of a label, ``label_<k>`` when unknown."""
    out = F.concat(F.lit("label_"), label.cast("string"))
    for k, name in names.items():
        out = F.when(label == k, F.lit(name)).otherwise(out)
    return out


def region_map(df: DataFrame, regions: Mapping[str, Sequence[int]]) -> DataFrame:
    """Rows ``region, label``: a lookup table whose size is that of the preset."""
    rows = [(region, label) for region, labels in regions.items() for label in labels]
    return df.sparkSession.createDataFrame(rows, "region string, label int")


def _voxels(seg: DataFrame, condition: Column | None = None) -> Column:
    """Number of voxels, those that meet the condition if there is one."""
    if "voxels" not in seg.columns:
        return F.count(F.lit(1)) if condition is None else F.count_if(condition)
    n = F.col("voxels") if condition is None else F.when(condition, F.col("voxels"))
    return F.coalesce(F.sum(n), F.lit(0))


def label_counts(seg: DataFrame) -> DataFrame:
    """Voxels per case and label; everything below works on this reduced table."""
    return seg.groupBy("case_id", "label").agg(_voxels(seg).alias("voxels"))


def label_volumes(seg: DataFrame, spacing: Sequence[float] = VOXEL_SPACING) -> DataFrame:
    """Voxels and mm3 of every label above zero in every case."""
    counts = label_counts(seg.where(F.col("label") > 0))
    return counts.select(
        "case_id",
        "label",
        label_name(F.col("label")).alias("name"),
        "voxels",
        (F.col("voxels") * float(prod(spacing))).alias("mm3"),
    )


def label_region_rows(counts: DataFrame, regions: Mapping[str, Sequence[int]]) -> DataFrame:
    """Counts joined to the regions that contain their label; regions overlap."""
    return counts.join(F.broadcast(region_map(counts, regions)), "label")


def region_volumes(
    seg: DataFrame, regions: Mapping[str, Sequence[int]], spacing: Sequence[float] = VOXEL_SPACING
) -> DataFrame:
    """Volume of every region in every case, zero where it is absent.

    One conditional sum per region keeps absent regions as zeros, so no grid of
    cases and regions has to be joined.
    """
    names = list(regions)
    sums = [_voxels(seg, F.col("label").isin(list(regions[r]))).alias(f"r{i}") for i, r in enumerate(names)]
    wide = seg.groupBy("case_id").agg(*sums)
    cells = [
        F.struct(F.lit(r).alias("region"), F.col(f"r{i}").alias("voxels")) for i, r in enumerate(names)
    ]
    return wide.select("case_id", F.inline(F.array(*cells))).withColumn(
        "mm3", F.col("voxels") * float(prod(spacing))
    )


def derive_labels(seg: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Presence, volumes and grade of every case in one aggregate.

    With ``cases`` listed, those without a mask follow with zeros.
    """
    counts = seg.groupBy("case_id").agg(
        _voxels(seg, F.col("label") == 3).alias("et_volume"),
        _voxels(seg, F.col("label").isin(2, 3)).alias("tc_volume"),
        _voxels(seg, F.col("label").isin(1, 2, 3)).alias("wt_volume"),
    )
    if cases is not None:
        counts = cases.select("case_id").join(counts, "case_id", "left")
    volume = {r: F.coalesce(F.col(f"{r}_volume"), F.lit(0)) for r in ("et", "tc", "wt")}
    return counts.select(
        "case_id",
        *[(volume[r] > 0).cast("int").alias(r) for r in ("et", "tc", "wt")],
        *[volume[r].cast("double").alias(f"{r}_volume") for r in ("wt", "tc", "et")],
        (volume["et"] > 0).cast("int").alias("grade_proxy"),
    )


def region_summary(volumes: DataFrame, region: str = "region", mm3: str = "mm3") -> DataFrame:
    """Cohort totals with both denominators: all cases and cases with the region."""
    v = F.col(mm3)
    return volumes.groupBy(region).agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.count_if(v > 0).alias("n_positive"),
        F.sum(v).alias("total_mm3"),
        F.avg(v).alias("mean_all"),
        F.coalesce(F.avg(F.when(v > 0, v)), F.lit(0.0)).alias("mean_positive"),
    )


def tumor_fractions(seg: DataFrame, target: int = 4) -> DataFrame:
    """Target voxels and their share of all voxels, per case."""
    hits = seg.groupBy("case_id").agg(
        _voxels(seg, F.col("label") == target).alias("voxels"), _voxels(seg).alias("n")
    )
    return hits.withColumn("fraction", F.try_divide("voxels", "n"))


def presence_and_fraction(seg: DataFrame, target: int = 4) -> DataFrame:
    """Cases with and without the target, and volume statistics over those with it."""
    per_case = materialise(tumor_fractions(seg, target).withColumn("cohort", F.lit("all")), "fractions")
    totals = per_case.groupBy("cohort").agg(
        F.count_if(F.col("voxels") > 0).alias("n_with"),
        F.count_if(F.col("voxels") == 0).alias("n_without"),
        F.count(F.lit(1)).alias("_n"),
        F.avg(F.when(F.col("voxels") > 0, F.col("voxels"))).alias("mean_voxels"),
        F.max("voxels").alias("max_voxels"),
        F.avg(F.when(F.col("voxels") > 0, F.col("fraction"))).alias("mean_fraction"),
        F.max("fraction").alias("max_fraction"),
    )
    middle = exact_percentiles(per_case.where("voxels > 0"), ["cohort"], "voxels", [0.5]).select(
        "cohort", F.col("p0").alias("median_voxels")
    )
    pct = F.coalesce(F.try_divide(F.col("n_with") * 100.0, F.col("_n")), F.lit(0.0))
    return totals.join(middle, "cohort", "left").select(
        "n_with", "n_without", pct.alias("with_pct"), "mean_voxels", "median_voxels", "max_voxels",
        "mean_fraction", "max_fraction",
    )


def top_k_by_volume(volumes: DataFrame, k: int = 5, minimum: float = 1000.0, mm3: str = "mm3") -> DataFrame:
    """Largest cases above a minimum; the case id breaks ties."""
    return volumes.where(F.col(mm3) > minimum).orderBy(F.desc(mm3), "case_id").limit(k)


def distinct_labels(seg: DataFrame) -> DataFrame:
    """Each label with its voxels and the cases that show it."""
    return label_counts(seg).groupBy("label").agg(
        F.sum("voxels").alias("voxels"), F.count(F.lit(1)).alias("n_cases")
    )


def dice(pairs: DataFrame, regions: Mapping[str, Sequence[int]], keys: Sequence[str]) -> DataFrame:
    """Overlap of two label columns ``a`` and ``b`` per region: ``2 n(A and B) / (n(A) + n(B))``."""
    sums = []
    for i, labels in enumerate(regions.values()):
        a, b = F.col("a").isin(list(labels)), F.col("b").isin(list(labels))
        sums += [F.count_if(a).alias(f"a{i}"), F.count_if(b).alias(f"b{i}"), F.count_if(a & b).alias(f"o{i}")]
    wide = pairs.groupBy(*keys).agg(*sums)
    cells = [
        F.struct(
            F.lit(r).alias("region"),
            F.col(f"a{i}").alias("n_a"),
            F.col(f"b{i}").alias("n_b"),
            F.col(f"o{i}").alias("n_both"),
        )
        for i, r in enumerate(regions)
    ]
    long = wide.select(*keys, F.inline(F.array(*cells)))
    score = F.try_divide(2.0 * F.col("n_both"), F.col("n_a") + F.col("n_b"))
    return long.withColumn("dice", F.coalesce(score, F.lit(1.0)))


def labels_per_mask(seg: DataFrame) -> DataFrame:
    """Distinct labels of each mask, in order, and their number."""
    found = seg.groupBy("case_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return found.select("case_id", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"), F.size("labels").alias("n_labels"))


def case_metadata(vox: DataFrame, seg: DataFrame, modalities: Sequence) -> DataFrame:
    """One row per case: size and moments of each modality, mask labels and region volumes, absences."""
    value, is_ = F.col("value"), lambda m: F.col("modality") == m
    parts = []
    for i, m in enumerate(modalities):
        here = F.when(is_(m), value)
        parts += [F.count(here).alias(f"n_{i}"), F.avg(here).alias(f"mean_{i}"), F.stddev_pop(here).alias(f"std_{i}")]
    absent = F.array_compact(F.array(*[F.when(F.col(f"n_{i}") == 0, F.lit(str(m))) for i, m in enumerate(modalities)]))
    scans = vox.groupBy("case_id").agg(*parts).withColumn("missing", F.array_join(absent, ","))
    volumes = derive_labels(seg).select("case_id", "et_volume", "tc_volume", "wt_volume")
    return scans.join(labels_per_mask(seg), "case_id", "left").join(volumes, "case_id", "left")
