"""Intensity statistics: moments, percentiles, histograms, box plots, correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from voxelarium.operators.bincounts import brick_moments, value_histogram, volume_percentiles, volume_shape
from voxelarium.operators.distributed import exact_percentiles, join_summary
from voxelarium.operators.voxels import explode_bricks, stride_bricks
from voxelarium.storage import materialise

MOMENTS = ["s", "s2", "n", "npos", "mn", "mx"]


def case_stats(vox: DataFrame, keys: Sequence[str] = ("case_id", "modality"), value: str = "value") -> DataFrame:
    """Minimum, maximum, mean, population deviation and share of positive and non-zero values."""
    v = F.col(value)
    return vox.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        (F.avg((v > 0).cast("double")) * 100).alias("positive_pct"),
        (F.avg((v != 0).cast("double")) * 100).alias("nonzero_pct"),
    )


def moments(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Additive accumulators; a later ``merge_moments`` may combine any grouping of them."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.sum(v).alias("s"),
        F.sum(v * v).alias("s2"),
        F.count(v).alias("n"),
        F.count_if(v > 0).alias("npos"),
        F.min(v).alias("mn"),
        F.max(v).alias("mx"),
    )


def merge_moments(acc: DataFrame, keys: Sequence[str]) -> DataFrame:
    return acc.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in MOMENTS[:4]], F.min("mn").alias("mn"), F.max("mx").alias("mx")
    )


def finalise_moments(acc: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, deviation (variance clipped at zero) and positive share; zeros for empty groups."""
    mean = F.coalesce(F.try_divide("s", "n"), F.lit(0.0))
    spread = F.col("s2") - F.coalesce(F.try_divide(F.col("s") * F.col("s"), F.col("n")), F.lit(0.0))
    variance = F.coalesce(F.try_divide(spread, F.col("n")), F.lit(0.0))
    share = F.coalesce(F.try_divide(F.col("npos") * 100.0, F.col("n")), F.lit(0.0))
    return acc.select(
        *keys,
        "n",
        mean.alias("mean"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std"),
        F.col("mn").alias("min"),
        F.col("mx").alias("max"),
        share.alias("positive_pct"),
    )


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    fractions: Mapping[str, float],
    value: str = "value",
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact percentiles, one named column each."""
    names = list(fractions)
    exact = exact_percentiles(df, keys, value, [fractions[k] for k in names], accuracy)
    return exact.select(*keys, *[F.col(f"p{i}").alias(k) for i, k in enumerate(names)])


def value_sketches(df: DataFrame, keys: Sequence[str], value: str = "value", k: int = 800) -> DataFrame:
    """``keys, n, sketch``: a KLL sketch of each group as bytes, to be stored and merged later."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored sketches merged upwards to coarser keys; the raw values are not read again."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_percentiles(sketches: DataFrame, keys: Sequence[str], fractions: Mapping[str, float]) -> DataFrame:
    """``keys, n, name, fraction, estimate`` of stored sketches.

    With ``k`` of 800 an estimate's rank is off by less than half a percent of ``n`` at 99
    percent confidence, whatever the number of merges.
    """
    cells = [
        F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("fraction"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("estimate"))
        for name, p in fractions.items()
    ]
    return sketches.where("n > 0").select(*keys, "n", F.inline(F.array(*cells)))


def rank_errors(df: DataFrame, estimates: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """``estimates`` with the distance of each one's rank in ``df`` from the wanted one, as a share of ``n``."""
    keys = list(keys)
    estimates = materialise(estimates, "estimates")  # merging draws at random
    asked = estimates.groupBy(*keys).agg(F.collect_list(F.struct("name", "estimate")).alias("asked"))
    v = F.col(value).cast("double")
    cells = F.transform("asked", lambda a: F.struct(a["name"].alias("name"), (v < a["estimate"]).alias("below"), (v <= a["estimate"]).alias("upto")))
    ranks = (
        join_summary(df, asked, keys).select(*keys, F.inline(cells)).groupBy(*keys, "name")
        .agg(F.count_if("below").alias("below"), F.count_if("upto").alias("upto"))
    )
    place = F.col("fraction") * F.col("n")
    off = F.greatest(F.col("below") - place, place - F.col("upto"), F.lit(0.0)) / F.col("n")
    return estimates.join(ranks, [*keys, "name"]).select(*keys, "n", "name", "fraction", "estimate", off.alias("rank_error"))


def approximate_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    fractions: Mapping[str, float],
    value: str = "value",
    accuracy: int = 10_000,
) -> DataFrame:
    """One-pass percentiles with a rank error of at most ``n / accuracy``; returns stored values."""
    names = list(fractions)
    sketch = df.groupBy(*keys).agg(
        F.percentile_approx(value, [fractions[k] for k in names], accuracy).alias("_q")
    )
    return sketch.select(*keys, *[F.get("_q", F.lit(i)).alias(k) for i, k in enumerate(names)])


def cohort_intensity(
    df: DataFrame,
    fractions: Mapping[str, float],
    group: str = "modality",
    case: str = "case_id",
    value: str = "value",
) -> DataFrame:
    """Headline table: case count, merged moments and percentiles per modality."""
    per_case = moments(df, [group, case], value)
    merged = per_case.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_cases"),
        *[F.sum(c).alias(c) for c in MOMENTS[:4]],
        F.min("mn").alias("mn"),
        F.max("mx").alias("mx"),
    )
    final = finalise_moments(merged, [group, "n_cases"])
    return final.join(percentiles(df, [group], fractions, value), group)


def first_cases(df: DataFrame, n: int, key: str = "case_id") -> DataFrame:
    """Rows of the first ``n`` cases by name (the feature is the limit itself)."""
    chosen = df.select(key).distinct().orderBy(key).limit(n)
    return df.join(F.broadcast(chosen) if n <= 100_000 else chosen, key, "left_semi")


def sampled_percentiles(
    bricks: DataFrame, n_cases: int, stride: int, fractions: Mapping[str, float]
) -> DataFrame:
    """Percentiles over strided voxels of the first cases, never truncated; cases are chosen among bricks."""
    chosen = explode_bricks(stride_bricks(first_cases(bricks, n_cases), stride))
    return percentiles(chosen, ["modality"], fractions)


def bin_counts(
    df: DataFrame, keys: Sequence[str], limits: DataFrame, bins: int, value: str, packed: bool = False
) -> DataFrame:
    """Rows per equal-width bin of ``limits`` (``mn, top, limit``), empty bins included.

    With ``packed`` the values are arrays, unpacked behind the join.
    """
    keys = list(keys)
    limits = limits.withColumn("width", F.expr(f"(top - mn) / {bins}"))
    rows = join_summary(df.select(*keys, F.col(value).alias("_v")), limits, keys)
    if packed:
        rows = rows.withColumn("_v", F.explode("_v"))
    counted = (
        rows.where("_v <= limit")
        .select(
            *keys,
            F.expr(f"cast(least(coalesce(floor(try_divide(_v - mn, width)), 0), {bins - 1}) as int) as bin"),
        )
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = limits.select(*keys, "mn", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counted, [*keys, "bin"], "left").selectExpr(
        *keys,
        "bin",
        "mn + bin * width as lower",
        "mn + (bin + 1) * width as upper",
        "coalesce(n, 0) as n",
    )


def histogram(
    df: DataFrame,
    keys: Sequence[str],
    bins: int,
    value: str = "value",
    cut: float | None = 0.995,
) -> DataFrame:
    """Equal-width bins over the range of the values up to a percentile."""
    keys = list(keys)
    if cut is None:
        limits = df.groupBy(*keys).agg(F.min(value).alias("mn"), F.max(value).alias("top"))
        limits = limits.withColumn("limit", F.col("top"))
    else:
        found = exact_percentiles(df, keys, value, [cut], neighbours=True)
        limits = found.selectExpr(*keys, "mn", "if(p0_hi <= p0, p0_hi, p0_lo) as top", "p0 as limit")
    return bin_counts(df, keys, limits, bins, value)


def box_summary(df: DataFrame, group: str = "modality", case: str = "case_id", value: str = "value") -> DataFrame:
    """Quartiles, whiskers within 1.5 IQR and outlier count of per-case means."""
    means = materialise(df.groupBy(group, case).agg(F.avg(value).alias("m")), "means")
    fences = exact_percentiles(means, [group], "m", [0.25, 0.5, 0.75]).select(
        group, F.col("p0").alias("q1"), F.col("p1").alias("median"), F.col("p2").alias("q3")
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("m") >= F.col("q1") - reach) & (F.col("m") <= F.col("q3") + reach)
    return join_summary(means, fences, [group]).groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("m"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("m"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
        F.count(F.lit(1)).alias("n_cases"),
    )


def case_means_wide(
    df: DataFrame, modalities: Sequence, case: str = "case_id", group: str = "modality", value: str = "value"
) -> DataFrame:
    """Per-case mean of every listed modality, only cases that have them all."""
    means = [F.avg(F.when(F.col(group) == m, F.col(value))).alias(f"m{i}") for i, m in enumerate(modalities)]
    wide = df.groupBy(case).agg(*means)
    return wide.dropna("any", subset=[f"m{i}" for i in range(len(modalities))])


def correlation_matrix(df: DataFrame, modalities: Sequence, **columns: str) -> DataFrame:
    """Pearson correlation of per-case means as rows ``a, b, r``, diagonal included."""
    wide = case_means_wide(df, modalities, **columns)
    pairs = [(i, j) for i in range(len(modalities)) for j in range(i, len(modalities))]
    one = wide.agg(*[F.corr(f"m{i}", f"m{j}").alias(f"r{i}_{j}") for i, j in pairs])
    cells = []
    for i, j in pairs:
        cells.append((modalities[i], modalities[j], f"r{i}_{j}"))
        if i != j:
            cells.append((modalities[j], modalities[i], f"r{i}_{j}"))
    entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(r).alias("r")) for a, b, r in cells]
    return one.select(F.inline(F.array(*entries)))


def pairwise_points(df: DataFrame, modalities: Sequence, **columns: str) -> DataFrame:
    """One point per case and unordered modality pair, unfolded from the wide row."""
    wide = case_means_wide(df, modalities, **columns)
    points: list[Column] = [
        F.struct(
            F.lit(modalities[i]).alias("a"),
            F.lit(modalities[j]).alias("b"),
            F.col(f"m{i}").alias("x"),
            F.col(f"m{j}").alias("y"),
        )
        for i, j in combinations(range(len(modalities)), 2)
    ]
    return wide.select(wide.columns[0], F.inline(F.array(*points)))


def inspect_files(vox: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Per file: mean and deviation of non-zero voxels, or the reason it is bad.

    ``vox`` carries ``label, case_id, value``; ``unreadable`` carries
    ``label, case_id, reason`` of files that did not decode.
    """
    v = F.when(F.col("value") != 0, F.col("value"))
    good = vox.groupBy("label", "case_id").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    files = good.select(
        "label",
        "case_id",
        F.when(F.col("mean").isNull(), F.lit("all-zero volume")).alias("reason"),
        "mean",
        "std",
    )
    if unreadable is not None:
        files = files.unionByName(unreadable, allowMissingColumns=True)
    return files


def bad_files(files: DataFrame) -> DataFrame:
    """Files that ``inspect_files`` found unusable, with the reason."""
    return files.where("reason IS NOT NULL").select("label", "case_id", "reason")


def inspect_dataset(files: DataFrame) -> DataFrame:
    """Class counts and shares with the cohort means of the readable files; bad files still count."""
    per_class = files.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_scans"),
        F.count("reason").alias("n_bad"),
        F.sum("mean").alias("_sm"),
        F.sum("std").alias("_ss"),
        F.count("mean").alias("_n"),
    )
    everything = per_class.agg(
        F.struct(
            F.sum("n_scans").alias("n"),
            F.try_divide(F.sum("_sm"), F.sum("_n")).alias("mean"),
            F.try_divide(F.sum("_ss"), F.sum("_n")).alias("std"),
        ).alias("t")
    )
    return per_class.withColumn("_t", everything.scalar()).select(
        "label",
        "n_scans",
        "n_bad",
        F.coalesce(F.try_divide(F.col("n_scans") * 100.0, F.col("_t.n")), F.lit(0.0)).alias("pct"),
        F.col("_t.mean").alias("intensity_mean"),
        F.col("_t.std").alias("intensity_std"),
    )


def stats_cube(df: DataFrame, dimensions: Sequence[str], value: str = "value") -> DataFrame:
    """Moments at every combination of levels from one scan.

    Rows are reduced to the finest level first; the cube only expands that
    summary, not the data.
    """
    finest = moments(df, dimensions, value)
    cubed = finest.cube(*dimensions).agg(
        F.grouping_id().cast("int").alias("level"),
        *[F.sum(c).alias(c) for c in MOMENTS[:4]],
        F.min("mn").alias("mn"),
        F.max("mx").alias("mx"),
    )
    return finalise_moments(cubed, [*dimensions, "level"])


def first_order_features(bricks: DataFrame, keys: Sequence[str], bins: int = 16) -> DataFrame:
    """Mean, median, deviation, skewness, kurtosis and histogram entropy (nats) of bricks."""
    keys = list(keys)
    shape = materialise(volume_shape(brick_moments(bricks, keys), keys), "volume-shapes")
    middle = volume_percentiles(bricks, keys, [0.5])
    limited = join_summary(bricks, shape.select(*keys, "mn", "mx"), keys)
    counts = value_histogram(limited, keys, bins, "mn", "mx")
    entropy = counts.groupBy(*keys).agg(
        (F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("entropy")
    )
    median = middle.select(*keys, F.col("p0").alias("median"))
    return shape.drop("n", "mn", "mx").join(median, keys).join(entropy, keys)
