"""Queries on intensities: per case, per cohort, percentiles, histograms, correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelarium import bindings as b
from voxelarium.operators import stats
from voxelarium.operators import voxels as v
from voxelarium.plans.registry import SCAN, VOX, query, r, rounded
from voxelarium.storage import materialise

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
# The percentiles of the reports.
FRACTIONS = {
    "p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p995": 0.995,
}
PERCENTILES_SQL = ", ".join(
    f"{r(f'quantile_cont(value, {p}::DOUBLE)')} AS {k}" for k, p in FRACTIONS.items()
)
STATS_SQL = f"""min(value) AS min, max(value) AS max, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std,
  {r('100.0 * count(*) FILTER (value > 0) / count(*)')} AS positive_pct"""


@query(
    "cohort_intensity_stats",
    f"""WITH {SCAN} SELECT modality, count(DISTINCT case_id) AS n_cases, count(*) AS n, {STATS_SQL},
    {PERCENTILES_SQL} FROM scan GROUP BY modality""",
)
def cohort_intensity_stats(spark, sf_dir):
    return rounded(stats.cohort_intensity(b.scan(spark, sf_dir), FRACTIONS))


@query(
    "case_intensity_stats",
    f"""WITH {VOX} SELECT case_id, modality, count(*) AS n, {r('min(value)')} AS min, {r('max(value)')} AS max,
    {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std,
    {r('100.0 * count(*) FILTER (value > 0) / count(*)')} AS positive_pct,
    {r('100.0 * count(*) FILTER (value <> 0) / count(*)')} AS nonzero_pct
    FROM vox GROUP BY case_id, modality""",
)
def case_intensity_stats(spark, sf_dir):
    return rounded(stats.case_stats(b.vox(spark, sf_dir)))


@query(
    "merged_moments",
    f"""WITH {SCAN} SELECT modality, count(*) AS n, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std,
    min(value) AS min, max(value) AS max, {r('100.0 * count(*) FILTER (value > 0) / count(*)')} AS positive_pct
    FROM scan GROUP BY modality""",
)
def merged_moments(spark, sf_dir):
    per_day = stats.moments(b.scan(spark, sf_dir), ["modality", "day"])
    merged = stats.merge_moments(per_day, ["modality"])
    return rounded(stats.finalise_moments(merged, ["modality"]))


@query(
    "cohort_percentiles",
    f"WITH {SCAN} SELECT modality, {PERCENTILES_SQL} FROM scan GROUP BY modality",
)
def cohort_percentiles(spark, sf_dir):
    return rounded(stats.percentiles(b.scan(spark, sf_dir), ["modality"], FRACTIONS))


@query(
    "sampled_percentiles",
    f"""WITH {VOX}, chosen AS (SELECT DISTINCT case_id FROM vox ORDER BY case_id LIMIT 100)
    SELECT modality, {PERCENTILES_SQL} FROM vox WHERE case_id IN (SELECT case_id FROM chosen)
    AND x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0 GROUP BY modality""",
)
def sampled_percentiles(spark, sf_dir):
    return rounded(stats.sampled_percentiles(b.bricks(spark, sf_dir), 100, 2, FRACTIONS))


@query(
    "bracketed_percentiles",
    f"""WITH {SCAN}, hot AS (SELECT 'all' AS grp, CASE WHEN patient % 3 = 0 THEN 7.5::DOUBLE ELSE value END AS value FROM scan
      UNION ALL SELECT modality, value FROM scan)
    SELECT grp, {PERCENTILES_SQL} FROM hot GROUP BY grp""",
)
def bracketed_percentiles(spark, sf_dir):
    """Narrow brackets: an accuracy far below the group sizes, and a group with a third of its values equal."""
    scan = b.scan(spark, sf_dir)
    hot = F.when(F.col("patient") % 3 == 0, F.lit(7.5)).otherwise(F.col("value"))
    both = scan.select(F.lit("all").alias("grp"), hot.alias("value")).union(scan.select("modality", "value"))
    return rounded(stats.percentiles(both, ["grp"], FRACTIONS, accuracy=200))


@query(
    "intensity_histogram",
    f"""WITH {SCAN}, cut AS (SELECT modality, quantile_cont(value, 0.995::DOUBLE) AS q FROM scan GROUP BY modality),
    kept AS (SELECT s.modality, s.value FROM scan s JOIN cut c ON s.modality = c.modality WHERE s.value <= c.q),
    lim AS (SELECT modality, min(value) AS mn, (max(value) - min(value)) / 100 AS w FROM kept GROUP BY modality),
    counted AS (SELECT k.modality, CAST(least(floor((k.value - l.mn) / l.w), 99) AS INTEGER) AS bin, count(*) AS n
      FROM kept k JOIN lim l ON k.modality = l.modality GROUP BY ALL)
    SELECT l.modality, CAST(g.bin AS INTEGER) AS bin, {r('l.mn + g.bin * l.w')} AS lower,
      {r('l.mn + (g.bin + 1) * l.w')} AS upper, coalesce(c.n, 0) AS n
    FROM lim l CROSS JOIN (SELECT unnest(range(100)) AS bin) g
    LEFT JOIN counted c ON c.modality = l.modality AND c.bin = g.bin""",
)
def intensity_histogram(spark, sf_dir):
    return rounded(stats.histogram(b.scan(spark, sf_dir), ["modality"], 100))


@query(
    "case_mean_boxes",
    f"""WITH {SCAN}, m AS (SELECT modality, case_id, avg(value) AS m FROM scan GROUP BY ALL),
    q AS (SELECT modality, quantile_cont(m, 0.25::DOUBLE) AS q1, quantile_cont(m, 0.5::DOUBLE) AS median,
      quantile_cont(m, 0.75::DOUBLE) AS q3 FROM m GROUP BY modality),
    j AS (SELECT m.*, q1, median, q3, m.m >= q1 - 1.5 * (q3 - q1) AND m.m <= q3 + 1.5 * (q3 - q1) AS inside
      FROM m JOIN q ON m.modality = q.modality)
    SELECT modality, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3,
      {r('min(m) FILTER (inside)')} AS whisker_low, {r('max(m) FILTER (inside)')} AS whisker_high,
      count(*) FILTER (NOT inside) AS n_outliers, count(*) AS n_cases
    FROM j GROUP BY modality, j.q1, j.median, j.q3""",
)
def case_mean_boxes(spark, sf_dir):
    return rounded(stats.box_summary(b.scan(spark, sf_dir)))


MEANS_SQL = f"""{SCAN}, means AS (SELECT case_id, modality, avg(value) AS m FROM scan GROUP BY ALL),
  complete AS (SELECT case_id FROM means GROUP BY case_id HAVING count(*) = 5),
  full_means AS (SELECT * FROM means WHERE case_id IN (SELECT case_id FROM complete))"""


@query(
    "modality_correlations",
    f"""WITH {MEANS_SQL} SELECT a.modality AS a, b.modality AS b, {r('corr(a.m, b.m)')} AS r
    FROM full_means a JOIN full_means b ON a.case_id = b.case_id GROUP BY a.modality, b.modality""",
)
def modality_correlations(spark, sf_dir):
    return rounded(stats.correlation_matrix(b.scan(spark, sf_dir), EVENT_TYPES))


@query(
    "pairwise_case_means",
    f"""WITH {MEANS_SQL} SELECT a.case_id, a.modality AS a, b.modality AS b, {r('a.m')} AS x, {r('b.m')} AS y
    FROM full_means a JOIN full_means b ON a.case_id = b.case_id AND a.modality < b.modality""",
)
def pairwise_case_means(spark, sf_dir):
    return rounded(stats.pairwise_points(b.scan(spark, sf_dir), EVENT_TYPES))


@query(
    "dataset_inspection",
    f"""WITH {VOX}, zeroed AS (SELECT v.case_id, e.label, CASE WHEN e.label = 0 THEN 0.0 ELSE v.value END AS value
      FROM vox v JOIN embeddings e ON e.vec_id = v.case_id),
    files AS (SELECT label, case_id, avg(value) FILTER (value <> 0) AS mean,
      stddev_pop(value) FILTER (value <> 0) AS std FROM zeroed GROUP BY ALL),
    total AS (SELECT count(*) AS n, avg(mean) AS mean, avg(std) AS std FROM files)
    SELECT f.label, count(*) AS n_scans, count(*) FILTER (f.mean IS NULL) AS n_bad,
      {r('100.0 * count(*) / any_value(t.n)')} AS pct, {r('any_value(t.mean)')} AS intensity_mean,
      {r('any_value(t.std)')} AS intensity_std
    FROM files f CROSS JOIN total t GROUP BY f.label""",
)
def dataset_inspection(spark, sf_dir):
    classes = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("case_id"), "label")
    vox = v.explode_bricks(b.bricks(spark, sf_dir).join(classes, "case_id"), "label")
    zeroed = vox.withColumn("value", F.when(F.col("label") == 0, 0.0).otherwise(F.col("value")))
    return rounded(stats.inspect_dataset(stats.inspect_files(zeroed)))


@query(
    "bad_files",
    f"""SELECT label, vec_id AS case_id, 'all-zero volume' AS reason FROM embeddings WHERE label = 0 AND vec_id % 5 <> 0
    UNION ALL SELECT label, vec_id, 'unreadable' FROM embeddings WHERE vec_id % 5 = 0""",
)
def bad_files(spark, sf_dir):
    """Volumes of zeros and files that did not decode."""
    classes = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("case_id"), "label")
    vox = v.explode_bricks(b.bricks(spark, sf_dir).join(classes.where("case_id % 5 <> 0"), "case_id"), "label")
    zeroed = vox.withColumn("value", F.when(F.col("label") == 0, 0.0).otherwise(F.col("value")))
    failed = classes.where("case_id % 5 = 0").withColumn("reason", F.lit("unreadable"))
    return stats.bad_files(stats.inspect_files(zeroed, failed))


@query(
    "stats_cube",
    f"""WITH {SCAN} SELECT coalesce(modality, 'all') AS modality, coalesce(patient, -1) AS patient,
      CAST(GROUPING(modality) * 2 + GROUPING(patient) AS INTEGER) AS level, count(*) AS n,
      {r('avg(value)', 8)} AS mean, {r('stddev_pop(value)', 5)} AS std, min(value) AS min, max(value) AS max,
      {r('100.0 * count(*) FILTER (value > 0) / count(*)', 8)} AS positive_pct
    FROM scan GROUP BY CUBE (modality, patient)""",
)
def stats_cube(spark, sf_dir):
    cube = stats.stats_cube(b.scan(spark, sf_dir), ["modality", "patient"])
    named = cube.withColumns(
        {"modality": F.coalesce("modality", F.lit("all")), "patient": F.coalesce("patient", F.lit(-1).cast("bigint"))}
    )
    return rounded(named.withColumn("std", F.round("std", 5)), 8)


@query(
    "first_order_features",
    f"""WITH {VOX}, m AS (SELECT case_id, modality, avg(value) AS mean, stddev_pop(value) AS std,
      quantile_cont(value, 0.5::DOUBLE) AS median, min(value) AS mn, (max(value) - min(value)) / 16 AS w,
      avg(value * value) AS m2, avg(value * value * value) AS m3, avg(value * value * value * value) AS m4
      FROM vox GROUP BY ALL),
    bins AS (SELECT v.case_id, v.modality, least(floor((v.value - m.mn) / m.w), 15) AS bin, count(*) AS n
      FROM vox v JOIN m ON v.case_id = m.case_id AND v.modality = m.modality GROUP BY ALL),
    e AS (SELECT case_id, modality, -sum((n / 16.0::DOUBLE) * ln(n / 16.0::DOUBLE)) AS entropy FROM bins GROUP BY ALL)
    SELECT m.case_id, m.modality, {r('mean')} AS mean, {r('std')} AS std, {r('median')} AS median,
      {r('(m3 - 3 * mean * m2 + 2 * mean * mean * mean) / (std * std * std)')} AS skewness,
      {r('(m4 - 4 * mean * m3 + 6 * mean * mean * m2 - 3 * mean * mean * mean * mean) / (std * std * std * std) - 3')}
        AS kurtosis,
      {r('entropy')} AS entropy
    FROM m JOIN e ON m.case_id = e.case_id AND m.modality = e.modality""",
)
def first_order_features(spark, sf_dir):
    return rounded(stats.first_order_features(b.bricks(spark, sf_dir), ["case_id", "modality"]))


@query(
    "ct_window",
    f"""SELECT event_id, {r('(greatest(least(value * 10 - 300, 300), -100) + 100) / 400')} AS windowed FROM events""",
)
def ct_window(spark, sf_dir):
    from voxelarium.functions.scalars import hu_window

    events = b.table(spark, sf_dir, "events")
    return rounded(events.select("event_id", hu_window(F.col("value") * 10 - 300).alias("windowed")))


@query(
    "merged_sketch_percentiles",
    f"""WITH {VOX} SELECT modality, count(*) AS n, name, fraction, TRUE AS within_bound
    FROM vox CROSS JOIN (VALUES ('p01', 0.01::DOUBLE), ('p50', 0.5::DOUBLE), ('p99', 0.99::DOUBLE)) f(name, fraction) GROUP BY ALL""",
)
def merged_sketch_percentiles(spark, sf_dir):
    """Sketches per case and modality, written, merged per modality: every rank is within one percent of the wanted one."""
    vox = b.vox(spark, sf_dir)
    sketches = materialise(stats.value_sketches(vox, ["case_id", "modality"]), "value-sketches")
    merged = stats.merged_sketches(sketches, ["modality"])
    estimates = stats.sketch_percentiles(merged, ["modality"], {"p01": 0.01, "p50": 0.5, "p99": 0.99})
    checked = stats.rank_errors(vox, estimates, ["modality"])
    return checked.select("modality", "n", "name", "fraction", (F.col("rank_error") <= 0.01).alias("within_bound"))
