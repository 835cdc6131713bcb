"""Queries on segmentation labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelarium import bindings as b
from voxelarium.conventions import LABEL_NAMES, REGION_PRESETS
from voxelarium.operators import regions, stats
from voxelarium.operators.splits import label_leakage
from voxelarium.plans.registry import SEG, VOX, query, r, rounded

NAME_SQL = "CASE label " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in LABEL_NAMES.items()) + " END"
MAP_SQL = "map(region, label) AS (VALUES " + ", ".join(
    f"('{region}', {label})" for region, labels in REGION_PRESETS["eda"].items() for label in labels
) + ")"
VOLUMES_SQL = f"""{SEG}, {MAP_SQL}, cases AS (SELECT DISTINCT case_id FROM seg),
  hits AS (SELECT s.case_id, m.region, count(*) AS voxels FROM seg s JOIN map m ON s.label = m.label GROUP BY ALL),
  volumes AS (SELECT c.case_id, g.region, coalesce(h.voxels, 0) AS voxels, CAST(coalesce(h.voxels, 0) AS DOUBLE) AS mm3
    FROM cases c CROSS JOIN (SELECT DISTINCT region FROM map) g
    LEFT JOIN hits h ON h.case_id = c.case_id AND h.region = g.region)"""
LABELS_SQL = f"""{SEG}, counts AS (SELECT case_id, count(*) FILTER (label = 3) AS et,
    count(*) FILTER (label IN (2, 3)) AS tc, count(*) FILTER (label IN (1, 2, 3)) AS wt FROM seg GROUP BY case_id),
  derived AS (SELECT o.o_orderkey AS case_id, CAST(coalesce(et, 0) > 0 AS INTEGER) AS et,
    CAST(coalesce(tc, 0) > 0 AS INTEGER) AS tc, CAST(coalesce(wt, 0) > 0 AS INTEGER) AS wt,
    CAST(coalesce(wt, 0) AS DOUBLE) AS wt_volume, CAST(coalesce(tc, 0) AS DOUBLE) AS tc_volume,
    CAST(coalesce(et, 0) AS DOUBLE) AS et_volume, CAST(coalesce(et, 0) > 0 AS INTEGER) AS grade_proxy
    FROM orders o LEFT JOIN counts c ON c.case_id = o.o_orderkey)"""


@query(
    "label_volumes",
    f"""WITH {SEG} SELECT case_id, label, {NAME_SQL} AS name, count(*) AS voxels, CAST(count(*) AS DOUBLE) AS mm3
    FROM seg WHERE label > 0 GROUP BY case_id, label""",
)
def label_volumes(spark, sf_dir):
    return regions.label_volumes(b.seg(spark, sf_dir))


@query("region_volumes", f"WITH {VOLUMES_SQL} SELECT * FROM volumes")
def region_volumes(spark, sf_dir):
    return regions.region_volumes(b.seg(spark, sf_dir), REGION_PRESETS["eda"])


@query(
    "region_label_breakdown",
    f"""WITH {SEG}, {MAP_SQL} SELECT m.region, s.label, count(*) AS voxels, count(DISTINCT case_id) AS n_cases
    FROM seg s JOIN map m ON s.label = m.label GROUP BY ALL""",
)
def region_label_breakdown(spark, sf_dir):
    rows = regions.label_region_rows(regions.label_counts(b.seg(spark, sf_dir)), REGION_PRESETS["eda"])
    return rows.groupBy("region", "label").agg(
        F.sum("voxels").alias("voxels"), F.count(F.lit(1)).alias("n_cases")
    )


@query("derived_labels", f"WITH {LABELS_SQL} SELECT * FROM derived")
def derived_labels(spark, sf_dir):
    return regions.derive_labels(b.seg(spark, sf_dir), b.cases(spark, sf_dir))


SUMMARY_SQL = f"""count(*) AS n_cases, count(*) FILTER (mm3 > 0) AS n_positive, {r('sum(mm3)')} AS total_mm3,
  {r('avg(mm3)')} AS mean_all, {r('coalesce(avg(mm3) FILTER (mm3 > 0), 0)')} AS mean_positive"""


@query(
    "region_summary",
    f"""WITH {VOLUMES_SQL} SELECT region, {SUMMARY_SQL} FROM volumes GROUP BY region
    UNION ALL SELECT name AS region, {SUMMARY_SQL}
    FROM (SELECT case_id, {NAME_SQL} AS name, CAST(count(*) AS DOUBLE) AS mm3 FROM seg WHERE label > 0
      GROUP BY case_id, label) GROUP BY name""",
)
def region_summary(spark, sf_dir):
    seg = b.seg(spark, sf_dir)
    by_region = regions.region_summary(regions.region_volumes(seg, REGION_PRESETS["eda"]))
    by_label = regions.region_summary(regions.label_volumes(seg), "name").withColumnRenamed("name", "region")
    return rounded(by_region.unionByName(by_label))


@query(
    "presence_and_fraction",
    f"""WITH {SEG}, c AS (SELECT case_id, count(*) FILTER (label = 4) AS voxels, count(*) AS n FROM seg GROUP BY case_id)
    SELECT count(*) FILTER (voxels > 0) AS n_with, count(*) FILTER (voxels = 0) AS n_without,
      {r('100.0 * count(*) FILTER (voxels > 0) / count(*)')} AS with_pct,
      {r('avg(voxels) FILTER (voxels > 0)')} AS mean_voxels,
      {r('quantile_cont(voxels, 0.5) FILTER (voxels > 0)')} AS median_voxels, max(voxels) AS max_voxels,
      {r('avg(voxels::DOUBLE / n) FILTER (voxels > 0)')} AS mean_fraction,
      {r('max(voxels::DOUBLE / n)')} AS max_fraction FROM c""",
)
def presence_and_fraction(spark, sf_dir):
    return rounded(regions.presence_and_fraction(b.seg(spark, sf_dir)))


@query(
    "volume_histogram",
    f"""WITH {VOLUMES_SQL}, kept AS (SELECT region, mm3 FROM volumes WHERE mm3 > 0),
    lim AS (SELECT region, min(mm3) AS mn, (max(mm3) - min(mm3)) / 30 AS w FROM kept GROUP BY region),
    counted AS (SELECT k.region, CAST(coalesce(least(floor((k.mm3 - l.mn) / nullif(l.w, 0)), 29), 0) AS INTEGER) AS bin,
      count(*) AS n FROM kept k JOIN lim l ON k.region = l.region GROUP BY ALL)
    SELECT l.region, CAST(g.bin AS INTEGER) AS bin, {r('l.mn + g.bin * l.w')} AS lower,
      {r('l.mn + (g.bin + 1) * l.w')} AS upper, coalesce(c.n, 0) AS n
    FROM lim l CROSS JOIN (SELECT unnest(range(30)) AS bin) g
    LEFT JOIN counted c ON c.region = l.region AND c.bin = g.bin""",
)
def volume_histogram(spark, sf_dir):
    volumes = regions.region_volumes(b.seg(spark, sf_dir), REGION_PRESETS["eda"]).where("mm3 > 0")
    return rounded(stats.histogram(volumes, ["region"], 30, "mm3", cut=None))


@query(
    "top_cases_by_volume",
    f"""WITH {SEG} SELECT case_id, CAST(count(*) AS DOUBLE) AS mm3 FROM seg WHERE label = 4 GROUP BY case_id
    HAVING count(*) > 1 ORDER BY mm3 DESC, case_id LIMIT 5""",
)
def top_cases_by_volume(spark, sf_dir):
    volumes = regions.region_volumes(b.seg(spark, sf_dir), {"whole_tumor": [4]})
    return regions.top_k_by_volume(volumes, 5, 1.0).select("case_id", "mm3")


@query(
    "distinct_labels",
    f"WITH {SEG} SELECT label, count(*) AS voxels, count(DISTINCT case_id) AS n_cases FROM seg GROUP BY label",
)
def distinct_labels(spark, sf_dir):
    return regions.distinct_labels(b.seg(spark, sf_dir))


@query(
    "label_leakage_audit",
    f"""WITH {LABELS_SQL}, f AS (SELECT 'et_volume' AS feature, grade_proxy AS y, et_volume AS v FROM derived
      UNION ALL SELECT 'tc_volume', grade_proxy, tc_volume FROM derived
      UNION ALL SELECT 'wt_volume', grade_proxy, wt_volume FROM derived)
    SELECT feature, count(*) AS n, count(*) FILTER (CAST(v > 0 AS INTEGER) <> y) AS n_mismatch,
      min(v) FILTER (y = 0) AS min0, max(v) FILTER (y = 0) AS max0,
      min(v) FILTER (y = 1) AS min1, max(v) FILTER (y = 1) AS max1,
      count(*) FILTER (CAST(v > 0 AS INTEGER) <> y) = 0 AS leaks
    FROM f GROUP BY feature""",
)
def label_leakage_audit(spark, sf_dir):
    labels = regions.derive_labels(b.seg(spark, sf_dir), b.cases(spark, sf_dir))
    return label_leakage(labels, "grade_proxy", ["et_volume", "tc_volume", "wt_volume"])


@query(
    "region_dice",
    """WITH pairs AS (SELECT l_orderkey AS case_id, CAST(l_quantity AS INTEGER) % 5 AS a,
      CAST(round(l_extendedprice) AS BIGINT) % 5 AS b FROM lineitem),
    map(region, label) AS (VALUES ('et', 3), ('tc', 2), ('tc', 3), ('wt', 1), ('wt', 2), ('wt', 3)),
    c AS (SELECT p.case_id, g.region,
        count(*) FILTER (p.a IN (SELECT label FROM map m WHERE m.region = g.region)) AS n_a,
        count(*) FILTER (p.b IN (SELECT label FROM map m WHERE m.region = g.region)) AS n_b,
        count(*) FILTER (p.a IN (SELECT label FROM map m WHERE m.region = g.region)
          AND p.b IN (SELECT label FROM map m WHERE m.region = g.region)) AS n_both
      FROM pairs p CROSS JOIN (SELECT DISTINCT region FROM map) g GROUP BY ALL)
    SELECT case_id, region, n_a, n_b, n_both,
      round(coalesce(2.0::DOUBLE * n_both / nullif(n_a + n_b, 0), 1.0), 6) + 0.0 AS dice FROM c""",
)
def region_dice(spark, sf_dir):
    pairs = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        (F.col("l_quantity").cast("int") % 5).alias("a"),
        (F.round("l_extendedprice").cast("bigint") % 5).alias("b"),
    )
    return rounded(regions.dice(pairs, REGION_PRESETS["preproc"], ["case_id"]))


MASK_LABELS_SQL = """masks AS (SELECT case_id, string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) AS labels,
    CAST(count(*) AS INTEGER) AS n_labels FROM (SELECT DISTINCT case_id, label FROM seg) GROUP BY case_id)"""


@query("labels_per_mask", f"WITH {SEG}, {MASK_LABELS_SQL} SELECT * FROM masks")
def labels_per_mask(spark, sf_dir):
    return regions.labels_per_mask(b.seg(spark, sf_dir))


@query(
    "case_metadata",
    f"""WITH {VOX}, {LABELS_SQL}, {MASK_LABELS_SQL}, have AS (SELECT * FROM vox
      UNION ALL SELECT * REPLACE (-1 - case_id AS case_id) FROM vox WHERE modality <> 2),
    m AS (SELECT case_id, {", ".join(
        f"count(*) FILTER (modality = {i}) AS n_{i}, {r(f'coalesce(avg(value) FILTER (modality = {i}), 0)')} AS mean_{i}, "
        f"{r(f'coalesce(stddev_pop(value) FILTER (modality = {i}), 0)')} AS std_{i}" for i in range(4)
    )}, CASE WHEN case_id < 0 THEN '2' ELSE '' END AS missing FROM have GROUP BY case_id)
    SELECT m.*, coalesce(labels, '') AS labels, coalesce(n_labels, 0) AS n_labels,
      CASE WHEN labels IS NULL THEN -1 ELSE et_volume END AS et_volume, CASE WHEN labels IS NULL THEN -1 ELSE tc_volume END AS tc_volume,
      CASE WHEN labels IS NULL THEN -1 ELSE wt_volume END AS wt_volume
    FROM m LEFT JOIN masks USING (case_id) LEFT JOIN derived USING (case_id)""",
)
def case_metadata(spark, sf_dir):
    """All cases, and a copy of each under a negative id that lacks a modality; cases without a mask have -1 volumes."""
    vox = b.with_incomplete(b.vox(spark, sf_dir), 2)
    found = regions.case_metadata(vox, b.seg(spark, sf_dir), range(4))
    absent = {**{f"{k}_{i}": 0.0 for k in ("mean", "std") for i in range(4)}, "labels": "", "n_labels": 0}
    return rounded(found.fillna(absent).fillna(-1.0, ["et_volume", "tc_volume", "wt_volume"]))
