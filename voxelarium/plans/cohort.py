"""Queries on cohort tables: names, completeness, resume, dedup, files, sinks."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from voxelarium import bindings as b
from voxelarium.conventions import MODALITY_NAMES, REGION_PRESETS
from voxelarium.functions import ids, scalars
from voxelarium.operators import cohort, regions, scoring, stats
from voxelarium.operators import voxels as v
from voxelarium.plans.intensity import EVENT_TYPES
from voxelarium.plans.regions import LABELS_SQL
from voxelarium.plans.registry import LAB, SCAN, SEG, VOX, VOX64, query, r, rounded
from voxelarium.plans.voxels import CTN_SQL
from voxelarium.sinks import tables as sinks
from voxelarium.sources import inventory, tables, volumes
from voxelarium.storage import materialise, new_folder

# Which file code each event type plays; the unknown code must be dropped.
CODES = {"click": "t1c", "error": "seg", "purchase": "t1n", "signup": "2w", "view": "t2f"}
CODE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in CODES.items()) + " ELSE 'other' END"
NAME_SQL = """CASE WHEN o_orderpriority = '5-LOW' THEN concat('scan_', o_orderkey)
  ELSE concat('BraTS-GLI-', lpad(CAST(o_custkey AS VARCHAR), 5, '0'), '-',
    lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')) END"""


@query(
    "parsed_case_ids",
    f"""SELECT o_orderkey AS row_id, {NAME_SQL} AS name,
      CASE WHEN o_orderpriority = '5-LOW' THEN '?' ELSE lpad(CAST(o_custkey AS VARCHAR), 5, '0') END AS patient,
      CASE WHEN o_orderpriority = '5-LOW' THEN '?' ELSE lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') END AS sequence
    FROM orders""",
)
def parsed_case_ids(spark, sf_dir):
    names = b.case_names(spark, sf_dir)
    return names.withColumns(
        {"patient": ids.patient_of(F.col("name")), "sequence": ids.sequence_of(F.col("name"))}
    )


def _scan_names(spark, sf_dir):
    code = F.lit("other")
    for event_type, c in CODES.items():
        code = F.when(F.col("event_type") == event_type, F.lit(c)).otherwise(code)
    parts = [F.lit("case-"), F.col("user_id").cast("string"), F.lit("-"), code, F.lit(".nii.gz")]
    return b.table(spark, sf_dir, "events").select("user_id", "value", F.concat(*parts).alias("name"))


@query(
    "modality_codes",
    f"SELECT {CODE_SQL} AS modality, count(*) AS n, count(DISTINCT user_id) AS n_cases FROM events GROUP BY ALL",
)
def modality_codes(spark, sf_dir):
    named = _scan_names(spark, sf_dir).withColumn("modality", ids.modality_of(F.col("name")))
    return named.groupBy("modality").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_cases")
    )


@query(
    "kept_modalities",
    f"""WITH c AS (SELECT {CODE_SQL} AS modality, value FROM events)
    SELECT modality, CASE modality WHEN 't1c' THEN 'T1ce' WHEN 't1n' THEN 'T1n' WHEN 't2f' THEN 'FLAIR' ELSE 'T2w' END AS display,
      count(*) AS n, {r('avg(value)')} AS mean FROM c WHERE modality IN ('t1c', 't1n', 't2f', '2w', 't2w') GROUP BY ALL""",
)
def kept_modalities(spark, sf_dir):
    named = _scan_names(spark, sf_dir).withColumn("modality", ids.modality_of(F.col("name")))
    kept = cohort.display_modalities(named, MODALITY_NAMES)
    return rounded(
        kept.groupBy("modality", "display").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    )


@query(
    "cohort_overview",
    f"""WITH {SCAN} SELECT count(DISTINCT patient) AS n_patients, count(DISTINCT case_id) AS n_cases,
      count(DISTINCT day) AS n_days, count(*) AS n_rows FROM scan""",
)
def cohort_overview(spark, sf_dir):
    return cohort.cohort_overview(
        b.scan(spark, sf_dir), {"n_patients": "patient", "n_cases": "case_id", "n_days": "day"}
    )


@query(
    "approximate_overview",
    f"""WITH {SCAN} SELECT modality, count(*) AS n_rows, TRUE AS patients_close, TRUE AS cases_close, TRUE AS days_close
    FROM scan GROUP BY modality""",
)
def approximate_overview(spark, sf_dir):
    """Sketches of each week, written, merged per modality and held against the exact counts: all within 2.5 percent."""
    columns = {"patients": "patient", "cases": "case_id", "days": "day"}
    scans = b.scan(spark, sf_dir).withColumn("week", F.date_trunc("week", "day"))
    sketches = materialise(cohort.distinct_sketches(scans, ["modality", "week"], columns), "distinct-sketches")
    estimates = cohort.approximate_overview(sketches, list(columns), ["modality"])
    exact = scans.groupBy("modality").agg(*[F.count_distinct(c).alias(f"n_{name}") for name, c in columns.items()])
    close = [(F.abs(F.col(name) - F.col(f"n_{name}")) <= F.greatest(0.025 * F.col(f"n_{name}"), F.lit(1.0))).alias(f"{name}_close") for name in columns]
    return estimates.join(exact, "modality").select("modality", "n_rows", *close)


@query(
    "class_balance",
    f"WITH {LAB} SELECT grade, count(*) AS n, {r('100.0 * count(*) / (SELECT count(*) FROM lab)')} AS pct FROM lab GROUP BY grade",
)
def class_balance(spark, sf_dir):
    return rounded(cohort.class_balance(b.lab(spark, sf_dir), "grade"))


@query(
    "region_presence_balance",
    f"""WITH {LABELS_SQL}, f AS (SELECT 'et' AS region, et AS f FROM derived UNION ALL SELECT 'tc', tc FROM derived
      UNION ALL SELECT 'wt', wt FROM derived)
    SELECT region, sum(f)::BIGINT AS n_present, {r('100.0 * sum(f) / count(*)')} AS pct FROM f GROUP BY region""",
)
def region_presence_balance(spark, sf_dir):
    labels = regions.derive_labels(b.seg(spark, sf_dir), b.cases(spark, sf_dir))
    return rounded(cohort.presence_balance(labels, ["et", "tc", "wt"]))


@query(
    "complete_cases",
    f"WITH {SCAN} SELECT case_id FROM scan GROUP BY case_id HAVING count(DISTINCT modality) = 5",
)
def complete_cases(spark, sf_dir):
    return cohort.complete_cases(b.scan(spark, sf_dir), EVENT_TYPES)


@query(
    "missing_modalities",
    f"""WITH {SCAN}, g AS (SELECT c.case_id, m.modality FROM (SELECT DISTINCT case_id FROM scan) c
      CROSS JOIN (SELECT DISTINCT modality FROM scan) m)
    SELECT case_id, modality, 'missing' AS status FROM g
    WHERE NOT EXISTS (SELECT 1 FROM scan s WHERE s.case_id = g.case_id AND s.modality = g.modality)""",
)
def missing_modalities(spark, sf_dir):
    return cohort.missing_modalities(b.scan(spark, sf_dir), EVENT_TYPES)


@query(
    "labels_with_volumes",
    f"""WITH {LAB}, {VOX}, s AS (SELECT case_id, count(*) AS n, avg(value) AS mean FROM vox GROUP BY case_id)
    SELECT l.case_id, grade, coalesce(n, 0) AS n, {r('coalesce(mean, 0)')} AS mean,
      CASE WHEN n IS NULL THEN 'missing' ELSE 'ok' END AS status FROM lab l LEFT JOIN s ON s.case_id = l.case_id""",
)
def labels_with_volumes(spark, sf_dir):
    volumes_of = b.vox(spark, sf_dir).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")
    )
    joined = cohort.labels_with_volumes(b.lab(spark, sf_dir).select("case_id", "grade"), volumes_of)
    return rounded(joined.fillna(0, ["n", "mean"]))


OUTPUTS_SQL = "outputs AS (SELECT l_orderkey AS case_id, sum(l_quantity) AS size FROM lineitem GROUP BY l_orderkey)"


def _outputs(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.sum("l_quantity").alias("size"))


@query(
    "output_status",
    f"""WITH {OUTPUTS_SQL} SELECT CASE WHEN size IS NULL THEN 'missing' WHEN size < 60 THEN 'corrupted' ELSE 'valid' END AS status,
      count(*) AS n FROM orders o LEFT JOIN outputs p ON p.case_id = o.o_orderkey GROUP BY ALL""",
)
def output_status(spark, sf_dir):
    status = cohort.output_status(b.cases(spark, sf_dir), _outputs(spark, sf_dir), 60)
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pending_cases",
    f"""WITH {OUTPUTS_SQL} SELECT o_orderkey AS case_id, o_custkey AS patient FROM orders
    WHERE o_orderkey NOT IN (SELECT case_id FROM outputs WHERE size >= 60)""",
)
def pending_cases(spark, sf_dir):
    return cohort.pending_cases(b.cases(spark, sf_dir), _outputs(spark, sf_dir), 60)


@query(
    "remaining_case_ids",
    "SELECT o_orderkey AS case_id FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'",
)
def remaining_case_ids(spark, sf_dir):
    done = b.table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'")
    return cohort.case_difference(b.cases(spark, sf_dir), done.select(F.col("l_orderkey").alias("case_id")))


@query(
    "backfilled_labels",
    f"""WITH {LABELS_SQL} SELECT d.* FROM derived d WHERE case_id IN (SELECT case_id FROM seg)
      AND case_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""",
)
def backfilled_labels(spark, sf_dir):
    seg = b.seg(spark, sf_dir)
    orders = b.table(spark, sf_dir, "orders")
    outputs = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("case_id"))
    kept = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("case_id"))
    labels = regions.derive_labels(seg, kept)
    return cohort.backfill_labels(labels, outputs, seg)


@query(
    "deduplicated_labels",
    """WITH copies AS (SELECT doc_id AS case_id, quality AS grade, 0 AS batch FROM labels
      UNION ALL SELECT doc_id, 1 - quality, 1 FROM labels UNION ALL SELECT doc_id % 10, toxic, 2 + doc_id FROM labels),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY batch, grade) AS rn FROM copies)
    SELECT case_id, grade, batch FROM ranked WHERE rn = 1""",
)
def deduplicated_labels(spark, sf_dir):
    labels = b.table(spark, sf_dir, "labels")
    first = labels.select(F.col("doc_id").alias("case_id"), F.col("quality").alias("grade"), F.lit(0).cast("bigint").alias("batch"))
    again = labels.select("doc_id", (1 - F.col("quality")), F.lit(1).cast("bigint"))
    hot = labels.select(F.col("doc_id") % 10, "toxic", F.col("doc_id") + 2)
    return cohort.dedup_keep_first(first.union(again).union(hot), ["case_id"], ["batch"])


@query(
    "first_cases",
    f"""WITH {VOX}, c AS (SELECT DISTINCT case_id FROM vox ORDER BY case_id LIMIT 200)
    SELECT case_id, modality, {r('avg(value)')} AS mean FROM vox WHERE case_id IN (SELECT case_id FROM c) GROUP BY ALL""",
)
def first_cases(spark, sf_dir):
    chosen = v.explode_bricks(stats.first_cases(b.bricks(spark, sf_dir), 200))
    return rounded(chosen.groupBy("case_id", "modality").agg(F.avg("value").alias("mean")))


@query(
    "features_by_ordinal",
    f"""WITH {LAB}, placed AS (SELECT *, concat('case-', case_id) AS name,
      row_number() OVER (ORDER BY concat('case-', case_id)) - 1 AS ordinal FROM lab)
    SELECT n.n_nationkey::BIGINT * 7 AS ordinal, name AS case_id, {r('ln(1 + et_volume) / 12')} AS et_log,
      {r('ln(1 + wt_volume) / 12')} AS wt_log FROM nation n JOIN placed p ON p.ordinal = n.n_nationkey * 7""",
)
def features_by_ordinal(spark, sf_dir):
    wanted = b.table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("bigint") * 7).alias("ordinal"))
    named = b.lab(spark, sf_dir).withColumn("case_id", F.concat(F.lit("case-"), F.col("case_id").cast("string")))
    found = cohort.lookup_by_ordinal(named, wanted)
    return rounded(scoring.scalar_features(found).select("ordinal", "case_id", "et_log", "wt_log"))


@query(
    "features_by_id",
    f"""WITH {LAB} SELECT o_orderkey AS order_id, case_id, {r('ln(1 + wt_volume) / 12')} AS wt_log
    FROM orders JOIN lab ON case_id = o_custkey""",
)
def features_by_id(spark, sf_dir):
    wanted = b.cases(spark, sf_dir).select(F.col("case_id").alias("order_id"), F.col("patient").alias("case_id"))
    found = cohort.lookup_by_id(b.lab(spark, sf_dir), wanted)
    return rounded(scoring.scalar_features(found).select("order_id", "case_id", "wt_log"))


# Files ---------------------------------------------------------------------


def _class_files(spark, sf_dir):
    """One text file per class of ``labels``, a line with the id of each row."""
    path = new_folder(spark, "classes")
    rows = b.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string"), F.col("quality").alias("class"))
    rows.repartition("class").write.partitionBy("class").text(path)
    return inventory.scan_inventory(spark, path, "*.txt").withColumn("root", F.regexp_extract("path", r"class=(\d+)/", 1))


CLASS_FILES_SQL = """files AS (SELECT CAST(quality AS VARCHAR) AS root,
      CAST(sum(length(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) AS bytes FROM labels GROUP BY quality)"""


@query("scan_inventory", f"WITH {CLASS_FILES_SQL} SELECT root, '.txt' AS suffix, bytes AS length FROM files")
def scan_inventory(spark, sf_dir):
    return _class_files(spark, sf_dir).select("root", F.right("name", F.lit(4)).alias("suffix"), "length")


@query(
    "inventory_summary",
    f"""WITH {CLASS_FILES_SQL} SELECT root, 1::BIGINT AS n_files, bytes, 'ok' AS status FROM files
    UNION ALL SELECT 'bare', 0, 0, 'empty' UNION ALL SELECT 'gone', 0, 0, 'missing'""",
)
def inventory_summary(spark, sf_dir):
    files = _class_files(spark, sf_dir).select("root", "length")
    bare = spark.range(1).select(F.lit("bare").alias("root"), F.lit(None).cast("bigint").alias("length"))
    gone = spark.range(1).select(F.lit("gone").alias("root"))
    expected = files.select("root").unionByName(bare.select("root")).unionByName(gone)
    return inventory.inventory_summary(expected, files.unionByName(bare))


@query(
    "class_folders",
    """SELECT p.path, p.split, CAST(p.quality AS INTEGER) AS label FROM (
      SELECT concat('/cohort/', CASE doc_id % 4 WHEN 0 THEN 'val' WHEN 1 THEN 'test' WHEN 2 THEN 'extra' ELSE 'train' END,
        '/', quality, '/', doc_id, CASE WHEN toxic = 1 THEN '.txt' ELSE '.nii.gz' END) AS path,
        CASE doc_id % 4 WHEN 0 THEN 'val' WHEN 1 THEN 'test' WHEN 2 THEN 'extra' ELSE 'train' END AS split, quality, toxic
      FROM labels) p WHERE split <> 'extra' AND toxic = 0""",
)
def class_folders(spark, sf_dir):
    m = F.col("doc_id") % 4
    split = F.when(m == 0, "val").when(m == 1, "test").when(m == 2, "extra").otherwise("train")
    end = F.when(F.col("toxic") == 1, ".txt").otherwise(".nii.gz")
    path = F.concat(F.lit("/cohort/"), split, F.lit("/"), F.col("quality").cast("string"), F.lit("/"),
                    F.col("doc_id").cast("string"), end)
    return inventory.scan_class_folders(b.table(spark, sf_dir, "labels").select(path.alias("path")))


@query(
    "located_files",
    """SELECT o_orderkey AS case_id, concat('/raw/', o_orderkey, '/', o_orderkey, '-t1n.nii.gz') AS path,
      CASE WHEN o_orderstatus = 'O' THEN concat('/raw/', o_orderkey, '/', o_orderkey, '-t1n.nii.gz')
        WHEN o_orderstatus = 'F' THEN concat('/moved/a/', o_orderkey, '-t1n.nii.gz') END AS located,
      CASE WHEN o_orderstatus = 'O' THEN 'ok' WHEN o_orderstatus = 'F' THEN 'moved' ELSE 'missing' END AS status FROM orders""",
)
def located_files(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    name = F.concat(key, F.lit("-t1n.nii.gz"))
    expected = orders.select(
        F.col("o_orderkey").alias("case_id"), F.concat(F.lit("/raw/"), key, F.lit("/"), name).alias("path")
    )
    at_home = orders.where("o_orderstatus = 'O'").select(F.concat(F.lit("/raw/"), key, F.lit("/"), name).alias("path"))
    moved = orders.where("o_orderstatus = 'F'").select(
        F.explode(F.array(F.concat(F.lit("/moved/b/"), name), F.concat(F.lit("/moved/a/"), name))).alias("path")
    )
    return inventory.locate_with_fallback(expected, at_home.union(moved))


@query(
    "decoded_scans",
    f"""WITH {VOX} SELECT concat('/scans/', case_id, '.nii.gz') AS path, modality AS channel, CAST(x // 3 AS INTEGER) AS bx,
      count(*) AS n, {r('sum(value)')} AS total, {r('max(value)')} AS highest FROM vox GROUP BY ALL""",
)
def decoded_scans(spark, sf_dir):
    name = F.concat(F.lit("/scans/"), F.col("vec_id").cast("string"), F.lit(".nii.gz"))
    files = volumes.encode_files(b.table(spark, sf_dir, "embeddings"), name, "embedding", (4, 4, 2, 2))
    decoded = volumes.decode_volumes(files, volumes.read_nifti, (3, 3, 3)).where("status = 'ok'")
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rounded(
        decoded.select(
            "path", "channel", "bx", F.size("values").cast("bigint").alias("n"), total.alias("total"),
            F.array_max("values").cast("double").alias("highest"),
        )
    )


@query(
    "array_files",
    f"""WITH {VOX}, s AS (SELECT case_id, count(*) AS n, sum(value) AS total FROM vox GROUP BY case_id)
    SELECT concat('/arrays/', vec_id, '.npy') AS path, CASE WHEN label = 0 THEN 'error' ELSE 'ok' END AS status,
      CASE WHEN label = 0 THEN 0 ELSE n END AS n, {r('CASE WHEN label = 0 THEN 0 ELSE total END')} AS total
    FROM embeddings JOIN s ON case_id = vec_id""",
)
def array_files(spark, sf_dir):
    name = F.concat(F.lit("/arrays/"), F.col("vec_id").cast("string"), F.lit(".npy"))
    vectors = b.table(spark, sf_dir, "embeddings")
    whole = volumes.encode_files(vectors.where("label <> 0"), name, "embedding", (4, 4, 2, 2), volumes.write_npy)
    broken = volumes.encode_files(vectors.where("label = 0"), name, "embedding", (4, 4, 2, 2), volumes.write_npy)
    cut = broken.withColumn("content", F.expr("substring(content, 1, length(content) - 16)"))
    bricks = volumes.decode_volumes(whole.union(cut), volumes.read_npy((4, 4, 2, 2)), (4, 4, 4))
    part = F.coalesce(F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double")), F.lit(0.0))
    return rounded(
        bricks.groupBy("path", "status").agg(
            F.sum(F.when(F.col("status") == "ok", F.size("values")).otherwise(0)).alias("n"), F.sum(part).alias("total")
        )
    )


MASK_SQL = f"""{VOX64}, mask AS (SELECT case_id, x, y, z, CASE WHEN value > 0.1 THEN 3 WHEN value > 0 THEN 1 ELSE 0 END AS label
      FROM vox64)"""


def _scan_files(spark, sf_dir, suffix):
    name = F.concat(F.lit("/scans/case"), F.col("vec_id").cast("string"), suffix)
    return b.table(spark, sf_dir, "embeddings").withColumn("name", name)


@query(
    "decoded_segmentations",
    f"WITH {MASK_SQL} SELECT concat('case', case_id) AS case_id, label, count(*) AS voxels FROM mask WHERE label > 0 GROUP BY ALL",
)
def decoded_segmentations(spark, sf_dir):
    """From mask files to voxels per label."""
    label = F.transform(
        "embedding", lambda x: F.when(x.cast("double") > 0.1, 3.0).when(x.cast("double") > 0, 1.0).otherwise(0.0).cast("float")
    )
    vectors = _scan_files(spark, sf_dir, F.lit("-seg.nii.gz")).withColumn("mask", label)
    decoded = volumes.decode_volumes(volumes.encode_files(vectors, F.col("name"), "mask", (4, 4, 4)), size=(3, 3, 3))
    return volumes.segmentation_counts(decoded).where("label > 0")


FEW_SQL = f"""{VOX64}, seg AS (SELECT concat('case', case_id) AS case_id,
      CASE WHEN value > 0.3 THEN 4 WHEN value > 0.28 THEN 2 WHEN value > 0.26 THEN 1 ELSE 0 END AS label FROM vox64)"""


def _few_masks(spark, sf_dir):
    """Mask files with few labelled voxels, many of them without a tumour, counted per case and label."""
    label = F.transform(
        "embedding",
        lambda x: F.when(x.cast("double") > 0.3, 4).when(x.cast("double") > 0.28, 2).when(x.cast("double") > 0.26, 1).otherwise(0).cast("float"),
    )
    vectors = _scan_files(spark, sf_dir, F.lit("-seg.nii.gz")).withColumn("mask", label)
    decoded = volumes.decode_volumes(volumes.encode_files(vectors, F.col("name"), "mask", (4, 4, 4)), size=(3, 3, 3))
    return volumes.segmentation_counts(decoded)


@query(
    "decoded_mask_volumes",
    f"""WITH {FEW_SQL}, map(region, label) AS (VALUES {", ".join(f"('{region}', {k})" for region, ks in REGION_PRESETS["eda"].items() for k in ks)})
    SELECT s.case_id, g.region, count(*) FILTER (s.label IN (SELECT label FROM map m WHERE m.region = g.region)) AS voxels,
      CAST(count(*) FILTER (s.label IN (SELECT label FROM map m WHERE m.region = g.region)) AS DOUBLE) AS mm3
    FROM seg s CROSS JOIN (SELECT DISTINCT region FROM map) g GROUP BY ALL""",
)
def decoded_mask_volumes(spark, sf_dir):
    """From mask files to the volume of every region, zero for masks without it."""
    return regions.region_volumes(_few_masks(spark, sf_dir), REGION_PRESETS["eda"])


@query(
    "decoded_mask_presence",
    f"""WITH {FEW_SQL}, c AS (SELECT case_id, count(*) FILTER (label = 4) AS voxels, count(*) AS n FROM seg GROUP BY case_id)
    SELECT count(*) FILTER (voxels > 0) AS n_with, count(*) FILTER (voxels = 0) AS n_without,
      {r('100.0 * count(*) FILTER (voxels > 0) / count(*)')} AS with_pct,
      {r('avg(voxels) FILTER (voxels > 0)')} AS mean_voxels,
      {r('quantile_cont(voxels, 0.5) FILTER (voxels > 0)')} AS median_voxels, CAST(max(voxels) AS BIGINT) AS max_voxels,
      {r('avg(voxels::DOUBLE / n) FILTER (voxels > 0)')} AS mean_fraction,
      {r('max(voxels::DOUBLE / n)')} AS max_fraction FROM c""",
)
def decoded_mask_presence(spark, sf_dir):
    """Cases with and without the target and its share of the whole mask, from files."""
    return rounded(regions.presence_and_fraction(_few_masks(spark, sf_dir)))


STACK = ["t1c", "t1n", "t2f", "t2w"]


@query(
    "stacked_array_bricks",
    f"""WITH {VOX} SELECT concat('case', case_id) AS case_id, ['t1c', 't1n', 't2f', 't2w'][modality + 1] AS modality,
      count(*) AS n, {r('sum(value)')} AS total FROM vox GROUP BY ALL""",
)
def stacked_array_bricks(spark, sf_dir):
    """From arrays with all modalities to bricks with their keys."""
    vectors = _scan_files(spark, sf_dir, F.lit(".npy"))
    files = volumes.encode_files(vectors, F.col("name"), "embedding", (4, 4, 2, 2), volumes.write_npy)
    decoded = volumes.decode_volumes(files, volumes.read_npy((4, 4, 2, 2)), (3, 3, 3))
    cells = v.explode_bricks(volumes.stacked_bricks(decoded, STACK))
    return rounded(cells.groupBy("case_id", "modality").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


FILE_KIND_SQL = """CASE label % 4 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'unnamed' WHEN 2 THEN 'several channels' END"""


@query(
    "undecodable_arrays",
    """SELECT concat('/scans/case', vec_id, '.npy') AS path,
      CASE WHEN label = 0 THEN 'unreadable' ELSE '2 channels, expected 4' END AS problem FROM embeddings WHERE label < 3""",
)
def undecodable_arrays(spark, sf_dir):
    """Arrays cut short and arrays of another number of channels, by name; whole ones are not listed."""
    import io

    import numpy as np

    vectors = _scan_files(spark, sf_dir, F.lit(".npy"))
    pair = volumes.encode_files(vectors.where("label in (1, 2)"), F.col("name"), "embedding", (2, 8, 2, 2), volumes.write_npy)
    four = volumes.encode_files(vectors.where("label not in (1, 2)"), F.col("name"), "embedding", (4, 4, 2, 2), volumes.write_npy)
    label = vectors.select(F.col("name").alias("path"), "label")
    short = F.when(F.col("label") == 0, F.expr("substring(content, 1, length(content) - 16)")).otherwise(F.col("content"))
    files = pair.union(four).join(label, "path").select("path", short.alias("content"))
    decoded = volumes.decode_volumes(files, lambda content: np.load(io.BytesIO(content), allow_pickle=False), (4, 4, 4))
    return volumes.undecodable_arrays(decoded, STACK).select("path", "problem")


@query(
    "undecodable_files",
    f"""WITH f AS (SELECT vec_id, label, {FILE_KIND_SQL} AS problem FROM embeddings)
    SELECT concat('/scans/case', vec_id, CASE label % 4 WHEN 1 THEN '.nii' ELSE '-t1n.nii.gz' END) AS path, problem
    FROM f WHERE problem IS NOT NULL""",
)
def undecodable_files(spark, sf_dir):
    """Files cut short, without a modality in their name, or with four channels."""
    kind = F.col("label") % 4
    vectors = _scan_files(spark, sf_dir, F.when(kind == 1, ".nii").otherwise("-t1n.nii.gz"))
    stacked = volumes.encode_files(vectors.where(kind == 2), F.col("name"), "embedding", (4, 4, 2, 2))
    single = volumes.encode_files(vectors.where(kind != 2), F.col("name"), "embedding", (4, 4, 4))
    broken = volumes.encode_files(vectors.where(kind == 0), F.col("name"), "embedding", (4, 4, 4)).select(
        "path", F.expr("substring(content, 1, 20)").alias("content")
    )
    files = stacked.union(single.join(broken.select("path"), "path", "left_anti")).union(broken)
    return volumes.undecodable_files(volumes.decode_volumes(files)).select("path", "problem")


# Sinks, each read back ------------------------------------------------------


def _label_file(spark, sf_dir):
    """Label table with padded names in an order of their own and some texts that are no numbers."""
    derived = regions.derive_labels(b.seg(spark, sf_dir), b.cases(spark, sf_dir))
    spoilt = F.when(F.col("case_id") % 50 == 0, F.lit("high")).otherwise(F.col("grade_proxy").cast("string"))
    blurred = F.when(F.col("case_id") % 100 == 0, F.lit("1,5")).otherwise(F.col("wt_volume").cast("string"))
    padded = F.concat(F.lit(" "), F.col("case_id").cast("string"), F.lit(" "))
    path = new_folder(spark, "labels")
    sinks.write_table(
        derived.select("et_volume", spoilt.alias("Grade_Proxy"), "wt", blurred.alias(" WT_volume "), "tc_volume",
                       padded.alias(" Case"), "et", "tc"),
        path, "csv", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return path


@query(
    "labels_csv_roundtrip",
    f"""WITH {LABELS_SQL} SELECT CAST(case_id AS VARCHAR) AS case_id, et, tc, wt, wt_volume, tc_volume, et_volume,
      grade_proxy AS label FROM derived WHERE case_id % 50 <> 0""",
)
def labels_csv_roundtrip(spark, sf_dir):
    return tables.read_labels(spark, _label_file(spark, sf_dir))


@query(
    "malformed_labels",
    f"""WITH {LABELS_SQL} SELECT CAST(case_id AS VARCHAR) AS case_id,
      CASE WHEN case_id % 100 = 0 THEN 'wt_volume,grade_proxy' ELSE 'grade_proxy' END AS malformed
    FROM derived WHERE case_id % 50 = 0""",
)
def malformed_labels(spark, sf_dir):
    return tables.malformed_labels(spark, _label_file(spark, sf_dir))


@query(
    "appended_labels",
    f"WITH {LABELS_SQL} SELECT case_id, et, tc, wt, wt_volume, tc_volume, et_volume, grade_proxy FROM derived",
)
def appended_labels(spark, sf_dir):
    labels = regions.derive_labels(b.seg(spark, sf_dir), b.cases(spark, sf_dir))
    path = new_folder(spark, "appended")
    for batch in (0, 1):
        sinks.append_labels(labels, path, batch)
    return sinks.current_labels(spark.read.parquet(path))


@query(
    "quarantined_cases",
    f"""WITH {OUTPUTS_SQL} SELECT * FROM (SELECT o_orderkey AS case_id, CASE WHEN size IS NULL THEN 'missing'
      WHEN size < 60 THEN 'corrupted' ELSE 'valid' END AS status FROM orders o LEFT JOIN outputs p ON p.case_id = o.o_orderkey)
    WHERE status <> 'valid'""",
)
def quarantined_cases(spark, sf_dir):
    status = cohort.output_status(b.cases(spark, sf_dir), _outputs(spark, sf_dir), 60)
    path = new_folder(spark, "errors")
    renamed = F.when(F.col("status") == "valid", "ok").otherwise(F.col("status"))
    sinks.quarantine(status.select("case_id", renamed.alias("status")), path)
    return spark.read.schema("case_id bigint, status string").parquet(path)


@query(
    "normalised_bricks",
    f"""WITH {CTN_SQL} SELECT case_id, modality, x, y, z, {r('value')} AS value FROM ctn""",
)
def normalised_bricks(spark, sf_dir):
    bricks = b.bricks(spark, sf_dir)
    path = new_folder(spark, "normalised")
    sinks.write_normalised(v.ctn_normalize(bricks, v.mask_bricks(bricks, 1, 0.0)), path)
    return rounded(v.explode_bricks(spark.read.parquet(path)))


HEURISTIC_SQL = """w AS (SELECT case_id, x, y, z, max(value) FILTER (modality = 1) AS t1ce,
      max(value) FILTER (modality = 2) AS t2, max(value) FILTER (modality = 3) AS flair FROM vox GROUP BY ALL),
    c AS (SELECT case_id, count(*) FILTER (t1ce > 0.1) AS et, count(*) FILTER (t2 > 0.05 OR flair > 0.05) AS wt,
      avg(t1ce) AS a FROM w GROUP BY case_id)"""


@query(
    "json_records",
    f"""WITH {VOX}, {HEURISTIC_SQL} SELECT case_id, CASE WHEN a > 0 THEN 'HIGH' ELSE 'LOW' END AS prediction,
      {r('1 / (1 + exp(-a))')} AS probability, et AS et_volume_voxels, {r('et / (wt + 1e-8::DOUBLE)')} AS et_wt_ratio,
      et > 3 AS has_enhancing FROM c""",
)
def json_records(spark, sf_dir):
    roles = {"t1ce": 1, "t2": 2, "flair": 3}
    found = v.heuristic_regions(b.bricks(spark, sf_dir), roles, 0.1, 0.05, 3)
    scored = scoring.score_to_prediction(found.withColumn("logit", F.col("t1ce_mean")))
    records = sinks.analysis_records(scored)
    path = new_folder(spark, "records")
    sinks.write_json_records(records, path)
    back = spark.read.schema(records.schema).json(path)
    inner = "tumor_characteristics"
    return rounded(
        back.select("case_id", "prediction", "probability", f"{inner}.et_volume_voxels", f"{inner}.et_wt_ratio",
                    f"{inner}.has_enhancing")
    )


def half_up(expression: str, digits: int) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(18, 6)), {digits}) AS DOUBLE)"


@query(
    "report_rows",
    f"""WITH {SCAN} SELECT modality, printf('| %s | %d | %.1f | %.1f | %.1f | %.1f | %.2f%% |', modality,
      count(DISTINCT case_id), {half_up('avg(value)', 1)}, {half_up('stddev_pop(value)', 1)}, {half_up('min(value)', 1)},
      {half_up('max(value)', 1)}, {half_up('100.0::DOUBLE * count(*) FILTER (value > 0) / count(*)', 2)}) AS line FROM scan GROUP BY modality""",
)
def report_rows(spark, sf_dir):
    return sinks.report_rows(stats.cohort_intensity(b.scan(spark, sf_dir), {"p50": 0.5}))


@query(
    "scan_progress",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, max(ts) AS last FROM events GROUP BY ALL),
    c AS (SELECT day, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS done, (SELECT count(*) FROM events) AS total,
      CAST(epoch_us(last) // 1000000 - (SELECT epoch_us(min(ts)) // 1000000 FROM events) AS BIGINT) AS secs FROM d),
    e AS (SELECT *, CAST(floor(secs / done * (total - done) + 1e-6::DOUBLE) AS BIGINT) AS eta FROM c)
    SELECT CAST(day AS VARCHAR) AS day, done, concat(secs // 3600, 'h ', secs % 3600 // 60, 'm ', secs % 60, 's') AS elapsed,
      concat(eta // 3600, 'h ', eta % 3600 // 60, 'm ', eta % 60, 's') AS eta FROM e""",
)
def scan_progress(spark, sf_dir):
    """Elapsed and remaining time after each day; days are few, so one window over them is small."""
    events = b.table(spark, sf_dir, "events")
    daily = events.groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.min("ts").alias("first")
    )
    by_day = Window.partitionBy(F.lit(0)).orderBy("day")
    everything = Window.partitionBy(F.lit(0))
    seconds = F.timestamp_diff("SECOND", F.date_trunc("second", F.min("first").over(everything)),
                               F.date_trunc("second", F.col("last")))
    counted = daily.select(
        F.col("day").cast("string").alias("day"),
        F.sum("n").over(by_day).alias("done"),
        F.sum("n").over(everything).alias("total"),
        seconds.alias("seconds"),
    )
    left = scalars.remaining_seconds(F.col("seconds").cast("double"), F.col("done"), F.col("total"))
    return counted.select(
        "day",
        "done",
        scalars.duration_text(F.col("seconds")).alias("elapsed"),
        scalars.duration_text(left + 1e-6).alias("eta"),
    )
