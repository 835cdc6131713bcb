"""Queries on voxels and bricks."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelarium import bindings as b
from voxelarium.conventions import REGION_PRESETS
from voxelarium.functions import ids
from voxelarium.operators import components, longitudinal, tiling
from voxelarium.operators import voxels as v
from voxelarium.plans.registry import VOX, VOX64, query, r, rounded
from voxelarium.sinks import tables as sinks

SHAPE = (4, 2, 2)
CUBE = (4, 4, 4)


def hash_sql(*parts: str, start: int = 1, digits: int = 8) -> str:
    text = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5(concat_ws('|', {text})), {start}, {digits})) AS BIGINT)"


@query(
    "volume_shapes",
    f"""WITH {VOX}, s AS (SELECT case_id, modality, max(x) + 1 AS a, max(y) + 1 AS b, max(z) + 1 AS c FROM vox GROUP BY ALL)
    SELECT case_id, modality, concat(a, ',', b, ',', c) AS shape, CAST(a AS INTEGER) AS nx, CAST(b AS INTEGER) AS ny,
      CAST(c AS INTEGER) AS nz, concat(a, 'x', b) AS xy, concat(a, 'x', c) AS xz, concat(b, 'x', c) AS yz FROM s""",
)
def volume_shapes(spark, sf_dir):
    extent = [F.max(F.col(f"{a}0") + F.col(f"n{a}")).alias(a) for a in v.AXES]
    shapes = b.bricks(spark, sf_dir).groupBy("case_id", "modality").agg(*extent)
    text = ids.shape_text(*[F.col(a) for a in v.AXES])
    parsed = shapes.select("case_id", "modality", text.alias("shape")).withColumns(
        {f"n{a}": ids.shape_part(F.col("shape"), i) for i, a in enumerate(v.AXES)}
    )
    return parsed.withColumns(
        {p + q: F.concat_ws("x", f"n{p}", f"n{q}") for p, q in (("x", "y"), ("x", "z"), ("y", "z"))}
    )


@query(
    "strided_voxels",
    f"WITH {VOX} SELECT case_id, modality, x, y, z, {r('value')} AS value FROM vox WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0",
)
def strided_voxels(spark, sf_dir):
    cells = v.explode_bricks(v.stride_bricks(b.bricks(spark, sf_dir), 2))
    return rounded(cells.withColumns({a: F.col(a) * 2 for a in v.AXES}))


@query(
    "threshold_masks",
    f"""WITH {VOX} SELECT case_id, x, y, z, CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask
    FROM vox WHERE modality = 1""",
)
def threshold_masks(spark, sf_dir):
    bricks = b.bricks(spark, sf_dir).where("modality = 1")
    return v.threshold_mask(v.explode_bricks(bricks), 0.0).select("case_id", "x", "y", "z", "mask")


@query(
    "windowed_volumes",
    f"""WITH {VOX}, q AS (SELECT case_id, modality, quantile_cont(value, 0.01::DOUBLE) AS lo,
      quantile_cont(value, 0.99::DOUBLE) AS hi FROM vox GROUP BY ALL)
    SELECT v.case_id, v.modality, x, y, z,
      {r('greatest(least((value - lo) / (hi - lo + 1e-8::DOUBLE), 1), 0)')} AS value
    FROM vox v JOIN q ON v.case_id = q.case_id AND v.modality = q.modality""",
)
def windowed_volumes(spark, sf_dir):
    return rounded(v.explode_bricks(v.window_minmax(b.bricks(spark, sf_dir))))


@query(
    "masked_voxels",
    f"""WITH {VOX}, m AS (SELECT case_id, x, y, z FROM vox WHERE modality = 1 AND value > 0)
    SELECT v.case_id, v.modality, v.x, v.y, v.z, {r('v.value')} AS value FROM vox v
    JOIN m ON v.case_id = m.case_id AND v.x = m.x AND v.y = m.y AND v.z = m.z""",
)
def masked_voxels(spark, sf_dir):
    bricks = b.bricks(spark, sf_dir)
    return rounded(v.explode_masked(v.apply_mask(bricks, v.mask_bricks(bricks, 1, 0.0))))


@query(
    "bucketed_mask_join",
    f"""WITH {VOX}, m AS (SELECT case_id, x, y, z FROM vox WHERE modality = 1 AND value > 0)
    SELECT v.case_id, v.modality, count(*) AS n, {r('sum(v.value)')} AS total FROM vox v
    JOIN m ON v.case_id = m.case_id AND v.x = m.x AND v.y = m.y AND v.z = m.z GROUP BY ALL""",
)
def bucketed_mask_join(spark, sf_dir):
    """Masked sums of volumes; scans and mask lie in buckets by brick, so their join moves nothing."""
    bricks = sinks.bucketed_bricks(b.bricks(spark, sf_dir), 8)
    masked = v.apply_mask(bricks, v.mask_bricks(bricks, 1, 0.0).hint("merge"))
    inner = F.transform(F.filter(F.arrays_zip("values", "inside"), lambda c: c["inside"]), lambda c: c["values"].cast("double"))
    sums = masked.select("case_id", "modality", inner.alias("inner")).select(
        "case_id", "modality", F.size("inner").alias("n"), F.aggregate("inner", F.lit(0.0), lambda a, x: a + x).alias("total")
    )
    whole = sums.groupBy("case_id", "modality").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return rounded(whole.where("n > 0"))


CTN_SQL = f"""{VOX}, m AS (SELECT case_id, x, y, z FROM vox WHERE modality = 1 AND value > 0),
  inside AS (SELECT v.* FROM vox v JOIN m ON v.case_id = m.case_id AND v.x = m.x AND v.y = m.y AND v.z = m.z),
  p AS (SELECT case_id, modality, quantile_cont(value, 0.995::DOUBLE) AS p FROM inside GROUP BY ALL),
  st AS (SELECT i.case_id, i.modality, any_value(p.p) AS p, avg(least(i.value, p.p)) AS mean,
    stddev_pop(least(i.value, p.p)) + 1e-8::DOUBLE AS sd
    FROM inside i JOIN p ON i.case_id = p.case_id AND i.modality = p.modality GROUP BY i.case_id, i.modality),
  z AS (SELECT v.case_id, v.modality, v.x, v.y, v.z, (least(v.value, st.p) - st.mean) / st.sd AS value
    FROM vox v JOIN st ON v.case_id = st.case_id AND v.modality = st.modality),
  s AS (SELECT case_id, modality, max(abs(value)) + 1e-8::DOUBLE AS s FROM z GROUP BY ALL),
  ctn AS (SELECT z.case_id, z.modality, x, y, z.z, value / s.s AS value
    FROM z JOIN s ON z.case_id = s.case_id AND z.modality = s.modality)"""


@query(
    "ctn_normalised",
    f"WITH {CTN_SQL} SELECT case_id, modality, x, y, z, {r('value')} AS value FROM ctn",
)
def ctn_normalised(spark, sf_dir):
    bricks = b.bricks(spark, sf_dir)
    return rounded(v.explode_bricks(v.ctn_normalize(bricks, v.mask_bricks(bricks, 1, 0.0))))


@query(
    "normalised_range",
    f"""WITH {CTN_SQL} SELECT modality, {r('min(value)')} AS lowest, {r('max(value)')} AS highest
    FROM ctn GROUP BY modality""",
)
def normalised_range(spark, sf_dir):
    bricks = b.bricks(spark, sf_dir)
    return rounded(v.value_range(v.ctn_normalize(bricks, v.mask_bricks(bricks, 1, 0.0))))


@query(
    "unmasked_volumes",
    f"""WITH {VOX}, have AS (SELECT * FROM vox
      UNION ALL SELECT * REPLACE (-1 - case_id AS case_id) FROM vox WHERE modality <> 1),
    ok AS (SELECT DISTINCT case_id FROM have WHERE modality = 1 AND value > 0.2)
    SELECT DISTINCT case_id, modality FROM have WHERE case_id NOT IN (SELECT case_id FROM ok)""",
)
def unmasked_volumes(spark, sf_dir):
    """All cases, and a copy of each under a negative id that lacks the modality of the mask."""
    bricks = b.with_incomplete(b.bricks(spark, sf_dir), 1)
    return v.unmasked_volumes(bricks, v.mask_bricks(bricks, 1, 0.2))


@query(
    "zscored_volumes",
    f"""WITH {VOX}, s AS (SELECT case_id, avg(value) AS m, stddev_pop(value) + 1e-8::DOUBLE AS d FROM vox GROUP BY case_id)
    SELECT v.case_id, modality, x, y, z, {r('(value - m) / d')} AS value FROM vox v JOIN s ON v.case_id = s.case_id""",
)
def zscored_volumes(spark, sf_dir):
    return rounded(v.explode_bricks(v.volume_zscore(b.bricks(spark, sf_dir))))


@query(
    "volume_percentile_cut",
    f"""WITH {VOX} SELECT case_id, modality, {r('quantile_cont(value, 0.995::DOUBLE)')} AS p995 FROM vox GROUP BY ALL""",
)
def volume_percentile_cut(spark, sf_dir):
    exact = v.volume_percentiles(b.bricks(spark, sf_dir), ["case_id", "modality"], [0.995])
    return rounded(exact.select("case_id", "modality", F.col("p0").alias("p995")))


@query(
    "center_crop",
    f"""WITH {VOX64} SELECT case_id, x - 1 AS x, y - 1 AS y, z - 1 AS z, {r('value')} AS value FROM vox64
    WHERE x BETWEEN 1 AND 2 AND y BETWEEN 1 AND 2 AND z BETWEEN 1 AND 2""",
)
def center_crop(spark, sf_dir):
    return rounded(v.explode_bricks(v.crop_bricks(b.bricks64(spark, sf_dir), CUBE, (2, 2, 2))).drop("modality"))


@query(
    "flipped_bricks",
    f"WITH {VOX} SELECT case_id, modality, 3 - x AS x, 1 - y AS y, z, {r('value')} AS value FROM vox",
)
def flipped_bricks(spark, sf_dir):
    mirrored = v.flip_bricks(v.flip_bricks(b.bricks(spark, sf_dir), "x", SHAPE[0]), "y", SHAPE[1])
    return rounded(v.explode_bricks(mirrored))


@query(
    "center_pad",
    f"""WITH {VOX64}, g AS (SELECT CAST(i // 36 AS INTEGER) AS x, CAST(i // 6 % 6 AS INTEGER) AS y,
      CAST(i % 6 AS INTEGER) AS z FROM (SELECT unnest(range(216)) AS i)),
    c AS (SELECT DISTINCT case_id FROM vox64)
    SELECT c.case_id, g.x, g.y, g.z, {r('coalesce(v.value, 0)')} AS value FROM c CROSS JOIN g
    LEFT JOIN vox64 v ON v.case_id = c.case_id AND v.x + 1 = g.x AND v.y + 1 = g.y AND v.z + 1 = g.z""",
)
def center_pad(spark, sf_dir):
    return rounded(v.center_pad(b.vox64(spark, sf_dir), CUBE, (6, 6, 6)))


def _checked(bricks, *keys):
    """Size, sum and a sum weighted by place: equal only if the arrays are, in order."""
    v = F.transform("values", lambda x: x.cast("double"))
    weighted = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return rounded(bricks.select(*keys, F.size("values").alias("n"), total.alias("total"), weighted.alias("weighted")), 5)


@query(
    "padded_bricks",
    f"""WITH {VOX64}, g AS (SELECT CAST(i // 36 AS INTEGER) AS x, CAST(i // 6 % 6 AS INTEGER) AS y,
      CAST(i % 6 AS INTEGER) AS z FROM (SELECT unnest(range(216)) AS i)),
    c AS (SELECT DISTINCT case_id FROM vox64),
    p AS (SELECT c.case_id, g.x // 4 AS bx, g.y // 4 AS "by", g.z // 4 AS bz, coalesce(v.value, 0) AS value,
      ((g.x % 4) * least(4, 6 - g.y // 4 * 4) + g.y % 4) * least(4, 6 - g.z // 4 * 4) + g.z % 4 + 1 AS place
      FROM c CROSS JOIN g LEFT JOIN vox64 v ON v.case_id = c.case_id AND v.x + 1 = g.x AND v.y + 1 = g.y AND v.z + 1 = g.z)
    SELECT case_id, CAST(bx AS INTEGER) AS bx, CAST("by" AS INTEGER) AS "by", CAST(bz AS INTEGER) AS bz, CAST(count(*) AS INTEGER) AS n,
      {r('sum(value)', 5)} AS total, {r('sum(value * place)', 5)} AS weighted FROM p GROUP BY ALL""",
)
def padded_bricks(spark, sf_dir):
    """Padding as arrays: slabs become cubes of another grid."""
    return _checked(tiling.pad_bricks(b.bricks64(spark, sf_dir), CUBE, (6, 6, 6), (4, 4, 4)), "case_id", "bx", "by", "bz")


@query(
    "channels_first",
    f"""SELECT vec_id AS case_id, CAST(p % 4 AS INTEGER) AS modality, CAST(p // 16 AS INTEGER) AS x,
      CAST(p // 8 % 2 AS INTEGER) AS y, CAST(p // 4 % 2 AS INTEGER) AS z, {r('v')} AS value
    FROM (SELECT vec_id, unnest(range(len(embedding))) AS p, unnest(embedding) AS v FROM embeddings)""",
)
def channels_first(spark, sf_dir):
    return rounded(v.channels_first(b.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", (4, 2, 2)))


FLIPS_SQL = ", ".join(
    f"CASE WHEN {hash_sql('42', 'case_id', '0', chr(39) + a + chr(39))} % 2 = 1 THEN {n - 1} - {a} ELSE {a} END AS {a}"
    for a, n in zip(v.AXES, SHAPE)
)


@query(
    "random_flips",
    f"WITH {VOX} SELECT case_id, modality, {FLIPS_SQL}, {r('value')} AS value FROM vox",
)
def random_flips(spark, sf_dir):
    return rounded(v.explode_bricks(v.random_flip_bricks(b.bricks(spark, sf_dir), SHAPE, 42)))


@query(
    "noisy_voxels",
    f"""WITH {VOX} SELECT case_id, modality, x, y, z, {r(
        "value + 0.02::DOUBLE * sqrt(-2 * ln((" + hash_sql('7', '3', 'case_id', 'modality', 'x', 'y', 'z')
        + " + 1) / 4294967297.0::DOUBLE)) * cos(2 * pi() * "
        + hash_sql('7', '3', 'case_id', 'modality', 'x', 'y', 'z', start=9) + " / 4294967296.0::DOUBLE)")} AS value FROM vox""",
)
def noisy_voxels(spark, sf_dir):
    return rounded(v.add_noise(b.vox(spark, sf_dir), 0.02, 7, epoch=3))


@query(
    "mid_slices",
    f"""WITH {VOX} SELECT 'x' AS plane, case_id, modality, x, y, z, {r('value')} AS value FROM vox WHERE x = 2
    UNION ALL SELECT 'y', case_id, modality, x, y, z, {r('value')} FROM vox WHERE y = 1
    UNION ALL SELECT 'z', case_id, modality, x, y, z, {r('value')} FROM vox WHERE z = 1""",
)
def mid_slices(spark, sf_dir):
    bricks = b.bricks(spark, sf_dir)
    planes = [
        v.mid_slice(bricks, axis, size).withColumn("plane", F.lit(axis)) for axis, size in zip(v.AXES, SHAPE)
    ]
    return rounded(planes[0].unionByName(planes[1]).unionByName(planes[2]))


def _label_bricks(bricks):
    label = lambda x: (F.floor(F.abs(x.cast("double")) * 20).cast("int") % 5)
    return bricks.where("modality = 0").select(*v.BRICK_KEYS, F.transform("values", label).alias("labels"))


@query(
    "label_overlay",
    f"""WITH {VOX}, l AS (SELECT case_id, x, y, z, CAST(floor(abs(value) * 20) AS INTEGER) % 5 AS label FROM vox WHERE modality = 0)
    SELECT v.case_id, v.modality, v.x, v.y, v.z, {r('v.value')} AS value, l.label, CAST(l.label = 4 AS INTEGER) AS target,
      CASE l.label WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE WHEN 3 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS colour
    FROM vox v JOIN l ON v.case_id = l.case_id AND v.x = l.x AND v.y = l.y AND v.z = l.z
    WHERE v.modality = 2 AND v.z = 1""",
)
def label_overlay(spark, sf_dir):
    bricks = b.bricks(spark, sf_dir)
    return rounded(v.label_overlay(bricks.where("modality = 2"), _label_bricks(bricks), "z", 1))


@query(
    "heuristic_regions",
    f"""WITH {VOX}, w AS (SELECT case_id, x, y, z, max(value) FILTER (modality = 1) AS t1ce,
      max(value) FILTER (modality = 2) AS t2, max(value) FILTER (modality = 3) AS flair FROM vox GROUP BY ALL),
    c AS (SELECT case_id, count(*) FILTER (t1ce > 0.1) AS et, count(*) FILTER (t2 > 0.05 OR flair > 0.05) AS wt,
      avg(t1ce) AS a, max(t1ce) AS m, stddev_pop(t1ce) AS s FROM w GROUP BY case_id)
    SELECT case_id, et AS et_volume_voxels, wt AS wt_volume_voxels, {r('et / (wt + 1e-8::DOUBLE)')} AS et_wt_ratio,
      {r('a')} AS t1ce_mean, {r('m')} AS t1ce_max, {r('s')} AS t1ce_std, et > 3 AS has_enhancing FROM c""",
)
def heuristic_regions(spark, sf_dir):
    roles = {"t1ce": 1, "t2": 2, "flair": 3}
    return rounded(v.heuristic_regions(b.bricks(spark, sf_dir), roles, 0.1, 0.05, 3))


OFFSETS_SQL = ", ".join(
    f"CAST({hash_sql('42', 'case_id', 'patch', chr(39) + a + chr(39))} % {m} AS INTEGER) AS p{a}"
    for a, m in zip(v.AXES, (2, 1, 1))
)
BOXES_SQL = f"""boxes AS (SELECT case_id, patch, {OFFSETS_SQL} FROM (SELECT vec_id AS case_id,
  CAST(unnest(range(10)) AS INTEGER) AS patch FROM embeddings))"""


@query("patch_offsets", f"WITH {BOXES_SQL} SELECT * FROM boxes")
def patch_offsets(spark, sf_dir):
    cases = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("case_id"))
    return v.patch_offsets(cases, SHAPE, 2, 10)


@query(
    "extracted_patches",
    f"""WITH {VOX}, {BOXES_SQL} SELECT v.case_id, v.modality, b.patch, v.x - b.px AS x, v.y - b.py AS y, v.z - b.pz AS z,
      {r('v.value')} AS value FROM vox v JOIN boxes b ON v.case_id = b.case_id AND v.x >= b.px AND v.x < b.px + 2
      AND v.y >= b.py AND v.y < b.py + 2 AND v.z >= b.pz AND v.z < b.pz + 2""",
)
def extracted_patches(spark, sf_dir):
    bricks = b.bricks(spark, sf_dir)
    boxes = patch_offsets(spark, sf_dir)
    return rounded(v.extract_patches(bricks, boxes, 2, (2, 2, 2)))


@query(
    "patch_bricks",
    f"""WITH {VOX}, {BOXES_SQL}, p AS (SELECT v.case_id, v.modality, b.patch, v.value,
      ((v.x - b.px) * 2 + v.y - b.py) * 2 + v.z - b.pz + 1 AS place FROM vox v JOIN boxes b ON v.case_id = b.case_id
      AND v.x >= b.px AND v.x < b.px + 2 AND v.y >= b.py AND v.y < b.py + 2 AND v.z >= b.pz AND v.z < b.pz + 2)
    SELECT case_id, modality, patch, 8 AS n, {r('sum(value)', 5)} AS total, {r('sum(value * place)', 5)} AS weighted
    FROM p GROUP BY ALL""",
)
def patch_bricks(spark, sf_dir):
    """Random patches, each as one array."""
    found = tiling.patch_bricks(b.bricks(spark, sf_dir), patch_offsets(spark, sf_dir), 2, (2, 2, 2))
    return _checked(found, "case_id", "modality", "patch")


COMPONENTS_SQL = f"""RECURSIVE {VOX64}, n AS (SELECT case_id, x * 16 + y * 4 + z AS node, x, y, z FROM vox64 WHERE value > 0),
    e AS (SELECT a.case_id, a.node AS a, b.node AS b FROM n a JOIN n b ON a.case_id = b.case_id
      AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1),
    reach(case_id, node, root) AS (SELECT case_id, node, node FROM n
      UNION SELECT e.case_id, e.b, reach.root FROM reach JOIN e ON e.case_id = reach.case_id AND e.a = reach.node),
    comp AS (SELECT case_id, node, min(root) AS root FROM reach GROUP BY case_id, node),
    sizes AS (SELECT case_id, root, count(*) AS size FROM comp GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY size DESC, root) AS rn FROM sizes),
    brain AS (SELECT n.case_id, x, y, z FROM n JOIN comp c ON c.case_id = n.case_id AND c.node = n.node
      JOIN ranked k ON k.case_id = c.case_id AND k.root = c.root WHERE rn = 1)"""


@query(
    "brain_components",
    f"WITH {COMPONENTS_SQL} SELECT case_id, CAST(root AS BIGINT) AS root, size FROM ranked WHERE rn = 1",
)
def brain_components(spark, sf_dir):
    largest, _ = components.brain_component(b.bricks64(spark, sf_dir), 0.0, CUBE)
    return largest


@query("brain_masks", f"WITH {COMPONENTS_SQL} SELECT * FROM brain")
def brain_masks(spark, sf_dir):
    """Voxels of the largest component of every case."""
    bricks = b.bricks64(spark, sf_dir)
    _, mask = components.brain_component(bricks, 0.0, CUBE)
    return v.explode_masked(v.apply_mask(bricks, mask)).select("case_id", "x", "y", "z")


@query(
    "preprocessed_volumes",
    f"""WITH {COMPONENTS_SQL}, inside AS (SELECT v.* FROM vox64 v JOIN brain USING (case_id, x, y, z)),
    p AS (SELECT case_id, quantile_cont(value, 0.995::DOUBLE) AS p FROM inside GROUP BY case_id),
    st AS (SELECT case_id, any_value(p) AS p, avg(least(value, p)) AS mean, stddev_pop(least(value, p)) + 1e-8::DOUBLE AS sd
      FROM inside JOIN p USING (case_id) GROUP BY case_id),
    z AS (SELECT case_id, x, y, v.z AS z, (least(value, p) - mean) / sd AS value FROM vox64 v JOIN st USING (case_id)),
    s AS (SELECT case_id, max(abs(value)) + 1e-8::DOUBLE AS s FROM z GROUP BY case_id)
    SELECT case_id, x, y, z, {r('value / s', 4)} AS value FROM z JOIN s USING (case_id)""",
)
def preprocessed_volumes(spark, sf_dir):
    """Mask, largest component and normalisation as one job; of a flat brain only the scale by the largest magnitude shows."""
    bricks = b.bricks64(spark, sf_dir)
    _, mask = components.brain_component(bricks, 0.0, CUBE)
    return rounded(v.explode_bricks(v.ctn_normalize(bricks, mask)).drop("modality"), 4)


@query(
    "delta_images",
    f"""WITH {VOX} SELECT a.case_id // 2 AS patient, a.modality, a.x, a.y, a.z, {r('a.value - b.value')} AS delta
    FROM vox a JOIN vox b ON a.case_id + 1 = b.case_id AND a.case_id % 2 = 0 AND a.modality = b.modality
      AND a.x = b.x AND a.y = b.y AND a.z = b.z""",
)
def delta_images(spark, sf_dir):
    # Cases 2k and 2k + 1 are the two visits of patient k.
    visits = b.bricks(spark, sf_dir).withColumns(
        {"patient": F.expr("case_id div 2"), "visit": F.expr("case_id % 2")}
    )
    return rounded(longitudinal.delta_image(visits.where("visit = 0"), visits.where("visit = 1"), "patient"))


@query(
    "temporal_consistency",
    f"""WITH {VOX64}, m AS (SELECT case_id, x, y, z, CASE WHEN value > 0.1 THEN 3 WHEN value > 0.05 THEN 2 WHEN value > 0 THEN 1 ELSE 0 END AS label FROM vox64),
    map(region, label) AS (VALUES ('et', 3), ('tc', 2), ('tc', 3), ('wt', 1), ('wt', 2), ('wt', 3)),
    c AS (SELECT a.case_id // 2 AS patient, g.region,
        count(*) FILTER (a.label IN (SELECT label FROM map m WHERE m.region = g.region)) AS n_before,
        count(*) FILTER (b.label IN (SELECT label FROM map m WHERE m.region = g.region)) AS n_after,
        count(*) FILTER (a.label IN (SELECT label FROM map m WHERE m.region = g.region)
          AND b.label IN (SELECT label FROM map m WHERE m.region = g.region)) AS n_both
      FROM m a JOIN m b ON a.case_id % 2 = 0 AND b.case_id = a.case_id + 1 AND a.x = b.x AND a.y = b.y AND a.z = b.z
      CROSS JOIN (SELECT DISTINCT region FROM map) g GROUP BY ALL)
    SELECT patient, region, n_before, n_after, n_both, n_after - n_both AS n_appeared, n_before - n_both AS n_vanished,
      round(coalesce(2.0::DOUBLE * n_both / nullif(n_before + n_after, 0), 1.0), 6) + 0.0 AS dice,
      round(coalesce(n_both::DOUBLE / nullif(n_before + n_after - n_both, 0), 1.0), 6) + 0.0 AS jaccard FROM c""",
)
def temporal_consistency(spark, sf_dir):
    # Cases 2k and 2k + 1 are the two visits of patient k.
    label = F.transform(
        "values",
        lambda x: F.when(x.cast("double") > 0.1, 3).when(x.cast("double") > 0.05, 2).when(x.cast("double") > 0, 1).otherwise(0).cast("float"),
    )
    masks = b.bricks64(spark, sf_dir).withColumns(
        {"values": label, "patient": F.expr("case_id div 2"), "visit": F.expr("case_id % 2")}
    )
    # The last case of an odd number has no second visit.
    before, after = masks.where("visit = 0"), masks.where("visit = 1")
    return rounded(longitudinal.temporal_consistency(before, after, "patient", REGION_PRESETS["preproc"]))


@query(
    "tiled_bricks",
    f"""WITH {VOX64} SELECT case_id, CAST(x // 3 AS INTEGER) AS bx, CAST(y // 3 AS INTEGER) AS "by", CAST(z // 3 AS INTEGER) AS bz,
      count(*) AS n, {r('sum(value)')} AS total FROM vox64 GROUP BY ALL""",
)
def tiled_bricks(spark, sf_dir):
    from voxelarium.functions import udtfs

    udtfs.register(spark)
    b.table(spark, sf_dir, "embeddings").createOrReplaceTempView("volume_arrays")
    tiles = spark.sql(
        "SELECT vec_id AS case_id, t.bx, t.by, t.bz, t.values "
        "FROM volume_arrays, LATERAL bricks(embedding, array(4, 4, 4), 3) t"
    )
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rounded(
        tiles.select("case_id", "bx", "by", "bz", F.size("values").cast("bigint").alias("n"), total.alias("total"))
    )
