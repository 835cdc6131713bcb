"""Voxel operators on bricks.

A volume is stored as bricks: rows of ``case_id, modality, bx, by, bz, x0, y0,
z0, nx, ny, nz, values`` (place in the brick grid, first voxel, extent) with at
most a few ten thousand values each.  Joins run between
bricks; voxels exist as rows only behind the last shuffle or in front of a
partial aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, functions as F

from voxelarium.conventions import CLIP_PERCENTILE, EPSILON, MASK_THRESHOLD
from voxelarium.operators.bincounts import brick_moments, volume_percentiles, volume_shape
from voxelarium.operators.distributed import hash_to_int, join_summary, seeded_hash
from voxelarium.storage import materialise

AXES = ("x", "y", "z")
BRICK_KEYS = ["case_id", "bx", "by", "bz"]
BRICK_SHAPE = ["bx", "by", "bz", "x0", "y0", "z0", "nx", "ny", "nz"]


def voxel_position(offset: str = "_p") -> list[Column]:
    """Coordinates of the value at ``offset`` of a brick."""
    return [
        F.expr(f"cast(x0 + {offset} div (ny * nz) as int)").alias("x"),
        F.expr(f"cast(y0 + ({offset} div nz) % ny as int)").alias("y"),
        F.expr(f"cast(z0 + {offset} % nz as int)").alias("z"),
    ]


def brick_cells(bricks: DataFrame, values: str | Column, name: str, *extra: str) -> DataFrame:
    """One row per array element with its offset ``_p``.

    The outer form with a plain test keeps Spark from inferring a filter on the
    array, which would compute a transformed array twice.
    """
    cells = bricks.select("case_id", "modality", *BRICK_SHAPE, *extra, F.posexplode_outer(values).alias("_p", name))
    return cells.where("_p is not null")


def explode_bricks(bricks: DataFrame, *extra: str) -> DataFrame:
    """Long view ``case_id, modality, x, y, z, value``."""
    cells = brick_cells(bricks, "values", "_v", *extra)
    return cells.select(
        "case_id", "modality", *voxel_position(), F.col("_v").cast("double").alias("value"), *extra
    )


def map_values(bricks: DataFrame, fn) -> DataFrame:
    """Bricks with ``fn`` applied to every value as a double."""
    return bricks.withColumn("values", F.transform("values", lambda v: fn(v.cast("double"))))


def stride_sample(vox: DataFrame, k: int) -> DataFrame:
    return vox.where(" and ".join(f"{a} % {k} = 0" for a in AXES))


def stride_bricks(bricks: DataFrame, k: int) -> DataFrame:
    """Bricks of every ``k``-th voxel along each axis, counted in steps of the stride.

    Bricks between two steps go by their corner; what is left is gathered inside the array.
    """
    first = {a: F.ceil(F.col(f"{a}0") / k).cast("int") for a in AXES}
    last = {a: F.floor((F.col(f"{a}0") + F.col(f"n{a}") - 1) / k).cast("int") for a in AXES}
    kept = bricks.where(reduce(lambda p, a: p & (first[a] <= last[a]), AXES, F.lit(True)))
    steps = kept.withColumns({f"_s{a}": first[a] for a in AXES} | {f"_c{a}": last[a] - first[a] + 1 for a in AXES})
    place = (
        f"((_sx + t div (_cy * _cz)) * {k} - x0) * ny * nz + ((_sy + (t div _cz) % _cy) * {k} - y0) * nz + (_sz + t % _cz) * {k} - z0"
    )
    gathered = F.expr(f"transform(sequence(0, _cx * _cy * _cz - 1), t -> get(values, cast({place} as int)))")
    out = steps.withColumn("values", gathered)
    moved = {f"{a}0": F.col(f"_s{a}") for a in AXES} | {f"n{a}": F.col(f"_c{a}") for a in AXES}
    return out.withColumns(moved).drop(*[f"_{p}{a}" for p in "sc" for a in AXES])


def threshold_mask(vox: DataFrame, threshold: float = MASK_THRESHOLD) -> DataFrame:
    return vox.withColumn("mask", F.when(F.col("value") > threshold, 1.0).otherwise(0.0))


def mask_bricks(bricks: DataFrame, modality, threshold: float = MASK_THRESHOLD) -> DataFrame:
    """Brain mask of one modality: ``inside`` is an array of booleans per brick."""
    inside = F.transform("values", lambda v: v > threshold).alias("inside")
    return bricks.where(F.col("modality") == modality).select(*BRICK_KEYS, inside)


def apply_mask(bricks: DataFrame, mask: DataFrame) -> DataFrame:
    """Bring the mask of a case to all its modalities, one row per brick.

    Where the mask has no brick, nothing lies inside.
    """
    outside = F.transform("values", lambda v: F.lit(False))
    return bricks.join(mask, BRICK_KEYS, "left").withColumn("inside", F.coalesce("inside", outside))


def explode_masked(masked: DataFrame) -> DataFrame:
    """Voxels of the masked bricks that lie inside the mask."""
    cells = brick_cells(masked, F.arrays_zip("values", "inside"), "_c")
    return cells.where("_c.inside").select(
        "case_id", "modality", *voxel_position(), F.col("_c.values").cast("double").alias("value")
    )


def window_minmax(bricks: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Scale each volume to [0, 1] between two of its percentiles."""
    keys = ["case_id", "modality"]
    limits = volume_percentiles(bricks, keys, [low, high]).select(*keys, "p0", "p1")
    scaled = map_values(
        join_summary(bricks, limits, keys),
        lambda v: F.greatest(
            F.least((v - F.col("p0")) / (F.col("p1") - F.col("p0") + EPSILON), F.lit(1.0)), F.lit(0.0)
        ),
    )
    return scaled.drop("p0", "p1")


def ctn_normalize(
    bricks: DataFrame, mask: DataFrame, clip: float = CLIP_PERCENTILE
) -> DataFrame:
    """Clip at a masked percentile, z-score with masked moments, divide by the largest magnitude.

    The largest magnitude needs no pass of its own: clipping and z-scoring are
    monotone, so it is attained at the smallest or largest value of the volume.
    Volumes with an empty mask have no statistics and are left out, see
    ``unmasked_volumes``.
    """
    keys = ["case_id", "modality"]
    masked = apply_mask(bricks, mask)
    inner = F.transform(
        F.filter(F.arrays_zip("values", "inside"), lambda c: c["inside"]), lambda c: c["values"]
    )
    # Three passes read the masked values; the join with the mask runs once.
    packed = materialise(masked.select(*keys, inner.alias("inner")).where(F.size("inner") > 0), "masked")
    limits = materialise(volume_percentiles(packed, keys, [clip], "inner").select(*keys, "p0"), "clips")
    clipped = volume_shape(brick_moments(join_summary(packed, limits, keys), keys, "inner", "p0"), keys)
    moments = clipped.select(*keys, "mean", (F.col("std") + EPSILON).alias("sd")).join(limits, keys)
    extremes = bricks.groupBy(*keys).agg(
        F.min(F.array_min("values")).cast("double").alias("lowest"),
        F.max(F.array_max("values")).cast("double").alias("highest"),
    )

    def z(v: Column) -> Column:
        return (F.least(v, F.col("p0")) - F.col("mean")) / F.col("sd")

    scale = F.greatest(F.abs(z(F.col("lowest"))), F.abs(z(F.col("highest")))) + EPSILON
    stats = moments.join(extremes, keys).select(*keys, "p0", "mean", "sd", scale.alias("scale"))
    scaled = map_values(join_summary(bricks, stats, keys), lambda v: z(v) / F.col("scale"))
    return scaled.drop("p0", "mean", "sd", "scale")


def unmasked_volumes(bricks: DataFrame, mask: DataFrame) -> DataFrame:
    """Volumes without a single voxel inside the mask, for the error table."""
    hits = apply_mask(bricks, mask).groupBy("case_id", "modality").agg(
        F.max(F.exists("inside", lambda i: i)).alias("any_inside")
    )
    return hits.where(~F.col("any_inside")).drop("any_inside")


def volume_zscore(bricks: DataFrame) -> DataFrame:
    """Z-score over all channels of a case together."""
    values = bricks.select("case_id", F.explode("values").alias("v"))
    stats = values.withColumn("v", F.col("v").cast("double")).groupBy("case_id").agg(
        F.avg("v").alias("mean"), (F.stddev_pop("v") + EPSILON).alias("sd")
    )
    scaled = map_values(
        join_summary(bricks, stats, ["case_id"]), lambda v: (v - F.col("mean")) / F.col("sd")
    )
    return scaled.drop("mean", "sd")


def value_range(bricks: DataFrame) -> DataFrame:
    """Smallest and largest value per modality, from brick extremes."""
    return bricks.groupBy("modality").agg(
        F.min(F.array_min("values")).alias("lowest"), F.max(F.array_max("values")).alias("highest")
    )


def center_crop(vox: DataFrame, shape: Sequence[int], target: Sequence[int]) -> DataFrame:
    """Keep the central part of every axis longer than its target."""
    out = vox
    for axis, size, want in zip(AXES, shape, target):
        if size > want:
            start = (size - want) // 2
            out = out.where(F.col(axis).between(start, start + want - 1))
            out = out.withColumn(axis, F.col(axis) - F.lit(start))
    return out


def gathered(counts: Mapping[str, Column], place: Mapping[str, Callable[[Column], Column]]) -> Column:
    """Values of a brick over the extents ``counts``; ``place`` gives each axis' old offset from the new one."""
    size = counts["x"] * counts["y"] * counts["z"]

    def cell(i: Column) -> Column:
        new = {
            "x": F.floor(i / (counts["y"] * counts["z"])),
            "y": F.floor(i / counts["z"]) % counts["y"],
            "z": i % counts["z"],
        }
        old = {a: place[a](new[a]) for a in AXES}
        return F.get("values", ((old["x"] * F.col("ny") + old["y"]) * F.col("nz") + old["z"]).cast("int"))

    return F.transform(F.sequence(F.lit(0), size - 1), cell)


def crop_bricks(bricks: DataFrame, shape: Sequence[int], target: Sequence[int]) -> DataFrame:
    """Central part of every axis longer than its target, as bricks.

    Bricks outside go by their stored corners, before any value is read; those
    across the border are cut.
    """
    low, high, counts, place, corner = {}, {}, {}, {}, {}
    for a, size, want in zip(AXES, shape, target):
        first = max(size - want, 0) // 2
        low[a], high[a] = first, first + min(size, want)
        start = F.greatest(F.lit(first) - F.col(f"{a}0"), F.lit(0))
        counts[a] = F.least(F.lit(high[a]) - F.col(f"{a}0"), F.col(f"n{a}")) - start
        place[a] = lambda i, start=start: i + start
        corner[a] = F.col(f"{a}0") + start - first
    near = reduce(
        lambda p, q: p & q,
        [(F.col(f"{a}0") < high[a]) & (F.col(f"{a}0") + F.col(f"n{a}") > low[a]) for a in AXES],
    )
    # In one step the lambda would read the new corners: names inside it may mean aliases beside it.
    cut = bricks.where(near).withColumn("values", gathered(counts, place))
    return cut.withColumns(
        {f"{a}0": corner[a].cast("int") for a in AXES} | {f"n{a}": counts[a].cast("int") for a in AXES}
    )


def flip_bricks(bricks: DataFrame, axis: str, size: int) -> DataFrame:
    """Mirror image along an axis of length ``size``, as bricks; the grid place is kept as a name only."""
    counts = {a: F.col(f"n{a}") for a in AXES}
    place = {a: (lambda i: i) for a in AXES}
    place[axis] = lambda i: F.col(f"n{axis}") - 1 - i
    corner = F.lit(size) - F.col(f"{axis}0") - F.col(f"n{axis}")
    return bricks.withColumn("values", gathered(counts, place)).withColumn(f"{axis}0", corner.cast("int"))


def center_pad(vox: DataFrame, shape: Sequence[int], target: Sequence[int]) -> DataFrame:
    """Surround dense volumes with zeros up to the target.

    Voxels only move and the added shell is generated per case, so neither a
    grid join nor a voxel shuffle is needed.
    """
    before = [max(want - size, 0) // 2 for size, want in zip(shape, target)]
    final = [max(size, want) for size, want in zip(shape, target)]
    moved = vox
    for axis, shift in zip(AXES, before):
        moved = moved.withColumn(axis, F.col(axis) + F.lit(shift))
    keys = [c for c in vox.columns if c not in (*AXES, "value")]
    first_voxel = reduce(lambda a, b: a & b, [F.col(a) == 0 for a in AXES])
    cell = F.explode(F.sequence(F.lit(0), F.lit(prod(final) - 1))).alias("_c")
    _, ny, nz = final
    shell = vox.where(first_voxel).select(*keys, cell).select(
        *keys,
        F.expr(f"cast(_c div {ny * nz} as int)").alias("x"),
        F.expr(f"cast((_c div {nz}) % {ny} as int)").alias("y"),
        F.expr(f"cast(_c % {nz} as int)").alias("z"),
        F.lit(0.0).alias("value"),
    )
    inside = reduce(
        lambda a, b: a & b,
        [F.col(a).between(s, s + size - 1) for a, s, size in zip(AXES, before, shape)],
    )
    return moved.select(*keys, *AXES, "value").unionByName(shell.where(~inside))


def channels_first(
    df: DataFrame, key: str, values: str, shape: Sequence[int], channels: int = 4
) -> DataFrame:
    """Long voxels of a flattened ``(H, W, D, channels)`` array; other lengths are rejected."""
    _, w, d = shape
    cells = df.where(F.size(values) == prod(shape) * channels).select(
        F.col(key).alias("case_id"), F.posexplode(values).alias("_p", "_v")
    )
    return cells.select(
        "case_id",
        F.expr(f"cast(_p % {channels} as int)").alias("modality"),
        F.expr(f"cast(_p div {w * d * channels} as int)").alias("x"),
        F.expr(f"cast((_p div {d * channels}) % {w} as int)").alias("y"),
        F.expr(f"cast((_p div {channels}) % {d} as int)").alias("z"),
        F.col("_v").cast("double").alias("value"),
    )


def random_flips(
    bricks: DataFrame, shape: Sequence[int], seed: int, epoch: int = 0, axes: Sequence[str] = AXES
) -> DataFrame:
    """Reflect each axis of a case with probability one half, repeatably.

    The coin is a digest bit of seed, case, epoch and axis, so a retried task
    and every modality of the case see the same toss.
    """
    tossed = bricks
    for axis in axes:
        coin = hash_to_int(seeded_hash(seed, "case_id", F.lit(epoch), F.lit(axis))) % 2 == 1
        tossed = tossed.withColumn(f"_flip_{axis}", coin)
    out = explode_bricks(tossed, *[f"_flip_{a}" for a in axes])
    for axis, size in zip(AXES, shape):
        if axis in axes:
            mirrored = F.lit(size - 1) - F.col(axis)
            out = out.withColumn(axis, F.when(F.col(f"_flip_{axis}"), mirrored).otherwise(F.col(axis)))
    return out.drop(*[f"_flip_{a}" for a in axes])


def random_flip_bricks(
    bricks: DataFrame, shape: Sequence[int], seed: int, epoch: int = 0, axes: Sequence[str] = AXES
) -> DataFrame:
    """``random_flips`` as bricks: the same tosses, values reordered inside each array."""
    counts = {a: F.col(f"n{a}") for a in AXES}
    place, corner = {}, {}
    for a, size in zip(AXES, shape):
        coin = hash_to_int(seeded_hash(seed, "case_id", F.lit(epoch), F.lit(a))) % 2 == 1 if a in axes else F.lit(False)
        bricks = bricks.withColumn(f"_flip_{a}", coin)
        place[a] = lambda i, a=a: F.when(F.col(f"_flip_{a}"), F.col(f"n{a}") - 1 - i).otherwise(i)
        corner[f"{a}0"] = F.when(F.col(f"_flip_{a}"), F.lit(size) - F.col(f"{a}0") - F.col(f"n{a}")).otherwise(F.col(f"{a}0")).cast("int")
    # In two steps: the lambdas must see the old corners.
    turned = bricks.withColumn("values", gathered(counts, place))
    return turned.withColumns(corner).drop(*[f"_flip_{a}" for a in AXES])


def flip(vox: DataFrame, axis: str, size: int) -> DataFrame:
    return vox.withColumn(axis, F.lit(size - 1) - F.col(axis))


def add_noise(vox: DataFrame, sigma: float = 0.02, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Additive Gaussian noise from the digest of epoch and voxel, equal on every retry."""
    digest = seeded_hash(seed, F.lit(epoch), "case_id", "modality", *AXES)
    u = (hash_to_int(F.col("_d")) + 1) / F.lit(4294967297.0)
    w = hash_to_int(F.col("_d"), 9) / F.lit(4294967296.0)
    normal = F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.pi() * w)
    return vox.withColumn("_d", digest).withColumn("value", F.col("value") + sigma * normal).drop("_d")


def slice_bricks(bricks: DataFrame, axis: str, index: int) -> DataFrame:
    """Bricks that a plane cuts; the test is on a stored column and prunes the scan."""
    return bricks.where(f"{axis}0 <= {index} and {index} < {axis}0 + n{axis}")


def mid_slice(bricks: DataFrame, axis: str, size: int, index: int | None = None) -> DataFrame:
    """Voxels of the plane at ``index``, by default the middle of the axis."""
    at = size // 2 if index is None else index
    return explode_bricks(slice_bricks(bricks, axis, at)).where(F.col(axis) == at)


def label_overlay(
    bricks: DataFrame,
    labels: DataFrame,
    axis: str,
    index: int,
    target: int = 4,
    # Colour of each sub-region label.
    colours: Mapping[int, float] = {1: 1.0, 2: 0.5, 3: 0.25},
) -> DataFrame:
    """One plane with target mask and sub-region colour; label bricks carry ``labels``."""
    plane = slice_bricks(bricks, axis, index).join(labels.select(*BRICK_KEYS, "labels"), BRICK_KEYS)
    cells = brick_cells(plane, F.arrays_zip("values", "labels"), "_c")
    label = F.col("label")
    colour = F.lit(0.0)
    for k, shade in colours.items():
        colour = F.when(label == k, shade).otherwise(colour)
    return (
        cells.select(
            "case_id",
            "modality",
            *voxel_position(),
            F.col("_c.values").cast("double").alias("value"),
            F.col("_c.labels").cast("int").alias("label"),
        )
        .where(F.col(axis) == index)
        .withColumn("target", (label == target).cast("int"))
        .withColumn("colour", colour)
    )


def pivot_modalities(bricks: DataFrame, modalities: Mapping[str, object]) -> DataFrame:
    """One row per brick with an array column per named modality."""
    picked = [
        F.first(F.when(F.col("modality") == code, F.col("values")), ignorenulls=True).alias(name)
        for name, code in modalities.items()
    ]
    return bricks.where(F.col("modality").isin(list(modalities.values()))).groupBy(*BRICK_KEYS).agg(*picked)


def heuristic_regions(
    bricks: DataFrame,
    roles: Mapping[str, object],
    et_threshold: float = 0.3,
    wt_threshold: float = 0.1,
    min_enhancing: int = 500,
) -> DataFrame:
    """Enhancing and whole-tumour guesses from normalised contrast, T2 and FLAIR channels.

    ``roles`` names the modality codes of ``t1ce``, ``t2`` and ``flair``.
    """
    wide = pivot_modalities(bricks, roles)
    cell = F.explode(F.arrays_zip("t1ce", "t2", "flair")).alias("c")
    cells = wide.select("case_id", cell).select(
        "case_id", *[F.col(f"c.{n}").cast("double").alias(n) for n in ("t1ce", "t2", "flair")]
    )
    return cells.groupBy("case_id").agg(
        F.count_if(F.col("t1ce") > et_threshold).alias("et_volume_voxels"),
        F.count_if((F.col("t2") > wt_threshold) | (F.col("flair") > wt_threshold)).alias("wt_volume_voxels"),
        F.avg("t1ce").alias("t1ce_mean"),
        F.max("t1ce").alias("t1ce_max"),
        F.stddev_pop("t1ce").alias("t1ce_std"),
    ).select(
        "case_id",
        "et_volume_voxels",
        "wt_volume_voxels",
        (F.col("et_volume_voxels") / (F.col("wt_volume_voxels") + EPSILON)).alias("et_wt_ratio"),
        "t1ce_mean",
        "t1ce_max",
        "t1ce_std",
        (F.col("et_volume_voxels") > min_enhancing).alias("has_enhancing"),
    )


def patch_offsets(
    cases: DataFrame,
    shape: Sequence[int],
    size: int,
    n: int = 50,
    seed: int = 42,
    inclusive: bool = False,
) -> DataFrame:
    """``n`` repeatable random patch corners per case.

    Corners lie in ``[0, d - size)``, or up to ``d - size`` when ``inclusive``;
    an axis no longer than the patch starts at 0.
    """
    picks = cases.select("case_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("patch"))
    for axis, extent in zip(AXES, shape):
        room = max(extent - size, 0) + (1 if inclusive else 0)
        corner = hash_to_int(seeded_hash(seed, "case_id", "patch", F.lit(axis))) % max(room, 1)
        picks = picks.withColumn(f"p{axis}", corner.cast("int"))
    return picks


def extract_patches(
    bricks: DataFrame, boxes: DataFrame, size: int, brick_shape: Sequence[int]
) -> DataFrame:
    """Voxels inside each box with corner ``px, py, pz``, coordinates relative to the corner.

    A box first lists the bricks it touches, which turns the range join into an
    equi-join on case and brick.
    """
    touched = boxes
    for axis, width in zip(AXES, brick_shape):
        first = F.expr(f"cast(p{axis} div {width} as int)")
        last = F.expr(f"cast((p{axis} + {size - 1}) div {width} as int)")
        touched = touched.withColumn(f"b{axis}", F.explode(F.sequence(first, last)))
    corners = [f"p{a}" for a in AXES]
    vox = explode_bricks(bricks.join(touched, BRICK_KEYS), "patch", *corners)
    for axis in AXES:
        vox = vox.where((F.col(axis) >= F.col(f"p{axis}")) & (F.col(axis) < F.col(f"p{axis}") + size))
        vox = vox.withColumn(axis, F.col(axis) - F.col(f"p{axis}"))
    return vox.drop(*corners)
