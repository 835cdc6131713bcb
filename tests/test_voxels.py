"""Voxel operators against numpy on small random volumes, bricks of uneven extent included."""

import gzip
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelarium.operators import components, voxels
from voxelarium.sources import volumes

SHAPE = (5, 4, 3)


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(3)
    return {(case, m): rng.normal(size=SHAPE).astype(np.float32) for case in range(6) for m in range(4)}


@pytest.fixture(scope="module")
def bricks(spark, arrays):
    """The arrays written as scan files and decoded into bricks of at most 2x2x2."""
    rows = [(f"{case}-{m}.nii.gz", volumes.write_nifti(a)) for (case, m), a in arrays.items()]
    files = spark.createDataFrame(rows, "path string, content binary")
    decoded = volumes.decode_volumes(files, size=(2, 2, 2))
    ids = F.split(F.split("path", r"\.")[0], "-")
    return decoded.withColumns({"case_id": ids[0].cast("bigint"), "modality": ids[1].cast("int")}).persist()


def assembled(vox, shape=SHAPE, value="value"):
    out = {}
    for row in vox.collect():
        key = (row.case_id, row.modality) if "modality" in vox.columns else row.case_id
        cube = out.setdefault(key, np.full(shape, np.nan))
        assert np.isnan(cube[row.x, row.y, row.z])
        cube[row.x, row.y, row.z] = row[value]
    return out


def test_bricks_reassemble(bricks, arrays):
    found = assembled(voxels.explode_bricks(bricks))
    assert found.keys() == arrays.keys()
    for key, cube in found.items():
        np.testing.assert_array_equal(cube, arrays[key])


def ctn(volume, mask):
    out = volume.astype(np.float64)
    top = np.percentile(out[mask], 99.5)
    out = np.minimum(out, top)
    out = (out - out[mask].mean()) / (out[mask].std() + 1e-8)
    return out / (np.abs(out).max() + 1e-8)


def test_ctn_normalisation(bricks, arrays):
    found = assembled(voxels.explode_bricks(voxels.ctn_normalize(bricks, voxels.mask_bricks(bricks, 1, 0.2))))
    for (case, m), cube in found.items():
        np.testing.assert_allclose(cube, ctn(arrays[case, m], arrays[case, 1] > 0.2), atol=1e-6)
        assert np.abs(cube).max() <= 1


def test_window_minmax(bricks, arrays):
    for key, cube in assembled(voxels.explode_bricks(voxels.window_minmax(bricks))).items():
        low, high = np.percentile(arrays[key].astype(np.float64), [1, 99])
        np.testing.assert_allclose(cube, np.clip((arrays[key] - low) / (high - low + 1e-8), 0, 1), atol=1e-6)


def test_volume_zscore(bricks, arrays):
    for (case, m), cube in assembled(voxels.explode_bricks(voxels.volume_zscore(bricks))).items():
        stack = np.stack([arrays[case, k] for k in range(4)]).astype(np.float64)
        np.testing.assert_allclose(cube, (arrays[case, m] - stack.mean()) / (stack.std() + 1e-8), atol=1e-6)


def test_empty_mask_is_reported(bricks):
    mask = voxels.mask_bricks(bricks, 1, 100.0)
    assert voxels.ctn_normalize(bricks, mask).count() == 0
    assert voxels.unmasked_volumes(bricks, mask).count() == 24


def test_flip_twice_is_identity(bricks):
    vox = voxels.explode_bricks(bricks)
    twice = voxels.flip(voxels.flip(vox, "x", 5), "x", 5)
    assert vox.exceptAll(twice).isEmpty() and twice.exceptAll(vox).isEmpty()


def test_modalities_flip_together(bricks, arrays):
    found = assembled(voxels.random_flips(bricks, SHAPE, 1))
    flipped = 0
    for case in range(6):
        match = [
            combo
            for combo in np.ndindex(2, 2, 2)
            if all(np.array_equal(np.flip(arrays[case, m], [i for i in range(3) if combo[i]]), found[case, m]) for m in range(4))
        ]
        assert len(match) == 1
        flipped += sum(match[0])
    assert 0 < flipped < 18


def test_pad_then_crop_is_identity(bricks):
    vox = voxels.explode_bricks(bricks)
    padded = voxels.center_pad(vox, SHAPE, (8, 4, 6))
    assert padded.count() == 24 * 8 * 4 * 6
    back = voxels.center_crop(padded, (8, 4, 6), SHAPE)
    assert back.select(vox.columns).exceptAll(vox).isEmpty() and back.count() == vox.count()


def test_pad_and_crop_match_numpy(bricks, arrays):
    vox = voxels.explode_bricks(bricks)
    mixed = voxels.center_pad(voxels.center_crop(vox, SHAPE, (2, 4, 6)), (2, 4, 3), (2, 4, 6))
    for key, cube in assembled(mixed, (2, 4, 6)).items():
        np.testing.assert_array_equal(cube, np.pad(arrays[key][1:3], [(0, 0), (0, 0), (1, 2)]))


def test_slice_reads_only_its_bricks(bricks, arrays):
    assert voxels.slice_bricks(bricks, "x", 4).count() == 24 * 4
    for row in voxels.mid_slice(bricks, "y", 4).collect():
        assert row.y == 2 and row.value == arrays[row.case_id, row.modality][row.x, row.y, row.z]


def test_patches(spark, bricks, arrays):
    cases = spark.range(6).select(F.col("id").alias("case_id"))
    boxes = voxels.patch_offsets(cases, SHAPE, 3, n=4)
    corners = {(r.case_id, r.patch): (r.px, r.py, r.pz) for r in boxes.collect()}
    assert all(0 <= x < 2 and y == 0 and z == 0 for x, y, z in corners.values())
    rows = voxels.extract_patches(bricks, boxes, 3, (2, 2, 2)).collect()
    assert len(rows) == 6 * 4 * 4 * 27
    for r in rows:
        x, y, z = corners[r.case_id, r.patch]
        assert r.value == arrays[r.case_id, r.modality][x + r.x, y + r.y, z + r.z]


def test_noise_is_repeatable_and_centred(bricks):
    vox = voxels.explode_bricks(bricks)
    noisy = voxels.add_noise(vox, 0.02, 5)
    assert noisy.exceptAll(voxels.add_noise(vox.repartition(3), 0.02, 5)).isEmpty()
    joined = vox.withColumnRenamed("value", "v0").join(noisy, ["case_id", "modality", "x", "y", "z"])
    row = joined.agg(F.avg(F.col("value") - F.col("v0")).alias("m"), F.stddev_pop(F.col("value") - F.col("v0")).alias("s")).first()
    assert abs(row.m) < 0.003 and abs(row.s - 0.02) < 0.003


def components_of(mask):
    """Breadth-first components, largest first, first in scan order on ties."""
    index = np.arange(mask.size).reshape(mask.shape)
    seen, found = np.zeros_like(mask), []
    for start in zip(*np.nonzero(mask)):
        if seen[start]:
            continue
        seen[start] = True
        queue, members = deque([start]), []
        while queue:
            at = queue.popleft()
            members.append(index[at])
            for axis in range(3):
                for step in (-1, 1):
                    to = list(at)
                    to[axis] += step
                    to = tuple(to)
                    if 0 <= to[axis] < mask.shape[axis] and mask[to] and not seen[to]:
                        seen[to] = True
                        queue.append(to)
        found.append(members)
    return sorted(found, key=lambda m: (-len(m), min(m)))


@pytest.mark.parametrize("threshold", [-0.3, 0.3])
def test_largest_component(bricks, arrays, threshold):
    one = bricks.where("modality = 0")
    largest, masked = components.brain_component(one, threshold, SHAPE)
    roots = {r.case_id: (r.root, r["size"]) for r in largest.collect()}
    inside = assembled(
        voxels.explode_bricks(
            masked.join(one, voxels.BRICK_KEYS).withColumn("values", F.transform("inside", lambda i: i.cast("float")))
        ).drop("modality")
    )
    for case in range(6):
        best = components_of(arrays[case, 0] > threshold)[0]
        assert roots[case] == (min(best), len(best))
        assert sorted(np.flatnonzero(inside[case] > 0)) == sorted(best)


def test_winding_component_crosses_many_bricks(spark):
    volume = np.zeros((9, 9, 1), np.float32)
    for i in range(0, 9, 2):
        volume[i, :, 0] = 1
    for i in range(1, 9, 2):
        volume[i, 0 if i % 4 == 3 else 8, 0] = 1
    files = spark.createDataFrame([("7", volumes.write_nifti(volume))], "path string, content binary")
    tiles = volumes.decode_volumes(files, size=(2, 2, 1)).withColumn("case_id", F.col("path").cast("bigint"))
    largest, _ = components.brain_component(tiles, 0.5, volume.shape)
    assert [tuple(r) for r in largest.collect()] == [(7, 0, int(volume.sum()))]


def test_empty_mask_has_no_component(bricks):
    largest, masked = components.brain_component(bricks.where("modality = 0"), 100.0, SHAPE)
    assert largest.count() == 0
    assert masked.where(F.exists("inside", lambda i: i)).count() == 0


def test_broken_files_become_error_rows(spark):
    good = np.ones((2, 2, 2), np.float32)
    image, array = volumes.write_nifti(good), volumes.write_npy(good)
    nifti = spark.createDataFrame(
        [("ok", image), ("raw", gzip.decompress(image)), ("cut", image[:40]), ("text", b"no image"),
         ("short", gzip.compress(gzip.decompress(image)[:-8]))],
        "path string, content binary",
    )
    found = {r.path: r.status for r in volumes.decode_volumes(nifti).collect()}
    assert found == {"ok": "ok", "raw": "ok", "cut": "error", "text": "error", "short": "error"}
    npy = spark.createDataFrame(
        [("ok", array), ("wide", volumes.write_npy(np.ones((2, 2, 3)))), ("cut", array[:-3]),
         ("double", volumes.write_npy(good.astype(np.float64)))],
        "path string, content binary",
    )
    found = {r.path: (r.status, r.error) for r in volumes.decode_volumes(npy, volumes.read_npy((2, 2, 2))).collect()}
    assert {k: v[0] for k, v in found.items()} == {"ok": "ok", "wide": "error", "cut": "error", "double": "ok"}
    assert "invalid shape" in found["wide"][1]


def test_slope_and_intercept_apply(spark):
    raw = bytearray(gzip.decompress(volumes.write_nifti(np.arange(8, dtype=np.float32).reshape(2, 2, 2))))
    raw[112:120] = np.array([2.0, 1.0], "<f4").tobytes()
    np.testing.assert_array_equal(
        volumes.read_nifti(bytes(raw)), 2 * np.arange(8, dtype=np.float32).reshape(2, 2, 2) + 1
    )
