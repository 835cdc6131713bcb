"""Bricks on other grids against numpy slices."""

import numpy as np
import pytest

from voxelarium.operators import tiling, voxels
from test_tables_and_time import bricks_of, dense


@pytest.mark.parametrize("size", [(3, 4, 2), (9, 9, 9)])
@pytest.mark.parametrize("target, box", [((9, 6, 8), (4, 4, 4)), ((7, 6, 5), (2, 3, 5)), ((12, 3, 11), (5, 8, 3))])
def test_padding(spark, size, target, box):
    volume = np.random.default_rng(1).normal(size=(7, 6, 5)).astype(np.float32)
    found = tiling.pad_bricks(bricks_of(spark, {"c-t1n": volume}, size), volume.shape, target, box)
    pads = [(max(t - s, 0) // 2, max(t - s, 0) - max(t - s, 0) // 2) for s, t in zip(volume.shape, target)]
    want = np.pad(volume, pads)
    rows = found.collect()
    assert len(rows) == np.prod([-(-w // b) for w, b in zip(want.shape, box)])
    np.testing.assert_allclose(dense(found, want.shape), want)
    assert all((r.x0, r.y0, r.z0) == (r.bx * box[0], r.by * box[1], r.bz * box[2]) for r in rows)


def test_patches_of_uneven_bricks(spark):
    volume = np.random.default_rng(2).normal(size=(7, 6, 5)).astype(np.float32)
    bricks = bricks_of(spark, {"c-t1n": volume, "c-t1c": -volume}, (3, 4, 2))
    corners = [(0, 0, 0), (3, 2, 1), (2, 3, 2), (5, 4, 3), (6, 5, 4)]
    boxes = spark.createDataFrame([("c", i, *c) for i, c in enumerate(corners)], "case_id string, patch int, px int, py int, pz int")
    found = {(r.modality, r.patch): r["values"] for r in tiling.patch_bricks(bricks, boxes, 3, (3, 4, 2)).collect()}
    assert len(found) == 10
    wide = np.pad(volume, 3)
    for i, (x, y, z) in enumerate(corners):
        want = wide[x + 3 : x + 6, y + 3 : y + 6, z + 3 : z + 6]
        np.testing.assert_allclose(np.reshape(found["t1n", i], (3, 3, 3)), want)
        np.testing.assert_allclose(np.reshape(found["t1c", i], (3, 3, 3)), -want)


def test_nothing_in_nothing_out(spark):
    empty = bricks_of(spark, {"c-t1n": np.ones((2, 2, 2))}, (2, 2, 2)).limit(0)
    assert tiling.pad_bricks(empty, (2, 2, 2), (4, 4, 4), (2, 2, 2)).count() == 0


def test_random_flips_of_bricks(spark):
    volume = np.random.default_rng(3).normal(size=(7, 6, 5)).astype(np.float32)
    bricks = bricks_of(spark, {f"c{i}-t1n": volume for i in range(6)}, (3, 4, 2))
    one = voxels.explode_bricks(voxels.random_flip_bricks(bricks, volume.shape, 1, 4, "xz")).select("case_id", "x", "y", "z", "value")
    other = voxels.random_flips(bricks, volume.shape, 1, 4, "xz").select("case_id", "x", "y", "z", "value")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
