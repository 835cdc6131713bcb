"""Counts inside bricks against numpy on whole volumes."""

import numpy as np
import pytest

from voxelarium.operators import bincounts, history, regions, voxels
from voxelarium.sources import volumes

BRICK = "case_id string, bx int, by int, bz int, x0 int, y0 int, z0 int, nx int, ny int, nz int, modality string, values array<{}>"


def frame(spark, cases, kind="float"):
    """Each case's values in uneven pieces."""
    rows = []
    for name, values in cases.items():
        for i, part in enumerate(np.array_split(np.arange(len(values)), 5)):
            rows.append((name, i, 0, 0, 0, 0, 0, 1, 1, len(part), "t1n", [None if values[j] is None else float(values[j]) for j in part]))
    return spark.createDataFrame(rows, BRICK.format(kind))


def cases(rng, kind):
    return {
        "normal": rng.normal(size=997).astype(kind),
        "ties": rng.integers(-3, 4, 500).astype(kind),
        "wide": (rng.normal(size=300) * 10.0 ** rng.integers(-30, 30, 300)).astype(kind),
        "close": (1 + rng.integers(0, 1000, 400) * np.finfo(kind).eps).astype(kind),
        "one": np.array([-2.5], kind),
        "zeros": np.array([0.0, -0.0, 0.0, 5.0], kind),
    }


@pytest.mark.parametrize("name, kind", [("float", np.float32), ("double", np.float64)])
def test_percentiles_are_exact(spark, name, kind):
    data = cases(np.random.default_rng(1), kind)
    fractions = [0.0, 0.01, 0.5, 0.995, 1.0]
    found = {r.case_id: r for r in bincounts.volume_percentiles(frame(spark, data, name), ["case_id"], fractions, neighbours=True).collect()}
    assert found.keys() == data.keys()
    for case, values in data.items():
        want = np.quantile(values.astype(np.float64), fractions)
        np.testing.assert_allclose([found[case][f"p{i}"] for i in range(5)], want, rtol=1e-12)
        assert found[case].n == len(values) and found[case].p2_lo in values and found[case].p2_hi in values


def test_odd_values(spark):
    data = {"nan": [1.0, float("nan"), 2.0], "inf": [float("-inf"), 0.0, float("inf")], "null": [None, 4.0, None, 8.0], "none": [None]}
    found = {r.case_id: r for r in bincounts.volume_percentiles(frame(spark, data), ["case_id"], [0.0, 0.5, 1.0]).collect()}
    assert found.keys() == {"nan", "inf", "null"}
    assert (found["nan"].p1, found["inf"].p1, found["null"].p1, found["null"].n) == (2.0, 0.0, 6.0, 2)
    assert np.isnan(found["nan"].p2) and found["inf"].p0 == float("-inf")
    assert bincounts.volume_percentiles(frame(spark, {"a": [1.0]}).limit(0), ["case_id"], [0.5]).count() == 0


def test_no_generator_in_the_counting_passes(spark):
    bricks = frame(spark, {"a": [1.0, 2.0, 3.0]})
    for made in (
        bincounts.label_histogram(bricks),
        bincounts.brick_moments(bricks, ["case_id"]),
        bincounts.value_histogram(bricks.selectExpr("*", "0d as lo", "4d as hi"), ["case_id"], 4, "lo", "hi"),
    ):
        assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()


def test_moments_merge(spark):
    rng = np.random.default_rng(2)
    data = {"a": rng.gamma(2, size=500).astype(np.float32) + 100, "b": rng.normal(size=77).astype(np.float32), "flat": np.full(9, 3, np.float32)}
    bricks = frame(spark, data).selectExpr("*", "101.5f as top")
    shape = {r.case_id: r for r in bincounts.volume_shape(bincounts.brick_moments(bricks, ["case_id"]), ["case_id"]).collect()}
    clipped = {r.case_id: r for r in bincounts.volume_shape(bincounts.brick_moments(bricks, ["case_id"], upper="top"), ["case_id"]).collect()}
    for case, values in data.items():
        v = values.astype(np.float64)
        got, d = shape[case], v - v.mean()
        np.testing.assert_allclose([got.n, got.mean, got.std, got.mn, got.mx], [len(v), v.mean(), v.std(), v.min(), v.max()], rtol=1e-9)
        if v.std():
            np.testing.assert_allclose([got.skewness, got.kurtosis], [(d**3).mean() / v.std() ** 3, (d**4).mean() / v.var() ** 2 - 3], rtol=1e-6)
        else:
            assert got.skewness is None and got.kurtosis is None
        c = np.minimum(v, 101.5)
        np.testing.assert_allclose([clipped[case].mean, clipped[case].std], [c.mean(), c.std()], rtol=1e-9)


def test_masks_without_a_tumour_count(spark):
    whole, empty = np.zeros((4, 4, 4), np.float32), np.zeros((4, 4, 4), np.float32)
    whole[0, 0, :2] = 4
    whole[1, 1, 1] = 1
    files = {"/a/c1-seg.nii.gz": volumes.write_nifti(whole), "/a/c2-seg.nii.gz": volumes.write_nifti(empty)}
    decoded = volumes.decode_volumes(spark.createDataFrame(list(files.items()), "path string, content binary"), size=(3, 3, 3))
    counts = volumes.segmentation_counts(decoded)
    assert sorted(map(tuple, counts.collect())) == [("c1", 0, 61), ("c1", 1, 1), ("c1", 4, 2), ("c2", 0, 64)]
    row = regions.presence_and_fraction(counts).first()
    assert (row.n_with, row.n_without, row.with_pct, row.mean_fraction, row.max_voxels) == (1, 1, 50.0, 2 / 64, 2)
    assert {(r.case_id, r.region): r.voxels for r in regions.region_volumes(counts, {"w": [4], "e": [1, 2]}).collect()} == {
        ("c1", "w"): 2, ("c1", "e"): 1, ("c2", "w"): 0, ("c2", "e"): 0
    }
    assert [tuple(r) for r in regions.labels_per_mask(counts).orderBy("case_id").collect()] == [("c1", "0,1,4", 3), ("c2", "0", 1)]
    assert sorted(map(tuple, regions.distinct_labels(counts).collect())) == [(0, 125, 2), (1, 1, 1), (4, 2, 1)]
    # Voxel rows give the same.
    assert regions.presence_and_fraction(volumes.segmentation_voxels(decoded)).first() == row


def test_arrays_of_another_shape_are_listed(spark):
    good, three = np.ones((4, 2, 2, 2), np.float32), np.ones((3, 2, 2, 2), np.float32)
    files = {"/a/c1.npy": good, "/a/c2.npy": three, "/a/c3.npy": good[0]}
    rows = [(p, volumes.write_npy(a)) for p, a in files.items()] + [("/a/c4.npy", b"broken")]

    def reader(content):
        import io

        return np.load(io.BytesIO(content), allow_pickle=False)

    decoded = volumes.decode_volumes(spark.createDataFrame(rows, "path string, content binary"), reader)
    names = ["t1c", "t1n", "t2f", "t2w"]
    assert {r.case_id for r in volumes.stacked_bricks(decoded, names).collect()} == {"c1"}
    problems = {r.path: r.problem for r in volumes.undecodable_arrays(decoded, names).collect()}
    assert problems == {"/a/c2.npy": "3 channels, expected 4", "/a/c3.npy": "1 channels, expected 4", "/a/c4.npy": "unreadable"}


def test_first_loss_not_a_number_is_no_improvement(spark):
    nan = float("nan")
    hist = spark.createDataFrame([("a", 1, nan), ("a", 2, 0.5), ("a", 3, nan), ("b", 1, None), ("b", 2, nan)], "run string, epoch int, val_loss double")
    rows = {(r.run, r.epoch): (r.improved, r.counter, r.stop) for r in history.early_stop(hist, 1).collect()}
    assert rows == {("a", 1): (0, 1, 1), ("a", 2): (1, 0, 0), ("a", 3): (0, 1, 1), ("b", 1): (0, 1, 1), ("b", 2): (0, 2, 1)}


def test_window_of_a_double_volume(spark):
    values = np.linspace(-5, 5, 101)
    out = voxels.window_minmax(frame(spark, {"a": values}, "double"), 0.1, 0.9).orderBy("bx").collect()
    lo, hi = np.quantile(values, [0.1, 0.9])
    np.testing.assert_allclose(np.concatenate([r["values"] for r in out]), np.clip((values - lo) / (hi - lo + 1e-8), 0, 1), atol=1e-9)
