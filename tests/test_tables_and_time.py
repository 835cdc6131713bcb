"""Bucketed bricks, stored sketches, strides, masks over time and as-of values against plain Python."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelarium.operators import cohort, longitudinal, stats, voxels
from voxelarium.sinks import tables as sinks
from voxelarium.sources import volumes
from voxelarium.storage import scratch


def bricks_of(spark, volumes_, size):
    rows = [(f"/a/{name}.nii.gz", volumes.write_nifti(v.astype(np.float32))) for name, v in volumes_.items()]
    return volumes.scan_bricks(volumes.decode_volumes(spark.createDataFrame(rows, "path string, content binary"), size=size))


def dense(frame, shape):
    out = np.full(shape, np.nan)
    for r in voxels.explode_bricks(frame).collect():
        assert np.isnan(out[r.x, r.y, r.z])
        out[r.x, r.y, r.z] = r.value
    return out


@pytest.mark.parametrize("size", [(3, 4, 2), (2, 2, 2), (9, 9, 9)])
@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_strides(spark, size, k):
    volume = np.random.default_rng(k).normal(size=(7, 6, 5)).astype(np.float32)
    found = voxels.stride_bricks(bricks_of(spark, {"c-t1n": volume}, size), k)
    want = volume[::k, ::k, ::k]
    np.testing.assert_allclose(dense(found, want.shape), want)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_bucketed_join_moves_nothing(spark):
    volume = np.random.default_rng(0).normal(size=(6, 6, 6))
    bricks = bricks_of(spark, {f"c{i}-{m}": volume + i for i in range(3) for m in ("t1n", "t1c")}, (2, 3, 2))
    with scratch(spark):
        table = sinks.bucketed_bricks(bricks, 4)
        joined = voxels.apply_mask(table, voxels.mask_bricks(table, "t1n", 0.0).hint("merge"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
        again = voxels.apply_mask(bricks, voxels.mask_bricks(bricks, "t1n", 0.0))
        columns = ["case_id", "modality", "bx", "by", "bz", "inside"]
        assert sorted(map(tuple, joined.select(columns).collect())) == sorted(map(tuple, again.select(columns).collect()))
        # A bucket is one file.
        assert len(table.inputFiles()) <= 4


def test_sketches_merge_within_their_bound(spark, tmp_path):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=20_000), rng.exponential(size=10_000), np.zeros(5_000)])
    rows = [(int(i % 40), "ab"[i % 3 == 0], float(v)) for i, v in enumerate(rng.permutation(values))]
    df = spark.createDataFrame(rows, "case_id long, modality string, value double")
    stats.value_sketches(df, ["case_id", "modality"]).write.parquet(str(tmp_path / "s"))
    merged = stats.merged_sketches(spark.read.parquet(str(tmp_path / "s")), ["modality"])
    found = stats.sketch_percentiles(merged, ["modality"], {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.999})
    checked = stats.rank_errors(df, found, ["modality"]).collect()
    assert len(checked) == 8 and all(r.rank_error <= 0.01 for r in checked)
    for r in checked:
        mine = np.array([v for _, m, v in rows if m == r.modality])
        off = max((mine < r.estimate).sum() - r.fraction * len(mine), r.fraction * len(mine) - (mine <= r.estimate).sum(), 0) / len(mine)
        assert r.n == len(mine) and abs(off - r.rank_error) < 1e-12
    assert stats.sketch_percentiles(stats.value_sketches(df.limit(0), ["modality"]), ["modality"], {"a": 0.5}).count() == 0


def test_distinct_sketches_merge_within_their_bound(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("part"), (F.col("id") % 30_000).alias("many"), (F.col("id") % 11).alias("few"))
    sketches = cohort.distinct_sketches(rows, ["part"], {"many": "many", "few": "few"})
    row = cohort.approximate_overview(sketches, ["many", "few"]).first()
    assert abs(row.many - 30_000) <= 0.025 * 30_000 and row.few == 11 and row.n_rows == 60_000
    empty = cohort.approximate_overview(cohort.distinct_sketches(rows.limit(0), ["part"], {"few": "few"}), ["few"]).first()
    assert (empty.few or 0, empty.n_rows) == (0, 0)


def test_masks_over_time(spark):
    rng = np.random.default_rng(4)
    before, after = (rng.integers(0, 4, (9, 8, 5)) for _ in range(2))
    after[:4] = before[:4]
    none = np.zeros((9, 8, 5))

    def masks(patients):
        return bricks_of(spark, {f"{p}-t1n": v for p, v in patients.items()}, (4, 8, 5)).withColumnRenamed("case_id", "patient")

    left, right = masks({"p": before, "q": none, "r": before, "s": before}), masks({"p": after, "q": none, "s": after})
    right = right.where("patient <> 's' or bx > 0")
    regions = {"one": [1], "two": [2, 3]}
    found = {(r.patient, r.region): r for r in longitudinal.temporal_consistency(left, right, "patient", regions).collect()}
    assert {p for p, _ in found} == {"p", "q", "s"}
    cut = after.copy()
    cut[:4] = 0
    for patient, now in (("p", after), ("s", cut)):
        for region, labels in regions.items():
            a, b = np.isin(before, labels), np.isin(now, labels)
            got = found[patient, region]
            assert (got.n_before, got.n_after, got.n_both) == (a.sum(), b.sum(), (a & b).sum())
            assert (got.n_appeared, got.n_vanished) == ((b & ~a).sum(), (a & ~b).sum())
            np.testing.assert_allclose([got.dice, got.jaccard], [2 * (a & b).sum() / (a.sum() + b.sum()), (a & b).sum() / (a | b).sum()])
    assert found["q", "one"].dice == 1.0 and found["q", "two"].jaccard == 1.0


def test_as_of_equals_a_search(spark):
    rng = np.random.default_rng(5)
    start = dt.datetime(2024, 1, 1)

    def times(n):
        return [start + dt.timedelta(minutes=int(m)) for m in rng.integers(0, 60 * 24 * 9, n)]

    keys = lambda n: [None if k == 5 else int(k) for k in np.where(rng.random(n) < 0.4, 0, rng.integers(0, 6, n))]
    measured = [(k, t, float(v)) for k, t, v in zip(keys(150), times(150), rng.integers(0, 50, 150))]
    measured += [(0, measured[0][1], 99.0), (0, None, 1.0), (0, start, None)]
    asked = [(k, t, i) for i, (k, t) in enumerate(zip(keys(400), times(400)))] + [(0, None, 1000), (0, measured[0][1], 1001), (0, measured[0][1], 1001)]
    m = spark.createDataFrame(measured, "p int, t timestamp, v double")
    a = spark.createDataFrame(asked, "p int, t timestamp, i int")
    want = []
    for k, t, i in asked:
        known = [(mt, mv) for mk, mt, mv in measured if None not in (k, t, mk, mt, mv) and mk == k and mt <= t]
        last = max(known, default=(None, None))
        want.append((i, last[1], last[0]))
    for period in ("DAY", "MONTH", "HOUR"):
        got = [(r.i, r.v, r.measured_at) for r in longitudinal.as_of(a, m, "p", "t", "v", period).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert longitudinal.as_of(a.limit(0), m, "p", "t", "v").count() == 0


def test_equal_days_do_not_grow_by_the_order_of_rows(spark):
    """In order of the key 0.3 + 0.2 + 0.1 is 0.6, the other way round a bit more."""
    rows = [(1, 1, 0, 0.6), (1, 2, 3, 0.1), (1, 2, 2, 0.2), (1, 2, 1, 0.3), (2, 1, 4, None), (2, 2, 5, 1.0), (2, 2, 6, None)]
    scans = spark.createDataFrame([(p, dt.date(2024, 1, d), k, v) for p, d, k, v in rows], "patient int, day date, key int, value double")
    assert (0.1 + 0.2) + 0.3 > 0.6
    for scans in (scans.coalesce(1), scans.repartition(7)):
        daily = longitudinal.daily_volumes(scans, "key")
        found = longitudinal.doubling_time(daily).orderBy("patient", "day").collect()
        assert [(r.volume, r.n, r.doubling_days) for r in found] == [(0.6, 1, None), (0.6, 3, None), (None, 1, None), (1.0, 2, None)]
