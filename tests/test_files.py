"""From scan files on disk to cohort statistics."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelarium.operators import history, stats, voxels
from voxelarium.sources import inventory, tables, volumes


def test_files_to_statistics(spark, tmp_path):
    rng = np.random.default_rng(5)
    arrays = {}
    for case in ("BraTS-GLI-00001-100", "BraTS-GLI-00001-101", "BraTS-GLI-00002-100"):
        folder = tmp_path / "scans" / case
        folder.mkdir(parents=True)
        for code in ("t1c", "t1n", "t2f", "t2w"):
            arrays[case, code] = (rng.gamma(2.0, 60.0, size=(7, 6, 5))).astype(np.float32)
            (folder / f"{case}-{code}.nii.gz").write_bytes(volumes.write_nifti(arrays[case, code]))
    (folder / "broken-t1c.nii.gz").write_bytes(b"broken")
    root = str(tmp_path / "scans")

    listing = inventory.scan_inventory(spark, root)
    assert listing.count() == 13 and listing.where("length <= 0").isEmpty()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    decoded = volumes.decode_volumes(files, size=(4, 4, 4))
    table = str(tmp_path / "decoded")
    decoded.write.partitionBy("status").parquet(table)
    again = spark.read.parquet(table)
    assert [r.path.rsplit("/", 1)[1] for r in again.where("status = 'error'").collect()] == ["broken-t1c.nii.gz"]

    bricks = volumes.scan_bricks(again)
    found = {r.modality: r for r in stats.cohort_intensity(voxels.explode_bricks(bricks), {"p50": 0.5, "p99": 0.99}).collect()}
    for code in ("t1c", "t1n", "t2f", "t2w"):
        values = np.concatenate([a.ravel() for (_, m), a in arrays.items() if m == code]).astype(np.float64)
        row = found[code]
        assert (row.n_cases, row.n, row.positive_pct) == (3, values.size, 100.0)
        assert row.mean == pytest.approx(values.mean()) and row.std == pytest.approx(values.std())
        assert [row.p50, row.p99] == pytest.approx(list(np.percentile(values, [50, 99])))

    normal = voxels.ctn_normalize(bricks, voxels.mask_bricks(bricks, "t1n"))
    extent = voxels.explode_bricks(normal).agg(F.count("value").alias("n"), F.max(F.abs("value")).alias("m")).first()
    assert extent.n == 12 * 210 and extent.m <= 1


def test_inventory_summary_statuses(spark):
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "root string")
    files = spark.createDataFrame([("a", 10), ("a", 5), ("b", None)], "root string, length long")
    rows = {r.root: (r.n_files, r.bytes, r.status) for r in inventory.inventory_summary(expected, files).collect()}
    assert rows == {"a": (2, 15, "ok"), "b": (0, 0, "empty"), "c": (0, 0, "missing")}


def test_sketched_percentiles_keep_their_error(spark):
    frame = spark.range(50_000).select(F.lit("m").alias("modality"), F.col("id").cast("double").alias("value"))
    row = stats.approximate_percentiles(frame, ["modality"], {"p50": 0.5, "p99": 0.99}, accuracy=1000).first()
    assert abs(row.p50 - 25_000) <= 50 and abs(row.p99 - 49_500) <= 50


def test_axes_of_images_and_arrays(spark):
    rng = np.random.default_rng(2)
    image = rng.normal(size=(5, 4, 3, 2)).astype(np.float32)
    files = {
        "four": volumes.write_nifti(image),
        "flat": volumes.write_nifti(image[..., :1]),
        "five": volumes.write_nifti(image.reshape(5, 4, 3, 2, 1)),
        "six": volumes.write_nifti(np.zeros((2, 2, 2, 2, 2), np.float32)),
    }
    frame = spark.createDataFrame(list(files.items()), "path string, content binary")
    rows = volumes.decode_volumes(frame, size=(8, 8, 8)).collect()
    found = {(r.path, r.channel): (r.status, r.channels, r.nx, r.ny, r.nz) for r in rows}
    for path in ("four", "five"):
        for channel in (0, 1):
            assert found[path, channel] == ("ok", 2, 5, 4, 3)
    assert found["flat", 0] == ("ok", 1, 5, 4, 3) and found["six", None][0] == "error" and len(found) == 6
    second = next(r.values if isinstance(r.values, list) else r["values"] for r in rows if (r.path, r.channel) == ("four", 1))
    np.testing.assert_allclose(second, image[..., 1].ravel())


def test_nothing_is_lost_between_file_and_table(spark):
    one, four = np.ones((2, 2, 2), np.float32), np.ones((2, 2, 2, 4), np.float32)
    mask = np.zeros((2, 2, 2), np.float32)
    mask[1, 0, 1], mask[0, 0, 0] = 3, 1
    names = {
        "/a/c1-t1n.nii.gz": volumes.write_nifti(one),
        "/a/c1-seg.nii.gz": volumes.write_nifti(mask),
        "/a/c1-other.nii.gz": volumes.write_nifti(one),
        "/a/c1.nii": volumes.write_nifti(one),
        "/a/c2-t1c.nii.gz": volumes.write_nifti(four),
        "/a/c3-t1c.nii.gz": b"broken",
    }
    decoded = volumes.decode_volumes(spark.createDataFrame(list(names.items()), "path string, content binary"))
    assert [(r.case_id, r.modality) for r in volumes.scan_bricks(decoded).collect()] == [("c1", "t1n")]
    labelled = volumes.segmentation_voxels(decoded)
    assert labelled.count() == 8
    voxels_ = [tuple(r) for r in labelled.where("label <> 0").orderBy("label").collect()]
    assert voxels_ == [("c1", 0, 0, 0, 1), ("c1", 1, 0, 1, 3)]
    problems = {r.path: r.problem for r in volumes.undecodable_files(decoded).collect()}
    assert problems == {
        "/a/c1-other.nii.gz": "unnamed",
        "/a/c1.nii": "unnamed",
        "/a/c2-t1c.nii.gz": "several channels",
        "/a/c3-t1c.nii.gz": "unreadable",
    }


def test_labels_are_found_by_header(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text(" ET ,Case,grade_proxy,wt,tc,ET_volume,wt_volume,tc_volume,extra\n1, c1 ,0,1,,2.5,3,4,x\n1,c2,yes,1,1,1,2,3,x\n")
    row = tables.read_labels(spark, str(path)).collect()
    assert [(r.case_id, r.et, r.label, r.tc, r.et_volume, r.wt_volume) for r in row] == [("c1", 1, 0, None, 2.5, 3.0)]
    assert [tuple(r) for r in tables.malformed_labels(spark, str(path)).collect()] == [("c2", "grade_proxy")]
    path.write_text("case,et\nc1,1\n")
    with pytest.raises(ValueError, match="lacks the columns tc"):
        tables.read_labels(spark, str(path))


def test_both_log_forms_and_odd_losses(spark):
    lines = [
        "2024-01-01 00:00:00,123 INFO Epoch   1 | Train: loss=nan acc=0.5 | Val: loss=-0.25 acc=0.75 f1=0",
        "Epoch 3/50 | train_loss=1e-05 train_acc=0.5 | val_loss=inf val_acc=0.75",
        "Epoch starts",
    ]
    rows = history.parse_epoch_lines(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("epoch").collect()
    assert [r.epoch for r in rows] == [1, 3] and np.isnan(rows[0].train_loss) and rows[0].val_loss == -0.25
    assert rows[1].train_loss == 1e-05 and np.isinf(rows[1].val_loss) and rows[1].ts is None


def test_crop_and_flip_of_uneven_bricks(spark):
    volume = np.random.default_rng(4).normal(size=(7, 6, 5)).astype(np.float32)
    files = spark.createDataFrame([("/c-t1n.nii.gz", volumes.write_nifti(volume))], "path string, content binary")
    bricks = volumes.scan_bricks(volumes.decode_volumes(files, size=(3, 4, 2)))

    def dense(frame, shape):
        out = np.full(shape, np.nan)
        for r in voxels.explode_bricks(frame).collect():
            out[r.x, r.y, r.z] = r.value
        return out

    cropped = voxels.crop_bricks(bricks, volume.shape, (3, 9, 4))
    np.testing.assert_allclose(dense(cropped, (3, 6, 4)), volume[2:5, :, :4])
    np.testing.assert_allclose(dense(voxels.flip_bricks(bricks, "y", 6), volume.shape), volume[:, ::-1])


def test_small_volumes_leave_in_short_batches():
    """Thousands of small files in one batch: as many rows of it at a time as ``OUTPUT_ROWS`` and one file allow."""

    class Files:
        def select(self, *columns):
            return self

        def mapInPandas(self, decode, schema):
            return decode

    content = volumes.write_nifti(np.ones((4, 4, 4), np.float32))
    batch = pd.DataFrame({"path": [f"/a/{i}.nii.gz" for i in range(3000)], "content": [content] * 3000})
    sizes = [len(frame) for frame in volumes.decode_volumes(Files(), size=(3, 3, 3))(iter([batch]))]
    assert sum(sizes) == 8 * 3000 and max(sizes) <= volumes.OUTPUT_ROWS + 8
