"""Streams against their batch results, over several batches and restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from voxelarium.operators import longitudinal
from voxelarium.sinks import tables as sinks
from voxelarium.storage import new_folder
from voxelarium.streaming import jobs

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def events(spark):
    """Five files in time order, then a file with one row far behind the watermark."""
    path = new_folder(spark, "events")
    rows = spark.range(2000).select(
        F.col("id").alias("event_id"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 600_000_000).alias("ts"),
        (F.col("id") % 3).alias("user_id"),
        F.when(F.col("id") % 5 == 0, "error").otherwise("view").alias("event_type"),
        (F.col("id") % 17 - 3).cast("double").alias("value"),
    )
    for i in range(5):
        rows.where(f"event_id between {400 * i} and {400 * i + 399}").coalesce(1).write.mode("append").parquet(path)
    return path, rows


def test_windows_over_many_batches(spark, events):
    path, rows = events
    rows.limit(1).withColumn("value", F.lit(1e6)).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.read_files(spark, path, files_per_batch=1)
    windows = jobs.windowed_moments(stream, ["event_type"], "ts", "value", "1 day")
    sink = new_folder(spark, "windows")
    jobs.write_closed_windows(windows, sink, new_folder(spark, "progress"))
    found = {(r.start, r.event_type): (r.n, r.s, r.mx) for r in spark.read.parquet(sink).collect()}
    batch = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(
        F.count("value").alias("n"), F.sum("value").alias("s"), F.max("value").alias("mx")
    )
    last = rows.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    expected = {(r.w.start, r.event_type): (r.n, r.s, r.mx) for r in batch.collect() if r.w.end <= last}
    assert len(expected) == 26 and found == expected


def test_ingest_resumes_without_duplicates(spark, events):
    path, rows = events
    labels, errors, progress = (new_folder(spark, p) for p in ("labels", "errors", "progress"))

    def run():
        stream = jobs.read_files(spark, path, files_per_batch=2)
        status = F.when(F.col("event_type") == "error", "exception").otherwise("ok")
        ready = stream.select(F.col("event_id").alias("case_id"), "value", status.alias("status"))
        jobs.incremental_ingest(ready, labels, errors, progress)

    run()
    first = spark.read.parquet(labels).count()
    run()
    assert first == spark.read.parquet(labels).count() == 1600
    extra = rows.limit(3).withColumn("event_id", F.lit(5000) + F.col("event_id")).withColumn("event_type", F.lit("view"))
    extra.coalesce(1).write.mode("append").parquet(path)
    run()
    assert sinks.current_labels(spark.read.parquet(labels)).count() == 1603
    assert spark.read.parquet(errors).count() == 400


def test_repeated_batch_is_idempotent(spark):
    labels = spark.range(100).select(F.col("id").alias("case_id"), (F.col("id") % 2).alias("label"))
    path = new_folder(spark, "labels")
    for batch in (3, 3, 4):
        sinks.append_labels(labels, path, batch)
    assert sinks.current_labels(spark.read.parquet(path)).exceptAll(labels).isEmpty()


def test_sessions_stream_equals_batch(spark, events):
    path, rows = events
    gappy = rows.where("event_id % 97 < 40")
    source = new_folder(spark, "gappy")
    gappy.write.parquet(source)
    windows = jobs.windowed_sessions(jobs.read_files(spark, source), ["user_id"], "ts", "value", "6 hours")
    sink = new_folder(spark, "sessions")
    jobs.write_closed_windows(windows, sink, new_folder(spark, "progress"))
    found = sorted((r.user_id, r.start, r.n) for r in spark.read.parquet(sink).collect())
    batch = longitudinal.session_activity(gappy.withColumnRenamed("user_id", "patient"), 6).collect()
    last = gappy.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    expected = sorted((r.patient, r.started, r.n) for r in batch if r.ended + dt.timedelta(hours=6) <= last)
    assert len(expected) > 10 and found == expected


def test_early_stop_state_survives_batches(spark):
    losses = [5.0, 4.0, 4.5, 4.2, 3.0, 3.1, 3.2, 3.3]
    source = new_folder(spark, "epochs")
    for i, v in enumerate(losses, 1):
        frame = spark.createDataFrame([("a", i, v), ("b", i, -v)], "run string, epoch int, val_loss double")
        frame.coalesce(1).write.mode("append").parquet(source)
    sink = new_folder(spark, "monitor")
    monitor = jobs.early_stop_monitor(jobs.read_files(spark, source, files_per_batch=3), 3)
    with jobs.rocksdb_state(spark):
        jobs.write_closed_windows(monitor, sink, new_folder(spark, "progress"))
    rows = {(r.run, r.epoch): (r.best, r.counter, r.stop) for r in spark.read.parquet(sink).collect()}
    assert [rows["a", i][1] for i in range(1, 9)] == [0, 0, 1, 2, 0, 1, 2, 3]
    assert rows["a", 8] == (3.0, 3, 1) and rows["b", 8] == (-5.0, 7, 1)


def test_late_epochs_are_reported_and_change_nothing(spark):
    source, sink = new_folder(spark, "epochs"), new_folder(spark, "monitor")
    monitor_of = lambda: jobs.early_stop_monitor(jobs.read_files(spark, source), 2)
    progress = new_folder(spark, "progress")
    for rows in ([("a", 2, 1.0), ("a", 3, 2.0)], [("a", 1, 0.1), ("a", 4, 3.0)]):
        frame = spark.createDataFrame(rows, "run string, epoch int, val_loss double")
        frame.coalesce(1).write.mode("append").parquet(source)
        with jobs.rocksdb_state(spark):
            jobs.write_closed_windows(monitor_of(), sink, progress)
    found = sorted((r.epoch, r.best, r.counter, r.stop, r.late) for r in spark.read.parquet(sink).collect())
    assert found == [(1, 1.0, 1, 0, 1), (2, 1.0, 0, 0, 0), (3, 1.0, 1, 0, 0), (4, 1.0, 2, 1, 0)]


def test_repeated_batch_does_not_double_errors(spark):
    rows = spark.range(20).select(F.col("id").alias("case_id"), F.lit("exception").alias("status"))
    path = new_folder(spark, "errors")
    for batch in (1, 1, 2):
        sinks.quarantine(rows, path, batch)
    assert sinks.current_errors(spark.read.parquet(path)).count() == 20


def test_updates_and_late_rows(spark, events):
    """All windows after every batch; the row behind the watermark is counted apart, a restart changes nothing."""
    path, rows = events
    folder, progress = new_folder(spark, "updates"), new_folder(spark, "progress")

    def run():
        stream = jobs.read_files(spark, path, files_per_batch=1)
        jobs.updating_moments(stream, ["event_type"], "ts", "value", "1 day", folder, progress)

    def found():
        windows = jobs.current_windows(spark, folder, ["event_type"]).collect()
        return {(r.start, r.event_type): (r.n, r.s, r.mx) for r in windows}

    run()
    batch = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(
        F.count("value").alias("n"), F.sum("value").alias("s"), F.max("value").alias("mx")
    )
    expected = {(r.w.start, r.event_type): (r.n, r.s, r.mx) for r in batch.collect()}
    assert found() == expected and jobs.late_rows(spark, folder).count() == 0
    rows.limit(1).withColumn("value", F.lit(1e6)).coalesce(1).write.mode("append").parquet(path)
    run()
    run()
    assert found() == expected
    assert [(r.event_id, r.value) for r in jobs.late_rows(spark, folder).collect()] == [(0, 1e6)]


def test_decoding_scan_files_as_they_arrive(spark, tmp_path):
    import numpy as np

    from voxelarium.sources import volumes

    folder = tmp_path / "scans"
    folder.mkdir()
    bricks, errors, progress = (new_folder(spark, p) for p in ("bricks", "errors", "progress"))

    def run():
        jobs.decoding_ingest(jobs.read_scans(spark, str(folder), "*.nii.gz", 1), bricks, errors, progress, size=(2, 2, 2))

    for i in range(2):
        (folder / f"c{i}-t1n.nii.gz").write_bytes(volumes.write_nifti(np.full((4, 4, 4), i, np.float32)))
    (folder / "c9-t1n.nii.gz").write_bytes(b"broken")
    run()
    run()
    (folder / "c2-t1n.nii.gz").write_bytes(volumes.write_nifti(np.full((4, 4, 4), 2, np.float32)))
    run()
    stored = spark.read.parquet(bricks)
    assert stored.count() == 24 and stored.where("channels = 1").selectExpr("sum(aggregate(values, 0f, (a, x) -> a + x))").first()[0] == 64 + 128
    assert [r.path.rsplit("/", 1)[1] for r in spark.read.parquet(errors).collect()] == ["c9-t1n.nii.gz"]
