"""Structured Streaming jobs: resumable ingest, running statistics, sessions, monitors.

All jobs read files as they appear, keep their progress in a checkpoint in the
shared folder, and stop when nothing is left (``availableNow``); a scheduler can
start them again, and they go on where they stopped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxelarium.sinks.tables import append_labels, quarantine
from voxelarium.sources.volumes import decode_volumes

LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of a parquet table, a folder or a single file, with the schema of its files.

    A single file is only accepted as a pattern, so the last letter is given as
    a set of one.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def incremental_ingest(rows: DataFrame, labels_path: str, errors_path: str, checkpoint: str) -> None:
    """Append good rows as labels and quarantine failed ones, batch by batch.

    ``rows`` carries ``status``.  A batch repeated after a failure appends copies
    that ``current_labels`` and ``current_errors`` remove by key.
    """
    def store(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            append_labels(batch.where(F.col("status") == "ok").drop("status"), labels_path, number)
            quarantine(batch, errors_path, number)
        finally:
            batch.unpersist()

    run_to_end(rows.writeStream.foreachBatch(store), checkpoint)


def windowed_moments(
    events: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    width: str,
    slide: str | None = None,
    lateness: str = "1 hour",
) -> DataFrame:
    """Additive accumulators per event-time window; tumbling, or sliding with ``slide``."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    v = F.col(value)
    return (
        stamped.groupBy(window, *keys)
        .agg(
            F.sum(v).alias("s"),
            F.sum(v * v).alias("s2"),
            F.count(v).alias("n"),
            F.count_if(v > 0).alias("npos"),
            F.min(v).alias("mn"),
            F.max(v).alias("mx"),
        )
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys,
                "s", "s2", "n", "npos", "mn", "mx")
    )


def windowed_sessions(
    events: DataFrame, keys: Sequence[str], ts: str, value: str, gap: str, lateness: str = "1 hour"
) -> DataFrame:
    """Sessions per key, emitted once the watermark has passed their end."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return (
        stamped.groupBy(F.session_window(ts, gap), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"),
                *keys, "n", "total")
    )


def write_closed_windows(windows: DataFrame, sink: str, checkpoint: str) -> None:
    """Append finished windows to a table; open ones stay in the state.

    Sessions of a key merge inside each task first, so that a hot key sends few rows on.
    """
    with session_setting(windows.sparkSession, LOCAL_MERGE, "true"):
        run_to_end(windows.writeStream.outputMode("append").format("parquet").option("path", sink), checkpoint)


def updating_moments(
    events: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    width: str,
    folder: str,
    checkpoint: str,
    lateness: str = "1 hour",
) -> None:
    """Keep moments of every window, open ones too, up to date after each batch; late rows go to a table of their own.

    A batch adds its accumulators per window and key, ``current_windows`` merges them, so no
    window is rewritten and a hot one is a few rows a batch.  A row is late if it is more
    than ``lateness`` older than the newest of all earlier batches.  Every batch writes
    folders of its own number, again if it is repeated after a failure, and takes the newest
    time from earlier numbers only: a repeated batch decides and counts the same.
    """
    spark = events.sparkSession

    def newest_before(number: int) -> Column:
        path = f"{folder}/newest"
        if number == 0:
            return F.lit(None).cast("timestamp")
        marks = spark.read.schema("batch long, newest timestamp").parquet(path)
        return F.lit(marks.where(F.col("batch") < number).agg(F.max("newest")).first()[0]).cast("timestamp")

    def written(rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    def store(batch: DataFrame, number: int) -> None:
        stamped = batch.withColumn(ts, F.col(ts).cast("timestamp"))
        edge = newest_before(number) - F.expr(f"INTERVAL {lateness}")
        late = F.coalesce(F.col(ts) < edge, F.lit(False))
        written(stamped.where(late), "late", number)
        v = F.col(value)
        sums = (
            stamped.where(~late).groupBy(F.window(ts, width), *keys)
            .agg(F.sum(v).alias("s"), F.sum(v * v).alias("s2"), F.count(v).alias("n"), F.count_if(v > 0).alias("npos"), F.min(v).alias("mn"), F.max(v).alias("mx"))
            .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "s", "s2", "n", "npos", "mn", "mx")
        )
        written(sums, "windows", number)
        written(stamped.agg(F.max(ts).alias("newest")), "newest", number)

    run_to_end(events.writeStream.foreachBatch(store), checkpoint)


def current_windows(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """One row per window and key: the merged accumulators of all batches so far."""
    parts = spark.read.parquet(f"{folder}/windows").drop("batch")
    sums = [F.sum(c).alias(c) for c in ("s", "s2", "n", "npos")]
    return parts.groupBy("start", "end", *keys).agg(*sums, F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that came too late, with the batch they came in."""
    return spark.read.parquet(f"{folder}/late")


def decoding_ingest(files: DataFrame, bricks_path: str, errors_path: str, checkpoint: str, **decoding) -> None:
    """Decode scan files of a stream (``path, content``), store bricks and quarantine files that fail.

    Each batch writes folders of its own number, again if it is repeated, so a restart adds
    nothing.  Files are decoded twice, once for each table, rather than held on executors.
    """

    def store(batch: DataFrame, number: int) -> None:
        decoded = decode_volumes(batch.select("path", "content"), **decoding)
        good = decoded.where("status = 'ok'").drop("status", "error")
        good.write.mode("overwrite").parquet(f"{bricks_path}/batch={number}")
        failed = decoded.where("status <> 'ok'").select("path", "status", "error")
        failed.write.mode("overwrite").parquet(f"{errors_path}/batch={number}")

    run_to_end(files.writeStream.foreachBatch(store), checkpoint)


def read_scans(spark: SparkSession, folder: str, pattern: str = "*", files_per_batch: int | None = None) -> DataFrame:
    """Stream of the scan files that appear below a folder."""
    reader = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    schema = "path string, modificationTime timestamp, length long, content binary"
    return reader.schema(schema).load(folder)


class _PatienceState(StatefulProcessor):
    """Best value and epochs since it, per run."""

    def __init__(self, patience: int) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("patience", "best double, counter int, last int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, counter, last = self.state.get() if self.state.exists() else (float("inf"), 0, -1)
        epochs = pd.concat(list(rows)).sort_values("epoch")
        out = []
        for epoch, value in zip(epochs["epoch"], epochs["val_loss"]):
            late = epoch <= last
            if not late:
                best, counter, last = (value, 0, int(epoch)) if value < best else (best, counter + 1, int(epoch))
            out.append((key[0], int(epoch), float(best), counter, int(counter >= self.patience), int(late)))
        self.state.update((float(best), int(counter), int(last)))
        yield pd.DataFrame(out, columns=["run", "epoch", "best", "counter", "stop", "late"])

    def close(self) -> None:
        pass


def early_stop_monitor(epochs: DataFrame, patience: int) -> DataFrame:
    """Patience counter as live state; ``epochs`` streams ``run, epoch, val_loss``.

    An epoch that arrives after a later one is reported with ``late = 1`` and the
    state as it stands, which it does not change.
    """
    return epochs.groupBy("run").transformWithStateInPandas(
        statefulProcessor=_PatienceState(patience),
        outputStructType="run string, epoch int, best double, counter int, stop int, late int",
        outputMode="append",
        timeMode="None",
    )


@contextmanager
def session_setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def rocksdb_state(spark: SparkSession):
    """Keep state on disk instead of the heap, as custom stateful operators require."""
    return session_setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def utc_seconds(ts: Column) -> Column:
    """Seconds since the epoch, free of any session time zone."""
    return F.unix_micros(ts) / 1_000_000.0
