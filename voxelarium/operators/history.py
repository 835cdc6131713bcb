"""Training histories: early stopping, plateau schedule, checkpoints, logs.

A run has one row per epoch, so a window or a fold per run stays small however
many runs there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelarium.conventions import EPOCH_LINE_PATTERNS, LOG_TIME_PATTERN


def early_stop(hist: DataFrame, patience: int, run: str = "run", metric: str = "val_loss") -> DataFrame:
    """Best epoch so far, epochs since it and whether training would stop, per epoch."""
    by_epoch = Window.partitionBy(run).orderBy("epoch")
    earlier = by_epoch.rowsBetween(Window.unboundedPreceding, -1)
    # The best starts at infinity, which a loss that is missing or not a number does not beat.
    loss = F.coalesce(F.nanvl(F.col(metric), F.lit(float("inf"))), F.lit(float("inf")))
    previous = F.coalesce(F.min(loss).over(earlier), F.lit(float("inf")))
    # The counter grows from zero and restarts at every strict improvement.
    marked = hist.withColumn("improved", loss < previous).withColumn("row", F.row_number().over(by_epoch))
    last_row = F.last(F.when(F.col("improved"), F.col("row")), ignorenulls=True).over(
        by_epoch.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = marked.withColumn("counter", F.col("row") - F.coalesce(last_row, F.lit(0)))
    stopped = F.max((F.col("counter") >= patience).cast("int")).over(earlier)
    return counted.select(
        run,
        "epoch",
        metric,
        F.col("improved").cast("int").alias("improved"),
        "counter",
        (F.col("counter") >= patience).cast("int").alias("stop"),
        F.coalesce(stopped, F.lit(0)).alias("after_stop"),
    )


def early_stop_summary(hist: DataFrame, patience: int, run: str = "run", metric: str = "val_loss") -> DataFrame:
    """Best epoch among those that run before the stop, and the stop epoch (last one if none)."""
    live = early_stop(hist, patience, run, metric).where("after_stop = 0")
    return live.groupBy(run).agg(
        F.max(F.when(F.col("improved") == 1, F.col("epoch"))).alias("best_epoch"),
        F.max("epoch").alias("stop_epoch"),
        F.max("stop").alias("stopped_early"),
    )


def plateau_lr(
    hist: DataFrame,
    initial: float,
    patience: int = 5,
    factor: float = 0.5,
    threshold: float = 1e-4,
    mode: str = "min",
    run: str = "run",
    metric: str = "val_loss",
) -> DataFrame:
    """Learning rate after each epoch: cut when more than ``patience`` epochs bring no relative gain."""
    start = F.struct(
        F.lit(None).cast("double").alias("best"),
        F.lit(0).alias("bad"),
        F.lit(float(initial)).alias("lr"),
        F.array().cast("array<struct<epoch:int,lr:double>>").alias("out"),
    )

    def step(state, row):
        bound = state["best"] * (1 - threshold if mode == "min" else 1 + threshold)
        gain = row["metric"] < bound if mode == "min" else row["metric"] > bound
        better = state["best"].isNull() | gain
        bad = F.when(better, 0).otherwise(state["bad"] + 1)
        cut = bad > patience
        lr = F.when(cut, state["lr"] * factor).otherwise(state["lr"])
        return F.struct(
            F.when(better, row["metric"]).otherwise(state["best"]).alias("best"),
            F.when(cut, 0).otherwise(bad).alias("bad"),
            lr.alias("lr"),
            F.concat(state["out"], F.array(F.struct(row["epoch"].alias("epoch"), lr.alias("lr")))).alias("out"),
        )

    row = F.struct(F.col("epoch").cast("int").alias("epoch"), F.col(metric).cast("double").alias("metric"))
    rows = F.array_sort(F.collect_list(row))
    folded = hist.groupBy(run).agg(F.aggregate(rows, start, step, lambda s: s["out"]).alias("out"))
    return folded.select(run, F.inline("out"))


def lr_changes(lrs: DataFrame, run: str = "run") -> DataFrame:
    """Epochs at which the learning rate differs from the previous one."""
    previous = F.lag("lr").over(Window.partitionBy(run).orderBy("epoch"))
    return lrs.withColumn("previous", previous).where("lr <> previous")


def growth_alerts(df: DataFrame, value: str, run: str = "run", limit: float = 1.10) -> DataFrame:
    """Rows whose value exceeds the previous one by more than ten percent."""
    previous = F.lag(value).over(Window.partitionBy(run).orderBy("epoch"))
    return df.withColumn("previous", previous).where(F.col(value) > F.col("previous") * limit)


def best_checkpoint(hist: DataFrame, metric: str, mode: str = "min", run: str = "run") -> DataFrame:
    """First epoch that attains the best value."""
    score = F.col(metric) if mode == "min" else -F.col(metric)
    best = hist.groupBy(run).agg(F.min(F.struct(score.alias("score"), "epoch", F.col(metric).alias("m"))).alias("b"))
    return best.select(run, F.col("b.epoch").alias("epoch"), F.col("b.m").alias(metric))


def parse_epoch_lines(lines: DataFrame, *keys: str, text: str = "value") -> DataFrame:
    """Epoch lines of a training log, in either form, as rows; other lines are skipped.

    Losses may be negative, in scientific notation, infinite or not a number.
    """
    line = F.col(text)

    def part(i: int) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract(line, p, i), F.lit("")) for p in EPOCH_LINE_PATTERNS])

    numbers = {
        name: part(i).try_cast("double")
        for i, name in enumerate(["train_loss", "train_acc", "val_loss", "val_acc"], start=2)
    }
    moment = F.regexp_extract(line, LOG_TIME_PATTERN, 1)
    return lines.where(part(1).isNotNull()).select(
        *keys,
        F.try_to_timestamp(F.replace(moment, F.lit(","), F.lit(".")), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).alias("ts"),
        part(1).cast("int").alias("epoch"),
        *[c.alias(name) for name, c in numbers.items()],
    )


def epoch_durations(epochs: DataFrame, run: str = "run") -> DataFrame:
    """Seconds since the previous epoch of the run, when that is its predecessor."""
    by_time = Window.partitionBy(run).orderBy("ts")
    gap = F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(by_time))
    follows = F.lag("epoch").over(by_time) == F.col("epoch") - 1
    return epochs.select(run, "epoch", F.when(follows, gap / 1000.0).alias("seconds"))
