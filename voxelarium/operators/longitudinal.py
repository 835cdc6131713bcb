"""Patients over time.

Scans are reduced to one row per patient and day before any window, so the
length of a patient's window is bounded by the calendar and not by the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelarium.operators.distributed import join_summary
from voxelarium.operators.voxels import AXES, BRICK_SHAPE, voxel_position
from voxelarium.storage import materialise


def daily_volumes(df: DataFrame, order: str, patient: str = "patient", value: str = "value") -> DataFrame:
    """Volume and number of the measurements of each patient and day.

    They are added one after the other by the key ``order``: sums of doubles that shuffles
    put together differ in their last bit from run to run, which makes growth of days with
    equal volumes.  A group holds one patient's measurements of one day.
    """
    measured = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value))))
    total = F.aggregate(F.col("_m"), F.lit(0.0), lambda a, m: a + m[value].cast("double"))
    grouped = df.groupBy(patient, "day").agg(measured.alias("_m"), F.count(F.lit(1)).alias("n"))
    return grouped.select(patient, "day", F.when(F.size("_m") > 0, total).alias("volume"), "n")


def _by_day(patient: str):
    return Window.partitionBy(patient).orderBy("day")


def sphere_diameter(volume: Column) -> Column:
    """Diameter of the sphere of that volume, our stand-in for the measured diameter."""
    return F.cbrt(6 * volume / F.pi())


def progression(
    timeline: DataFrame,
    patient: str = "patient",
    pd_growth: float = 0.25,
    pd_diameter: float = 5.0,
    pr_shrink: float = 0.65,
) -> DataFrame:
    """Change against the previous scan and the lowest earlier volume, and the response category.

    Progressive disease needs both the relative growth and the diameter growth
    over the lowest volume; complete response is an empty volume; partial
    response is a shrinkage from the first scan (a parameter of ours).
    """
    w = _by_day(patient)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    v = F.col("volume")
    known = timeline.withColumns(
        {
            "previous": F.lag("volume").over(w),
            "nadir": F.min("volume").over(past),
            "baseline": F.first("volume").over(past),
        }
    )
    grown = known.withColumns(
        {
            "dv_previous": F.try_divide(v - F.col("previous"), F.col("previous")),
            "dv_nadir": F.try_divide(v - F.col("nadir"), F.col("nadir")),
            "dd_nadir": sphere_diameter(v) - sphere_diameter(F.col("nadir")),
            "dv_baseline": F.try_divide(v - F.col("baseline"), F.col("baseline")),
        }
    )
    response = (
        F.when(F.col("nadir").isNull(), "BASELINE")
        .when(v <= 0, "CR")
        .when((F.col("dv_nadir") >= pd_growth) & (F.col("dd_nadir") >= pd_diameter), "PD")
        .when(F.col("dv_baseline") <= -pr_shrink, "PR")
        .otherwise("SD")
    )
    return grown.withColumn("response", response)


def doubling_time(timeline: DataFrame, patient: str = "patient") -> DataFrame:
    """Days to double at the growth since the previous scan, NULL when not growing."""
    w = _by_day(patient)
    gap = F.datediff("day", F.lag("day").over(w))
    previous = F.lag("volume").over(w)
    growing = (previous > 0) & (F.col("volume") > previous)
    days = F.when(growing, F.ln(F.lit(2.0)) * gap / F.ln(F.col("volume") / previous))
    return timeline.withColumn("doubling_days", days)


def dense_timeline(timeline: DataFrame, patient: str = "patient") -> DataFrame:
    """Every day between first and last scan, the last volume carried forward, days since the scan."""
    span = timeline.groupBy(patient).agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    grid = span.select(patient, F.explode(F.sequence("d0", "d1")).alias("day"))
    joined = grid.join(timeline.select(patient, "day", "volume"), [patient, "day"], "left")
    filled = _by_day(patient).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col("volume").isNotNull(), F.col("day")), ignorenulls=True).over(filled)
    return joined.select(
        patient,
        "day",
        F.last("volume", ignorenulls=True).over(filled).alias("volume"),
        F.datediff("day", seen).alias("days_since_scan"),
        F.col("volume").isNull().cast("int").alias("carried"),
    )


def delta_image(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Voxelwise ``before - after`` of two brick sets that share ``key``; the join is between bricks."""
    same = [key, "modality", *BRICK_SHAPE]
    pair = before.select(*same, F.col("values").alias("pre")).join(
        after.select(*same, F.col("values").alias("post")), same
    )
    cells = pair.select(key, "modality", *BRICK_SHAPE, F.posexplode(F.arrays_zip("pre", "post")).alias("_p", "_c"))
    delta = F.col("_c.pre").cast("double") - F.col("_c.post").cast("double")
    return cells.select(key, "modality", *voxel_position(), delta.alias("delta")).select(
        key, "modality", *AXES, "delta"
    )


def _packed_regions(bricks: DataFrame, regions: Mapping[str, Sequence[int]]) -> list[Column]:
    """For each region the voxels that belong to it as bits, 63 to a long."""
    words = F.sequence(F.lit(0), F.ceil(F.size("values") / 63).cast("int") - 1)

    def packed(labels: Sequence[int]) -> Column:
        def word(w: Column) -> Column:
            part = F.slice(F.col("values"), w * 63 + 1, F.lit(63))
            return F.aggregate(
                part, F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, 1).bitwiseOR(F.rint(v).cast("int").isin(list(labels)).cast("long"))
            )

        return F.when(F.size("values") > 0, F.transform(words, word)).otherwise(F.array().cast("array<bigint>"))

    return [packed(labels).alias(f"r{i}") for i, labels in enumerate(regions.values())]


def temporal_consistency(before: DataFrame, after: DataFrame, key: str, regions: Mapping[str, Sequence[int]]) -> DataFrame:
    """How much of each region two masks of ``key`` share: voxels of both visits, kept, new and gone, Dice, Jaccard.

    Bricks carry a bit per voxel and region, are joined by place, and only numbers of set
    bits leave them.  A brick that one visit lacks counts as background; patients without a
    second mask are left out.  Two absent regions agree, score 1.
    """
    place = [key, "bx", "by", "bz"]
    names, many = list(regions), range(len(regions))

    def bits(bricks: DataFrame, side: str) -> DataFrame:
        return bricks.select(*place, *_packed_regions(bricks, regions)).withColumnsRenamed({f"r{i}": f"{side}{i}" for i in many})

    def ones(words: Column) -> Column:
        return F.aggregate(F.coalesce(words, F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w))

    both = bits(before, "a").join(bits(after, "b"), place, "full")
    seen = [F.max(F.col(f"{side}0").isNotNull()).alias(f"has_{side}") for side in "ab"]
    sums = []
    for i in many:
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        shared = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).bitwiseAND(F.coalesce(y, F.lit(0))))
        sums += [F.sum(ones(a)).alias(f"a{i}"), F.sum(ones(b)).alias(f"b{i}"), F.sum(ones(shared)).alias(f"o{i}")]
    wide = both.groupBy(key).agg(*seen, *sums).where("has_a and has_b")
    cells = [
        F.struct(F.lit(names[i]).alias("region"), F.col(f"a{i}").alias("n_before"), F.col(f"b{i}").alias("n_after"), F.col(f"o{i}").alias("n_both"))
        for i in many
    ]
    long = wide.select(key, F.inline(F.array(*cells)))
    a, b, o = F.col("n_before"), F.col("n_after"), F.col("n_both")
    return long.select(
        key, "region", "n_before", "n_after", "n_both", (b - o).alias("n_appeared"), (a - o).alias("n_vanished"),
        F.coalesce(F.try_divide(2.0 * o, a + b), F.lit(1.0)).alias("dice"),
        F.coalesce(F.try_divide(o.cast("double"), a + b - o), F.lit(1.0)).alias("jaccard"),
    )


def as_of(asked: DataFrame, measured: DataFrame, key: str, time: str, value: str, period: str = "DAY") -> DataFrame:
    """``asked`` with the last ``value`` measured at or before its ``time``, and when that was.

    Both timelines are united and sorted once inside each key and ``period``; what was last
    known before a period is carried in from a table with one row per key and period that
    has measurements.  A key with most of all rows is thus sorted in as many tasks as it has
    periods, and no row is made for times without one.  Of measurements at the same time
    the largest value counts.  Rows without a key or time have no value.
    """
    bucket = F.date_trunc(period, F.col(time).cast("timestamp"))
    taken = measured.where(F.col(value).isNotNull() & F.col(time).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key), F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("_new"), bucket.alias("_period")
    )
    last = taken.groupBy(key, "_period").agg(F.max("_new").alias("_last"))
    carried = materialise(
        last.union(asked.where(F.col(time).isNotNull()).select(key, bucket, F.lit(None).cast(last.schema["_last"].dataType)).distinct())
        .groupBy(key, "_period").agg(F.max("_last").alias("_last"))
        .withColumn("_before", F.max("_last").over(Window.partitionBy(key).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)))
        .select(key, "_period", "_before"),
        "carried",
    )
    # Measurements come before questions of the same time.
    rows = asked.withColumns({"_at": F.col(time), "_side": F.lit(1), "_period": bucket, "_new": F.lit(None).cast(taken.schema["_new"].dataType)})
    new = taken.select(*[F.col(key) if c == key else F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in asked.columns],
                       F.col("_new.t").alias("_at"), F.lit(0).alias("_side"), "_period", "_new")
    order = Window.partitionBy(key, "_period").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.unionByName(new).withColumn("_seen", F.max("_new").over(order)).where("_side = 1")
    known = F.coalesce("_seen", "_before")
    out = seen.join(carried, [key, "_period"], "left")
    return out.select(*[F.col(c) for c in asked.columns], known["v"].alias(value), known["t"].alias("measured_at"))


def kaplan_meier(df: DataFrame, group: str, time: str = "time", event: str = "event") -> DataFrame:
    """Product-limit survival per group at every distinct time, in whole days.

    The table of distinct days is as long as the study, however many cases it has.
    """
    steps = df.groupBy(group, F.col(time).cast("int").alias(time)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(event) == 1).alias("n_events")
    )
    w = Window.partitionBy(group).orderBy(time)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(Window.partitionBy(group))
    earlier = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    risk = steps.withColumn("at_risk", total - earlier).withColumn(
        "_s", 1 - F.col("n_events") / F.col("at_risk")
    )
    gone = F.min("_s").over(upto) <= 0
    product = F.exp(F.sum(F.when(F.col("_s") > 0, F.ln("_s")).otherwise(0.0)).over(upto))
    return risk.select(
        group, time, "at_risk", "n_events", F.when(gone, 0.0).otherwise(product).alias("survival")
    )


def site_harmonise(df: DataFrame, site: str, value: str) -> DataFrame:
    """Give every site the location and scale of the whole cohort.

    This is the location and scale part of ComBat without its empirical-Bayes prior.
    """
    v = F.col(value).cast("double")
    acc = df.groupBy(site).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("s2"))
    total = acc.agg(F.struct(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2")).alias("t"))

    def spread(n: Column, s: Column, s2: Column) -> Column:
        return F.sqrt(F.greatest((s2 - s * s / n) / n, F.lit(0.0)))

    local = acc.withColumn("_t", total.scalar()).select(
        site,
        (F.col("s") / F.col("n")).alias("_m"),
        spread(F.col("n"), F.col("s"), F.col("s2")).alias("_d"),
        (F.col("_t.s") / F.col("_t.n")).alias("_gm"),
        spread(F.col("_t.n"), F.col("_t.s"), F.col("_t.s2")).alias("_gd"),
    )
    scaled = F.coalesce(F.try_divide(v - F.col("_m"), F.col("_d")), F.lit(0.0)) * F.col("_gd") + F.col("_gm")
    return join_summary(df, local, [site]).withColumn("harmonised", scaled).drop("_m", "_d", "_gm", "_gd")


def session_activity(
    df: DataFrame, gap_hours: int, keys: Sequence[str] = ("patient",), ts: str = "ts", value: str = "value"
) -> DataFrame:
    """Scan sessions separated by at least ``gap_hours``.

    Rows are first reduced to one cell per hour; a cell is shorter than any gap,
    so its first and last time are all the sessions need.
    """
    keys = list(keys)
    cells = df.groupBy(*keys, F.date_trunc("hour", ts).alias("_cell")).agg(
        F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("s")
    )
    w = Window.partitionBy(*keys).orderBy("_cell")
    quiet = F.unix_micros("lo") - F.unix_micros(F.lag("hi").over(w)) >= gap_hours * 3_600_000_000
    started = F.when(quiet | F.lag("hi").over(w).isNull(), 1).otherwise(0)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = cells.withColumn("_new", started).withColumn("session", F.sum("_new").over(upto))
    return numbered.groupBy(*keys, "session").agg(
        F.min("lo").alias("started"), F.max("hi").alias("ended"), F.sum("n").alias("n"), F.sum("s").alias("total")
    )
