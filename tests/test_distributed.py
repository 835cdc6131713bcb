"""Ranks, running totals and percentiles on skewed data."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelarium.operators import cohort, distributed, splits, stats
from voxelarium.storage import materialise, scratch

FRACTIONS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 0.995, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with most rows, one value with a third of them, one key with a single row."""
    rng = np.random.default_rng(7)
    hot = np.where(rng.random(6000) < 0.35, 0.0, rng.normal(size=6000).round(3))
    values = {"hot": hot, "warm": rng.exponential(size=801), "flat": np.full(50, 2.5), "one": np.array([4.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    frame = spark.createDataFrame(rows, "key string, value double").repartition(5).persist()
    return values, frame


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
@pytest.mark.parametrize("accuracy", [200, 10_000])
def test_percentiles(spark, skewed, accuracy, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    values, frame = skewed
    found = distributed.exact_percentiles(frame, ["key"], "value", FRACTIONS, accuracy).collect()
    assert len(found) == len(values)
    for row in found:
        expected = np.percentile(values[row.key], [100 * f for f in FRACTIONS])
        np.testing.assert_allclose([row[f"p{i}"] for i in range(len(FRACTIONS))], expected, atol=1e-9)
        assert (row.n, row.mn, row.mx) == (len(values[row.key]), values[row.key].min(), values[row.key].max())


def test_percentiles_of_arrays(skewed):
    values, frame = skewed
    packed = frame.groupBy("key", F.expr("pmod(hash(value), 9)")).agg(F.collect_list("value").alias("values"))
    found = distributed.exact_percentiles(packed, ["key"], "values", [0.995], 200, packed=True).collect()
    for row in found:
        assert row.p0 == pytest.approx(np.percentile(values[row.key], 99.5))


def test_running_totals(skewed):
    values, frame = skewed
    counted = frame.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = distributed.running_totals(counted, "value", ["n"], ["key"], pieces=64).collect()
    for row in rows:
        assert row.cum_n == (values[row.key] <= row.value).sum()


def test_running_totals_without_keys(spark):
    frame = spark.range(5000).withColumn("w", F.lit(2)).repartition(7)
    rows = distributed.running_totals(frame, "id", ["w"]).collect()
    assert len(rows) == 5000 and all(r.cum_w == 2 * (r.id + 1) for r in rows)


def test_hashed_rank_is_a_permutation(spark):
    frame = spark.range(3000).withColumn("g", F.when(F.col("id") < 2900, 1).otherwise(0))
    rows = distributed.hashed_rank(frame, "id", 42, ["g"]).collect()
    for g, n in ((1, 2900), (0, 100)):
        assert sorted(r.rn for r in rows if r.g == g) == list(range(1, n + 1))
        assert {r.n for r in rows if r.g == g} == {n}


def test_rank_does_not_depend_on_partitioning(spark):
    frame = spark.range(500)
    a = distributed.hashed_rank(frame.repartition(3), "id", 1).toPandas().sort_values("id")
    b = distributed.hashed_rank(frame.repartition(11), "id", 1).toPandas().sort_values("id")
    assert a.rn.tolist() == b.rn.tolist()


def test_dedup_keeps_first_of_a_hot_key(spark):
    frame = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("case_id"), F.col("id").alias("batch")
    )
    rows = {r.case_id: r.batch for r in cohort.dedup_keep_first(frame, ["case_id"], ["batch"]).collect()}
    assert rows[0] == 0 and len(rows) == 1 + 20_000 - 6667


def test_split_is_a_partition(spark):
    frame = spark.range(1003).select(F.col("id").alias("case_id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    rows = splits.stratified_split(frame, "y").groupBy("y", "split").count().collect()
    found = {(r.y, r.split): r["count"] for r in rows}
    for y, n in ((0, 859), (1, 144)):
        assert found[y, "train"] == int(n * 0.8) and found[y, "val"] == int(n * 0.1)
        assert sum(found[y, s] for s in ("train", "val", "test")) == n


def test_balanced_batches_draw_both_classes(spark):
    frame = spark.range(103).select(F.col("id").alias("case_id"), (F.col("id") < 90).cast("int").alias("y"))
    rows = splits.balanced_batches(frame, "y", 8).groupBy("batch").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    assert [(r.p, r.n) for r in rows.collect()] == [(4, 8)] * 12


def test_histogram_counts_everything_below_the_cut(skewed):
    values, frame = skewed
    rows = stats.histogram(frame, ["key"], 20).groupBy("key").agg(F.sum("n").alias("n")).collect()
    for row in rows:
        v = values[row.key]
        assert row.n == (v <= np.percentile(v, 99.5)).sum()


def test_merge_is_associative(spark, skewed):
    _, frame = skewed
    parts = frame.withColumn("a", F.expr("pmod(hash(value), 3)")).withColumn("b", F.expr("pmod(hash(value), 5)"))
    direct = stats.moments(frame, ["key"])
    via_a = stats.merge_moments(stats.moments(parts, ["key", "a"]), ["key"])
    twice = stats.merge_moments(stats.merge_moments(stats.moments(parts, ["key", "a", "b"]), ["key", "b"]), ["key"])
    for other in (via_a, twice):
        for x, y in zip(direct.orderBy("key").collect(), other.orderBy("key").collect()):
            assert (x.n, x.npos, x.mn, x.mx) == (y.n, y.npos, y.mn, y.mx)
            assert x.s == pytest.approx(y.s) and x.s2 == pytest.approx(y.s2)


def test_ranks_of_texts(spark):
    names = [f"BraTS-{i * 7919 % 5003:05d}" for i in range(5003)]
    frame = spark.createDataFrame([(n, i % 2) for i, n in enumerate(names)], "name string, g int").repartition(5)
    for keys, groups in (([], [names]), (["g"], [names[0::2], names[1::2]])):
        found = {r.name: r.rn for r in distributed.ordered_rank(frame, "name", keys).collect()}
        for group in groups:
            assert [found[n] for n in sorted(group)] == list(range(1, len(group) + 1))


def test_scratch_removes_its_folders(spark):
    with scratch(spark):
        inner = materialise(spark.range(3), "kept")
        with scratch(spark):
            other = materialise(spark.range(3), "gone")
            paths = [f.rsplit("/", 1)[0].removeprefix("file://") for f in (inner.inputFiles()[0], other.inputFiles()[0])]
        assert os.path.isdir(paths[0]) and not os.path.isdir(paths[1])
    assert not os.path.isdir(paths[0])
