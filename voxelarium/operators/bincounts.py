"""Counts taken inside bricks: exact percentiles, moments, label and value histograms of volumes.

A brick stays one row.  Each pass reads arrays in Arrow batches and returns what a brick
adds to its volume, a few numbers or sparse counts, which a hash aggregate sums up.  No
voxel becomes a row and none is sorted across bricks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from voxelarium.operators.distributed import join_summary
from voxelarium.storage import materialise

#: Bits of a value's code that one pass resolves: at most 65,536 counts of a volume and parent.
STEP = 16


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all arrays and the row of each; null elements are left out."""
    rows = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = column.flatten()
    if flat.null_count:
        rows, flat = rows[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
    return flat.to_numpy(zero_copy_only=False), rows


def _per_brick(
    bricks: DataFrame,
    keys: Sequence[str],
    columns: Sequence[Column],
    added: str,
    work: Callable[[list[pa.Array]], tuple[np.ndarray, list[np.ndarray]]],
) -> DataFrame:
    """``keys`` and the ``added`` columns: ``work`` gives a row of the batch for each, and their values."""
    source = bricks.select(*keys, *columns)
    extra = T.StructType.fromDDL(added)
    schema = T.StructType([source.schema[k] for k in keys] + extra.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = work(batch.columns[len(keys) :])
            kept = [batch.column(i).take(pa.array(rows)) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, values)], names=schema.names)

    return source.mapInArrow(run, schema)


def label_histogram(bricks: DataFrame, keys: Sequence[str] = ("case_id",), values: str = "values") -> DataFrame:
    """``keys, label, voxels`` with every label that occurs, background included."""

    def count(columns: list[pa.Array]) -> tuple[np.ndarray, list[np.ndarray]]:
        found, rows = _flat(columns[0])
        labels = np.rint(found).astype(np.int64)
        pairs, n = np.unique(np.stack([rows, labels]), axis=1, return_counts=True) if len(rows) else (np.empty((2, 0), np.int64), np.empty(0, np.int64))
        return pairs[0], [pairs[1].astype(np.int32), n]

    counted = _per_brick(bricks, keys, [F.col(values)], "label int, voxels long", count)
    return counted.groupBy(*keys, "label").agg(F.sum("voxels").alias("voxels"))


def _codes(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the values; not-a-number is above infinity, both zeros are one."""
    values = np.where(np.isnan(values), np.nan, values + values.dtype.type(0))
    bits = values.view(np.int32 if values.dtype == np.float32 else np.int64)
    low = np.iinfo(bits.dtype).max
    return (bits ^ ((bits >> (8 * bits.itemsize - 1)) & low)).astype(np.int64)


def _decoded(codes: np.ndarray, wide: bool) -> np.ndarray:
    kind = np.int64 if wide else np.int32
    bits = codes.astype(kind)
    bits ^= (bits >> (8 * bits.itemsize - 1)) & np.iinfo(kind).max
    return bits.view(np.float64 if wide else np.float32).astype(np.float64)


def volume_percentiles(
    bricks: DataFrame, keys: Sequence[str], fractions: Sequence[float], values: str = "values", neighbours: bool = False
) -> DataFrame:
    """Linear-interpolation percentiles per volume, exact: ``keys, n`` and ``p{i}`` of the i-th fraction.

    Values become integer codes of the same order.  The first pass counts their upper 16
    bits, each further one the next 16 bits of the values that share a wanted rank's bits so
    far; a float takes two passes, a double four.  Volumes without a value give no row.
    With ``neighbours`` also ``p{i}_lo`` and ``p{i}_hi``, the data on both sides.
    """
    keys = list(keys)
    wide = isinstance(bricks.schema[values].dataType.elementType, T.DoubleType)
    bits, many = (64 if wide else 32), 2 * len(fractions)
    state = None
    for shift in range(bits - STEP, -1, -STEP):
        wanted = [f"parent{t}" for t in range(many)] if state is not None else []

        def count(columns: list[pa.Array], shift: int = shift, wanted: int = len(wanted)) -> tuple[np.ndarray, list[np.ndarray]]:
            found, rows = _flat(columns[0])
            part = _codes(found) >> shift
            taken = np.ones(len(part), bool) if not wanted else np.zeros(len(part), bool)
            for column in columns[1:]:
                taken |= (part >> STEP) == column.to_numpy(zero_copy_only=False)[rows]
            order = np.lexsort((part[taken], rows[taken]))
            rows, part = rows[taken][order], part[taken][order]
            first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (part[1:] != part[:-1])]) if len(rows) else np.empty(0, np.int64)
            return rows[first], [part[first], np.diff(np.r_[first, len(rows)])]

        source = bricks if state is None else join_summary(bricks, state.select(*keys, *wanted), keys)
        counted = _per_brick(source, keys, [F.col(c) for c in [values, *wanted]], "part long, c long", count)
        counted = counted.groupBy(*keys, "part").agg(F.sum("c").alias("c")).withColumn("parent", F.shiftright("part", STEP))
        if state is None:
            counted = counted.withColumn("parent", F.lit(0).cast("long"))
            sizes = materialise(counted, "volume-bins")
            counted, n = sizes, F.col("n") - 1
            state = sizes.groupBy(*keys).agg(F.sum("c").alias("n")).select(
                *keys, "n",
                *[F.lit(0).cast("long").alias(f"parent{t}") for t in range(many)],
                *[
                    (F.floor if t % 2 == 0 else F.ceil)(F.lit(float(fractions[t // 2])) * n).cast("long").alias(f"rank{t}")
                    for t in range(many)
                ],
            )
        # At most 65,536 rows of a volume and parent.
        order = Window.partitionBy(*keys, "parent").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = counted.withColumn("upto", F.sum("c").over(order)).join(state, keys)
        picks = []
        for t in range(many):
            rank = F.col(f"rank{t}")
            here = (F.col("parent") == F.col(f"parent{t}")) & (F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)
            picks.append(F.max(F.when(here, F.struct("part", (rank - F.col("upto") + F.col("c")).alias("rank")))).alias(f"pick{t}"))
        state = materialise(
            placed.groupBy(*keys).agg(F.max("n").alias("n"), *picks).select(
                *keys, "n", *[F.col(f"pick{t}.part").alias(f"parent{t}") for t in range(many)], *[F.col(f"pick{t}.rank").alias(f"rank{t}") for t in range(many)]
            ),
            "volume-ranks",
        )

    @F.arrow_udf("double")
    def value(codes: pa.Array) -> pa.Array:
        return pa.array(_decoded(codes.to_numpy(zero_copy_only=False), wide))

    out = state.select(*keys, "n", *[value(F.col(f"parent{t}")).alias(f"v{t}") for t in range(many)])
    columns = []
    for i, p in enumerate(fractions):
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}")
        between = low + (high - low) * (place - F.floor(place))
        columns.append(F.when(low == high, low).otherwise(between).alias(f"p{i}"))
        if neighbours:
            columns += [low.alias(f"p{i}_lo"), high.alias(f"p{i}_hi")]
    return out.select(*keys, "n", *columns)


def brick_moments(bricks: DataFrame, keys: Sequence[str], values: str = "values", upper: str | None = None) -> DataFrame:
    """A row per brick: ``n, mean, m2, m3, m4`` (sums of powers about its mean), ``mn, mx``.

    Values above the column ``upper`` count as that.  Bricks without a value give no row.
    """

    def sum_up(columns: list[pa.Array]) -> tuple[np.ndarray, list[np.ndarray]]:
        found, rows = _flat(columns[0])
        found = found.astype(np.float64)
        if upper is not None:
            found = np.minimum(found, columns[1].to_numpy(zero_copy_only=False).astype(np.float64)[rows])
        size = len(columns[0])
        n = np.bincount(rows, minlength=size)
        mean = np.bincount(rows, found, size) / np.maximum(n, 1)
        off = found - mean[rows]
        powers = [np.bincount(rows, off**k, size) for k in (2, 3, 4)]
        some = np.flatnonzero(n)
        starts = np.searchsorted(rows, some)
        limits = [f.reduceat(found, starts) if len(some) else np.empty(0) for f in (np.minimum, np.maximum)]
        return some, [n[some], mean[some], *(p[some] for p in powers), *limits]

    added = "n long, mean double, m2 double, m3 double, m4 double, mn double, mx double"
    return _per_brick(bricks, keys, [F.col(c) for c in (values, upper) if c], added, sum_up)


def volume_shape(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``n, mean, std, skewness, kurtosis, mn, mx`` per volume from its bricks' moments, about the common mean."""
    keys = list(keys)
    parts = materialise(moments, "brick-moments")
    means = parts.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mu"))
    n, d = F.col("n"), F.col("mean") - F.col("mu")
    m2, m3, m4 = F.col("m2"), F.col("m3"), F.col("m4")
    total = join_summary(parts, means, keys).groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.first("mu").alias("mean"),
        F.sum(m2 + n * d * d).alias("s2"),
        F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("s3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("s4"),
        F.min("mn").alias("mn"),
        F.max("mx").alias("mx"),
    )
    v = F.col("s2") / F.col("n")
    return total.select(
        *keys, "n", "mean", F.sqrt(v).alias("std"),
        F.try_divide(F.col("s3") / F.col("n"), v * F.sqrt(v)).alias("skewness"),
        (F.try_divide(F.col("s4") / F.col("n"), v * v) - 3).alias("kurtosis"),
        "mn", "mx",
    )


def value_histogram(bricks: DataFrame, keys: Sequence[str], bins: int, lowest: str, highest: str, values: str = "values") -> DataFrame:
    """``keys, bin, n``: the non-empty of ``bins`` even bins between two columns; the last one holds its upper edge."""

    def count(columns: list[pa.Array]) -> tuple[np.ndarray, list[np.ndarray]]:
        found, rows = _flat(columns[0])
        low, high = (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns[1:])
        width = ((high - low) / bins)[rows]
        place = np.divide(found - low[rows], width, out=np.zeros(len(rows)), where=width > 0)
        bin_ = np.clip(np.floor(place), 0, bins - 1).astype(np.int64)
        cells, n = np.unique(rows * bins + bin_, return_counts=True)
        return cells // bins, [(cells % bins).astype(np.int32), n]

    counted = _per_brick(bricks, keys, [F.col(c) for c in (values, lowest, highest)], "bin int, c long", count)
    return counted.groupBy(*keys, "bin").agg(F.sum("c").alias("n"))
