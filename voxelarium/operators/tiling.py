"""Bricks cut to other grids: padding, patches and new brick sizes, as arrays all the way.

A brick is cut into the pieces that fall into each target box, in the task that holds it;
only the pieces are shuffled, and each box is put together from them.  How many pieces meet
in a box follows from the sizes of boxes and bricks alone.  What no piece covers is zero.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from voxelarium.operators.voxels import AXES, BRICK_KEYS, BRICK_SHAPE, gathered

_CORNER, _COUNT = [f"_o{a}" for a in AXES], [f"_c{a}" for a in AXES]


def _pieces(bricks: DataFrame, keys: Sequence[str], size: Sequence[int]) -> DataFrame:
    """Part of each brick inside the box at ``_tx, _ty, _tz``; boxes it only announces get an empty part."""
    counts, place, offset = {}, {}, {}
    for a, width in zip(AXES, size):
        corner, box = F.col(f"{a}0"), F.col(f"_t{a}")
        low = F.greatest(corner, box)
        counts[a] = F.greatest(F.least(corner + F.col(f"n{a}"), box + width) - low, F.lit(0))
        place[a] = lambda i, low=low, corner=corner: i + low - corner
        offset[a] = low - box
    some = reduce(lambda p, a: p & (counts[a] > 0), AXES, F.lit(True))
    values = F.when(some, gathered(counts, place)).otherwise(F.array().cast("array<float>"))
    return bricks.select(
        *keys,
        *[offset[a].cast("int").alias(f"_o{a}") for a in AXES],
        *[F.when(some, counts[a]).otherwise(0).cast("int").alias(f"_c{a}") for a in AXES],
        values.cast("array<float>").alias("values"),
    )


def _assembled(pieces: DataFrame, keys: Sequence[str], extent: Sequence[Column], size: Sequence[int]) -> DataFrame:
    """``keys, nx, ny, nz, values`` from the pieces of each box; ``extent`` may be less than ``size`` at the far edges."""
    grouped = pieces.groupBy(*keys).agg(F.collect_list(F.struct(*_CORNER, *_COUNT, "values")).alias("_parts"))
    source = grouped.select(*keys, *[e.cast("int").alias(f"n{a}") for a, e in zip(AXES, extent)], "_parts")
    extra = T.StructType.fromDDL("nx int, ny int, nz int, values array<float>")
    schema = T.StructType([source.schema[k] for k in keys] + extra.fields)
    first = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(first + 3)
            flat = parts.flatten()
            places = np.stack([flat.field(i).to_numpy(zero_copy_only=False) for i in range(6)], axis=1) if len(flat) else np.empty((0, 6), int)
            arrays = flat.field(6)
            ends = np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))
            shapes = np.stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            rows, start = [], 0
            for shape, end in zip(shapes.tolist(), ends.tolist()):
                box = np.zeros(size, np.float32)
                for i in range(start, end):
                    (x, y, z), count = places[i, :3], places[i, 3:]
                    if count.all():
                        box[x : x + count[0], y : y + count[1], z : z + count[2]] = arrays[i].values.to_numpy(zero_copy_only=False).reshape(count)
                rows.append(box[: shape[0], : shape[1], : shape[2]].ravel())
                start = end
            lengths = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(rows) if rows else np.empty(0, np.float32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: first + 3], values], names=schema.names)

    return source.mapInArrow(run, schema)


def _touched(first: dict[str, Column], last: dict[str, Column], size: Sequence[int]) -> Column:
    """Corners of all boxes of a grid between two boxes."""
    def along(a: str, fn):
        return F.transform(F.sequence(first[a].cast("int"), last[a].cast("int")), fn)

    def cell(i: Column, j: Column, k: Column) -> Column:
        return F.struct(*[(n * w).cast("int").alias(f"_t{a}") for n, w, a in zip((i, j, k), size, AXES)])

    return F.flatten(along("x", lambda i: F.flatten(along("y", lambda j: along("z", lambda k: cell(i, j, k))))))


def pad_bricks(bricks: DataFrame, shape: Sequence[int], target: Sequence[int], size: Sequence[int]) -> DataFrame:
    """Volumes of ``shape`` in the middle of zeros up to ``target``, as bricks of ``size``; one read of the input.

    The brick at a volume's first corner announces all boxes, so those without a voxel exist too.
    """
    final = [max(s, t) for s, t in zip(shape, target)]
    boxes = [-(-extent // width) for extent, width in zip(final, size)]
    moved = bricks.withColumns({f"{a}0": F.col(f"{a}0") + max(t - s, 0) // 2 for a, s, t in zip(AXES, shape, target)})
    first = {a: F.floor(F.col(f"{a}0") / w) for a, w in zip(AXES, size)}
    last = {a: F.floor((F.col(f"{a}0") + F.col(f"n{a}") - 1) / w) for a, w in zip(AXES, size)}
    starts = reduce(lambda p, q: p & q, [F.col(f"b{a}") == 0 for a in AXES])
    every = _touched({a: F.lit(0) for a in AXES}, {a: F.lit(n - 1) for a, n in zip(AXES, boxes)}, size)
    cells = F.when(starts, every).otherwise(_touched(first, last, size))
    keys = ["case_id", "modality", *[f"_t{a}" for a in AXES]]
    dealt = moved.select("case_id", "modality", *[f"{p}{a}" for p in ("n",) for a in AXES], *[f"{a}0" for a in AXES], "values", F.inline(cells))
    extent = [F.least(F.lit(w), F.lit(f) - F.col(f"_t{a}")) for a, w, f in zip(AXES, size, final)]
    out = _assembled(_pieces(dealt, keys, size), keys, extent, size)
    place = [(F.col(f"_t{a}") / w).cast("int").alias(f"b{a}") for a, w in zip(AXES, size)] + [F.col(f"_t{a}").alias(f"{a}0") for a in AXES]
    return out.select("case_id", "modality", *place, *BRICK_SHAPE[6:], "values")


def patch_bricks(bricks: DataFrame, boxes: DataFrame, size: int, brick_shape: Sequence[int]) -> DataFrame:
    """``case_id, modality, patch, px, py, pz, values``: each box of ``size`` per axis as one array.

    A box first lists the bricks it touches, which turns the range join into an equi-join.
    A box that reaches beyond its volume holds zeros there.
    """
    touched = boxes
    for axis, width in zip(AXES, brick_shape):
        first, last = F.floor(F.col(f"p{axis}") / width), F.floor((F.col(f"p{axis}") + size - 1) / width)
        touched = touched.withColumn(f"b{axis}", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    corners = [f"p{a}" for a in AXES]
    met = bricks.join(touched, BRICK_KEYS).withColumns({f"_t{a}": F.col(f"p{a}") for a in AXES})
    keys = ["case_id", "modality", "patch", *corners]
    cube = [size] * 3
    return _assembled(_pieces(met, keys, cube), keys, [F.lit(size)] * 3, cube).select(*keys, "values")

