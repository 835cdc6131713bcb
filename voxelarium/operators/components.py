"""Largest connected component of a mask, 6-connected.

Components are labelled inside each brick first.  Only the contacts between
touching faces leave a brick, so the iterative part runs on a graph of brick
components and needs a number of rounds logarithmic in practice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from voxelarium.operators.voxels import BRICK_KEYS, BRICK_SHAPE
from voxelarium.storage import cut_lineage

_OUTSIDE = -1
STACKED_VOXELS = 4_000_000


def _label_blocks(inside: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Smallest scan index of the component of every inside voxel, for a stack of blocks."""
    far = np.iinfo(np.int64).max
    labels = np.where(inside, index, far)
    while True:
        before = labels.copy()
        for axis in (1, 2, 3):
            moved = np.moveaxis(labels, axis, 0)
            for a, b in ((moved[1:], moved[:-1]), (moved[:-1], moved[1:])):
                np.minimum(a, np.where(a == far, far, b), out=a)
        if np.array_equal(before, labels):
            return np.where(inside, labels, _OUTSIDE)


def label_bricks(bricks: DataFrame, threshold: float, shape: Sequence[int]) -> DataFrame:
    """Bricks with ``labels`` per voxel and the labels on their six faces.

    Bricks of equal extent are stacked and labelled together, a bounded number
    of voxels at a time.
    """
    _, height, width = shape

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, alike in batch.groupby(["nx", "ny", "nz"]):
                step = max(1, STACKED_VOXELS // int(np.prod(size)))
                for start in range(0, len(alike), step):
                    yield label_alike(alike.iloc[start : start + step], size)

    def label_alike(part: pd.DataFrame, size: tuple[int, int, int]) -> pd.DataFrame:
        inside = (np.stack(part["values"].to_numpy()) > threshold).reshape(-1, *size)
        x, y, z = (
            part[f"{axis}0"].to_numpy(np.int64).reshape(-1, 1, 1, 1) + steps
            for axis, steps in zip("xyz", np.indices(size))
        )
        labels = _label_blocks(inside, (x * height + y) * width + z)
        out = {"labels": list(labels.reshape(len(part), -1))}
        for axis, name in enumerate("xyz", start=1):
            out[f"low_{name}"] = list(np.take(labels, 0, axis).reshape(len(part), -1))
            out[f"high_{name}"] = list(np.take(labels, -1, axis).reshape(len(part), -1))
        return part[["case_id", *BRICK_SHAPE]].assign(**{name: out[name] for name in ("labels", *faces)})

    faces = [f"{side}_{axis}" for side in ("low", "high") for axis in "xyz"]
    compact = bricks.select("case_id", *BRICK_SHAPE, "values")
    schema = compact.drop("values").schema
    for name in ("labels", *faces):
        schema = schema.add(name, T.ArrayType(T.LongType()))
    return compact.mapInPandas(label, schema)


def face_contacts(labelled: DataFrame) -> DataFrame:
    """Distinct pairs of brick components that touch across a brick face."""
    def faces(side: str, shift: int) -> DataFrame:
        cells = []
        for axis in "xyz":
            place = [(F.col(k) + (shift if k == f"b{axis}" else 0)).alias(k) for k in BRICK_KEYS[1:]]
            cells.append(F.struct(F.lit(axis).alias("axis"), *place, F.col(f"{side}_{axis}").alias(side)))
        return labelled.select("case_id", F.inline(F.array(*cells)))

    met = faces("high", 1).join(faces("low", 0), [*BRICK_KEYS, "axis"])
    pairs = met.select("case_id", F.explode(F.array_distinct(F.arrays_zip("high", "low"))).alias("p"))
    return pairs.select("case_id", F.col("p.high").alias("a"), F.col("p.low").alias("b")).where(
        (F.col("a") >= 0) & (F.col("b") >= 0)
    ).distinct()


def _settled(pairs: pd.DataFrame) -> pd.DataFrame:
    """Smallest reachable label of each node, for all cases in ``pairs`` at once."""
    case, cases = pd.factorize(pairs["case_id"])
    a, b = pairs["a"].to_numpy(np.int64), pairs["b"].to_numpy(np.int64)
    stride = max(a.max(), b.max()) + 1
    keys, place = np.unique(np.concatenate([case * stride + a, case * stride + b]), return_inverse=True)
    a, b = place[: len(case)], place[len(case) :]
    comp = np.arange(len(keys))
    while True:
        before = comp.copy()
        np.minimum.at(comp, a, comp[b])
        np.minimum.at(comp, b, comp[a])
        comp = comp[comp]
        if (comp == before).all():
            break
    return pd.DataFrame({"case_id": cases[keys // stride], "node": keys % stride, "comp": keys[comp] % stride})


def merge_components(contacts: DataFrame) -> DataFrame:
    """Smallest reachable label of every component in contact with another.

    The contacts of a case, bounded by the faces of its bricks, meet in one task
    and are settled there; a task takes as many cases at once as a batch holds.
    """

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the last case so far, which may go on
        for batch in batches:
            pairs = pd.concat([*held, batch]) if held else batch
            if pairs.empty:
                continue
            goes_on = pairs["case_id"] == pairs["case_id"].iloc[-1]
            held = [pairs[goes_on]]
            if not goes_on.all():
                yield _settled(pairs[~goes_on])
        if held:
            yield _settled(held[0])

    case = contacts.schema["case_id"].dataType.simpleString()
    together = contacts.repartition("case_id").sortWithinPartitions("case_id")
    return together.mapInPandas(settle, f"case_id {case}, node long, comp long")


def component_sizes(labelled: DataFrame, merged: DataFrame) -> DataFrame:
    """Voxels per case and merged component."""
    local = labelled.select("case_id", F.explode("labels").alias("node")).where("node >= 0")
    sizes = local.groupBy("case_id", "node").agg(F.count(F.lit(1)).alias("size"))
    joined = sizes.join(merged, ["case_id", "node"], "left")
    root = F.coalesce("comp", "node")
    return joined.groupBy("case_id", root.alias("root")).agg(F.sum("size").alias("size"))


def largest_components(sizes: DataFrame) -> DataFrame:
    """Largest component of every case; the first in scan order wins ties."""
    best = F.max(F.struct("size", (-F.col("root")).alias("_r"))).alias("b")
    return sizes.groupBy("case_id").agg(best).select(
        "case_id", (-F.col("b._r")).alias("root"), F.col("b.size").alias("size")
    )


def brain_component(bricks: DataFrame, threshold: float, shape: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Root and size of the largest component per case, and its mask bricks (``inside``)."""
    labelled = cut_lineage(label_bricks(bricks, threshold, shape))
    merged = merge_components(face_contacts(labelled))
    largest = largest_components(component_sizes(labelled, merged))
    local = labelled.select(*BRICK_KEYS, F.explode(F.array_distinct("labels")).alias("node")).where("node >= 0")
    root = F.coalesce("comp", "node")
    winners = (
        local.join(merged, ["case_id", "node"], "left")
        .withColumn("root", root)
        .join(largest, ["case_id", "root"])
        .groupBy(*BRICK_KEYS)
        .agg(F.collect_set("node").alias("nodes"))
    )
    masked = labelled.select(*BRICK_KEYS, "labels").join(winners, BRICK_KEYS, "left")
    nodes = F.coalesce("nodes", F.array().cast("array<bigint>"))
    inside = F.transform("labels", lambda k: F.array_contains(nodes, k)).alias("inside")
    return largest, masked.select(*BRICK_KEYS, inside)
