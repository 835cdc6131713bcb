"""Links between near-equal vectors of a label through an inverted multi-index.

Each half of the normalised vectors has a codebook of its own; the pairs of centroids are a
product grid, and a vector is stored in the cell of its two nearest centroids.  A query
visits cells by rising sum of both distances.  In that multi-sequence every cell ``(a, b)``
of nearest-centroid ranks comes behind all of smaller ranks, so the first ``t`` cells have
``(a + 1) * (b + 1) <= t`` and are found for a whole batch at once.

How many cells are visited is measured: a bounded sample of queries meets all vectors by
brute force, and ``t`` is the least number of cells that holds ``TARGET`` of their links;
if ``VISITS`` cells are too few, the codebooks are halved and measured again.  A pair is
found from the side with the smaller cell.  Whatever meets is verified in double precision,
so no link is below the threshold.

Scale: the codebooks grow with the largest label, so that its cells keep about ``OCCUPANCY``
vectors.  A cell of more than ``BLOCK`` different vectors is cut into blocks that meet
pairwise in tasks of their own.  Copies of a vector are one row with a count; the vectors
with most copies, a bounded number, are reduced before the shuffle.  A task returns
counts and a star for each component it found, never pairs.  What the driver and all tasks
hold is bounded by ``SAMPLE``, ``QUERIES``, ``COPIED`` and ``CELLS``.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and those without a label, link with nothing and stay; vectors of different length link
with nothing of the other length; copies link with each other, repeated rows are copies; a
component is named by its smallest id that is not null; a null id is kept only if it links
with nothing or all of its component are null; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxelarium.llm.simhash import star_components
from voxelarium.storage import materialise

#: Least cosine of linked vectors.
SIMILARITY = 0.93
#: Share of the sampled queries' links that the visited cells have to hold.
TARGET = 0.98
#: Vectors that the codebooks are fitted on, and queries that measure recall; expected numbers, at most twice as many.
SAMPLE = 8192
QUERIES = 512
#: Cells visited at least, without any sampled link, and at most.
LEAST, UNMEASURED, VISITS = 2, 8, 64
#: Different vectors expected in a cell of the largest label, and centroids of a half at most.
OCCUPANCY = 256
CENTROIDS = 1024
#: Vectors of a block of a large cell, and rows of a product that are held at once.
BLOCK = 16384
TILE = 512
#: At most so many vectors have a share of 1 / COPIED of all rows, and so many cells one of 1 / CELLS.
COPIED = 10_000
CELLS = 1_000_000
ROUNDS = 8

MARKS = "vec_id long, label string, node binary, cell long"
DEALT = "label string, cell long, part long, against int, node binary, copies long, vector binary"
FOUND = "node binary, root binary, links long"


def normalised(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is taken out first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _padded(vectors: list[np.ndarray], size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def codebook(vectors: np.ndarray, centroids: int) -> np.ndarray:
    """Centroids of the rows, from an even choice of them, by alternating assignment and means."""
    vectors = np.unique(vectors, axis=0)
    book = vectors[np.linspace(0, len(vectors) - 1, min(centroids, len(vectors))).astype(int)]
    for _ in range(ROUNDS):
        nearest = ((book * book).sum(axis=1) - 2 * vectors @ book.T).argmin(axis=1)
        count = np.bincount(nearest, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, nearest, vectors)
        book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
    return book


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, centroids: int) -> MultiIndex:
        half = (sample.shape[1] + 1) // 2
        return cls(codebook(sample[:, :half], centroids), codebook(sample[:, half:], centroids))

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def visits(self, vectors: np.ndarray, cells: int) -> np.ndarray:
        """The first ``cells`` cells of each row's multi-sequence; the very first stores it."""
        half = self.first.shape[1]
        near = []
        for book, part in ((self.first, vectors[:, :half]), (self.second, vectors[:, half:])):
            apart = (book * book).sum(axis=1) - 2 * part @ book.T
            order = np.argsort(apart, axis=1, kind="stable")[:, :cells]
            near.append((order, np.take_along_axis(apart, order, axis=1)))
        (order_a, apart_a), (order_b, apart_b) = near
        ranks = [(a, b) for a in range(order_a.shape[1]) for b in range(min(order_b.shape[1], cells // (a + 1)))]
        a, b = (np.array(r) for r in zip(*ranks))
        picked = np.argsort(apart_a[:, a] + apart_b[:, b], axis=1, kind="stable")[:, :cells]
        return np.take_along_axis(order_a[:, a].astype(np.int64) * len(self.second) + order_b[:, b], picked, axis=1)


@dataclass
class Batch:
    """The vectors of an Arrow batch that can link: their places, labels, digests, raw and normalised forms."""

    places: np.ndarray
    labels: list[str]
    nodes: list[bytes]
    raw: list[bytes]
    unit: np.ndarray

    @classmethod
    def of(cls, labels: pa.Array, column: pa.Array, size: int) -> Batch:
        values = column.flatten().to_numpy(zero_copy_only=False)
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        names = labels.to_pylist()
        places, kept = [], []
        for i, (start, length) in enumerate(zip(starts.tolist(), lengths.tolist())):
            part = values[start : start + length]
            if names[i] is not None and length and np.isfinite(part).all() and part.any():
                places.append(i)
                kept.append(part)
        raw = [np.ascontiguousarray(v).tobytes() for v in kept]
        # Vectors of different length never link: the length is a part of the label.
        keys = [f"{len(v)}:{names[i]}" for i, v in zip(places, kept)]
        nodes = [hashlib.blake2b(k.encode() + b"\0" + r, digest_size=16).digest() for k, r in zip(keys, raw)]
        unit = normalised(_padded(kept, size)) if kept else np.zeros((0, size))
        return cls(np.array(places, np.int64), keys, nodes, raw, unit)


def _base(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    kind = dict(vectors.dtypes)[vector_column]
    wanted = kind if kind in ("array<float>", "array<double>") else "array<double>"
    return vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).cast(wanted).alias("vector")
    )


def _sampled(base: DataFrame, rows: int, expected: int, seed: int) -> list:
    """About ``expected`` of ``rows`` rows, chosen by a hash of the id; twice as many at most."""
    share = min(1.0, expected / max(rows, 1))
    chosen = base.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    return chosen.select("label", "vector").limit(2 * expected).toArrow().to_batches()


def _measured(base: DataFrame, index: MultiIndex, queries: Batch, size: int, similarity: float) -> dict[int, int]:
    """Links of the queries by the place of the larger cell in the smaller one's sequence; ``VISITS`` if beyond."""
    seen = index.visits(queries.unit, VISITS)
    names = np.array(queries.labels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = Batch.of(batch.column(0), batch.column(1), size)
            if not len(here.places):
                continue
            ranks = np.zeros(VISITS + 1, np.int64)
            labels, visits = np.array(here.labels), index.visits(here.unit, VISITS)
            for q in range(len(names)):
                linked = np.flatnonzero((labels == names[q]) & (here.unit @ queries.unit[q] >= similarity))
                linked = linked[[here.nodes[i] != queries.nodes[q] for i in linked]]
                own, theirs = seen[q, 0], visits[linked]
                from_query = own <= theirs[:, 0]
                places = np.where(from_query[:, None], seen[q] == theirs[:, :1], theirs == own)
                found = places.any(axis=1)
                ranks += np.bincount(np.where(found, places.argmax(axis=1), VISITS), minlength=VISITS + 1)
            at = np.flatnonzero(ranks)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ranks[at])], names=["place", "links"])

    counted = base.select("label", "vector").mapInArrow(work, "place long, links long")
    return dict(map(tuple, counted.groupBy("place").agg(F.sum("links")).collect()))


def fitted_index(base: DataFrame, rows: int, largest: int, size: int, similarity: float, target: float) -> tuple[MultiIndex, int]:
    """Codebooks from a bounded sample, and the number of cells that reaches the target recall."""
    parts = [Batch.of(b.column(0), b.column(1), size) for b in _sampled(base, rows, SAMPLE, 0)]
    sample = np.concatenate([p.unit for p in parts]) if parts else np.zeros((0, size))
    if not len(sample):
        sample = np.ones((1, size))
    asked = _sampled(base, rows, QUERIES, 1)
    queries = Batch.of(*(pa.concat_arrays([b.column(i) for b in asked]) for i in (0, 1)), size) if asked else None
    centroids = min(CENTROIDS, max(1, math.ceil(math.sqrt(largest / OCCUPANCY))))
    while True:
        index = MultiIndex.fit(sample, centroids)
        ranks = _measured(base, index, queries, size, similarity) if queries else {}
        total, held = sum(ranks.values()), 0
        if not total:
            return index, min(UNMEASURED, index.cells)
        for place in range(min(VISITS, index.cells)):
            held += ranks.get(place, 0)
            if held >= target * total:
                return index, min(max(place + 1, LEAST), index.cells)
        centroids //= 2  # one cell holds everything


def _marks(base: DataFrame, index: MultiIndex, size: int) -> DataFrame:
    """Digest and cell of each row's vector; null if it cannot link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = Batch.of(batch.column(1), batch.column(2), size)
            columns = [[None] * batch.num_rows for _ in range(3)]
            cells = index.visits(here.unit, 1)[:, 0].tolist() if len(here.places) else []
            for i, *values in zip(here.places.tolist(), here.labels, here.nodes, cells):
                for column, value in zip(columns, values):
                    column[i] = value
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["vec_id", "label", "node", "cell"])

    return base.mapInArrow(work, MARKS)


def _dealt(base: DataFrame, index: MultiIndex, size: int, cells: int, copied: dict, blocks: dict) -> DataFrame:
    """Each different vector in the tasks that it has to visit, those of the larger cells in its sequence.

    A cell of ``g`` blocks has a task for each block and each two of them; ``part`` is odd for
    a single block.  A stored vector goes to all tasks of its block, ``against`` is then
    -1 - its block.  A visiting one meets block ``against`` in the task of that block and
    its own digest's.
    """
    sent = base.sparkSession.sparkContext.broadcast((copied, blocks))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copied, blocks = sent.value
        for batch in batches:
            here = Batch.of(batch.column(1), batch.column(2), size)
            ids = batch.column(0).to_pylist()
            once: dict[bytes, list] = {}
            for k, (place, node) in enumerate(zip(here.places.tolist(), here.nodes)):
                if node in copied:
                    least, n = copied[node]
                    if ids[place] == least:
                        once[node] = [k, -n]
                else:
                    once.setdefault(node, [k, 0])[1] += 1
            if not once:
                continue
            chosen = [k for k, _ in once.values()]
            rows = []
            for (node, (k, n)), visited in zip(once.items(), index.visits(here.unit[chosen], cells).tolist()):
                label, own, salt = here.labels[k], visited[0], int.from_bytes(node[:4], "little")
                for cell in visited:
                    if cell < own:
                        continue
                    g = blocks.get((label, cell), 1)
                    mine = salt % g
                    for j in range(g):
                        part = 2 * (min(mine, j) * g + max(mine, j)) + (mine == j)
                        rows.append((label, cell, part, -1 - mine if cell == own else j, node, n, here.raw[k]))
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary())
            for start in range(0, len(rows), BLOCK):
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows[start : start + BLOCK]), types)]
                yield pa.RecordBatch.from_arrays(arrays, names=["label", "cell", "part", "against", "node", "copies", "vector"])

    return base.mapInArrow(work, DEALT)


def _joined(roots: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``roots`` after joining the components of the given pairs of places."""
    while True:
        a, b = roots[one], roots[other]
        apart = a != b
        if not apart.any():
            return roots
        np.minimum.at(roots, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(roots, roots[roots]):
            roots = roots[roots]


def _linked(rows: pd.DataFrame, kind: str, similarity: float) -> pd.DataFrame:
    """What one task finds: for each vector with links their number here, and the root of its component here."""
    single = rows["part"].iloc[0] % 2 == 1
    # Copies: a negative number is the whole count, others add up.
    groups = rows.groupby(["node", "against"], sort=False)
    rows = groups.agg(vector=("vector", "first"), n=("copies", "sum"), whole=("copies", "min")).reset_index()
    unit = normalised(np.frombuffer(b"".join(rows["vector"]), kind).reshape(len(rows), -1).astype(np.float64))
    weight = np.where(rows["whole"] < 0, -rows["whole"], rows["n"]).astype(np.float64)
    against = rows["against"].to_numpy()
    links, roots = np.zeros(len(rows)), np.arange(len(rows))

    def meet(left: np.ndarray, right: np.ndarray) -> None:
        nonlocal roots
        for start in range(0, len(left), TILE):
            some = left[start : start + TILE]
            for begin in range(0, len(right), BLOCK):
                others = right[begin : begin + BLOCK]
                near = unit[some] @ unit[others].T >= similarity
                if left is right:
                    near &= some[:, None] != others[None, :]
                one, other = np.nonzero(near)
                if not len(one):
                    continue
                dense = near.astype(np.float64)
                links[some] += dense @ weight[others]
                if left is not right:
                    links[others] += weight[some] @ dense
                roots = _joined(roots, some[one], others[other])

    blocks = [np.flatnonzero(against == b) for b in np.unique(against[against < 0])]
    if len(blocks) == 2:
        meet(*blocks)
    elif blocks and single:
        meet(blocks[0], blocks[0])
    for b in np.unique(against[against >= 0]):
        stored = np.flatnonzero(against == -1 - b)
        if len(stored):
            meet(np.flatnonzero(against == b), stored)
    some = np.flatnonzero(links > 0)
    nodes = rows["node"].to_numpy()
    return pd.DataFrame({"node": nodes[some], "root": nodes[roots[some]], "links": links[some].astype(np.int64)})


def _groups(found: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, n_links, component_id`` of the different vectors."""
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    stars = star_components(
        found.where("node <> root").select(F.greatest("node", "root").alias("hi"), F.least("node", "root").alias("lo")).distinct()
    )
    rooted = materialise(
        classes.join(links, "node", "left")
        .join(stars.withColumnRenamed("hi", "node"), "node", "left")
        .select("node", "least", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("lo", "node").alias("root")),
        "rooted-vectors",
    )
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialise(rooted.join(of_root, "root").select("node", "n_links", "component_id"), "vector-groups")


def near_vectors(
    vectors: DataFrame,
    similarity: float = SIMILARITY,
    target: float = TARGET,
    block: int = BLOCK,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """Per row ``vec_id, n_links, component_id, kept``."""
    base = _base(vectors, id_column, vector_column, label_column)
    by_label = base.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("size"))
    rows, largest, size = by_label.agg(F.sum("n"), F.max("n"), F.max("size")).first()
    rows, largest, size = rows or 0, largest or 0, max(size or 0, 1)
    index, cells = fitted_index(base, rows, largest, size, similarity, target)

    marks = materialise(_marks(base, index, size), "vector-marks")
    classes = materialise(
        marks.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("size")), "vector-classes"
    )
    often = classes.where(F.col("size") >= max(2, rows // COPIED)).collect()  # COPIED rows at most
    in_cell = marks.where("node is not null").groupBy("label", "cell").agg(F.approx_count_distinct("node").alias("n"))
    large = in_cell.where(F.col("n") > max(block, rows // CELLS)).collect()  # CELLS rows at most
    blocks = {(r["label"], r["cell"]): math.ceil(r["n"] / block) for r in large}
    dealt = _dealt(base, index, size, cells, {bytes(r["node"]): (r["least"], r["size"]) for r in often}, blocks)
    kind = "<f4" if dict(base.dtypes)["vector"] == "array<float>" else "<f8"

    def links(found: pd.DataFrame) -> pd.DataFrame:
        return _linked(found, kind, similarity)

    found = materialise(dealt.groupBy("label", "cell", "part").applyInPandas(links, FOUND), "vector-links")
    component = F.coalesce("component_id", "vec_id")
    return marks.join(_groups(found, classes), "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.coalesce("n_links", F.lit(0)) == 0).alias("kept"),
    )
