import numpy as np
import pytest
from pyspark.sql import types as T

from voxelarium.llm import vector_links
from voxelarium.llm.vector_links import MultiIndex, near_vectors

SCHEMA = "vec_id long, embedding array<{}>, label int, node string, `Cell` string"


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA.format(kind))


def brute(rows):
    """All pairs of equal label and length; ``{row: (n_links, component)}`` and the pairs."""
    unit = []
    for _, v, label in rows:
        ok = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    root, pairs = list(range(len(rows))), []
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is None or unit[j] is None or rows[i][2] != rows[j][2] or len(unit[i]) != len(unit[j]):
                continue
            if unit[i] @ unit[j] >= 0.93:
                pairs.append((j, i))
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    links = np.bincount(np.array(pairs, int).ravel(), minlength=len(rows))
    least = {}
    for (i, *_), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return links, [least.get(r) for r in root], pairs


def near(rng, base, cosine):
    """A vector with about this cosine to ``base``."""
    other = rng.normal(size=len(base))
    other -= (other @ base) / (base @ base) * base
    return cosine * base / np.linalg.norm(base) + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def clusters(rng, groups, size, dims=24, cosine=0.985, labels=3):
    rows = []
    for g in range(groups):
        base = rng.normal(size=dims)
        rows += [near(rng, base, cosine).astype(np.float32).tolist() for _ in range(size)]
    order = rng.permutation(len(rows))
    return [(int(i), rows[k], int(k // size % labels)) for i, k in enumerate(order)]


@pytest.mark.parametrize("block", [vector_links.BLOCK, 7])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(block)
    rows = clusters(rng, 12, 20) + [(1000 + i, rng.normal(size=24).astype(np.float32).tolist(), i % 3) for i in range(150)]
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(40)] + [(2000, rows[5][1], rows[5][2])]
    links, components, _ = brute(rows)
    done = near_vectors(frame(spark, rows), block=block).collect()
    want = sorted((i, int(n), c, i == c) for (i, *_), n, c in zip(rows, links, components))
    assert sorted(map(tuple, done)) == want


def test_recall_near_the_threshold(spark):
    """Random vectors and partners of cosine 0.93 to 0.95, the hardest links there are."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        base = rng.normal(size=64)
        rows += [(2 * i, base.tolist(), 1), (2 * i + 1, near(rng, base, rng.uniform(0.931, 0.95)).tolist(), 1)]
    done = {r["vec_id"]: r for r in near_vectors(frame(spark, rows, "double")).collect()}
    assert all(r["n_links"] <= 1 for r in done.values())
    found = sum(done[2 * i]["n_links"] for i in range(1500))
    assert found >= 0.9 * 1500
    assert all(done[2 * i + 1]["component_id"] == 2 * i for i in range(1500) if done[2 * i]["n_links"])


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, None, 1),
        (2, [], 1),
        (3, [0.0, 0.0, 0.0], 1),
        (4, [1.0, None, 2.0], 1),
        (5, [1.0, float("nan"), 2.0], 1),
        (6, [float("inf"), 1.0, 1.0], 1),
        (7, v, None),
        (8, v, None),
        (9, v, 1),
        (9, v, 1),
        (10, [2.0, 4.0, 6.0], 1),
        (11, v, 2),
        (12, [1.0, 2.0, 3.0, 0.0], 1),
        (None, v, 1),
        (None, [-5.0, 1.0, 0.0], 4),
        (None, [3e38, 3e38, 0.0], 5),
        (13, [1e-40, 1e-40, 0.0], 5),
    ]
    done = near_vectors(frame(spark, rows)).collect()
    links, components, _ = brute([(i, None if v is None else v, label) for i, v, label in rows])
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in done), key=str)
    want = []
    for (i, _, _), n, c in zip(rows, links, components):
        c = i if c is None else c
        want.append((i, int(n), c, i == c if i is not None else bool(n == 0)))
    assert got == sorted(want, key=str)
    assert near_vectors(frame(spark, [])).count() == 0
    assert near_vectors(frame(spark, [(1, None, None)])).first()["kept"]


def test_visits_follow_the_sums():
    rng = np.random.default_rng(0)
    index = MultiIndex(rng.normal(size=(9, 3)), rng.normal(size=(7, 3)))
    x = rng.normal(size=(50, 6))
    for cells in (1, 5, 20, 63):
        got = index.visits(x, cells)
        for row, seen in zip(x, got):
            sums = ((row[:3] - index.first) ** 2).sum(1)[:, None] + ((row[3:] - index.second) ** 2).sum(1)
            assert seen.tolist() == np.argsort(sums.ravel())[:cells].tolist()


def test_types(spark):
    assert near_vectors(frame(spark, [(1, [1.0], 1)])).schema.simpleString() == (
        "struct<vec_id:bigint,n_links:bigint,component_id:bigint,kept:boolean>"
    )
    assert isinstance(frame(spark, []).schema, T.StructType)
