import numpy as np
import pytest
from text_cases import EDGE, key
from pyspark.sql import functions as F

from voxelarium.llm.fingerprint import simhash
from voxelarium.llm.simhash import components, linked_pairs, near_duplicates, simhash_groups


def brute_components(marks):
    marks = np.array(sorted(set(marks)), dtype=np.uint64)
    parent = list(range(len(marks)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(np.bitwise_count(marks[:, None] ^ marks[None, :]) <= 2)):
        parent[max(find(i), find(j))] = min(find(i), find(j))
    return {int(m): int(marks[find(i)]) for i, m in enumerate(marks)}


def signed(marks):
    return [int(m) - (1 << 64) if int(m) >> 63 else int(m) for m in marks]


@pytest.mark.parametrize("levels", [8, 16, 32])
def test_pairs_equal_brute_force(spark, levels):
    rng = np.random.default_rng(levels)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 60, dtype=np.uint64)
    marks = [base]
    for _ in range(6):
        flips = [np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64) for _ in range(2)]
        marks += [base ^ flips[0], base ^ flips[0] ^ flips[1]]
    marks = np.unique(np.concatenate([*marks, np.array([0, 1, 3, 7], dtype=np.uint64)]))
    df = spark.createDataFrame([(m,) for m in signed(marks)], "mark long")
    got = {tuple(sorted(r)) for r in linked_pairs(df, levels=levels).collect()}
    near = np.bitwise_count(marks[:, None] ^ marks[None, :])
    s = signed(marks)
    want = {tuple(sorted((s[i], s[j]))) for i, j in zip(*np.nonzero(near <= 2)) if i < j}
    assert got == want


def test_long_chain_is_one_component(spark):
    """Each mark links to the next only; the chain takes several star rounds."""
    marks = [0]
    for i in range(60):
        marks.append(marks[-1] ^ (1 << i))
    rows = [(i, m) for i, m in enumerate(signed(marks))]
    got = components(spark.createDataFrame(rows, "doc_id long, mark long")).collect()
    assert {r["least_id"] for r in got} == {0} and len({r["root"] for r in got}) == 1 and len(got) == 61


def test_fingerprint_is_xxh64_of_shingles(spark):
    text = "One two\tthree four"
    rows = spark.createDataFrame([("one two three",), ("two three four",)], "s string")
    hashes = [r[0] & (2**64 - 1) for r in rows.select(F.xxhash64("s")).collect()]
    assert simhash(text.encode()) == hashes[0] & hashes[1]
    assert simhash(b"") == simhash(b" \n") == 0
    assert simhash(b"Two ONE") == spark.range(1).select(F.xxhash64(F.lit("two one"))).first()[0] & (2**64 - 1)


def test_groups_edges(make, edge):
    got = simhash_groups(edge).collect()
    marks = {t: simhash((t or "").encode()) for _, t in EDGE}
    roots = brute_components(marks.values())
    least = {}
    for i, t in EDGE:
        r = roots[marks[t]]
        least[r] = min([x for x in (i, least.get(r)) if x is not None], default=None)
    want = [(i, f"{marks[t]:016x}", least[roots[marks[t]]]) for i, t in EDGE]
    assert key(map(tuple, got)) == key(want)
    assert near_duplicates(make([])).count() == 0
