"""SimHash near-deduplication by a forest of vantage-point trees.

Fingerprints are combined first: every later step sees each distinct one once, so a group
of equal documents, however large, is one row.

The trees partition by Hamming distance.  Level ``j`` has a vantage point and looks at its
own few bits of the fingerprint; the branch is the distance there.  Over all 64 bits the
distances to any vantage point crowd around 32, and a search of radius 2 would enter both
sides of almost every cut.  Therefore each half of the bits has a tree of its own: a pair
that differs in at most ``radius`` bits differs in at most ``radius // 2`` within one half,
and a level's distance moves by no more than the bits that differ on it (the triangle
bound, which adds up over levels as they share no bits).  A query thus prunes to its own
leaf and the leaves one step away on a single level, and as each pair can be found from
the side with the smaller branch, only steps upwards are visited: at most ``1 + LEVELS``
leaves a half, where it meets the stored fingerprints by an equi-join.  The full distance
decides, so the pairs are exact.

With 16 levels the expected number of comparisons is 1.7e-6 n^2 for each half, and 34
rows are shuffled per fingerprint at most; 32 levels take 66 rows and 4e-9 n^2.

Links between fingerprints become components by alternating large-star and small-star
steps, each written to the shared folder.

Defined results: null text is empty; documents without words share fingerprint zero and
link like any other; a component is named by its smallest id that is not null; repeated
rows each get their row; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voxelarium.llm.common import text_or_empty
from voxelarium.llm.fingerprint import SHINGLE, simhash
from voxelarium.storage import materialise

#: Differing bits of linked fingerprints.
RADIUS = 2
#: Levels of each tree: 8, 16 or 32, of 4, 2 or 1 bits.
LEVELS = 16
#: The vantage points of all levels, one after the other, in both halves.
_VANTAGE = 0x9E3779B9


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text as a signed long with the same bits."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        marks = (simhash(t, shingle) for t in texts)
        return pd.Series([m - (1 << 64) if m >> 63 else m for m in marks], dtype="int64")

    return of(text.cast("binary"))


def _leaves(mark: Column, half: int, levels: int) -> tuple[Column, Column]:
    """The leaf that stores ``mark`` in one half's tree, and the leaves a query enters."""
    bits = 32 // levels
    branches = []
    for j in range(levels):
        own = F.shiftrightunsigned(mark, 32 * half + bits * j).bitwiseAND((1 << bits) - 1)
        branches.append(F.bit_count(own.bitwiseXOR((_VANTAGE >> (bits * j)) & ((1 << bits) - 1))).cast("long"))
    weights = [(bits + 1) ** j for j in range(levels)]
    leaf = sum((b * w for b, w in zip(branches, weights)), F.lit(0).cast("long"))
    steps = [F.when(b < bits, leaf + w) for b, w in zip(branches, weights)]
    entered = F.filter(F.array(leaf, *steps), lambda x: x.isNotNull())
    return leaf * 2 + half, F.transform(entered, lambda x: x * 2 + half)


def linked_pairs(marks: DataFrame, radius: int = RADIUS, levels: int = LEVELS) -> DataFrame:
    """``hi, lo``: the pairs of distinct ``mark`` values at most ``radius`` bits apart."""
    if radius > 3 or 32 % levels or levels < 8:
        raise ValueError("a half may differ in one bit, so radius is 3 at most; levels are 8, 16 or 32")
    mark = F.col("mark")
    # A mark takes 8 bytes and becomes dozens of rows: spread them before, as file sizes would not.
    marks = marks.repartition(int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mark")
    trees = [_leaves(mark, half, levels) for half in (0, 1)]
    stored = marks.select(F.explode(F.array(*(t[0] for t in trees))).alias("leaf"), mark.alias("other"))
    queries = marks.select(F.explode(F.concat(*(t[1] for t in trees))).alias("leaf"), "mark")
    near = (mark != F.col("other")) & (F.bit_count(mark.bitwiseXOR(F.col("other"))) <= radius)
    return (
        queries.join(stored, "leaf")
        .filter(near)
        .select(F.greatest("mark", "other").alias("hi"), F.least("mark", "other").alias("lo"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the smallest node around it."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node sends itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", "m")).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def star_components(pairs: DataFrame) -> DataFrame:
    """``hi, lo`` where ``lo`` is the smallest node of the component of ``hi``; roots are left out."""
    edges = materialise(pairs, "star-links")
    before = _signature(edges)
    while True:
        edges = materialise(_small_star(_large_star(edges)), "star-links")
        after = _signature(edges)
        if after == before:
            return edges
        before = after


def components(marked: DataFrame, radius: int = RADIUS, levels: int = LEVELS) -> DataFrame:
    """``mark, root, least_id`` for the distinct ``mark`` of ``marked(doc_id, mark)``; the id is the component's."""
    marks = materialise(marked.groupBy("mark").agg(F.min("doc_id").alias("least_id")), "marks")
    stars = star_components(linked_pairs(marks.select("mark"), radius, levels))
    root = F.coalesce("lo", "mark")
    rooted = marks.join(stars.withColumnRenamed("hi", "mark"), "mark", "left").select("mark", root.alias("root"), "least_id")
    linked = stars.select(F.col("hi").alias("mark"), F.col("lo").alias("root")).union(
        stars.select("lo", "lo").distinct()
    )
    of_root = linked.join(marks, "mark").groupBy("root").agg(F.min("least_id").alias("root_id"))
    return materialise(
        rooted.join(of_root, "root", "left").select("mark", "root", F.coalesce("root_id", "least_id").alias("least_id")),
        "mark-components",
    )


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, mark, component_id`` per row."""
    marked = materialise(
        docs.select(F.col(id_column).cast("long").alias("doc_id"), fingerprints(text_or_empty(text_column)).alias("mark")),
        "fingerprints",
    )
    groups = components(marked).select("mark", F.col("least_id").alias("component_id"))
    return marked.join(groups, "mark")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """The registered form, fingerprints as hex."""
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id"
    )
