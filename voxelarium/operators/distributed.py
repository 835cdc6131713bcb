"""Ranks, running totals and percentiles without a single-task sort.

A plain ``Window.partitionBy(group)`` sorts a whole group in one task, and
``percentile`` keeps every distinct value of a group in one buffer.  One
modality or class may hold most of a cohort, so the helpers here cut a group
into ordered pieces first: each piece is sorted on its own, and the totals of
the pieces, a table of bounded size, carry the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelarium.storage import materialise

def join_summary(rows: DataFrame, summary: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join an aggregate back to ``rows``.

    The aggregate is written first, so that Spark knows its size in bytes: below
    its own limit for broadcasts ``rows`` stay where they are, above it they are
    joined by a shuffle, where adaptive execution splits skewed keys.
    """
    return rows.join(materialise(summary, "summary"), list(keys), how)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Sequence[float],
    accuracy: int = 10_000,
    packed: bool = False,
    neighbours: bool = False,
) -> DataFrame:
    """Linear-interpolation percentiles per ``keys``, exact for any group size.

    A mergeable sketch brackets every wanted rank, then one more pass counts
    what lies below each bracket and keeps only the values inside.  A bracket
    holds about ``8 * n / accuracy`` rows; groups of at most ``accuracy`` rows
    are kept whole.  Equal values are one row with a count, and those of a group
    are ranked in one task, which a higher ``accuracy`` keeps small for groups
    beyond 10^11 rows.  A bracket that missed its rank raises instead of
    guessing.  With ``packed`` the value column is an array, unpacked only after
    the brackets were joined, so that at most compact rows are shuffled.

    Returns ``keys, n, mn, mx`` and, for the i-th fraction, ``p{i}``; on request
    also its neighbours in the data, ``p{i}_lo`` and ``p{i}_hi``.
    """
    keys = list(keys)
    margin = 4.0 / accuracy
    compact = df.select(*keys, F.col(value).alias("_v"))

    def unpacked(frame: DataFrame) -> DataFrame:
        if packed:
            frame = frame.withColumn("_v", F.explode("_v"))
        return frame.withColumn("_v", F.expr("cast(_v as double)")).where("_v is not null")

    probes = [min(max(p + d, 0.0), 1.0) for p in fractions for d in (-margin, margin)]
    sketch = unpacked(compact).groupBy(*keys).agg(
        F.expr("count(1) as n"),
        F.expr("min(_v) as mn"),
        F.expr("max(_v) as mx"),
        F.percentile_approx("_v", probes, accuracy).alias("_q"),
    )
    brackets = []
    for i, p in enumerate(fractions):
        brackets += [
            f"if(n <= {accuracy} or {p} <= {margin}, mn, get(_q, {2 * i})) as _lo{i}",
            f"if(n <= {accuracy} or {p} >= {1 - margin}, mx, get(_q, {2 * i + 1})) as _hi{i}",
        ]
    summary = sketch.selectExpr(*keys, "n", "mn", "mx", *brackets)
    # Values between brackets only count: they move to the lower edge of the next one.
    many = range(len(fractions))
    inside = " or ".join(f"_v between _lo{i} and _hi{i}" for i in many)
    gates = ", ".join(f"if(_lo{i} > _v, _lo{i}, null)" for i in many)
    counted = (
        unpacked(join_summary(compact, summary, keys))
        .selectExpr(*keys, "n", "mn", "mx", f"{inside} as _in", f"if({inside}, _v, least({gates}, null, null)) as _at")
        .where("_at is not null")
        .groupBy(*keys, "_at", "_in")
        .agg(*[F.expr(e) for e in ("count(1) as c", "max(n) as n", "max(mn) as mn", "max(mx) as mx")])
    )
    order = Window.partitionBy(*keys).orderBy("_at", "_in")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("cum_c", F.sum("c").over(upto))
    picks, columns = [], []
    for i, p in enumerate(fractions):
        rank = f"{float(p)!r}D * (n - 1)"
        for side_name, place in (("_a", f"floor({rank})"), ("_b", f"ceil({rank})")):
            here = f"cum_c > {place} and cum_c - c <= {place} and _in"
            picks.append(F.expr(f"max(if({here}, _at, null)) as {side_name}{i}"))
        columns.append(f"_a{i} + (_b{i} - _a{i}) * ({rank} - floor({rank})) as p{i}")
        if neighbours:
            columns += [f"_a{i} as p{i}_lo", f"_b{i} as p{i}_hi"]
    limits = [F.expr(f"max({name}) as {name}") for name in ("n", "mn", "mx")]
    missed = " or ".join(f"_a{i} is null or _b{i} is null" for i in many)
    found = ranked.groupBy(*keys).agg(*limits, *picks).withColumn(
        "n", F.expr(f"if({missed}, raise_error('percentile bracket missed its rank; raise accuracy'), n)")
    )
    return found.selectExpr(*keys, "n", "mn", "mx", *columns)


def seeded_hash(seed: Column | int | str, *parts: str | Column) -> Column:
    """Hex digest of seed and key: a shuffle order that any engine can repeat."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    columns = [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.md5(F.concat_ws("|", first.cast("string"), *[c.cast("string") for c in columns]))


def hash_to_int(digest: Column, start: int = 1, digits: int = 8) -> Column:
    """Hex digits of a digest, 15 at most, as a non-negative integer."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def hashed_rank(df: DataFrame, key: str, seed: int, group: Sequence[str] = ()) -> DataFrame:
    """Add ``rn`` (1-based place in seeded hash order) and ``n`` per ``group``.

    The order is that of 60 digest bits, then of ``key``, which must be unique.
    Digests are uniform, so their first 14 bits cut every group into 16,384 even
    pieces.
    """
    group = list(group)
    digits = F.left(seeded_hash(seed, key), F.lit(15))
    hashed = df.withColumn("_h", F.conv(digits, 16, 10).cast("bigint"))
    # Never NULL, so that no null check on it repeats the digest below the join.
    hashed = hashed.withColumn("_piece", F.expr("coalesce(cast(shiftright(_h, 46) as int), 0)"))
    sizes = hashed.groupBy(*group, "_piece").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group,
        "_piece",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"),
        F.sum("_c").over(whole).alias("n"),
    )
    inner = Window.partitionBy(*group, "_piece").orderBy("_h", key)
    placed = hashed.withColumn("_i", F.row_number().over(inner))
    return (
        placed.join(offsets, [*group, "_piece"])
        .withColumn("rn", F.col("_base") + F.col("_i"))
        .drop("_h", "_piece", "_base", "_i")
    )


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    keys: Sequence[str] = (),
    ties: Sequence[str] = (),
    pieces: int = 1024,
) -> DataFrame:
    """Add inclusive running totals ``cum_<name>`` in ascending ``order``, then ``ties``.

    ``order`` may have any orderable type and, with ``ties``, has to be unique
    within ``keys``: equal values have to be aggregated first.  The rows with the
    smallest digests, an even sample, only place the cuts; they are the same for
    all keys, so a piece of a key is never larger than one of the whole.  The
    totals are exact wherever the cuts fall.
    """
    keys, step = list(keys), 32
    identity = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in [*keys, order, *ties]]))
    sample = df.where(F.col(order).isNotNull()).select(F.col(order).alias("_at"), identity.alias("_id"))
    cuts = sample.orderBy("_id", "_at").limit(pieces - 1).agg(F.array_sort(F.array_agg("_at")).alias("_q"))
    # Every 32nd edge is tried first, then the 32 behind it.
    every = f"transform(filter(sequence(0, size(_q)), i -> i > 0 and i % {step} = 0), i -> _q[i - 1])"
    edges = cuts.selectExpr(f"struct(_q as fine, {every} as coarse) as _edges")
    cut = df.withColumn("_edges", edges.scalar())
    cut = cut.withColumn("_c", F.expr(f"size(filter(_edges.coarse, e -> e < {order})) * {step}"))
    fine = f"size(filter(slice(_edges.fine, _c + 1, {step}), e -> e < {order}))"
    # Never NULL, so that no null check on it is pushed below the caller's aggregate.
    cut = cut.withColumn("_piece", F.expr(f"coalesce(_c + {fine}, 0)")).drop("_edges", "_c")
    sizes = cut.groupBy(*keys, "_piece").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_piece", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums]
    )
    inner = (
        Window.partitionBy(*keys, "_piece")
        .orderBy(order, *ties)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    for s in sums:
        cut = cut.withColumn(f"cum_{s}", F.sum(s).over(inner))
    out = cut.join(offsets, [*keys, "_piece"])
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.col(f"cum_{s}") + F.col(f"_o_{s}"))
    return out.drop("_piece", *[f"_o_{s}" for s in sums])


def ordered_rank(df: DataFrame, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``rn``, the 1-based place in ascending ``order`` (unique within ``keys``)."""
    ranked = running_totals(df.withColumn("one", F.lit(1).cast("bigint")), order, ["one"], keys)
    return ranked.withColumnRenamed("cum_one", "rn").drop("one")
