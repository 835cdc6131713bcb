"""Near copies by SimHash fingerprints and the Jaccard similarity of word shingles.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8
or more; a text of fewer words is one shingle.  Candidates come from the vantage-point
trees of ``simhash``: fingerprints of the same shingles that differ in at most ``RADIUS``
bits, the most the trees search, and the components of these links are buckets.  At a
similarity of 0.8 fingerprints differ in some ten of 64 bits, so links that far apart are
found beside them by MinHash: ``BANDS`` keys of ``ROWS`` minima each are buckets too.  Texts
that share a bucket are compared exactly.

Texts with the same words are combined first, so a group of copies, however large, is one
row.  In each bucket all texts are compared with a leader, drawn by a hash, so that the
bands of a group have different ones.  Texts that the leader does not link with stay for
the next of ``LEADS`` rounds, under a leader of their own.  A round thus makes at most one
comparison for each text and band, whatever the size of a bucket.

Links that the rounds miss, between texts of different components so far, are found by a
join on heads, which loses none.  The shingles of all texts have one order, rare ones
first; a head is the part of a text that cannot be all its own if a similar text exists, so
two similar texts share a shingle of their heads, the first that they share leaves enough
shingles behind it in both, and with those that their heads share there are enough.  The order comes from a sample of the documents: it decides how
many pairs are compared, not which links are found.  In each key the largest component is
not compared with itself, so a large group of copies adds no pairs of its own.  A text
compared with many is dealt in parts.

Defined results: null text is empty, texts without words are copies of each other; words
are cut and lowered as in ``fingerprint``; a component keeps its smallest id, rows without
an id lose to all others; rows that agree in id and words are one document; other columns
pass through; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelarium.llm.common import carries, free_name, text_or_empty
from voxelarium.llm.fingerprint import simhash
from voxelarium.llm.simhash import components, star_components
from voxelarium.sinks.tables import bucketed_bricks
from voxelarium.storage import materialise

#: Words of a shingle and the similarity of linked texts.
SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits of fingerprints that the trees find.
RADIUS = 3
#: Keys of a text, and minima of a key.
BANDS = 24
ROWS = 4
#: Leaders that a text of a bucket meets at most.
LEADS = 4
#: Comparisons with one text that a task takes before they are dealt in parts.
COMPARED = 64
#: Documents of the sample behind the order of shingles, and the frequent shingles kept of it.
SAMPLE = 1 << 14
LISTED = 1 << 18

_LOWER = bytes(range(256)).lower()
_RNG = np.random.default_rng(42)
_FLIPS = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64)
_FACTORS = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
#: Shingles whose permutations are held at once.
_BLOCK = 1 << 10


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit digests of the different shingles."""
    size = min(shingle, len(words))
    if not size:
        return np.empty(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), dtype=np.uint64, count=len(words) - size + 1))


def band_keys(hashes: np.ndarray) -> list[int]:
    """Signed keys; texts without words have none."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for start in range(0, len(hashes), _BLOCK):
        part = (hashes[start : start + _BLOCK] ^ _FLIPS) * _FACTORS
        least = np.minimum(least, part.min(axis=1))
    keys = (xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS))
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def head(hashes: np.ndarray, known: np.ndarray, often: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles in the order of frequency, then value; ``often`` belongs to the sorted ``known``.

    A similar text shares at least ``similarity`` times as many shingles as there are, hence one of these.
    """
    if not len(hashes):
        return hashes
    counts = np.zeros(len(hashes), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        counts = np.where(known[at] == hashes, often[at], 0)
    shared = math.ceil(similarity * len(hashes) - 1e-6)
    return hashes[np.lexsort((hashes, counts))[: len(hashes) - shared + 1]]


def similar(one: bytes, other: bytes, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> bool:
    a, b = shingles(words_of(one), shingle), shingles(words_of(other), shingle)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def _alike(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``hi, lo``: those of ``pairs(a, b)`` whose texts are similar."""

    @F.pandas_udf("boolean")
    def alike(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([similar(x, y, shingle, similarity) for x, y in zip(one, other)], dtype=bool)

    # The texts lie in buckets by node: those of this round are taken out without moving the others.
    named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = texts.join(named, "node", "left_semi")
    often = materialise(
        pairs.groupBy("b").agg(F.ceil(F.count("*") / COMPARED).cast("int").alias("parts")).filter("parts > 1"), "compared-often"
    )
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(often, "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int")).drop("parts")
    many = texts.join(often.withColumnRenamed("b", "node"), "node", "left").select(
        F.col("node").alias("b"), F.col("text").alias("other"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")
    )
    return (
        dealt.join(texts.withColumnRenamed("node", "a"), "a")
        .join(many, ["b", "part"])
        .filter(alike(F.col("text").cast("binary"), F.col("other").cast("binary")))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    )


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``_alike`` for the pairs of one round of leaders."""
    return _alike(pairs, texts, shingle, similarity)


def _frequent(docs: DataFrame, mark: str, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that repeat in a sample of the ``n`` rows of ``docs(text)``, drawn by ``mark``, and how often."""

    @F.pandas_udf("array<long>")
    def digests(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(words_of(t), shingle).view(np.int64) for t in texts])

    parts = 1 << 20
    drawn = docs.where(F.pmod(F.xxhash64(mark), F.lit(parts)) < math.ceil(parts * SAMPLE / max(SAMPLE, n)))
    counted = drawn.select(F.explode(digests(F.col("text").cast("binary"))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    counted = materialise(counted.where("n > 1"), "frequent-shingles")
    # The most frequent: all of a count or none.  There are as many counts as sampled documents at most.
    kept, least = 0, None
    for row in counted.groupBy("n").agg(F.count("*").alias("keys")).orderBy(F.desc("n")).collect():
        kept += row["keys"]
        if kept > LISTED:
            break
        least = row["n"]
    rows = counted.where(F.col("n") >= least).toPandas() if least else pd.DataFrame({"key": [], "n": []})
    known, often = rows["key"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(known)
    return known[order], often[order]


def _heads(texts: DataFrame, known: np.ndarray, often: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """``key, id, size, rest`` for the head of each of ``texts(node, text)``: its shingles from this one on."""
    order = texts.sparkSession.sparkContext.broadcast((known, often))

    @F.pandas_udf("struct<size: int, keys: array<long>>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            hashes = shingles(words_of(text), shingle)
            rows.append((len(hashes), head(hashes, *order.value, similarity).view(np.int64)))
        return pd.DataFrame(rows, columns=["size", "keys"])

    # Short names of texts: two texts of one name would only be compared once more.
    named = texts.select(F.xxhash64("node").alias("id"), cut(F.col("text").cast("binary")).alias("cut"))
    placed = named.select("id", F.col("cut.size").alias("size"), F.posexplode("cut.keys").alias("place", "key"))
    return placed.select("key", "id", "size", (F.col("size") - F.col("place")).alias("rest"))


def _open_pairs(heads: DataFrame, stars: DataFrame, similarity: float) -> DataFrame:
    """``x, y``: ids of texts in different components of ``stars`` whose heads allow that they are similar."""
    w = Window.partitionBy("key")
    met = heads.withColumns({"first": F.min("id").over(w), "last": F.max("id").over(w)}).where("first < last").drop("first", "last")
    met = materialise(met, "met-heads")
    named = stars.select(F.xxhash64("hi").alias("id"), F.xxhash64("lo").alias("root"))
    met = met.join(named, "id", "left").withColumn("root", F.coalesce("root", "id"))
    in_root = met.groupBy("key", "root").agg(F.count("*").alias("n"))
    keys = in_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("roots"))
    parts = F.ceil((F.col("n") - F.col("most.n")) / COMPARED).cast("int")
    met = materialise(met.join(keys.where("roots > 1").select("key", F.col("most.root").alias("main"), parts.alias("parts")), "key"), "open-heads")

    def side(name: str) -> list[Column]:
        return [F.col(c).alias(f"{name}_{c}") for c in ("id", "root", "main", "size", "rest")]

    some = met.where("root <> main").select("key", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), *side("x"))
    every = met.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *side("y"))
    # A pair meets once in each key that both heads hold, either way round.
    met = some.join(every, ["key", "part"]).where(F.col("x_root") != F.col("y_root")).where("y_root = y_main or x_id < y_id")
    needed = similarity * (F.col("x_size") + F.col("y_size")) - 1e-6
    # What follows the first common shingle, and all that can be common beside the heads.
    first = F.least("x_rest", "y_rest") * (1 + similarity) >= needed
    behind = F.greatest(*(F.ceil(similarity * F.col(f"{c}_size") - 1e-6) - 1 for c in "xy"))
    both = (F.count("*") + F.max(behind)) * (1 + similarity) >= F.max(needed)
    pair = [F.least("x_id", "y_id").alias("x"), F.greatest("x_id", "y_id").alias("y")]
    return met.groupBy(*pair).agg(F.max(first).alias("first"), both.alias("both")).where("first and both").select("x", "y")


def _stars(shared: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``hi, lo`` where ``lo`` names the component of ``hi``, of the texts in ``shared(bucket, node)``."""
    links = tried = None
    for _ in range(LEADS):
        drawn = F.struct(F.xxhash64("bucket", "node").alias("h"), "node")
        first = shared.groupBy("bucket").agg(F.min(drawn)["node"].alias("leader"), F.count("*").alias("n"))
        led = materialise(
            shared.join(materialise(first.where("n > 1").drop("n"), "bucket-leaders"), "bucket")
            .where("node <> leader")
            .select("bucket", "node", "leader", F.greatest("node", "leader").alias("hi"), F.least("node", "leader").alias("lo")),
            "led-texts",
        )
        # Of equal pairs one order of the two stays: the leader is the side that may meet many.
        new = led.groupBy("hi", "lo").agg(F.min(F.struct("node", "leader")).alias("p"))
        if tried is not None:
            new = new.join(tried, ["hi", "lo"], "left_anti")
        new = materialise(new.select("hi", "lo", "p.*"), "new-pairs")
        tried = new.select("hi", "lo") if tried is None else tried.union(new.select("hi", "lo"))
        found = materialise(_verified(new.select(F.col("node").alias("a"), F.col("leader").alias("b")), texts, shingle, similarity), "near-copies")
        links = found if links is None else links.union(found)
        shared = materialise(led.join(links, ["hi", "lo"], "left_anti").select("bucket", "node"), "open-buckets")
    return star_components(links)


@carries("id_column", "text_column")
def keep_one(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``docs`` with one document of each component of near copies: its smallest id."""

    @F.pandas_udf("struct<node: binary, bands: array<long>, mark: long>")
    def tag(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words, mark = words_of(text), simhash(text, shingle)
            node = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
            rows.append((node, band_keys(shingles(words, shingle)), mark - (1 << 64) if mark >> 63 else mark))
        return pd.DataFrame(rows, columns=["node", "bands", "mark"])

    # A row is known again by 128 bits of its id and text, which need no Python.  Rows move once, into
    # buckets by these bits: both joins by them, for the texts to compare and for the rows to keep, find them there.
    one, two = free_name(docs.columns, "row_one"), free_name(docs.columns, "row_two")
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row_id, text = F.col(id_column).cast("long"), text_or_empty(text_column)
    marked = bucketed_bricks(
        docs.withColumn(one, F.xxhash64(row_id, text)).withColumn(two, F.xxhash64(text, F.lit(1), row_id)), buckets, keys=[one, two]
    )
    tags = materialise(marked.select(row_id.alias("id"), one, two, tag(text.cast("binary")).alias("mark")), "document-tags")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", one, two)).alias("best")
    nodes = materialise(
        tags.groupBy(F.col("mark.node").alias("node")).agg(
            best, F.first("mark.bands").alias("bands"), F.first("mark.mark").alias("mark")
        ),
        "different-texts",
    )
    near = components(nodes.select(F.lit(0).cast("long").alias("doc_id"), "mark"), RADIUS)
    by_mark = materialise(
        nodes.select("node", "mark").join(near, "mark").select("node", F.xxhash64("root", F.lit("root")).alias("bucket")), "near-marks"
    )
    keyed = nodes.select("node", F.explode("bands").alias("bucket")).union(by_mark)
    often = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    shared = materialise(keyed.join(materialise(often, "full-buckets"), "bucket"), "shared-buckets")

    def once(rows: DataFrame) -> DataFrame:
        """One of rows that agree in id and text; behind a join by them it needs no sort of its own."""
        order = Window.partitionBy(one, two).orderBy(one, two)
        nth = free_name(rows.columns, "nth")
        return rows.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth, one, two)

    def texts_of(nodes: DataFrame) -> DataFrame:
        """``node, text``; the same plan at every size: small lists of rows are not broadcast."""
        named = nodes.select("node", f"best.{one}", f"best.{two}")
        found = marked.select(one, two, text.alias("text")).join(materialise(named, "compared").hint("merge"), [one, two])
        return once(found).select("node", "text")

    texts = bucketed_bricks(texts_of(nodes.join(shared.select("node").distinct(), "node", "left_semi")), buckets, keys=["node"])
    stars = _stars(shared, texts, shingle, similarity)

    known, often = _frequent(marked.select(one, text.alias("text")), one, tags.count(), shingle)
    heads = _heads(texts_of(nodes.where(F.size("bands") > 0)), known, often, shingle, similarity)
    ids = nodes.select("node", F.xxhash64("node").alias("id"))
    pairs = _open_pairs(heads, stars, similarity).join(ids.toDF("a", "x"), "x").join(ids.toDF("b", "y"), "y").select("a", "b")
    pairs = materialise(pairs, "open-pairs")
    if not pairs.isEmpty():
        named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        texts = materialise(texts_of(nodes.join(named, "node", "left_semi")), "open-texts")
        stars = star_components(stars.union(_alike(pairs, texts, shingle, similarity)))
    winners = materialise(
        nodes.drop("bands", "mark")
        .join(stars.withColumnRenamed("hi", "node"), "node", "left")
        .groupBy(F.coalesce("lo", "node"))
        .agg(F.min("best").alias("best"))
        .select(f"best.{one}", f"best.{two}"),
        "winners",
    )
    return once(marked.join(winners.hint("merge"), [one, two], "left_semi"))
