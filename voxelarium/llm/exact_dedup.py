"""Exact deduplication by salted combining.

Texts are equal when they agree after all white space is deleted.  Rows are combined
three times: by the partial aggregate inside each map task, by salted digest, and by
digest over the salts.  Each time the grouping key holds the digest *and* the whole
normalised text, so two texts that merely share a digest never merge.

The winner of a group travels as one decimal (length, then smallest id), which keeps the
aggregates in fixed-width buffers: a hash aggregate, no sort by content.

Going back from groups to rows needs no content as long as each digest stands for one
text.  That is looked up in the table of groups; if a digest ever stands for several, the
rows are joined by digest and whole text instead.

Defined results: null text is the empty text; a null id loses to every other id of the
same length and gives a null ``keep_id``; of rows that agree in id, length and normalised
text one is kept; no rows give no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from voxelarium.llm.common import lower_hex, sha256, text_or_empty, without_white
from voxelarium.storage import materialise

#: Pieces of a digest's rows in the first shuffle.
SALTS = 64

_SHIFT, _HALF = Decimal(2**65), Decimal(2**63)


def _rank(length: Column, row_id: Column) -> Column:
    """One number that grows with the length and, below it, with falling id; a null id is lowest."""
    low = F.coalesce(F.lit(_HALF) - row_id.cast("decimal(20,0)"), F.lit(Decimal(0)))
    return length.cast("decimal(10,0)") * F.lit(_SHIFT) + low


def _rank_id(rank: Column) -> Column:
    low = rank % F.lit(_SHIFT)
    return F.when(low > 0, (F.lit(_HALF) - low).cast("long"))


def _rank_length(rank: Column) -> Column:
    return F.floor(rank / F.lit(_SHIFT)).cast("long")


def exact_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_digest``."""
    text = text_or_empty(text_column)
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.char_length(text).cast("long").alias("chars"),
        without_white(text).alias("content"),
    ).withColumn("text_digest", digest(F.col("content")))

    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("text_digest", "salt", "content")
        .agg(F.max(_rank(F.col("chars"), F.col("doc_id"))).alias("best"), F.count("*").alias("n"))
    )
    groups = salted.groupBy("text_digest", "content").agg(
        F.max("best").alias("best"), F.sum("n").alias("group_size")
    )
    by_digest = materialise(
        groups.groupBy("text_digest").agg(
            F.count("*").alias("contents"), F.max("best").alias("best"), F.max("group_size").alias("group_size")
        ),
        "exact-groups",
    )
    key = ["text_digest"]
    if by_digest.filter("contents > 1").isEmpty():
        groups = by_digest.drop("contents")
    else:
        key.append("content")
    members = rows.groupBy("doc_id", "chars", *key).agg(F.count("*").alias("times"))
    return (
        members.join(groups, key)
        .withColumn("keep_id", _rank_id(F.col("best")))
        .withColumn("wins", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == _rank_length(F.col("best"))))
        .withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select("doc_id", "keep_id", "group_size", (F.col("wins") & (F.col("turn") == 1)).alias("kept"), "text_digest")
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The registered form, digests as lower-case hex."""
    return exact_groups(docs).select(
        "doc_id", "keep_id", "group_size", "kept", lower_hex(F.col("text_digest")).alias("text_sha256")
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS chars, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS norm FROM d)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)"""
