"""Line deduplication over the whole corpus.

A line's key is the line without white space at both ends, A-Z in lower case.  Keys are
hashed, and each document hands in each of its keys once, so that counting documents is
counting rows, with a map-side combine.  Only the hashes at or over the threshold are
kept; Spark broadcasts that table if it is small and joins by shuffle if not.

The lines to drop depend on a document's text alone.  Hits are therefore gathered by text
digest (a set, combined map-side), which serves rows without or with repeated ids too,
and the lines that stay are put together by position.  Line texts are never shuffled by
line; each document's text moves once.

Defined results: a null or empty text is one empty line; empty keys are never dropped;
each row counts as a document of its own; result columns replace input columns of the
same name, other columns pass through; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxelarium.llm.common import WHITE, ascii_lower, carries, free_name, sha256, text_or_empty, with_result
from voxelarium.storage import materialise

#: Documents that make a line a repeated one.
MIN_DOCUMENTS = 10
MIN_CHARS = 1


def line_hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """A 128-bit hash for each line in order, null for keys shorter than ``min_chars``."""

    def hashed(line: Column) -> Column:
        key = F.trim(line, F.lit(WHITE))
        return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key)))

    return F.transform(F.split(ascii_lower(text), "\n"), hashed)


def repeated_lines(docs: DataFrame, text_column: str, min_documents: int, min_chars: int) -> DataFrame:
    """``line_hash`` and ``documents`` of the keys found in at least ``min_documents`` rows."""
    once = F.array_distinct(F.filter(line_hashes(text_or_empty(text_column), min_chars), lambda h: h.isNotNull()))
    return (
        docs.select(F.explode(once).alias("line_hash"))
        .groupBy("line_hash")
        .agg(F.count("*").alias("documents"))
        .filter(F.col("documents") >= min_documents)
    )


@carries("text_column")
def drop_repeated_lines(
    docs: DataFrame,
    text_column: str = "text",
    min_documents: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (before) and ``n_dropped``."""
    text = text_or_empty(text_column)
    repeated = materialise(repeated_lines(docs, text_column, min_documents, min_chars), "repeated-lines")
    hits = (
        docs.select(sha256(text).alias("digest"), F.posexplode(line_hashes(text, min_chars)).alias("position", "line_hash"))
        .filter("line_hash IS NOT NULL")
        .join(repeated.select("line_hash"), "line_hash", "left_semi")
        .groupBy("digest")
        .agg(F.collect_set("position").alias("positions"))
    )
    digest, positions = (free_name(docs.columns, c) for c in ("text_digest", "drop_positions"))
    # Read back, a side of the join that Spark can split where many documents share a text.
    hits = materialise(hits, "line-hits").select(F.col("digest").alias(digest), F.col("positions").alias(positions))
    lines, n_lines = F.split(text, "\n"), F.size(F.split(text, "\n"))
    kept = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col(positions))
    joined = docs.withColumn(digest, sha256(text)).join(hits, digest, "left")
    return with_result(
        joined,
        kept_text=F.when(F.col(positions).isNull(), text).otherwise(
            F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
        ),
        n_lines=n_lines.cast("long"),
        n_dropped=F.coalesce(F.array_size(positions), F.lit(0)).cast("long"),
    ).drop(digest, positions)


def line_dedup(docs: DataFrame) -> DataFrame:
    """The registered form: counts and the digest of what stays."""
    return drop_repeated_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


SQL = r"""
WITH l AS (SELECT row, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
           FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY row, doc_id"""
