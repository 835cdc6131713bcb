"""Packing of tokenized documents by shortest-pack-first over the length histogram.

Each document becomes token ids with an end id, cut into pieces of at most one sequence.
The histogram of piece lengths has at most ``size`` rows, whatever the corpus.  On it the
lengths are placed from the longest to the shortest, each time onto the packs that are
shortest so far; packs that look alike are one pattern with a count, and a step moves as
many of them at once as there are pieces.  Every step is a range of ranks of one length
that goes to a range of sequences at one offset.

Pieces get their rank within their length from hashed buckets (counts, prefix sums, then a
row number inside a bucket), so a length shared by most pieces is never sorted in one
task.  The steps, few and made on the driver, are joined back by length and rank.

Defined results: null text is the empty text, whose only id is the end id; a null id
column is carried; repeated rows are packed each on their own; other columns are not read;
no rows give no sequences.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from voxelarium.llm.common import text_or_empty
from voxelarium.llm.tokens import MEMO, WORD_PATTERN, Memo, PreTokens, default_path
from voxelarium.storage import materialise

SIZE = 4096
END_ID = 2
#: Hashed buckets of a length, each ranked in a task.
BUCKETS = 1024

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class TokenIds(PreTokens):
    """Ids as little-endian unsigned 32-bit integers.

    No pre-token holds a blank, so most stretches are one and both share a memo.
    """

    def __init__(self, path: str):
        super().__init__(path, WORD_PATTERN, base={})
        self.of_piece = self.of_stretch = Memo(self.stretch, size=2 * MEMO)

    def value(self, ids: list[int]) -> bytes:
        return pack_ids(f"<{len(ids)}I", *ids)

    def stretch(self, text: str) -> bytes:
        pieces = self.find(text)
        return self.piece(text) if pieces == [text] else b"".join(map(self.of_piece.__getitem__, pieces))

    def ids(self, text: str) -> bytes:
        """The tokenizer drops white space, so every word stands alone."""
        if self.safe(text) and not self.has_special(text):
            return b"".join(map(self.of_stretch.__getitem__, text.lower().split()))
        return self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)


#: Tokenizers of this worker process by file; a worker serves many tasks.
_OPEN: dict[str, TokenIds] = {}


def token_pieces(docs: DataFrame, path: str, size: int, end_id: int, id_column: str, text_column: str) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _OPEN:
            _OPEN[path] = TokenIds(path)
        end = pack_ids("<I", end_id)
        for batch in batches:
            rows = []
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = _OPEN[path].ids(text.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start : 4 * (start + size)]
                    rows.append((row_id, start, len(part) // 4, zlib.crc32(part), total))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return docs.select(F.col(id_column).cast("long"), text_or_empty(text_column)).mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Steps ``(length, first rank, count, first sequence, offset)``.

    ``patterns[used]`` holds ranges of sequences that are filled to ``used``.
    """
    steps, patterns, filled, sequences = [], defaultdict(list), [], 0

    def keep(used: int, first: int, count: int) -> None:
        if used < size:
            if not patterns[used]:
                heapq.heappush(filled, used)
            patterns[used].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            while filled and not patterns[filled[0]]:
                heapq.heappop(filled)
            if filled and filled[0] + length <= size:
                used = filled[0]
                first, count = patterns[used].pop()
                if not patterns[used]:
                    heapq.heappop(filled)
                moved = min(count, left)
                steps.append((length, rank, moved, first, used))
                keep(used + length, first, moved)
                if count > moved:
                    keep(used, first + moved, count - moved)
                rank, left = rank + moved, left - moved
                continue
            # Nothing fits: new packs, each filled with this length before the next is opened.
            copies = min(size // length, left)
            packs = left // copies
            for copy in range(copies):
                steps.append((length, rank, packs, sequences, copy * length))
                rank += packs
            keep(copies * length, sequences, packs)
            sequences, left = sequences + packs, left - packs * copies
    return steps


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """``pieces`` with ``rank``: 0, 1, ... within each length."""
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order))
    return (
        dealt.withColumn("inside", inside)
        .join(base, ["length", "bucket"])
        .withColumn("rank", F.col("base") + F.col("inside") - 1)
        .drop("bucket", "inside", "base")
    )


def pack(
    docs: DataFrame,
    path: str | None = None,
    size: int = SIZE,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per piece: its place in its document, digest of its ids, sequence and offset."""
    path = path or default_path("word_bpe_49k.json")
    pieces = materialise(token_pieces(docs, path, size, end_id, id_column, text_column), "token-pieces")
    # At most ``size`` rows.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = np.array(sorted(shortest_pack_first(histogram, size)), dtype=np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(steps)

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = shared.value
        key = np.int64(1) << 48
        at = np.searchsorted(table[:, 0] * key + table[:, 1], length.to_numpy() * key + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": table[at, 3] + rank.to_numpy() - table[at, 1], "offset": table[at, 4]})

    return ranked(pieces, buckets).withColumn("place", placed("length", "rank")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "place.sequence_id", "place.offset"
    )
