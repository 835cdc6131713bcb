"""Language identification with language-bitmask n-gram filters.

A language's n-grams are its ``MAX_GRAMS`` most frequent ones, whatever their share, so that
scripts with flat n-grams are known as well.  All languages share one Bloom filter in bit-sliced
form: each cell is a mask with a bit per language, an n-gram sets its language's bit in
``PROBES`` cells, and a lookup ANDs those cells, which answers for all languages at once.
The filter's size follows from the number of n-grams and is bounded by languages times
``MAX_GRAMS``.

A text's n-grams are looked up together; for each language the set bits are counted and
corrected for its false-positive rate (the share of set cells to the power ``PROBES``).
The language with the largest corrected count wins, and the score is that count's share of
all n-grams.

The filter is fitted on a sample of labelled documents: all of a language that has up to
``SAMPLE``, of others that many in expectation, drawn evenly by a hash of the id.  So a rare
language is learned from all its documents.  The label is taken to be a language column:
its different values are listed on the driver.  Everything else reads all documents and
whole texts.

Defined results: null text, or text without a letter, is ``und`` with score 0; if no
n-gram is known the most frequent learned language is given with score 0; equal counts go
to the more frequent and then alphabetically first language; without any label every text
is ``und``; rows with a null id are never held out and, as no hash of an id can pick them,
not learned from; repeated rows each get their row; result columns replace input columns
of the same name, others pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelarium.llm.common import carries, free_name, text_or_empty, with_result
from voxelarium.storage import materialise

#: Labelled documents of a language to fit on, n-grams per language, n, probes and cells per n-gram.
SAMPLE = 5_000
MAX_GRAMS = 20_000
SIZES = (3, 4)
PROBES = 3
#: Characters hashed at once.
BLOCK = 1 << 20
CELLS = 16
UNKNOWN = "und"

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_DRAWS = 1 << 30


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def letter_codes(text: str) -> np.ndarray:
    """Code points of ``text`` in lower case; every run of other characters is one blank, also at the ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return np.where(letter, codes, np.uint32(32))[keep]


def gram_hashes(codes: np.ndarray) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams, repeats included, a bounded number at a time."""
    for start in range(0, len(codes), BLOCK):
        part = codes[start : start + BLOCK + SIZES[-1] - 1].astype(np.uint64)
        h = np.full(len(part), _MULTIPLIERS[0])
        for n in range(1, SIZES[-1] + 1):
            left = min(BLOCK, len(part) - n + 1)
            if left <= 0:
                break
            h = (h[: len(part) - n + 1] ^ part[n - 1 :]) * _MULTIPLIERS[0]
            h ^= h >> np.uint64(29)
            if n in SIZES:
                yield h[:left]


class LanguageFilter:
    """Bit-sliced Bloom filter over the n-gram hashes of several languages."""

    def __init__(self, languages: list[str], grams: list[np.ndarray]):
        """``languages`` in the order that decides between equal counts."""
        self.languages = languages
        cells = max(1, sum(map(len, grams))) * CELLS
        self.shift = np.uint64(64 - max(1, math.ceil(math.log2(cells))))
        self.masks = np.zeros((1 << int(64 - self.shift), (len(languages) + 63) // 64), dtype=np.uint64)
        for k, hashes in enumerate(grams):
            for cell in self._cells(hashes):
                np.bitwise_or.at(self.masks[:, k // 64], cell, np.uint64(1) << np.uint64(k % 64))
        filled = np.array([np.mean(self._bit(self.masks, k)) for k in range(len(languages))])
        self.false_rate = filled**PROBES

    def _cells(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        for m in _MULTIPLIERS[1 : 1 + PROBES]:
            yield (hashes * m) >> self.shift

    @staticmethod
    def _bit(masks: np.ndarray, k: int) -> np.ndarray:
        return (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)

    def languages_of(self, hashes: np.ndarray) -> np.ndarray:
        """For each hash the mask of the languages that contain it."""
        found = None
        for cell in self._cells(hashes):
            found = self.masks[cell] if found is None else found & self.masks[cell]
        return found

    def decide(self, text: str) -> tuple[str, float]:
        codes = letter_codes(text)
        if not self.languages or len(codes) < 2:
            return UNKNOWN, 0.0
        total, counts = 0, np.zeros(len(self.languages))
        for hashes in gram_hashes(codes):
            masks = self.languages_of(hashes)
            total += len(hashes)
            counts += [np.count_nonzero(self._bit(masks, k)) for k in range(len(counts))]
        share = (counts / total - self.false_rate) / np.maximum(1e-9, 1 - self.false_rate)
        best = int(np.argmax(share))
        return (self.languages[best], min(1.0, float(share[best]))) if share[best] > 0 else (self.languages[0], 0.0)


def held_out(row_id: Column) -> Column:
    """Documents that nothing is learned from; a null id is not among them."""
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, text_column: str, label_column: str, draw: Column, sample: int) -> LanguageFilter:
    """Fit on about ``sample`` labelled ``docs`` of each language, chosen by the number ``draw`` below 2^30."""
    labelled = docs.filter(F.col(label_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(label_column).cast("string").alias("language"), F.col(text_column).alias("text"), draw.alias("draw")
    )
    counted_rows = materialise(labelled.groupBy("language").agg(F.count("*").alias("size")), "language-sizes")
    sizes = {r["language"]: r["size"] for r in counted_rows.collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))

    def counts(language: str, hashes: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(hashes), return_counts=True)
        columns = [pa.array([language] * len(n), pa.string()), pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["language", "gram", "n"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for hashes in gram_hashes(letter_codes(text.as_py())):
                    seen.setdefault(language, []).append(hashes.copy())
                    size += len(hashes)
                if size >= 4 * BLOCK:
                    yield from (counts(*x) for x in seen.items())
                    seen, size = {}, 0
        yield from (counts(*x) for x in seen.items())

    counted = materialise(
        labelled.join(counted_rows, "language")
        .filter(F.col("draw") * F.col("size") < sample * _DRAWS)
        .select("language", "text")
        .mapInArrow(grams, "language string, gram long, n long")
        .groupBy("language", "gram")
        .agg(F.sum("n").alias("n")),
        "language-grams",
    )
    # A window holds the different n-grams of one language's sample; ties go by the n-gram's hash.
    order = Window.partitionBy("language").orderBy(F.desc("n"), "gram")
    ranked = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= MAX_GRAMS)
    rows = ranked.select("language", "gram").collect()
    found: dict[str, list[int]] = {}
    for r in rows:
        found.setdefault(r["language"], []).append(r["gram"])
    return LanguageFilter(languages, [np.array(sorted(found.get(k, [])), dtype=np.int64).view(np.uint64) for k in languages])


@carries("id_column", "text_column", "label_column")
def identify(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "lang",
    sample: int = SAMPLE,
) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``; the label serves fitting only."""
    draw = F.pmod(F.xxhash64(F.col(id_column).cast("string")), F.lit(_DRAWS))
    learnable = docs.filter(F.col(id_column).isNotNull() & ~held_out(F.col(id_column)))
    shared = docs.sparkSession.sparkContext.broadcast(fit(learnable, text_column, label_column, draw, sample))

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.decide(t) for t in texts], columns=["lang_pred", "score"])

    guess = free_name(docs.columns, "guess")
    out = docs.withColumn(guess, predicted(text_or_empty(text_column)))
    return with_result(
        out,
        held_out=held_out(F.col(id_column)),
        lang_pred=F.col(guess)["lang_pred"],
        score=F.col(guess)["score"],
    ).drop(guess)


def language_predictions(docs: DataFrame) -> DataFrame:
    """The registered form."""
    return identify(docs.select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
