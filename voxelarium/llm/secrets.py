"""Secret scan: fixed patterns, and values in credential contexts that are costly to guess.

The base kinds are matched leftmost and without overlap within a kind: ``assign`` (the
whole assignment), ``access`` and ``hex``; matches that are too short are dropped after
matching.  On top, values behind a wider range of credential words, in URLs and behind
``Bearer`` are judged by ``guess_cost``: those that take at least ``MIN_BITS`` bits to
guess become ``guess`` spans unless they lie inside a base span.  Words, dates, repeats
and keyboard walks are cheap, so prose behind such a word is left alone.

Defined results: null text is empty and has no spans; repeated rows each get their row;
values are judged whole; result columns replace input columns of the same name, others
pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voxelarium.llm.common import carries, text_or_empty, with_result
from voxelarium.llm.guess_cost import guess_bits, word_ranks
from voxelarium.llm.tokens import default_path

MIN_VALUE = 8
MIN_BITS = 40.0
#: In the order of equal starts.
KINDS = ("assign", "access", "hex", "guess")

_ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
# A run is matched whole, so asking for its length is the same as dropping short ones.
_HEX = re.compile(r"[0-9a-f]{16,}")
_CONTEXT = re.compile(
    r"(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|secret|auth)[_-]?key)"
    r"[\"'\])]{0,2}\x20{0,4}(?:=>|:=|[:=])\x20{0,4}"
    # In quotes a value goes to the closing one and may hold any other sign but white space.
    r"(?:\"(?P<double>[^\s\"]+)\"|'(?P<single>[^\s']+)'|[\"']?(?P<value>[^\s\"'<>,;]+))"
    r"|://[^\s/:@\"'<>]+:(?P<login>[^\s/@\"'<>]+)@"
    r"|(?ai:bearer)\x20(?P<bearer>[A-Za-z0-9+/_.=~-]+)"
)

SPAN = "array<struct<kind: string, start: int, end: int, bits: double>>"


def find_secrets(text: str, ranks: dict[str, int]) -> list[tuple[str, int, int, float | None]]:
    """Spans in code points, end exclusive, by start and then kind; bits of the value where it was judged."""
    found = [
        ("assign", m.start(), m.end(), guess_bits(m[1], ranks)) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12
    ]
    found += [("access", *m.span(), None) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span(), None) for m in _HEX.finditer(text)]
    # A value lies in a base span if one that starts no later reaches its end.
    starts = sorted((a, b) for _, a, b, _ in found)
    reach = list(accumulate((b for _, b in starts), max))
    for m in _CONTEXT.finditer(text):
        start, end = m.span(m.lastgroup)
        before = bisect_right(starts, (start, len(text)))
        if end - start >= MIN_VALUE and not (before and reach[before - 1] >= end):
            bits = guess_bits(text[start:end], ranks)
            if bits >= MIN_BITS:
                found.append(("guess", start, end, bits))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


@carries("text_column")
def scan_secrets(docs: DataFrame, vocabulary: str | None = None, text_column: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: an array of kind, start, end and guess bits."""
    path = vocabulary or default_path("word_bpe_49k.json")

    @F.pandas_udf(SPAN)
    def spans(texts: pd.Series) -> pd.Series:
        ranks = word_ranks(path)
        names = ("kind", "start", "end", "bits")
        return pd.Series([[dict(zip(names, s)) for s in find_secrets(t, ranks)] for t in texts], dtype=object)

    return with_result(docs, secrets=spans(text_or_empty(text_column)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """The registered form."""
    found = scan_secrets(docs.select("doc_id", "text"))
    secrets = F.col("secrets")

    def count(kind: str) -> Column:
        return F.size(F.filter(secrets, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(kind) for kind in KINDS[:3]),
        F.sha2(_joined(F.filter(secrets, lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        _joined(secrets).alias("spans"),
        count("guess"),
    )
