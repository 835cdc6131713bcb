"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items form one automaton, one block of items at a time.
Training words stream through it: after each word the state says how long a suffix of
what was read occurs in an item.  Where that length reaches the window, the window's words
are a hit and the state names the items; items shorter than the window hit as a whole.

Items are dealt into blocks of about ``block_words`` words, so one automaton, which is
what gets broadcast, has a bounded size (at most two states a word) however long the
benchmark is.  Further blocks run over the result of the one before, written in between,
so a worker never holds two.  Documents are never shuffled.

Defined results: null text has no words; items without words match nothing; equal items
are all named; a null item id counts as an item named by the empty string; repeated
documents each get their row; result columns replace input columns of the same name, all
others pass through; an empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voxelarium.llm.common import UPPER, carries, free_name, text_or_empty, with_result
from voxelarium.storage import materialise

#: Words of a window, and the share of hit words (as a fraction) that makes a document contaminated.
WINDOW = 13
COVERAGE = (1, 20)
#: Words of test items in one automaton.
BLOCK_WORDS = 100_000

#: Words of the original text; a normalised word has the same place.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_KEPT = b"0123456789" + UPPER.encode() + UPPER.lower().encode() + bytes(range(128, 256))
_TABLE = bytes(b if b in _KEPT else 32 for b in range(256)).lower()

MATCH = (
    "n_words bigint, spans array<struct<start: bigint, end: bigint>>, "
    "char_spans array<struct<start: bigint, end: bigint>>, items array<string>"
)


def words_of(text: bytes) -> list[bytes]:
    """Normalised words of UTF-8 ``text``: runs of digits, letters a-z and non-ASCII characters."""
    return text.translate(_TABLE).split()


class ItemAutomaton:
    """Suffix automaton of several word sequences that knows which items own each window."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window, self.vocabulary, self.names = window, {}, []
        self.next, self.link, self.length = [{}], [-1], [0]
        self.owners: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        sequences = []
        for name, words in items:
            if words:
                self.names.append(name)
                sequences.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        for item, sequence in enumerate(sequences):
            self._own(item, sequence)
        # The first state on the way to the root where a short item ends; links lead to shorter states.
        self.nearest = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.nearest[s] = s if s in self.short else self.nearest[self.link[s]]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._exact(last, word)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._exact(p, word)
        return new

    def _exact(self, p: int, word: int) -> int:
        """The target of an edge, split off if it also stands for longer sequences from elsewhere."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = part
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = part
            p = self.link[p]
        return part

    def _own(self, item: int, sequence: list[int]) -> None:
        s = 0
        for at, word in enumerate(sequence, 1):
            s = self.next[s][word]
            if at >= self.window:
                s = self._window_state(s)
                self.owners.setdefault(s, set()).add(item)
        if len(sequence) < self.window:
            self.short.setdefault(s, []).append((len(sequence), item))

    def _window_state(self, s: int) -> int:
        while self.length[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Disjoint hit spans of word positions, end exclusive, and the items that occur."""
        step, link, length, nearest, window = self.next, self.link, self.length, self.nearest, self.window
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        s = matched = 0
        for at, word in enumerate(map(self.vocabulary.get, words), 1):
            if word is None:
                s = matched = 0
                continue
            t = step[s].get(word)
            if t is None:
                while t is None:  # the root has an edge for each known word
                    s = link[s]
                    t = step[s].get(word)
                matched = length[s]
            s = t
            matched += 1
            hit = 0
            if matched >= window:
                s, matched, hit = self._window_state(s), window, window
                found |= self.owners[s]
            t = nearest[s]
            while t:
                for size, item in self.short[t]:
                    if size <= matched:
                        found.add(item)
                        hit = max(hit, size)
                t = nearest[link[t]]
            if hit:
                start = at - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at))
        return spans, found


def _matcher(shared):
    """Column function: matches of one block, joined to those of earlier blocks."""

    def one(text: bytes, before) -> tuple:
        automaton, words = shared.value, words_of(text)
        spans, found = automaton.scan(words)
        names = {automaton.names[i] for i in found}
        if before is not None:
            names |= set(before["items"])
            spans = united(spans + [(x["start"], x["end"]) for x in before["spans"]])
        if not spans:
            return len(words), [], [], []
        places = [m.span() for m in WORD.finditer(text.decode("utf-8", "replace"))]
        return (
            len(words),
            [{"start": a, "end": b} for a, b in spans],
            [{"start": places[a][0], "end": places[b - 1][1]} for a, b in spans],
            sorted(names),
        )

    names = ["n_words", "spans", "char_spans", "items"]

    @F.pandas_udf(MATCH)
    def first(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t, None) for t in texts], columns=names)

    @F.pandas_udf(MATCH)
    def further(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([one(t, b) for t, b in zip(texts, before.to_dict("records"))], columns=names)

    return first, further


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def match_items(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    text_column: str = "text",
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, str]:
    """``docs`` with a column of type ``MATCH``, and that column's name."""
    spark = docs.sparkSession
    named = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_or_empty().alias("text")
    )
    # Every second character at most starts a word.
    words = named.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    blocks = int(words // block_words) + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    column = free_name(docs.columns, "match")
    text = text_or_empty(text_column).cast("binary")
    for k in range(blocks):
        rows = named.filter(block == k).collect()  # a block: bounded by block_words
        shared = spark.sparkContext.broadcast(
            ItemAutomaton(((r["item_id"], words_of(r["text"].encode())) for r in rows), window)
        )
        first, further = _matcher(shared)
        if k == 0:
            docs = docs.withColumn(column, first(text))
        else:
            docs = materialise(docs, "item-matches").withColumn(column, further(text, F.col(column)))
    return docs, column


def _covered(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the characters of sorted, disjoint ``spans``."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.array_join(pieces, "")


@carries("text_column")
def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    coverage: tuple[int, int] = COVERAGE,
    text_column: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, items, spans, contaminated`` and ``clean_text``.

    ``contaminated``: at least one word is hit and hit words reach the ``coverage`` share.
    ``clean_text``: the text of a contaminated document without its hit spans; the text as
    it is for all others.
    """
    matched, column = match_items(docs, items, window, text_column, block_words)
    match, text = F.col(column), F.col(text_column)
    n_hit = _covered(match["spans"])
    contaminated = (n_hit > 0) & (n_hit * coverage[1] >= match["n_words"] * coverage[0])
    return with_result(
        matched,
        n_words=match["n_words"],
        n_hit=n_hit,
        items=match["items"],
        spans=match["char_spans"],
        contaminated=contaminated,
        clean_text=F.when(contaminated, without_spans(text, match["char_spans"])).otherwise(text),
    ).drop(column)


def benchmark_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The registered form."""
    return decontaminate(docs.select("doc_id", "text"), items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM p),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
q AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hit AS (SELECT r, q.k, p, item_id FROM q JOIN win ON q.k = win.k AND array_to_string(w[p:p + q.k - 1], ' ') = g),
n AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS x FROM hit) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)"""
