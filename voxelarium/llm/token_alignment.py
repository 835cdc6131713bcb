"""Alignment of the tokens of two tokenizers by diagonal run skipping, and its corpus counts.

Both tokenizers read the same bytes: a blank and the text.  Each gives an array of the byte
offsets where its tokens end; an offset in both arrays closes a group.  ``shared_ends``
walks the arrays at a shift between their indices.  While tokens agree one to one, the shift
stays and slices of doubling length are compared at once, then of halving length where they
differ; an irregular group is resolved token by token, which moves the shift.

The first tokenizer's merges are applied by a byte-level library that takes ranks: its file
qualifies if every merge makes the next id, which is proven when a worker opens it.  Texts
with characters whose class the libraries may see differently, or with very long unbroken
stretches, go to the tokenizer itself, as do all texts of a file that does not qualify.

No token of either file crosses a blank between two characters that are no white space: the
first splits there, and the second's merges cannot if no piece holds a blank behind another
character and its scores are ranks (both proven when a worker opens it).  Texts whose blanks
are all of that kind are put together from stretches between them, which both libraries
encode once and a worker remembers up to a bound; all other texts are encoded whole.

Documents keep their different id pairs with the number of links, so that nothing is
tokenized twice.  The pairs are counted by documents, then looked up: those of most documents
(``HOT`` of them at most) from a broadcast table, all others by a join on the pair.  A pair
found in a third of all documents is thus never one key of a shuffle, apart from its count,
which combines map-side.

Defined results: texts that are null, empty or not given back by both tokenizers byte by
byte have no tokens, zeros and no groups; strings of special tokens are plain text; repeated
rows are documents of their own; a null id is carried; other columns are not read; no rows
give no rows.  A group of very many tokens is linked through counts of its different ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from voxelarium.llm.common import text_or_empty
from voxelarium.llm.tokens import BYTE_PATTERN, PreTokens, byte_alphabet, default_path
from voxelarium.storage import materialise

#: Most pairs whose counts are broadcast, 24 bytes each.
HOT = 1 << 18
#: Links that are held at once, and pairs in a batch of results.
BLOCK = 1 << 20

BLANK = "▁"
#: Characters without, or of nothing but, white space from which on the tokenizer itself is used: its time is not quadratic in them.
LONG = 400
_LONG = re.compile(rf"\S{{{LONG}}}|\s{{{LONG}}}").search
#: Bytes of stretches that a worker remembers (each of fewer than ``LONG`` characters), and how many are looked up at once.
MEMO, WORDS = 1 << 22, 1 << 12
#: A blank beside white space.
_OPEN_BLANK = re.compile(r" (?:\s|(?<=\s ))").search

ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<struct<a: int, b: int, n: int>>"
)


def shared_ends(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each group the number of tokens up to its end in ``a`` and in ``b``.

    Both rise strictly and end alike.
    """
    # Groups as runs of consecutive ends: the number of tokens before each, and its length.
    runs, lengths = [], []
    shifts = []
    i, j, total = 0, 0, len(a)
    while i < total:
        if a[i] == b[j]:
            first, step = i, 1
            i, j = i + 1, j + 1
            while True:
                step *= 2
                part = a[i : i + step]
                if not part or part != b[j : j + step]:
                    break
                i, j = i + len(part), j + len(part)
            step //= 2
            while step:
                part = a[i : i + step]
                if part and part == b[j : j + step]:
                    i, j = i + len(part), j + len(part)
                step //= 2
            runs.append(first)
            lengths.append(i - first)
            shifts.append(j - i)
            if i == total:
                break
        end, other = a[i], b[j]
        while end != other:
            if end < other:
                i += 1
                end = a[i]
            else:
                j += 1
                other = b[j]
        runs.append(i)
        lengths.append(1)
        shifts.append(j - i)
        i, j = i + 1, j + 1
    if not runs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = np.array(lengths)
    before = np.cumsum(lengths) - lengths
    in_a = np.arange(1, before[-1] + lengths[-1] + 1) + np.repeat(np.array(runs) - before, lengths)
    return in_a, in_a + np.repeat(np.array(shifts), lengths)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def linked_pairs(
    a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, bits: int, block: int = BLOCK
) -> tuple[np.ndarray, np.ndarray]:
    """The different id pairs that share a group, as ``a << bits | b``, and their links."""
    size_a, size_b = np.diff(in_a, prepend=0), np.diff(in_b, prepend=0)
    cells = size_a * size_b
    kind = np.uint32 if int(a.max(initial=0)) < 1 << (32 - bits) else np.uint64
    found = []
    upto = np.cumsum(cells)
    start = 0
    while start < len(cells):
        stop = max(int(np.searchsorted(upto, (upto[start - 1] if start else 0) + block, side="right")), start + 1)
        first_a, first_b = in_a[start] - size_a[start], in_b[start] - size_b[start]
        part_a, part_b = a[first_a : in_a[stop - 1]].astype(kind) << kind(bits), b[first_b : in_b[stop - 1]].astype(kind)
        if cells[start] > block:  # one group: its different ids
            left, n_left = np.unique(part_a, return_counts=True)
            right, n_right = np.unique(part_b, return_counts=True)
            for key, n in zip(left, n_left):
                found.append((key | right, n * n_right))
        else:
            sizes = size_a[start:stop]
            links = np.repeat(size_b[start:stop], sizes)
            before = np.cumsum(links) - links
            place = np.arange(links.sum()) + np.repeat(np.repeat(in_b[start:stop] - size_b[start:stop], sizes) - first_b - before, links)
            found.append(np.unique(np.repeat(part_a, links) | part_b[place], return_counts=True))
        start = stop
    if len(found) == 1:
        return found[0]
    if not found:
        return np.empty(0, kind), np.empty(0, np.int64)
    return _summed(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))


class BytePairs:
    """The first tokenizer; special strings are plain text."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        entries = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(entries.values()) + 1)
        for shown, i in entries.items():
            self.bytes[i] = bytes(map(byte.__getitem__, shown))
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ranked = len(merges) + 256
        proven = all(entries.get(m) == 256 + k for k, m in enumerate(merges)) and not model.get("dropout")
        ranks = {self.bytes[i]: i for i in range(min(ranked, len(self.bytes)))}
        self.ranked = tiktoken.Encoding("ranked", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}) if proven else None

    def ids(self, text: str) -> list[int]:
        if self.ranked is not None and PreTokens.safe(text) and not _LONG(text):
            return self.ranked.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """The second tokenizer, which puts a blank in front of what it encodes."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        shown = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(s[1:-1], 16)]) if self.model.is_byte(i) else s.replace(BLANK, " ").encode() for i, s in enumerate(shown)
        ]
        ranks = all(self.model.get_score(i).is_integer() for i in range(len(shown)))
        self.splits = ranks and not any(BLANK in s.lstrip(BLANK) for s in shown)


class Runs:
    """Runs of ids, looked up by their numbers."""

    def __init__(self):
        self.ids, self.edges = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.count = self.held = 0

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        self.ids = _behind(self.ids, self.held, ids)
        self.edges = _behind(self.edges, self.count + 1, ends + self.held)
        self.count, self.held = self.count + len(ends), self.held + len(ids)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        first = self.edges[numbers]
        sizes = self.edges[numbers + 1] - first
        before = np.cumsum(sizes) - sizes
        return self.ids[np.arange(sizes.sum()) + np.repeat(first - before, sizes)]


def _behind(table: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``more`` written behind the used part, in a table twice as long if there is no room."""
    if used + len(more) > len(table):
        table = np.concatenate([table, np.empty(max(len(more), len(table)), table.dtype)])
    table[used : used + len(more)] = more
    return table


class Stretches(dict):
    """Ids of both sides for stretches between blanks, which are numbered as they come.

    Beyond ``size`` bytes of them all are forgotten, so what is held is bounded.
    """

    def __init__(self, aligner: Aligner, size: int = MEMO):
        super().__init__()
        self.aligner, self.size = aligner, size
        self.new, self.sides, self.held = [], (Runs(), Runs()), 0

    def __missing__(self, stretch: str) -> int:
        self.new.append(stretch)
        self[stretch] = number = len(self)
        return number

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a blank and ``text``, or none if it has to be encoded whole."""
        stretches = text.split(" ")
        if max(map(len, stretches)) >= LONG or _OPEN_BLANK(f" {text} ") or not PreTokens.safe(text):
            return None
        found = []
        for start in range(0, len(stretches), WORDS):
            if self.held > self.size:
                self.clear()
                self.sides, self.held = (Runs(), Runs()), 0
            part = stretches[start : start + WORDS]
            numbers = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            new, self.new = self.new, []
            if new and not self.learn(new):
                for stretch in new:
                    del self[stretch]
                return None
            found.append([side.of(numbers) for side in self.sides])
        return found[0] if len(found) == 1 else tuple(map(np.concatenate, zip(*found)))

    def learn(self, new: list[str]) -> bool:
        """Encode ``new`` at once; false, and nothing learnt, if the libraries do not give them back one by one."""
        text = " " + " ".join(new)
        at = self.aligner
        want = text.encode()
        a, b = at.a.ranked.encode_ordinary(text), at.b.model.encode(text[1:])
        if b"".join(map(at.b.bytes.__getitem__, b)) != want:  # the ranks hold the bytes themselves
            return False
        is_end = np.frombuffer(want + b" ", np.uint8)[1:] == ord(" ")
        learnt = []
        for ids, length in ((a, at.length_a), (b, at.length_b)):
            ids = np.array(ids, np.int32)
            upto = np.flatnonzero(is_end[length[ids].cumsum() - 1]) + 1
            if len(upto) != len(new):
                return False
            learnt.append((ids, upto))
        for side, run in zip(self.sides, learnt):
            side.add(*run)
        self.held += len(want)
        return True


class Aligner:
    """Both tokenizers of a worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = BytePairs(path_a), Pieces(path_b)
        self.length_a = np.array(list(map(len, self.a.bytes)))
        self.length_b = np.array(list(map(len, self.b.bytes)))
        self.bits = (len(self.b.bytes) - 1).bit_length()
        # Each id with the sign that follows it: inside a side, at its end.
        self.shown = [f"{i}{end}" for i in range(len(self.a.bytes)) for end in ",|"]
        self.shown += [f"{i}{end}" for i in range(len(self.b.bytes)) for end in ",;"]
        self.stretches = Stretches(self) if self.a.ranked is not None and self.b.splits else None

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a blank and ``text``; empty if one side's bytes differ from those."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        if self.stretches is not None:
            known = self.stretches.ids(text)
            if known is not None:
                return known
        a, b = self.a.ids(" " + text), self.b.model.encode(text)
        want = (" " + text).encode()
        if b"".join(map(self.a.bytes.__getitem__, a)) != want or b"".join(map(self.b.bytes.__getitem__, b)) != want:
            return none, none
        return np.array(a, np.int64), np.array(b, np.int64)

    def align(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides and the groups' ends in each."""
        a, b = self.ids(text)
        ends = shared_ends(self.length_a[a].cumsum().tolist(), self.length_b[b].cumsum().tolist())
        return a, b, *ends

    def listed(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> str:
        """The groups as text: ``a1,a2|b1;a3|b2,b3``."""
        sizes_a, sizes_b = np.diff(in_a, prepend=0), np.diff(in_b, prepend=0)
        signs = np.empty(len(a) + len(b), np.int64)
        code_a, code_b = 2 * a, 2 * (b + len(self.a.bytes))
        code_a[in_a - 1] += 1
        code_b[in_b - 1] += 1
        signs[np.arange(len(a)) + np.repeat(in_b - sizes_b, sizes_a)] = code_a
        signs[np.arange(len(b)) + np.repeat(in_a, sizes_b)] = code_b
        return "".join(map(self.shown.__getitem__, signs.tolist()))[:-1]


#: Aligners of this worker process by files; a worker serves many tasks.
_OPEN: dict[tuple[str, str], Aligner] = {}


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, id_column: str, text_column: str) -> DataFrame:
    """A row per document with its counts, digest and id pairs, written once."""

    def results(rows: list, pairs: list) -> pa.RecordBatch:
        columns = list(zip(*rows))
        ends = np.cumsum([0] + [len(p[0]) for p in pairs]).astype(np.int32)
        fields = [np.concatenate([p[i] for p in pairs]).astype(np.int32) for i in range(3)]
        struct = pa.StructArray.from_arrays([pa.array(f) for f in fields], names=["a", "b", "n"])
        arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.string())]
        arrays.append(pa.ListArray.from_arrays(pa.array(ends), struct))
        return pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _OPEN:
            _OPEN[path_a, path_b] = Aligner(path_a, path_b)
        aligner = _OPEN[path_a, path_b]
        low = (1 << aligner.bits) - 1
        for batch in batches:
            rows, pairs, held = [], [], 0
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                a, b, in_a, in_b = aligner.align(text.as_py())
                keys, links = linked_pairs(a, b, in_a, in_b, aligner.bits)
                digest = hashlib.sha256(aligner.listed(a, b, in_a, in_b).encode()).hexdigest() if len(a) else ""
                rows.append((row, doc_id, len(a), len(b), len(in_a), int(links.sum()), digest))
                pairs.append((keys >> keys.dtype.type(aligner.bits), keys & keys.dtype.type(low), links))
                held += len(keys)
                if held >= BLOCK:
                    yield results(rows, pairs)
                    rows, pairs, held = [], [], 0
            if rows:
                yield results(rows, pairs)

    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column)
    )
    return materialise(source.mapInArrow(work, ALIGNED), "aligned-documents")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, docs, best`` for every linked id pair: its documents, and if no pair of its first id has more."""
    counts = materialise(
        aligned.select(F.inline("pairs")).groupBy("a", "b").agg(F.count("*").alias("docs")), "pair-documents"
    )
    most = materialise(counts.groupBy("a").agg(F.max("docs").alias("most")), "most-documents")  # bounded by the vocabulary
    return materialise(
        counts.join(most, "a").select(_pair().alias("pair"), "docs", (F.col("docs") == F.col("most")).alias("best")),
        "pair-counts",
    )


def _pair():
    return F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))


def _least_hot(counts: DataFrame, hot: int) -> float:
    """Documents from which on pairs are broadcast: the least quarter power of two that leaves at most ``hot``."""
    power = F.floor(F.log2("docs") * 4).cast("int").alias("power")  # some 250 values at most
    total, least = 0, None
    for power, n in sorted(counts.groupBy(power).agg(F.count("*")).collect(), reverse=True):
        total += n
        if total > hot:
            break
        least = power
    return float("inf") if least is None else least


def alignment(
    docs: DataFrame,
    path_a: str | None = None,
    path_b: str | None = None,
    hot: int = HOT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    path_a, path_b = path_a or default_path("byte_bpe_50k.json"), path_b or default_path("piece_bpe_32k.model")
    aligned = aligned_documents(docs, path_a, path_b, id_column, text_column)
    counts = pair_counts(aligned)
    is_hot = F.floor(F.log2("docs") * 4) >= F.lit(_least_hot(counts, hot))
    common, rare = F.broadcast(counts.where(is_hot)), counts.where(~is_hot)
    links = aligned.select("row", F.inline("pairs")).select("row", _pair().alias("pair"), "n")

    def summed(looked_up: DataFrame) -> DataFrame:
        return looked_up.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("n").cast("long")).otherwise(0)).alias("n_best"),
            F.sum(F.col("n") * F.col("docs")).alias("count_sum"),
        )

    others = links.join(common.select("pair"), "pair", "left_anti").join(rare, "pair")
    sums = summed(links.join(common, "pair")).union(summed(others)).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )
    return aligned.drop("pairs").join(sums, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"),
        F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"),
        "groups_sha256",
    )
