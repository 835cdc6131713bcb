import json
import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
from text_cases import EDGE, key
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from voxelarium.llm import packing, tokens
from voxelarium.llm.packing import TokenIds, pack, shortest_pack_first
from voxelarium.llm.tokens import BYTE_PATTERN, SAFE_END, WORD_PATTERN, TokenCounter, default_path, token_counts, whole_tokens

BYTE, WORD = default_path("byte_bpe_50k.json"), default_path("word_bpe_49k.json")
byte_tokenizer, word_tokenizer = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
counter, ids = TokenCounter(BYTE, whole_tokens(BYTE)), TokenIds(WORD)


def library_count(text):
    return len(byte_tokenizer.encode(text or "", add_special_tokens=False).ids)


def library_ids(text):
    return word_tokenizer.encode(text or "", add_special_tokens=False).ids


def test_patterns_are_those_of_the_files():
    assert json.dumps(WORD_PATTERN) in word_tokenizer.to_str() and BYTE_PATTERN == public_tokenizers.PATTERN


def test_every_safe_character_is_split_as_by_the_library():
    for c in map(chr, range(SAFE_END)):
        text = f"a{c}1{c}!{c}{c}a {c} '{c}"
        assert counter.count(text) == library_count(text), hex(ord(c))
        assert ids.ids(text) == struct.pack(f"<{len(x := library_ids(text))}I", *x), hex(ord(c))


PIECES = ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "  ", "\n\n", "\t", "12", "été", "中", "é", "Σ", "İ", "the", " The", "!?", "\x1d", "\x85"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=12).map("".join))
def test_counts_and_ids_equal_the_library(text):
    assert counter.count(text) == library_count(text)
    assert list(struct.unpack(f"<{len(x := ids.ids(text)) // 4}I", x)) == library_ids(text)


def test_memo_may_overflow(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 5)
    small, small_ids = TokenCounter(BYTE, frozenset()), TokenIds(WORD)
    text = "many different strange wordlets appear here, again and again: wordlets!"
    assert small.count(text) == library_count(text)
    assert list(struct.unpack(f"<{len(x := small_ids.ids(text)) // 4}I", x)) == library_ids(text)


def test_token_counts_edges(edge):
    got = [tuple(r) for r in token_counts(edge).collect()]
    want = [(i, len((t or "").encode()), n := library_count(t), n > 512) for i, t in EDGE]
    assert key(got) == key(want)


def check_packed(rows, docs, size=packing.SIZE):
    """Every id once, sequences without gaps and within size, digests of the library's ids."""
    want = defaultdict(int)
    for i, t in docs:
        x = [*library_ids(t), 2]
        for start in range(0, len(x), size):
            part = x[start : start + size]
            want[i, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(x)] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def test_packing_edges(make, edge):
    check_packed(pack(edge).collect(), EDGE)
    assert pack(make([])).count() == 0


def test_packing_is_tight(make):
    rnd = random.Random(3)
    docs = [(i, "word " * rnd.choice([3, 50, 400, 2000, 5000])) for i in range(600)]
    used = check_packed(pack(make(docs), buckets=7).collect(), docs)
    total = sum(len(t.split()) + 1 for _, t in docs)
    assert used <= total / packing.SIZE * 1.02 + 1


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_steps_place_each_piece_once(histogram):
    fill, ranks = defaultdict(int), defaultdict(set)
    for length, rank, count, first, offset in shortest_pack_first(histogram, 64):
        ranks[length] |= set(range(rank, rank + count))
        for sequence in range(first, first + count):
            assert fill[sequence] == offset
            fill[sequence] += length
    assert {k: set(range(n)) for k, n in histogram.items()} == ranks
    assert all(x <= 64 for x in fill.values())
    # Two sequences are never both at most half full.
    assert sum(x <= 32 for x in fill.values()) <= 1


def test_a_new_word_is_worked_on_once():
    """A stretch that is one pre-token takes one step; those of others are remembered with it."""
    fresh, seen = TokenIds(WORD), []
    real = fresh.of_stretch.work
    fresh.of_stretch.work = fresh.of_piece.work = lambda text: seen.append(text) or real(text)
    text = "wordlet wordlet, other other wordlet"
    assert list(struct.unpack(f"<{len(x := fresh.ids(text)) // 4}I", x)) == library_ids(text)
    assert seen == ["wordlet", "wordlet,", ",", "other"]
