import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from text_cases import EDGE, key
from tokenizers import Tokenizer

from voxelarium.llm import token_alignment
from voxelarium.llm.token_alignment import Aligner, alignment, linked_pairs, shared_ends
from voxelarium.llm.tokens import byte_alphabet, default_path

A, B = default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model")


class Libraries:
    """Whole texts through both libraries."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.bytes_a = {i: bytes(byte[c] for c in s) for s, i in self.a.get_vocab(with_added_tokens=False).items()}

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, text):
        if not text:
            return [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        want = (" " + text).encode()
        if b"".join(self.bytes_a[i] for i in a) != want or b"".join(map(self.bytes_b, b)) != want:
            return [], []
        return a, b

    def groups(self, text):
        a, b = self.ids(text)
        ends = [{}, {}]
        for side, ids, of in ((0, a, self.bytes_a.get), (1, b, self.bytes_b)):
            at = 0
            for k, i in enumerate(ids):
                at += len(of(i))
                ends[side][at] = k + 1
        out, i, j = [], 0, 0
        for at in sorted(ends[0].keys() & ends[1].keys()):
            out.append((a[i : ends[0][at]], b[j : ends[1][at]]))
            i, j = ends[0][at], ends[1][at]
        return out


@pytest.fixture(scope="module")
def libraries():
    return Libraries()


def brute(libraries, rows):
    docs, holding = [], Counter()
    for doc_id, text in rows:
        groups = libraries.groups(text)
        links = Counter((x, y) for a, b in groups for x in a for y in b)
        holding.update(links.keys())
        docs.append((doc_id, groups, links))
    most = defaultdict(int)
    for (x, _), n in holding.items():
        most[x] = max(most[x], n)
    for doc_id, groups, links in docs:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (
            doc_id,
            sum(len(a) for a, _ in groups),
            sum(len(b) for _, b in groups),
            len(groups),
            sum(links.values()),
            sum(n for p, n in links.items() if holding[p] == most[p[0]]),
            sum(n * holding[p] for p, n in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        )


TEXTS = [
    "The quick brown fox jumps over the lazy dog, doesn't it?",
    "Zażółć gęślą jaźń; naïve café — “quoted” …",
    "def f(x):\n\treturn x**2  # squares\n\n\nprint(f(10))   ",
    "<|endoftext|> <s> </s> <unk> [INST]",
    "a▁b keeps no bytes",
    "www.example.com said: \"no.\" (etc.); x,y;z!? ..., e\u0301, ½, don't.",
    "日本語のテキスト、中文文本。 한국어",
    "a\x1cb \x00 c\r\nd　e\xa0f᠎g",
    "aGVsbG8gd29ybGQ" * 400,
    " leading and trailing ",
    "\n\n",
]


@pytest.mark.parametrize("hot", [0, 40, 1 << 18])
def test_equals_brute_force(libraries, make, hot):
    rows = EDGE + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(200, TEXTS[0])] * 2
    done = [tuple(r) for r in alignment(make(rows), hot=hot).collect()]
    assert key(done) == key(brute(libraries, rows))


def test_no_rows(make):
    assert alignment(make([])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'\"<s>▁_09azAZéß\x85\xa0 "), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_are_the_libraries(libraries, text):
    if not hasattr(test_ids_are_the_libraries, "aligner"):
        test_ids_are_the_libraries.aligner = Aligner(A, B)
    got = test_ids_are_the_libraries.aligner.ids(text)
    assert tuple(x.tolist() for x in got) == tuple(map(list, libraries.ids(text)))


STRETCHES = ["the", "The", "don't", "'s", "a\nb", "\n", "a\n", "\tb", "", "é½", "日本", "x\x85y", "\xa0", "<s>", "▁", "\x00", "12345", "#" * 450]


@pytest.mark.parametrize("size", [0, 30, 1 << 22])
def test_stretches_that_are_remembered(libraries, monkeypatch, size):
    monkeypatch.setattr(token_alignment, "WORDS", 5)
    aligner = Aligner(A, B)
    aligner.stretches = token_alignment.Stretches(aligner, size)
    rng = np.random.default_rng(size)
    whole = 0
    for k in range(1500):
        known = STRETCHES[:5] + ["word", "ends.", f"new{k % 50}"] if k % 2 else STRETCHES
        text = " ".join(rng.choice(known, rng.integers(1, 14)))
        assert tuple(x.tolist() for x in aligner.ids(text)) == tuple(map(list, libraries.ids(text)))
        whole += bool(text) and aligner.stretches.ids(text) is None
        assert len(aligner.stretches) == aligner.stretches.sides[0].count == aligner.stretches.sides[1].count
        assert aligner.stretches.held <= size + 5 * 2 * token_alignment.LONG
    assert 300 < whole <= 750


def test_a_stretch_is_encoded_once():
    aligner = Aligner(A, B)
    given, model = [], aligner.b.model

    class Counting:
        def encode(self, text):
            given.append(text)
            return model.encode(text)

    aligner.b.model = Counting()
    words = [f"word{k}, thing{k}." for k in range(50)]
    for k in range(200):
        a, b = aligner.ids(" ".join(words[k % 50 :] + words[: k % 50]))
        assert len(a) and len(b)
    assert sum(map(len, given)) < 2 * len(" ".join(words))


@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)), st.integers(0, 40))
def test_shared_ends(one, other, run):
    tail = list(range(61, 61 + run)) + [200]
    a, b = sorted(one) + tail, sorted(other) + tail
    both = sorted(set(a) & set(b))
    assert tuple(x.tolist() for x in shared_ends(a, b)) == ([a.index(x) + 1 for x in both], [b.index(x) + 1 for x in both])


def test_a_stretch_that_is_not_given_back(libraries):
    aligner = Aligner(A, B)
    aligner.b.bytes[aligner.b.model.encode("the")[0]] = b" THE"
    assert [x.tolist() for x in aligner.ids("in the house")] == [[], []]
    assert not aligner.stretches
    text = "in a house"
    assert tuple(x.tolist() for x in aligner.ids(text)) == tuple(map(list, libraries.ids(text)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 9)), max_size=30), st.integers(1, 40), st.integers(0, 5))
def test_linked_pairs_in_blocks(sizes, block, seed):
    rng = np.random.default_rng(seed)
    in_a, in_b = (np.cumsum([s[i] for s in sizes], dtype=np.int64) if sizes else np.empty(0, np.int64) for i in (0, 1))
    a, b = (rng.integers(0, 5, e[-1] if len(e) else 0).astype(np.uint32) for e in (in_a, in_b))
    want = Counter()
    for (x, y), i, j in zip(sizes, in_a, in_b):
        want.update((p, q) for p in a[i - x : i].tolist() for q in b[j - y : j].tolist())
    keys, links = linked_pairs(a, b, in_a, in_b, 3, block)
    assert dict(zip(((k >> 3, k & 7) for k in keys.tolist()), links.tolist())) == want
    assert token_alignment.BLOCK >= 1 << 20
