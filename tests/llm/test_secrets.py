import hashlib
import random
import re

import pytest
from text_cases import EDGE, key

from voxelarium.llm.guess_cost import STRETCH_BITS, _char_bits, _stretches, guess_bits, word_ranks
from voxelarium.llm.secrets import find_secrets, scan_secrets, secret_spans
from voxelarium.llm.tokens import default_path

RANKS = word_ranks(default_path("word_bpe_49k.json"))


def brute_base(text):
    word = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    patterns = [
        ("assign", word + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ]
    found = [(m.start(), n, kind, m.end()) for n, (kind, p, ok) in enumerate(patterns) for m in re.finditer(p, text) if ok(m)]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


PARTS = ["password", "TOKEN", "secret", "apiKey", "api_key", " ", "=", ":", "'", '"', "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMN", "tokentoken", "é", "\n", "Kelvin", "toKen", "-", "x"]


@pytest.mark.parametrize("seed", range(200))
def test_base_spans_equal_brute_force(seed):
    text = "".join(random.Random(seed).choices(PARTS, k=40))
    got = [f"{k}:{a}:{b}" for k, a, b, _ in find_secrets(text, RANKS) if k != "guess"]
    assert got == brute_base(text)


def cheapest(value):
    """The same minimum over all segmentations, by recursion."""
    steps = {}
    for a, b, bits in _stretches(value, RANKS):
        steps.setdefault(a, []).append((b, bits))

    def best(at):
        if at == len(value):
            return 0.0
        options = [bits + STRETCH_BITS + best(b) for b, bits in steps.get(at, ())]
        force = STRETCH_BITS
        for end in range(at + 1, len(value) + 1):
            force += _char_bits(value[end - 1])
            options.append(force + best(end))
        return min(options)

    return best(0)


@pytest.mark.parametrize("value", ["pass2019word", "aaaabbbb", "qwerty12", "x9K$mQ2v", "Monkey!1", "abcd1999", "20200131ab"])
def test_dynamic_program_equals_all_segmentations(value):
    assert guess_bits(value, RANKS) == pytest.approx(cheapest(value))


def test_cheap_and_costly_values():
    assert guess_bits("", RANKS) == 0
    for weak in ("Password123", "qwertyuiop", "aaaaaaaaaaaaaaaa", "1999-12-31", "abcdefgh", "p4ssw0rd"):
        assert guess_bits(weak, RANKS) < 40
    for strong in ("x9K$mQ2vLp7z", "wJalrXUtnFEMI", "24be64439e3e49cf46b2d7"):
        assert guess_bits(strong, RANKS) > 40


def test_added_spans():
    text = 'pwd: "x9K$mQ2vLp7z!" and http://u:Zr8#kQ!x91v@h, password: required-here, passphrase = sunshine'
    assert [(k, text[a:b]) for k, a, b, _ in find_secrets(text, RANKS) if k == "guess"] == [("guess", "x9K$mQ2vLp7z!"), ("guess", "Zr8#kQ!x91v")]


def test_quoted_values_are_whole():
    def guesses(text):
        return [text[a:b] for k, a, b, _ in find_secrets(text, RANKS) if k == "guess"]

    assert guesses("DB_PASSWORD='s3cr,et;Zx4Tq9LmR7'") == ["s3cr,et;Zx4Tq9LmR7"]
    assert guesses('password = "k#9<Qv>;x2\'Lm8Zt"') == ["k#9<Qv>;x2'Lm8Zt"]
    assert guesses("password = \"Zr8#kQ!x91vW and no end") == ["Zr8#kQ!x91vW"]
    assert guesses('pwd: "the garden of the old house by the river"') == []


def test_edges(make, edge):
    extra = [(60, 'é😀 token = "24be64439e3e49cf46b2d7c90f3602a3" AKIAABCDEFGHIJKLMN')]
    got = secret_spans(edge.unionByName(make(extra))).collect()
    want = []
    for i, t in EDGE + extra:
        base = brute_base(t or "")
        want.append((i, *(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(base).encode()).hexdigest()))
    assert key(tuple(r)[:5] for r in got) == key(want)
    assert scan_secrets(edge).select("Secrets", "source").count() == len(EDGE)
    assert secret_spans(make([])).count() == 0
