"""How many guesses a value costs, as the cheapest way to put it together.

A minimum-cost segmentation: each stretch of the value is a known word, a date, a repeated
unit, a walk over neighbouring keys or code points, or plain brute force, and costs the
binary logarithm of the guesses an attacker needs for it who knows the kind.  The dynamic
program keeps the cheapest cost up to each character; as every kind of stretch has a
bounded length or only its longest form is tried, it is linear in the value's length.
"""

from __future__ import annotations

import json
import math
import re
from functools import cache
from itertools import groupby

#: Bits for saying where a stretch ends and of which kind it is.
STRETCH_BITS = 2.5
MIN_WORD, MAX_WORD, MAX_UNIT, MIN_WALK = 3, 24, 4, 3
#: Years a date is looked for in; day and month add their own bits.
_YEARS = 150
_DATE = re.compile(
    r"(?:19|20)\d\d(?P<a>[-/._]?)(?:0[1-9]|1[0-2])(?P=a)(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])(?P<b>[-/._]?)(?:0[1-9]|1[0-2])(?P=b)(?:19|20)\d\d"
    r"|(?:0[1-9]|1[0-2])(?P<c>[-/._]?)(?:0[1-9]|[12]\d|3[01])(?P=c)(?:19|20)\d\d"
    r"|(?P<year>(?:19|20)\d\d)"
)
#: Digits and signs that stand for letters, and the rows of a keyboard.
_LEET = str.maketrans("013457@$", "oleastas")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_STEP_BITS = math.log2(5)


@cache
def _keys() -> dict[str, tuple[int, float]]:
    """Row and place of each key; each row lies half a key further right."""
    return {c: (row, at + row / 2) for row, keys in enumerate(_ROWS) for at, c in enumerate(keys)}


@cache
def word_ranks(path: str) -> dict[str, int]:
    """Rank of each whole word in the vocabulary of a tokenizer file, which lists frequent ones first."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = sorted((i, w[:-4]) for w, i in vocabulary.items() if w.endswith("</w>"))
    return {w: rank for rank, (_, w) in enumerate((x for x in words if len(x[1]) >= MIN_WORD and x[1].isalpha()), 1)}


def _char_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    return math.log2(26) if c.isalpha() else math.log2(33)


def _case_bits(word: str) -> float:
    upper = sum(map(str.isupper, word))
    if not upper:
        return 0.0
    if upper == len(word) or upper == 1 and word[0].isupper():
        return 1.0
    return math.log2(math.comb(len(word), upper)) + 1


def _near(a: str, b: str) -> bool:
    keys = _keys()
    if a == b or a not in keys or b not in keys:
        return False
    (r, x), (s, y) = keys[a], keys[b]
    return abs(r - s) <= 1 and abs(x - y) <= 1


def _run_ends(value: str, follows) -> list[int]:
    """For each position where the run of characters that follow one another ends."""
    ends = list(range(1, len(value) + 1))
    for i in range(len(value) - 2, -1, -1):
        if follows(value[i], value[i + 1]):
            ends[i] = ends[i + 1]
    return ends


def _stretches(value: str, ranks: dict[str, int]):
    """``(start, end, bits)`` of every stretch that is more than brute force."""
    lower = value.lower()
    plain = lower.translate(_LEET)
    longest = min(MAX_WORD, len(value))
    for start in range(len(value)):
        for end in range(start + MIN_WORD, min(start + longest, len(value)) + 1):
            word = lower[start:end]
            rank, swaps = ranks.get(word), 0
            if rank is None and (other := plain[start:end]) != word:
                rank, swaps = ranks.get(other), sum(a != b for a, b in zip(word, other))
            if rank is not None:
                yield start, end, math.log2(rank) + _case_bits(value[start:end]) + 1.5 * swaps
    for m in re.finditer(rf"(?=({_DATE.pattern}))", value):
        bits = math.log2(_YEARS) + (0 if m["year"] else math.log2(366) + 1)
        yield m.start(1), m.end(1), bits
    for unit in range(1, MAX_UNIT + 1):
        alike = [i for i in range(len(value) - unit) if value[i] == value[i + unit]]
        for _, run in groupby(enumerate(alike), lambda x: x[1] - x[0]):
            places = [i for _, i in run]
            times = len(places) // unit + 1
            if times * unit >= 3 and times >= 2:
                start = places[0]
                yield start, start + times * unit, sum(map(_char_bits, value[start : start + unit])) + math.log2(times) + 1
    walks = [
        (_run_ends(lower, _near), math.log2(47), _STEP_BITS),
        (_run_ends(value, lambda a, b: ord(b) - ord(a) == 1), math.log2(62), 0.0),
        (_run_ends(value, lambda a, b: ord(a) - ord(b) == 1), math.log2(62) + 1, 0.0),
    ]
    for ends, first, step in walks:
        at = 0
        while at < len(value):
            size = ends[at] - at
            if size >= MIN_WALK:
                turns = sum(lower[i] not in _keys() or not _same_way(lower, i) for i in range(at + 1, ends[at] - 1))
                yield at, ends[at], first + math.log2(size) + step * (1 + turns if step else 0)
            at = ends[at]


def _same_way(s: str, i: int) -> bool:
    (r0, x0), (r1, x1), (r2, x2) = (_keys().get(c, (0, 0.0)) for c in s[i - 1 : i + 2])
    return (r1 - r0, x1 - x0) == (r2 - r1, x2 - x1)


def guess_bits(value: str, ranks: dict[str, int]) -> float:
    """Binary logarithm of the guesses that ``value`` costs; 0 for the empty value."""
    at_end: dict[int, list[tuple[int, float]]] = {}
    for start, end, bits in _stretches(value, ranks):
        at_end.setdefault(end, []).append((start, bits))
    # Cheapest cost up to here, and cheapest if the last stretch is brute force and may go on.
    best, open_force = [0.0], [math.inf]
    for end, c in enumerate(value, 1):
        force = min(open_force[-1], best[-1] + STRETCH_BITS) + _char_bits(c)
        open_force.append(force)
        known = (best[start] + bits + STRETCH_BITS for start, bits in at_end.get(end, ()))
        best.append(min(force, *known) if end in at_end else force)
    return best[-1]
