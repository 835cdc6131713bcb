import random

import pytest
from text_cases import EDGE, key
from pyspark.sql import functions as F

from voxelarium.llm.decontamination import WORD, ItemAutomaton, benchmark_hits, decontaminate, words_of


def brute(words, items, window):
    hit, found = set(), set()
    for name, item in items:
        k = min(window, len(item))
        for p in range(len(item) - k + 1) if k else ():
            for at in range(len(words) - k + 1):
                if words[at : at + k] == item[p : p + k]:
                    hit |= set(range(at, at + k))
                    found.add(name)
    return hit, found


@pytest.mark.parametrize("seed", range(30))
def test_scan_equals_brute_force(seed):
    rnd = random.Random(seed)
    letters = [b"a", b"b", b"c", b"d"][: 2 + seed % 3]
    items = [(str(i), rnd.choices(letters, k=rnd.randint(0, 9))) for i in range(6)]
    automaton = ItemAutomaton(items, 4)
    for _ in range(40):
        words = rnd.choices([*letters, b"x"], k=rnd.randint(0, 30))
        spans, found = automaton.scan(words)
        want, names = brute(words, items, 4)
        assert {p for a, b in spans for p in range(a, b)} == want
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        assert {automaton.names[i] for i in found} == names


def test_words():
    assert words_of("Don't STOP_me ñandú42!".encode()) == [b"don", b"t", b"stop", b"me", "ñandú42".encode()]
    text = "x\x7fÉ-Z@[`{|"
    assert [m[0].encode().lower() for m in WORD.finditer("aB9 cÿ")] == words_of("aB9 cÿ".encode())
    assert words_of(text.encode()) == [b"x", "É".encode(), b"z"]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, match string")


ITEMS = [(1, "alpha beta gamma", "m"), (2, None, "m"), (3, "", "m"), (None, "delta epsilon", "m"), (4, " ".join(f"w{i}" for i in range(20)), "m"), (4, "alpha beta gamma", "m")]


def test_edges_and_blocks(spark, make, edge):
    passage = " ".join(f"W{i}," for i in range(3, 18))
    docs = edge.unionByName(make([(50, f"See: {passage} end"), (51, "x " * 300 + "Alpha-beta gamma"), (52, "Delta! Epsilon")]))
    bench = items(spark, ITEMS)
    one = key(map(tuple, benchmark_hits(docs, bench).collect()))
    rows = {r[0]: r for r in one}
    assert len(one) == len(EDGE) + 3
    assert rows[50][1:4] == (17, 15, 1) and rows[50][5]
    assert rows[51][1:4] == (303, 3, 2) and not rows[51][5]
    assert rows[52][1:4] == (2, 2, 1) and rows[52][5]
    assert rows[1][1:] == rows[2][1:] and rows[1][1:4] == (0, 0, 0) and not rows[1][5]
    several = decontaminate(docs, bench, block_words=8)
    single = decontaminate(docs, bench)
    names = ["doc_id", "n_words", "n_hit", "items", "contaminated", "clean_text"]
    assert sorted(map(str, several.select(names).collect())) == sorted(map(str, single.select(names).collect()))
    clean = {r[0]: r[1] for r in single.select("doc_id", "clean_text").collect()}
    assert clean[50] == "See: , end" and clean[51].endswith("Alpha-beta gamma")
    assert single.filter("match IS NULL OR match <> 'x'").count() == 0


def test_empty_tables(spark, make, edge):
    assert benchmark_hits(make([]), items(spark, ITEMS)).count() == 0
    got = benchmark_hits(edge, items(spark, []))
    assert got.agg(F.sum("n_hit"), F.count("*")).first() == (0, len(EDGE))
