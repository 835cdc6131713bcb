import hashlib
import re

from hypothesis import given, settings, strategies as st
from text_cases import CLASHING, EDGE, key

from voxelarium.llm.fill_in_middle import SkipList, line_widths, restore, transform
from pyspark.sql import functions as F


def brute(doc_id, text, rate=100):
    """The rewriting with slices of a list of lines."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=700), st.integers(2, 9))
def test_skip_list_adds_up(widths, fan):
    units = SkipList(widths, fan)
    assert len(units) == len(widths)
    assert [units.offset(r) for r in range(0, len(widths) + 1, 7)] == [sum(widths[:r]) for r in range(0, len(widths) + 1, 7)]


@given(st.text("ab\n\r\x85é😀", max_size=40))
def test_lines(text):
    assert line_widths(text) == [len(x) for x in re.findall(r"[^\n]*\n|[^\n]+", text)]


TEXTS = [
    "a\nb\nc",
    "a\nb\n",
    "\n",
    "\n\n\n",
    "one line",
    "é\n😀😀\n中文\r\n\x85x\n",
    "<\nP>\nS>\n<\n<S\n",
    "has <P> inside\nx",
    "$1\n\\2\n(a|b)*\n",
    "line\n" * 5000,
    "x" * 300_000 + "\ny",
]


def test_equals_brute_force(make):
    rows = EDGE + [(1000 + 40 * k + i, t) for i, t in enumerate(TEXTS) for k in range(12)]
    for rate in (100, 40):
        done = transform(make(rows), rate=rate).withColumn("back", restore(F.col("output"), F.col("form"))).collect()
        got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in done]
        want = [(i, *brute(i, t, rate), t or "") for i, t in rows]
        assert key(got) == key(want)
        assert {r["match"] for r in done} == {"x"} and set(CLASHING) <= set(done[0].asDict())


def test_clashing_and_empty(spark, make):
    docs = make([(1, "a\nb")]).withColumn("Form", F.lit(1)).withColumn("N", F.lit(2)).withColumn("cut", F.lit(3))
    done = transform(docs)
    assert [c for c in done.columns if c.lower() == "form"] == ["form"] and done.first()["n"] == 2
    assert done.first()["cut"] == 3
    assert transform(make([])).count() == 0
