import hashlib
import re
from collections import Counter

from text_cases import EDGE, key
from pyspark.sql import functions as F

from voxelarium.llm.exact_dedup import exact_dedup, exact_groups
from voxelarium.llm.line_dedup import drop_repeated_lines, line_dedup

WHITE = r"[\x20\x09-\x0D]"


def brute_groups(rows):
    rows = [(i, t or "") for i, t in rows]
    norm = [re.sub(WHITE, "", t) for _, t in rows]
    out, done = [], set()
    for (i, t), n in zip(rows, norm):
        group = [r for r, m in zip(rows, norm) if m == n]
        best = min(group, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        wins = (i, len(t)) == (best[0], len(best[1])) and n not in done
        if wins:
            done.add(n)
        out.append((i, best[0], len(group), wins, hashlib.sha256(n.encode()).hexdigest()))
    return out


def test_exact_dedup_edges(edge):
    got = [tuple(r) for r in exact_dedup(edge).collect()]
    assert key(got) == key(brute_groups(EDGE))


def test_exact_dedup_survives_digest_collisions(edge):
    got = exact_groups(edge, digest=lambda c: F.unhex(F.hex(F.char_length(c) % 3))).select(
        "doc_id", "keep_id", "group_size", "kept"
    )
    assert key(map(tuple, got.collect())) == key(r[:4] for r in brute_groups(EDGE))


def test_exact_dedup_hot_group(make):
    rows = [(i, "hot  text" if i % 3 else f"text {i}") for i in range(3000)]
    got = exact_dedup(make(rows)).filter("group_size > 1")
    assert got.agg(F.min("keep_id"), F.count("*"), F.sum(F.col("kept").cast("int"))).first() == (1, 2000, 1)


def test_empty_tables(make):
    assert exact_dedup(make([])).count() == 0
    assert line_dedup(make([])).count() == 0


def brute_lines(rows, threshold):
    def line_key(line):
        return re.sub(f"^{WHITE}+|{WHITE}+$", "", line).translate({c: c + 32 for c in range(65, 91)})

    lines = [(i, (t or "").split("\n")) for i, t in rows]
    seen = Counter(k for _, ls in lines for k in {line_key(x) for x in ls} if k)
    out = []
    for i, ls in lines:
        kept = [x for x in ls if seen[line_key(x)] < threshold]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_edges(make, edge):
    extra = [(100 + i, f"\tRepeated Ünit \nown {i}\nREPEATED Ünit") for i in range(12)] + [(200, "repeated ünit")]
    docs = edge.unionByName(make(extra))
    got = drop_repeated_lines(docs)
    assert [tuple(r) for r in got.select("source").distinct().collect()] == [("s",)]
    rows = [tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()]
    assert key(rows) == key(brute_lines(EDGE + extra, 10))


def test_line_dedup_counts_documents_not_lines(make):
    rows = [(i, "many\n" * 30) for i in range(9)]
    assert line_dedup(make(rows)).agg(F.sum("n_dropped")).first()[0] == 0
    rows += [(9, "MANY")]
    assert line_dedup(make(rows)).agg(F.sum("n_dropped")).first()[0] == 9 * 30 + 1
