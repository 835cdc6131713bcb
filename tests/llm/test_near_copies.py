import numpy as np

import corpus_pipeline
from voxelarium.llm import near_copies
from voxelarium.llm.fingerprint import simhash
from voxelarium.llm.near_copies import keep_one, shingles, similar, words_of

SF = "/root/testdata/sf0.001"


def texts(rng, n, words):
    return [" ".join(f"w{x}" for x in rng.integers(0, 5000, words)) for _ in range(n)]


def changed(rng, text, n):
    """``text`` with ``n`` words replaced."""
    words = text.split(" ")
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"new{i}"
    return " ".join(words)


def survivors(rows):
    """Smallest ids of the components of all similar pairs, by brute force."""
    sets = {i: set(shingles(words_of(t.encode())).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                new, old = min(root[i], root[j]), max(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    return sorted(set(root.values()))


def test_stage_drops_near_copies(spark, make):
    rng = np.random.default_rng(3)
    base = texts(rng, 40, 300)
    rows = list(enumerate(base)) + [(100 + i, changed(rng, t, 3)) for i, t in enumerate(base)]
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, make(rows), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(40))


def test_equals_brute_force_around_the_threshold(make):
    rng = np.random.default_rng(4)
    rows = []
    for g, t in enumerate(texts(rng, 6, 200)):
        rows += [(100 * g + k, changed(rng, t, n)) for k, n in enumerate(rng.integers(0, 9, 12))]
    rows += [(1000 + k, t) for k, t in enumerate(["a b", "A  b", "a c", "", " \t"])]
    want = survivors(rows)
    assert sorted(r["doc_id"] for r in keep_one(make(rows)).select("doc_id").collect()) == want
    assert len(want) < len(rows) - 30


def test_similar_counts_exactly():
    one = b"a b c d e f g h i j k l m"
    assert similar(one, one + b" n n2") and not similar(one, one + b" n n2 n3")


def test_edges(make, edge):
    kept = keep_one(edge)
    assert sorted(kept.columns) == sorted(edge.columns)
    ids = [r["doc_id"] for r in kept.collect()]
    # Texts without words are copies; rows 4, 5 and 6 have equal words, the two without an id are one.
    assert sorted(x for x in ids if x is not None) == [1, 4, 7, 8, 9, 10, 11] and ids.count(None) == 1
    assert keep_one(make([])).count() == 0


def whole_components(rows, kept):
    """Share of the components of all similar pairs of which one document stays."""
    return len(survivors(rows)) / len(kept)


def test_recall_in_one_hot_bucket(make):
    """Many versions of one text, most of them linked only through others, and unlike texts with one passage."""
    rng = np.random.default_rng(8)
    base = texts(rng, 1, 200)[0]
    rows = [(i, changed(rng, base, int(n))) for i, n in enumerate(rng.integers(1, 6, 150))]
    passage = " ".join(f"p{x}" for x in range(60))
    rows += [(1000 + i, passage + " " + t) for i, t in enumerate(texts(rng, 60, 120))]
    kept = keep_one(make(rows)).select("doc_id").collect()
    assert whole_components(rows, kept) >= 0.9
    assert {r["doc_id"] for r in kept} >= set(survivors(rows))


def test_comparisons_follow_the_rows(spark, make):
    """Texts that share a bucket but no link: as many pairs as leaders allow, not all."""
    rng = np.random.default_rng(9)
    base = texts(rng, 1, 300)[0]
    seen = []
    real = near_copies._verified
    near_copies._verified = lambda pairs, *rest: seen.append(pairs.count()) or real(pairs, *rest)
    try:
        rows = [(i, changed(rng, base, 14)) for i in range(120)]
        assert len(survivors(rows)) == len(keep_one(make(rows)).collect()) == 120
    finally:
        near_copies._verified = real
    assert len(seen) == near_copies.LEADS and max(seen) <= near_copies.BANDS * 120


def test_fingerprint_trees_find_candidates(make, monkeypatch):
    """Without any MinHash key, texts of near fingerprints are found, compared and dropped."""
    monkeypatch.setattr(near_copies, "band_keys", lambda hashes: [])
    rng = np.random.default_rng(11)
    base = texts(rng, 12, 3000)
    rows = list(enumerate(base)) + [(100 + i, changed(rng, t, 1)) for i, t in enumerate(base)]
    marks = [simhash(t.encode(), near_copies.SHINGLE) for _, t in rows]
    want = [100 + i for i in range(12) if (marks[i] ^ marks[12 + i]).bit_count() > near_copies.RADIUS]
    assert len(want) < 3
    assert sorted(r["doc_id"] for r in keep_one(make(rows)).select("doc_id").collect()) == [*range(12), *want]


def test_no_link_is_lost_behind_the_leaders(make, monkeypatch):
    """All texts in one bucket, far more groups than leaders: the join on heads finds the links of the others."""
    monkeypatch.setattr(near_copies, "band_keys", lambda hashes: [7] if len(hashes) else [])
    rng = np.random.default_rng(12)
    rows = []
    for g, t in enumerate(texts(rng, 25, 200)):
        rows += [(10 * g + k, changed(rng, t, n)) for k, n in enumerate((0, 2, 4, 6, 9))]
    rows += [(1000, ""), (1001, " "), (1002, "a b"), (1003, "A b"), (1004, "a")]
    want = survivors(rows)
    assert len(want) < len(rows) - 40
    assert sorted(r["doc_id"] for r in keep_one(make(rows)).select("doc_id").collect()) == want


def test_heads_meet_in_any_order():
    rng = np.random.default_rng(13)
    links = 0
    for _ in range(400):
        pool = np.unique(rng.integers(0, 1 << 64, 60, dtype=np.uint64))
        known = np.sort(rng.choice(pool, 30, replace=False))
        often = rng.integers(2, 5, 30)
        n = int(rng.integers(1, 50))
        one = np.sort(rng.choice(pool, n, replace=False))
        other = np.union1d(rng.choice(one, max(1, n - int(rng.integers(0, 6))), replace=False), rng.choice(pool, int(rng.integers(0, 4))))
        if len(np.intersect1d(one, other)) >= 0.8 * len(np.union1d(one, other)) - 1e-9:
            links += 1
            for order in ((known, often), (known[:0], often[:0])):
                a, b = near_copies.head(one, *order), near_copies.head(other, *order)
                first = next(x for x in a if x in set(b.tolist()))
                rest = min(len(one) - a.tolist().index(first), len(other) - b.tolist().index(first))
                assert rest * 1.8 >= 0.8 * (len(one) + len(other)) - 1e-6
    assert links > 100
    assert len(near_copies.head(one[:0], known, often)) == 0


def test_a_common_passage_makes_no_pairs(make, monkeypatch):
    """Frequent shingles come last in the order, so unlike texts that share them do not meet."""
    rng = np.random.default_rng(14)
    passage = " ".join(f"p{x}" for x in range(60))
    rows = [(i, passage + " " + t) for i, t in enumerate(texts(rng, 150, 60))]
    seen, real = [], near_copies._open_pairs

    def counted(*given):
        pairs = real(*given)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_copies, "_open_pairs", counted)
    assert len(keep_one(make(rows)).collect()) == 150
    assert seen == [0]


def test_common_shingles_are_counted_either_way_round(spark):
    """Of two texts each is outside the largest component of some keys; all their common keys count."""
    heads = [(k, i, 45, 45 - k) for i in (1, 2) for k in range(8)]
    # The components of 1 and 2 have two texts each; the other text holds every other key.
    heads += [(k, 3 if k % 2 else 4, 45, 20) for k in range(8)]
    nodes = {n: spark.sql(f"SELECT xxhash64({n}) AS h").first()["h"] for n in (1, 2, 3, 4)}
    heads = spark.createDataFrame([(k, nodes[i], size, rest) for k, i, size, rest in heads], "key long, id long, size int, rest int")
    stars = spark.createDataFrame([(3, 1), (4, 2)], "hi int, lo int")
    found = near_copies._open_pairs(heads, stars, near_copies.SIMILARITY).collect()
    assert [{r["x"], r["y"]} for r in found] == [{nodes[1], nodes[2]}]
    few = near_copies._open_pairs(heads.where("key < 4"), stars, near_copies.SIMILARITY).collect()
    assert few == []
