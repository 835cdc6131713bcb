import numpy as np
from text_cases import EDGE
from test_decontamination import brute
from test_exact_and_lines import brute_lines
from test_near_copies import survivors
from test_tokens_and_packing import check_packed

import corpus_pipeline
from voxelarium.llm.decontamination import words_of
from voxelarium.llm.language_id import identify

SF = "/root/testdata/sf0.001"


def brute_pipeline(spark, docs):
    """The stages in plain Python; the language model is the library's own."""
    judged = identify(docs).select("doc_id", "text", "lang_pred", "score").collect()
    rows = [(r["doc_id"], r["text"]) for r in judged if r["lang_pred"] != "und" and r["score"] >= 0.1]
    rows = [(i, kept) for i, _, _, kept in brute_lines(rows, 10)]
    kept = set(survivors(rows))
    seen, winners = set(), []
    for i, t in rows:
        if i in kept and i not in seen:
            seen.add(i)
            winners.append((i, t))
    items = [(str(r["item_id"]), words_of(r["text"].encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = []
    for i, t in winners:
        words = words_of(t.encode())
        n = len(brute(words, items, 13)[0]) if {w for _, x in items for w in x} & set(words) else 0
        if not (n and 20 * n >= len(words)):
            out.append((i, t))
    return out


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packed(rows, brute_pipeline(spark, docs))


def test_stages_keep_the_columns_and_survive_edges(spark, make, edge):
    for docs in (edge, make([])):
        for name, stage in corpus_pipeline.STAGES:
            columns, before = docs.columns, docs.count()
            docs = stage(spark, docs, SF)
            assert name == "packing" or docs.columns == columns and docs.count() <= before
            if name != "packing":
                assert {r[0] for r in docs.select("match").distinct().collect()} <= {"x"}


def test_clean_documents_stay(spark, make):
    rng = np.random.default_rng(1)
    words = ["river", "stone", "cloud", "ember", "field", "winter", "garden", "letter", "music", "harbour"]
    rows = [(i, " ".join(rng.choice(words, 60))) for i in range(60)]
    docs = make(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == rows
    assert len(EDGE) == 14
