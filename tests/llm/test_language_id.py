from text_cases import EDGE
from pyspark.sql import functions as F

from voxelarium.llm.language_id import LanguageFilter, gram_hashes, identify, language_predictions, letter_codes
import numpy as np
import zlib

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert [(zlib.crc32(str(i).encode()) % 5 == 0) for i in got.doc_id] == list(got.held_out)
    test = got[got.held_out]
    assert (test.lang == test.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_labels_of_held_out_documents_are_not_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    wrong = docs.withColumn("lang", F.when(out, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("zz"))
    columns = ["doc_id", "lang_pred", "score"]
    assert sorted(language_predictions(docs).select(columns).collect()) == sorted(language_predictions(wrong).select(columns).collect())


def test_edges(make, edge):
    got = {r["doc_id"]: r for r in identify(edge).select("doc_id", "lang_pred", "score", "source").collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3))
    assert got[7]["lang_pred"] == "en" and got[None]["lang_pred"] == "en"
    assert identify(edge).count() == len(EDGE)
    assert identify(make([])).count() == 0
    assert {r[0] for r in identify(make(EDGE, lang=None)).select("lang_pred").collect()} == {"und"}


def test_ties_and_unknown_text():
    grams = np.unique(np.concatenate([h.copy() for h in gram_hashes(letter_codes("same words"))]))
    model = LanguageFilter(["big", "alike"], [grams, grams])
    assert model.decide("same words") == ("big", 1.0)
    assert model.decide("qqq") == ("big", 0.0)
    assert model.decide("12 !") == ("und", 0.0)


def test_blocks_do_not_change_the_grams(monkeypatch):
    text = "Some longer text, with ünusual letters: " * 50
    whole = np.sort(np.concatenate([h.copy() for h in gram_hashes(letter_codes(text))]))
    monkeypatch.setattr("voxelarium.llm.language_id.BLOCK", 37)
    parts = np.sort(np.concatenate([h.copy() for h in gram_hashes(letter_codes(text))]))
    assert (whole == parts).all()


def test_more_than_64_languages():
    sets = [np.array([k * 7919 + 13], dtype=np.uint64) for k in range(70)]
    model = LanguageFilter([str(k) for k in range(70)], sets)
    for k in (0, 63, 64, 69):
        masks = model.languages_of(sets[k])
        assert model._bit(masks, k)[0] == 1
