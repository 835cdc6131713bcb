"""Extra columns of any name, hostile pages, odd dates, rare languages."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxelarium.llm import (
    decontamination,
    fill_in_middle,
    html_tree,
    language_id,
    line_dedup,
    main_text,
    near_copies,
    secrets,
    tokens,
    url_filter,
)
from voxelarium.llm.language_id import identify

ODD = ["TEXT", "a`b", "x.y", "Doc_ID", "text "]


def odd(docs):
    """``docs`` with columns whose names differ in case only or hold special signs."""
    return docs.select("*", *[F.lit(f"v{i}").alias(f"odd_{i}") for i in range(len(ODD))]).toDF(*docs.columns, *ODD)


@pytest.mark.parametrize(
    "operator",
    [
        secrets.scan_secrets,
        tokens.count_tokens,
        line_dedup.drop_repeated_lines,
        near_copies.keep_one,
        fill_in_middle.transform,
        identify,
        lambda d: decontamination.decontaminate(d, d.sparkSession.createDataFrame([("i", "one two")], "item_id string, text string")),
        *(stage for _, stage in corpus_pipeline.STAGES[:-1]),
    ],
)
def test_any_column_name(spark, make, operator):
    docs = odd(make([(1, "one two three\nfour five six seven"), (2, None), (3, "another text altogether, with words")]))
    try:
        done = operator(docs)
    except TypeError:
        done = operator(spark, docs, "/root/testdata/sf0.001")
    assert [c for c in done.columns if c in ODD] == ODD
    at = {c: done.columns.index(c) for c in ["doc_id", *ODD]}
    for row in done.collect():
        assert row[at["doc_id"]] in (1, 2, 3) and [row[at[c]] for c in ODD] == [f"v{i}" for i in range(len(ODD))]


def test_any_column_name_of_pages(spark):
    pages = spark.createDataFrame([("http://h/a", "<p>text</p>", "v", "w", dt.date(2024, 1, 1))], ["url", "html", "z", "y", "fetched"]).toDF(
        "url", "html", "HTML", "a`b", "fetched"
    )
    entries = spark.createDataFrame([("l", "h", False, None, None)], "list string, key string, allow boolean, added date, removed date")
    for done in (main_text.main_text(pages), url_filter.filter_urls(pages, entries)):
        row = done.first()
        assert [row[done.columns.index(c)] for c in ("HTML", "a`b")] == ["v", "w"]


def test_long_references():
    digits = "9" * 5000
    page = f"<p title='&#{digits};'>a&#{digits};b&#x{'f' * 5000};c&#{'0' * 5000}65;d&#x{'0' * 5000}42;e&#65;&#x41;&amp;</p>"
    assert [b.text() for b in html_tree.parse(page)] == ["a�b�cAdBeAA&"]
    assert html_tree.parse(page)[0].node.attributes["title"] == "�"


@pytest.mark.parametrize("one", ["<div>", "<div>t", "<b>", "<ul><li>t", "<div><li></li>", "<table><tr><td>"])
def test_deep_pages(one):
    source = one * 50_000 + "<p>the end</p>"
    start = time.perf_counter()
    assert main_text.extract(source, [1]).endswith("the end")
    assert time.perf_counter() - start < 30


def test_implied_ends():
    page = "<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul><dl><dt>f<dd>g<dt>h</dl><table><tr><td>i<td>j<tr><th>k</table>"
    assert [(b.node.tag, b.text(), b.node.depth) for b in html_tree.parse(page)] == [
        ("li", "a", 2), ("li", "b", 4), ("li", "c", 4), ("li", "d", 2), ("li", "e", 2),
        ("dt", "f", 2), ("dd", "g", 2), ("dt", "h", 2), ("td", "i", 3), ("td", "j", 3), ("th", "k", 3),
    ]


def test_one_odd_date_costs_nothing(spark, monkeypatch):
    entries = spark.range(1000).select(
        F.lit("l").alias("list"), F.concat(F.lit("h"), F.col("id")).alias("key"), F.lit(False).alias("allow"),
        F.lit(None).cast("date").alias("added"), F.lit(None).cast("date").alias("removed"),
    )
    captures = spark.createDataFrame([("http://h1/", dt.date(2024, 1, 1)), ("http://h2/", dt.date(9999, 1, 1))], "url string, fetched date")
    rows = {}
    real = url_filter.materialise

    def counted(df, purpose):
        out = real(df, purpose)
        rows[purpose] = out.count()
        return out

    monkeypatch.setattr(url_filter, "materialise", counted)
    assert [r.blocked for r in url_filter.filter_urls(captures, entries).collect()] == [True, True]
    assert rows["list-periods"] == 2


def test_rare_and_unspaced_languages(spark):
    import numpy as np

    rng = np.random.default_rng(0)

    def prose(alphabet, blank, n):
        words = ["".join(rng.choice(list(alphabet), 4)) for _ in range(60)]
        return [blank.join(rng.choice(words, 30)) for _ in range(n)]

    han = [chr(0x4E00 + i) for i in range(3000)]
    rows = [(t, "en") for t in prose("abcdefgh", " ", 600)] + [(t, "pl") for t in prose("ąćęłńóśźż", " ", 6)]
    rows += [(t, "zh") for t in prose(han, "", 300)]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    for sample in (4, 40):
        done = identify(docs, sample=sample).collect()
        wrong = [r.lang for r in done if r.lang_pred != r.lang]
        assert wrong.count("pl") == 0 and wrong.count("en") <= 6
        assert sample < 40 or wrong.count("zh") <= 15


def test_filter_equals_plain_sets(spark):
    """The bit-sliced filter decides as plain sets of n-grams do, but for false positives."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    learnable = docs.filter(~language_id.held_out(F.col("doc_id")))
    found = language_id.fit(learnable, "text", "lang", draw, 5000)
    counts: dict[str, dict[int, int]] = {}
    for r in learnable.where("lang is not null and text is not null").collect():
        for hashes in language_id.gram_hashes(language_id.letter_codes(r.text)):
            mine = counts.setdefault(r.lang, {})
            for h in hashes.tolist():
                mine[h] = mine.get(h, 0) + 1
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    sets = {k: {h for h, _ in sorted(v.items(), key=lambda x: (-x[1], signed(x[0])))[: language_id.MAX_GRAMS]} for k, v in counts.items()}
    agree = n = 0
    for r in docs.where("text is not null").collect():
        codes = language_id.letter_codes(r.text)
        if len(codes) < 2:
            continue
        hashes = np.concatenate([h.copy() for h in language_id.gram_hashes(codes)]).tolist()
        shares = [sum(h in sets[k] for h in hashes) / len(hashes) for k in found.languages]
        best, (guess, score) = max(shares), found.decide(r.text)
        n += 1
        agree += not best or (shares[found.languages.index(guess)] >= best - 0.01 and abs(score - best) < 0.02)
    assert agree >= 0.99 * n > 100
