"""Toxicity, language and language-model scores: held-out accuracy and brute force."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.llm.language import identify, identify_documents, identify_pages, train_trigrams
from seriesmith.llm.ngrams import hashes, laid_out
from seriesmith.llm.toxicity import score_texts, score_toxicity

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_slices_lose_no_ngram(monkeypatch):
    from seriesmith.llm import ngrams

    texts = ["abc déf 日本", None, "", "x" * 100, "Word, word!"]
    def seen():
        out = Counter()
        for codes, starts, index in laid_out(texts, 3):
            ends = [*starts[1:], len(codes)]
            for a, b, i in zip(starts, ends, index):
                out.update((int(i), tuple(codes[k : k + 4])) for k in range(a, b - 3))
        return out

    whole = seen()
    monkeypatch.setattr(ngrams, "SLICE", 11)
    assert seen() == whole


def auc(score, label):
    pairs = [(a > b) + 0.5 * (a == b) for a, x in zip(score, label) if x for b, y in zip(score, label) if not y]
    return sum(pairs) / len(pairs)


@needs_data
def test_toxicity_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    own = [r for r in rows if r["held_out"]]
    assert auc([r["score"] for r in own], [r["toxic"] for r in own]) > 0.85


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(["vile brute " * 3, "kind word " * 3, None, ""] * 20)] + [(None, "vile", 0.1)], "doc_id long, text string, score double")
    labels = docs.filter("doc_id is not null").select("doc_id", F.when(F.col("doc_id") % 4 == 0, 1).when(F.col("doc_id") % 4 == 1, 0).alias("toxic"))
    got = {r["doc_id"]: r for r in score_toxicity(docs, labels.unionByName(labels)).collect()}
    assert len(got) == 81 and got[0]["predicted"] == 1 and got[1]["predicted"] == 0 and got[2]["score"] == got[3]["score"]
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r["predicted"] for r in score_toxicity(docs, none).collect()} == {0}
    assert score_toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_toxicity_takes_whole_texts():
    table = np.zeros((2, 1 << 20), np.float32)
    table[0][hashes(np.array([ord(c) for c in "vile"], np.uint32), 4, 20)] = 5000.0
    clean, late = score_texts(["x" * 3_000_000, "x" * 3_000_000 + " vile"], table, -1.0)
    assert late > 0.5 > clean


@needs_data
def test_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["language"] == r["lang"] for r in rows]) > 0.99 and np.mean([r["kept"] for r in rows]) > 0.99
    pages = spark.createDataFrame(
        [(1, None, None), (2, "http://x.example.org/de/1", "<html lang='de'><body>12 34</body></html>"), (3, "nonsense", "<p>the and of to was</p>"), (4, "http://x.example.org/de/1", "<html lang=de>der und die nicht schach</html>")],
        "page_id long, url string, html string",
    )
    got = {r["page_id"]: r for r in identify_pages(pages, docs).collect()}
    assert got[1]["language"] == "und" and not got[1]["kept"] and got[3]["language"] == "en" and got[4]["language"] == "de"
    assert not got[2]["kept"]


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "aaa bbb", "x", "s"), (2, None, "x", None), (3, "ccc ddd", "y", "s"), (4, "", None, "s"), (None, "ccc", "y", "s"), (5, "9 9 !", "y", "s")], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in identify_documents(docs).collect()}
    assert got[1]["language"] == "x" and got[3]["language"] == "y" and got[None]["language"] == "y"
    assert not got[2]["kept"] and got[2]["language"] == "und" and not got[5]["kept"]
    assert identify_documents(docs.limit(0)).count() == 0
    model = train_trigrams(docs.limit(0), "text", "lang")
    assert {r["language"] for r in identify(docs, model, id_col="doc_id", text_col="text").collect()} == {"und"}


@needs_data
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, count = docs.columns, docs.count()
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(apply(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.columns == columns and 0.7 * count < docs.count() <= count
    texts = [r["text"] for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_every_label_and_declared_value_counts(spark):
    from seriesmith.llm.language import _trust

    rng = np.random.default_rng(3)
    words = {f"l{k:02d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(8)] for k in range(40)}
    docs = spark.createDataFrame([(i, " ".join(w), l, "s") for i, (l, w) in enumerate(words.items())], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: r["language"] for r in identify_documents(docs).collect()} == dict(enumerate(words))
    seen = spark.createDataFrame([(f"v{i}", i % 2, 3) for i in range(1100)], "v string, best int, n long")
    found = _trust(seen, "v", 2).collect()
    assert len(found) == 1100 and all((r["_trusted"][0] > r["_trusted"][1]) == (int(r["v"][1:]) % 2 == 0) for r in found)


def test_host_suffix_is_evidence(spark):
    text = {"de": "der und die nicht schach", "en": "the and of to was"}
    docs = spark.createDataFrame([(i, text[l], l) for i, l in enumerate(("de", "en"))], "doc_id long, text string, lang string")
    url = lambda i, s: f"http://h{i}.site{i}.{s}/artikel"
    body = lambda t: f"<p>{t}</p>"
    rows = [(i, url(i, "de" if l == "de" else "uk"), body(text[l])) for i, l in enumerate(["de", "en"] * 20)]
    pages = spark.createDataFrame([*rows, (100, url(100, "de"), body("12 34")), (101, url(101, "uk"), body("12 34"))], "page_id long, url string, html string")
    got = {r["page_id"]: r["language"] for r in identify_pages(pages, docs).collect()}
    assert got[100] == "de" and got[101] == "en"


def test_op5_fuses_all_evidence(spark, tmp_path):
    """One row a document and page; a page's markup, suffix and folder speak where its text does not."""
    from seriesmith.llm.queries import op5_language

    words = {"en": "the house and the garden", "de": "das haus und der garten"}
    docs = spark.createDataFrame([(i, words[l], l, "src") for i, l in enumerate(["en", "de"] * 20)], "doc_id long, text string, lang string, source string")
    page = lambda i, l, body: (i, f"http://host{i}.example.{l}/{l}/p", f'<html lang="{l}"><p>{body}</p></html>')
    rows = [page(i, l, words[l]) for i, l in enumerate(["en", "de"] * 20)] + [page(40, "de", "12345"), page(41, "en", "12345")]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op5_language(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == list(range(40))
    by_page = {r["page_id"]: r for r in got if r["page_id"] is not None}
    assert sorted(by_page) == list(range(42)) and len(got) == 82
    assert (by_page[40]["language"], by_page[41]["language"]) == ("de", "en") and not by_page[40]["kept"]
    assert all(r["language"] == ("en", "de")[r["doc_id"] % 2] for r in got if r["doc_id"] is not None)
