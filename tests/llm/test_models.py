import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evaquery.llm import langid, quality
from evaquery.llm.queries import op9_language_id, op10_quality_classifier
from evaquery.llm.sample import fold, sampled

SF = "/root/testdata/sf0.01"


def test_subwords_cover_whole_text_in_any_blocks(monkeypatch):
    text = "Ärger und Éclair, " * 500
    whole = langid.subwords(text)
    monkeypatch.setattr(langid, "_BLOCK", 97)
    assert (langid.subwords(text) == whole).all()
    assert whole.sum() == sum(len(f" {text} ".encode()) - n + 1 for n in langid.ORDERS)


def test_interactions_equal_the_pairwise_sum():
    rng = np.random.default_rng(0)
    f = quality.Features(n_meta=1)
    m = quality.Model(f, 0.3, rng.normal(size=f.size), rng.normal(size=(f.size, 4)))
    at, x = f.vector("a b c a 12 !!", (55,))
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i + 1, len(at)))
    assert m.margin(at, x) == pytest.approx(0.3 + m.linear[at] @ x + pairs)


def test_fold_is_crc32_of_the_decimal_id(spark):
    got = spark.range(50).select("id", fold(F.col("id"), 4).alias("x")).collect()
    assert all(r.x == zlib.crc32(str(r.id).encode()) % 4 for r in got)


def test_language_held_out_accuracy(spark):
    got = op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and np.mean([r.rejected for r in got]) < 0.1


def test_quality_held_out_accuracy(spark):
    got = op10_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 100
    assert np.mean([r.predicted == r.quality for r in got]) > 0.97
    assert np.mean([r.predicted for r in got if r.quality == 1]) > 0.98


def test_every_language_is_learned_in_a_bounded_sample(spark):
    rows = [(i, " ".join([f"wort{chr(97 + i % 60 // 26)}{chr(97 + i % 60 % 26)}"] * 6), f"l{i % 60}") for i in range(6000)] + [(None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = sampled(df, "lang", 1000, 300)
    assert {r.lang for r in got} == {f"l{k}" for k in range(60)} and len(got) <= 60 * 56
    assert len(langid.fit(df, F.lit(True), per_label=20).labels) == 60
    with pytest.raises(ValueError):
        sampled(df, "lang", 10, 59)


def test_rows_that_share_an_id_are_drawn_one_by_one(spark):
    rows = [(7, f"x{i} " * 5, "xx") for i in range(2000)] + [(100 + i, f"word {i}", "en") for i in range(500)] + [(None, "same", "null")] * 3000
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = sampled(df, "lang", 1000, 50_000)
    assert {lang: sum(r.lang == lang for r in got) for lang in ("xx", "en", "null")} == {"xx": 1000, "en": 500, "null": 1}
    assert got == sampled(df.repartition(7), "lang", 1000, 50_000)


def plain_language(model, text):
    """The prediction by the definition: every subword of the whole text, one after another."""
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    data = [c if 97 <= c <= 122 or c >= 128 else 32 for c in f" {text} ".lower().encode()]
    total, n = np.zeros(len(model.labels)), 0
    for order in langid.ORDERS:
        for i in range(len(data) - order + 1):
            h = 0
            for k, c in enumerate(data[i : i + order]):
                h = (h * 0x01000193 + c + k + 1) % 2**32
            bucket = ((h ^ h >> 15) * 0x85EBCA6B) % 2**32 >> 32 - langid.BUCKET_BITS
            total, n = total + model.table[bucket], n + 1
    z = np.exp((total / n + model.bias) / model.temperature - ((total / n + model.bias) / model.temperature).max())
    return model.labels[int(z.argmax())], float(z.max() / z.sum())


def test_language_query_against_the_definition(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs, fold(F.col("doc_id"), 4) != 2, per_label=1000)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = op9_language_id(spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    checked = [r for r in got if len(texts[r.doc_id]) < 4000]
    assert len(checked) > 100
    for r in checked:
        lang, score = plain_language(model, texts[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_quality_query_against_all_pairs(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"), fold(F.col("doc_id"), 3) != 1)
    rows = {r.doc_id: r for r in docs.collect()}
    got = op10_quality_classifier(spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    checked = 0
    for r in got:
        own = rows[r.doc_id]
        at, x = model.features.vector(own.text or "", (own.n_chars,))
        if len(at) > 1500:
            continue
        v = model.factors[at].astype(np.float64)
        pairs = np.tril((v @ v.T) * np.outer(x, x), -1).sum()
        z = model.bias + model.linear[at] @ x + pairs
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5) and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        checked += 1
    assert checked > 100


def test_repeated_ids_bring_one_text_each(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "good fine text", 3)] * 500 + [(1, "another", 1), (2, "!!!! ####", None)], "doc_id bigint, text string, n_chars bigint")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (4, 1), (5, None)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows, **k: seen.extend(rows))
    quality.fit(docs, labels, F.lit(True))
    assert seen == [("another", (1,), 1), ("!!!! ####", (None,), 0)]


def test_edge_rows(spark):
    model = langid.train([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 10)
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "12 !?", "x"), (5, "und die " * 30000, "x")], "doc_id bigint, text string, score string")
    got = {(r.doc_id, r.lang_pred) for r in langid.languages(df, model).collect()}
    assert got == {(1, "und"), (2, "und"), (None, "und"), (5, "de")}
    assert langid.languages(df, langid.train([])).where("lang_pred = 'und'").count() == 5
    assert langid.languages(df.limit(0), model).count() == 0
    q = quality.train([("fine words here", (3,), 1), ("!!!! ####", (None,), 0)] * 5)
    df = df.selectExpr("*", "cast(null as bigint) n_chars")
    assert [0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in quality.scores(df, q).collect()] == [True] * 5
    assert quality.scores(df, quality.train([]), meta_cols=()).where("score between 0.3 and 0.7").count() == 5
    empty_labels = spark.createDataFrame([], "doc_id bigint, quality int")
    m = quality.fit(df, empty_labels, fold(F.col("doc_id"), 3) != 1)
    assert m.score("x", (1,)) >= 0
