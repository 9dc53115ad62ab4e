import os
import sys
import zlib

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from helpers import documents  # noqa: E402

from lattica.llm import language_id as li  # noqa: E402
from lattica.llm.catalog import op10_language_id  # noqa: E402

SF = "/root/testdata/sf0.01"


def brute_features(text):
    clean = " " + " ".join(text.lower().split()) + " "
    out = []
    for n in (2, 3, 4):
        for i in range(len(clean) - n + 1):
            piece = clean[i : i + n]
            if " " in piece[1:-1]:
                continue
            h = 0
            for c in piece:
                h = (h * 0x9E3779B1 + ord(c)) % 2**64
            h = (h * 0xD6E8FEB86659FD93 + n) % 2**64
            out.append((((h ^ (h >> 29)) * 0x9E3779B97F4A7C15) % 2**64) >> 49)
    return out


def test_features_equal_definition():
    for text in ("a", "Ab c", "  Ünï\tcode\nwords  and more", "x" * 50):
        assert li.features(text).tolist() == brute_features(text)


def test_held_out_accuracy_on_whole_table(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op10_language_id(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97


def test_repeats_and_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = li.fit(docs.repartition(5))
    b = li.fit(docs.withColumn("lang", F.when(li.held_out_fold(), F.lit("xx")).otherwise(F.col("lang"))))
    assert a.languages == b.languages and np.array_equal(a.table, b.table) and a.thresholds == b.thresholds


def test_rejection_is_calibrated_and_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = li.predict(docs, li.fit(docs))
    assert found.filter("rejected").count() <= 0.01 * docs.count()


def test_predictions_equal_a_plain_computation_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = li.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op10_language_id(spark, SF).collect():
        text = texts[r.doc_id]
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        ids, counts = np.unique(brute_features(text), return_counts=True)
        z = (counts @ model.table[ids] / counts.sum() + model.bias) / model.temperature
        p = np.exp(z) / np.exp(z).sum()
        assert model.languages[int(p.argmax())] == r.lang_pred and abs(p.max() - r.score) < 1e-9
        least = [t for n, t in zip(li.EXAMPLE_WORDS, model.thresholds) if n <= max(1, len(text.split()))][-1]
        assert r.rejected == (r.score < least)


def test_an_unlearned_language_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text IS NOT NULL")
    for left in ("es", "fr", "de"):
        model = li.fit(docs.filter(F.col("lang") != left))
        held = li.predict(docs.filter(li.held_out_fold()), model).join(docs.select("doc_id", "lang"), "doc_id")
        share = {r.own: r.share for r in held.groupBy((F.col("lang") == left).alias("own")).agg(F.avg(F.col("rejected").cast("int")).alias("share")).collect()}
        assert share[True] > 0.9 and share[False] < 0.01, (left, share)


def test_letters_are_letters_only(spark):
    docs = documents(spark, ["the quick brown fox " * 4, "le renard brun " * 4] * 3, langs=["en", "fr"] * 3)
    model = li.fit(docs)
    for text in ("\u00bd", "\u2460", "x\u00b2"[1:], "12_3", "\u0663 \u0967"):
        assert model.predict(text) == ("und", 0.0)
    assert model.predict("12 \u00e9")[0] in model.languages


def test_rows_without_id_are_not_learned_from(spark):
    texts = ["the quick brown fox " * 4, "le renard brun " * 4, "der braune fuchs " * 4] * 4
    langs = ["en", "fr", "de"] * 4
    docs = documents(spark, texts, langs=langs, ids=[None if lang == "de" else k for k, lang in enumerate(langs)])
    assert li.fit(docs).languages == ["en", "fr"]
    twice = li.fit(docs.unionAll(docs))  # the sample is of distinct rows
    assert np.array_equal(twice.table, li.fit(docs).table)
    held = {r.held_out for r in docs.select("doc_id", li.held_out_fold().alias("held_out")).filter("doc_id IS NULL").collect()}
    assert held == {False}


def test_edge_cases(spark):
    texts = [None, "", "123 !?", "the quick brown fox " * 4, "le renard brun et la rose " * 4, "x", "der " * 50_000]
    langs = ["en", "en", "en", "en", "fr", None, "de"]
    docs = documents(spark, texts, langs=langs).withColumn("rejected", F.lit(3)).withColumn("n", F.lit(0))
    model = li.fit(docs)
    got = {r.doc_id: r for r in li.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and all(got[i].rejected for i in range(3))
    assert all(got[i].lang_pred in model.languages for i in range(3, 7))
    kept = li.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {3, 4, 5, 6}
    assert li.predict(docs.limit(0), model).count() == 0
    nothing = li.fit(docs.limit(0))
    assert {r.lang_pred for r in li.predict(docs, nothing).collect()} == {"und"}
    assert li.predict(documents(spark, ["a b"], ids=[None]), model).count() == 1


def test_thresholds_rest_on_all_other_documents(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, real = [], li.calibrate
    monkeypatch.setattr(li, "calibrate", lambda model, rest: seen.append(rest.count()) or real(model, rest))
    monkeypatch.setattr(li, "LEAST_CALIBRATED", 10)
    many = docs.unionAll(docs.withColumn("doc_id", F.col("doc_id") + 10**6)).unionAll(docs.withColumn("doc_id", F.col("doc_id") + 10**7))
    for _ in range(3):
        many = many.unionAll(many.withColumn("doc_id", F.col("doc_id") * 7 + 3))
    many = many.dropDuplicates(["doc_id"])
    model = li.fit(many, 50)
    learned = many.filter("lang IS NOT NULL AND text IS NOT NULL").filter(~li.held_out_fold())
    assert seen[0] > 4 * 2000 and seen[0] > 0.95 * learned.count()
    assert li.fit(many.unionAll(many), 50).thresholds == model.thresholds
