"""Queries of the llm subpackage and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.llm import (
    decontamination,
    html_text,
    language_id,
    line_dedup,
    mixing,
    order_minhash,
    simhash,
    substring_dedup,
    token_counts,
    warc,
)
from lattica.llm.oracles import ORACLES
from lattica.session import shared_path, table


def _total(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def op1_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return warc.read_archives(manifest, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op4_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_substring_dedup(spark, sf_dir):
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", _total("spans").alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_line_dedup(spark, sf_dir):
    found = line_dedup.remove_lines(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.col("_lines").alias("n_lines"), _total("_spans").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256")
    )


def op8_html_text(spark, sf_dir):
    found = html_text.extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_order_minhash(spark, sf_dir):
    return order_minhash.compare_edits(table(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", language_id.held_out_fold().alias("held_out"), "lang_pred", "score", "rejected")


def queries():
    return {
        "op1_decontamination": op1_decontamination,
        "op2_token_counts": op2_token_counts,
        "op3_warc": op3_warc,
        "op4_simhash": op4_simhash,
        "op5_mixing": op5_mixing,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_line_dedup": op7_line_dedup,
        "op8_html_text": op8_html_text,
        "op9_order_minhash": op9_order_minhash,
        "op10_language_id": op10_language_id,
    }


def oracle_sql():
    return dict(ORACLES)
