import hashlib
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from helpers import documents  # noqa: E402

from lattica.llm import order_minhash as om  # noqa: E402
from lattica.llm.substring_dedup import WordHashes  # noqa: E402

SF = "/root/testdata/sf0.01"


def brute_sketch(text):
    """Straight from the definition, with the module's hash of a numbered k-mer."""
    words = text.encode().split()
    if not words:
        return None
    items = om.numbered_kmers(words, WordHashes()).tolist()
    out = []
    for f, s in zip(om.FACTORS[:, 0].tolist(), om.SHIFTS[:, 0].tolist()):
        ranked = sorted(range(len(items)), key=lambda i: ((items[i] * f + s) % 2**64, i))[:2]
        a, b = min(ranked), max(ranked)
        second = int(om._mixed(np.array([(items[b] + s) % 2**64], np.uint64))[0])
        joint = int(om._mixed(np.array([(items[a] * f + second) % 2**64], np.uint64))[0])
        out.append(joint >> 48)
    return out


def brute_hex(text):
    s = brute_sketch(text)
    return "0000" * om.SKETCHES if s is None else "".join(f"{x:04x}" for x in s)


def check(rows, docs):
    """docs: (doc_id, text) in order of succession."""
    got = {r.doc_id: r for r in rows}
    for k, (doc_id, text) in enumerate(docs):
        text, following = text or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(text) // 2
        other = text[: len(text) - half] + following[:half]
        r = got[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert r.fingerprint == brute_hex(text) and r.edited_fingerprint == brute_hex(other)
        same = lambda a, b: sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / om.SKETCHES
        near = lambda a, b: float(not a.split() and not b.split()) if not a.split() or not b.split() else same(brute_hex(a), brute_hex(b))
        assert r.near_edited == near(text, other) and r.near_next == near(text, following)


@pytest.mark.parametrize("n", [1, 2, 3, 30, 2047, 2048, 2049, 2050, 5000])
def test_sketch_equals_definition(n):
    rng = random.Random(n)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n))
    assert om.sketch(text.encode().split(), WordHashes()).tolist() == brute_sketch(text)


def test_occurrences_and_order_count():
    h = WordHashes()
    of = lambda t: om.sketch(t.encode().split(), h)
    a = [f"a{i}" for i in range(300)]
    b = [f"b{i}" for i in range(300)]
    assert om.likeness(of(" ".join(a + b)), of(" ".join(b + a))) < 0.8
    assert om.likeness(of(" ".join(a)), of(" ".join(a + a))) < 0.7
    assert om.likeness(of(" ".join(a)), of(" ".join(a))) == 1


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = om.compare_edits(docs).collect()
    want = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    assert len(rows) == len(want)
    step = want[::25]
    short = {r.doc_id: r for r in rows}
    at = {d: k for k, (d, _) in enumerate(want)}
    for doc_id, text in step:
        following = want[(at[doc_id] + 1) % len(want)][1]
        half = len(text) // 2
        other = text[: len(text) - half] + following[:half]
        assert short[doc_id].edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert short[doc_id].fingerprint == brute_hex(text)
        assert short[doc_id].edited_fingerprint == brute_hex(other)
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.95


def test_edge_cases(spark):
    texts = ["a b c d e f " * 9, None, "", "x", "é" * 9000, "w1 w2 w3 w4 " * 900, "a b c d e f " * 9, " \n"]
    docs = documents(spark, texts, ids=[3, 1, 8, 5, 100, -7, 40, 9]).withColumn("part", F.lit(1)).withColumn("h", F.lit(0))
    check(om.compare_edits(docs).collect(), sorted(zip([3, 1, 8, 5, 100, -7, 40, 9], texts)))
    assert om.compare_edits(docs.limit(0)).count() == 0
    one = om.compare_edits(documents(spark, ["only one here"])).collect()
    check(one, [(0, "only one here")])
    assert om.compare_edits(docs.unionAll(docs)).count() == 16
    some = documents(spark, ["a b", "c d", "e f"], ids=[None, 2, None])
    assert om.compare_edits(some).count() == 3


def test_rows_without_id_and_of_one_id_are_split(spark):
    texts = [f"word{k} {k} and more" for k in range(400)]
    ids = [None if k < 150 else 7 if k < 300 else k for k in range(400)]
    docs = documents(spark, texts, ids=ids)
    dealt = om.successors(docs).filter("ahead = 0")
    sizes = {r.part: r["count"] for r in dealt.groupBy("part").count().collect()}
    assert sum(sizes.values()) == 400 and max(sizes.values()) < 100
    h = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(zip(ids, texts), key=lambda r: (r[0] is None, r[0] or 0, h[r[1]]))
    want = sorted((i or -1, hashlib.sha256(om.edited(t, order[(k + 1) % 400][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert sorted((r.doc_id or -1, r.edited_sha256) for r in om.compare_edits(docs).collect()) == want
