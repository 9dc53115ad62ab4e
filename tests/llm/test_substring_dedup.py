import hashlib
import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from helpers import documents  # noqa: E402

from lattica.llm import substring_dedup as sd  # noqa: E402
from lattica.llm.catalog import op6_substring_dedup  # noqa: E402

SF = "/root/testdata/sf0.01"


def brute(rows):
    """rows: (doc_id, text), ids distinct."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_rolling_hash_is_the_polynomial():
    x = np.random.default_rng(1).integers(0, 2**63, 57, dtype=np.uint64)
    for width in (1, 2, 3, 20, 31, 57):
        got = sd.rolling(x, width, sd.BASES[0])
        want = [sum(int(v) * sd.BASES[0] ** (width - 1 - k) for k, v in enumerate(x[i : i + width])) % 2**64 for i in range(58 - width)]
        assert got.tolist() == want


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op6_substring_dedup(spark, SF).collect()}
    assert got == brute(rows)
    assert sum(n for _, n, _ in got.values()) > 0


@pytest.mark.parametrize("bucket, batch", [(1 << 21, 1 << 20), (40, 150)])
def test_spans_and_edges(spark, monkeypatch, bucket, batch):
    monkeypatch.setattr(sd, "BUCKET_WINDOWS", (bucket, bucket))
    monkeypatch.setattr(sd, "BATCH_WINDOWS", (batch, batch))
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = [None, "", "short text"]
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        at = rng.randint(0, len(words))
        texts.append(" ".join(words[:at] + passage + words[at:]))
    texts += ["a " * 5000, "a " * 100, texts[7], texts[7].replace(" ", "\t\n")]
    docs = documents(spark, texts).withColumn("tag", F.lit(1)).withColumn("id", F.lit("x")).withColumn("key", F.lit("y")).withColumn("order", F.lit(2))
    got = {r.doc_id: r for r in sd.remove_repeats(docs.repartition(5)).collect()}
    want = brute(list(enumerate(texts)))
    for i, r in got.items():
        removed = sum(s["end"] - s["start"] for s in r.spans)
        assert (r.n_words, removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) == want[i], i
        assert all(a["end"] < b["start"] for a, b in zip(r.spans, r.spans[1:]))
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def test_rows_with_one_id_or_none(spark):
    text = " ".join(f"x{i}" for i in range(25))
    docs = documents(spark, [text, text, text, text + " more", text], ids=[4, 4, None, 4, None])
    got = sorted((r.doc_id is None, len(r.spans)) for r in sd.remove_repeats(docs).collect())
    assert got == [(False, 0)] * 3 + [(True, 1)] * 2


def test_many_rows_without_id_equal_brute_force(spark):
    rng = random.Random(5)
    shared = [" ".join(f"s{k}x{i}" for i in range(24)) for k in range(40)]
    texts = [" ".join(f"{k}y{i}" for i in range(21)) + (" " + rng.choice(shared) if k % 10 == 0 else "") for k in range(20_000)]
    first = [(k, t) for k, t in enumerate(shared[:20])]
    docs = documents(spark, [t for _, t in first] + texts, ids=[k for k, _ in first] + [None] * len(texts))
    rows = [r for r in sd.remove_repeats(docs).collect() if r.doc_id is None]
    assert len(rows) == len(texts)
    want = sorted((len(t.split()), 24 if any(s in t for s in shared[:20]) else 0) for t in texts)
    assert sorted((r.n_words, sum(s["end"] - s["start"] for s in r.spans)) for r in rows) == want


def test_negative_and_extreme_ids(spark):
    text = " ".join(f"x{i}" for i in range(25))
    ids = [2**63 - 2, -(2**63), 0, -1]
    got = {r.doc_id: len(r.spans) for r in sd.remove_repeats(documents(spark, [text] * 4, ids=ids)).collect()}
    assert got == {2**63 - 2: 1, -(2**63): 0, 0: 1, -1: 1}


def test_buckets_follow_the_windows():
    for windows in (0, 1, 10**6, 10**9, 10**11, 10**13):
        buckets, batch = sd.layout(windows)
        assert windows / buckets <= sd.BUCKET_WINDOWS[1] and batch <= sd.BATCH_WINDOWS[1]
        assert windows < 8 * 10**9 and windows / buckets <= sd.BUCKET_WINDOWS[0] or windows >= 8 * 10**9 or not windows
