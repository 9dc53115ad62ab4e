import math
import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from helpers import documents  # noqa: E402

from lattica.llm import decontamination as dc  # noqa: E402
from lattica.llm.catalog import op1_decontamination  # noqa: E402

SF = "/root/testdata/sf0.01"


def brute_bm25(items, passage):
    """Score of each item for the distinct words of a passage, over its score against itself."""
    docs = [re.findall(r"\w+", t.lower()) for t in items]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    out = []
    for d in docs:
        tf = Counter(d)
        weight = {
            w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(d) / mean)) for w, c in tf.items()
        }
        out.append(sum(v for w, v in weight.items() if w in passage) / sum(weight.values()))
    return out


def brute_hits(items, text):
    words = re.findall(r"\w+", text.lower())
    kept = [(i, t) for i, t in items if re.findall(r"\w+", t.lower())]
    step = max(len(re.findall(r"\w+", t.lower())) for _, t in kept)
    found = set()
    for lo in range(0, max(len(words), 1), step):
        passage = words[lo : lo + 2 * step]
        scores = brute_bm25([t for _, t in kept], set(passage))
        for (i, t), s in zip(kept, scores):
            w = re.findall(r"\w+", t.lower())
            n = min(5, len(w))
            want = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            have = {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)}
            answer = set(re.findall(r"\w+", re.split(r"(?<=[.?!])\s+", t.strip())[-1].lower())) or set(w)
            if s >= 0.5 - 1e-6 and len(want & have) >= 0.8 * len(want) and len(answer & set(passage)) >= 0.8 * len(answer):
                found.add(i)
    return found


def test_whole_table_finds_every_contained_item(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for d in docs:
        words = " ".join(re.findall(r"\w+", d.text.lower()))
        near = [i for i, t in items if " ".join(re.findall(r"\w+", t.lower())[:7]) in words or " ".join(re.findall(r"\w+", t.lower())[-7:]) in words]
        if near:
            want |= {(d.doc_id, i) for i in brute_hits(items, d.text)}
    rows = op1_decontamination(spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and want
    assert all(r.score >= 0.49 and r.overlap >= 0.8 for r in rows)


@pytest.mark.parametrize("block", [8, 2, 1])
def test_random_texts_equal_brute_force(monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_ITEMS", block)
    monkeypatch.setattr(dc, "BATCH_WORDS", 150)
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14))) + rng.choice([".", "? yes.", ""])) for k in range(23)]
    texts = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 70))]
        at = rng.randint(0, len(words))
        quoted = rng.choice(items)[1].split()
        if rng.random() < 0.4 and len(quoted) > 6:
            quoted[rng.randrange(len(quoted))] = "changed"
        texts.append(" ".join(words[:at] + quoted + words[at:]))
    got = [{i for i, _, _ in found} for found in dc.Index(items).hits(texts)]
    assert got == [brute_hits(items, t) for t in texts]
    assert sum(map(len, got)) > 20


def test_retrieval_reaches_every_item_over_the_threshold_and_skips_the_rest(monkeypatch):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 20)))) for k in range(200)]
    index, scored = dc.Index(items), []
    whole = dc.Index._scored
    monkeypatch.setattr(dc.Index, "_scored", lambda self, p, c, least: scored.append(len(np.unique(p))) or whole(self, p, c, least))
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 9))] for _ in range(150)]
    pairs = sorted({(k, index.terms[w]) for k, words in enumerate(passages) for w in words if w in index.terms})
    for least in (0.5, 0.3, 0.9):
        found = index.retrieve(*(np.array(x) for x in zip(*pairs)), least)
        got = {(p, index.ids[i]): s for p, i, s in found}
        assert len(got) == len(found)
        for k, words in enumerate(passages):
            scores = brute_bm25([t for _, t in items], set(words))
            assert {i for i, s in enumerate(scores) if s >= least + 1e-5} <= {i for p, i in got if p == k} <= {i for i, s in enumerate(scores) if s >= least - 1e-5}
            assert all(abs(got[k, i] - s) < 1e-9 for i, s in enumerate(scores) if (k, i) in got)
    assert sum(scored) < 0.5 * 3 * len(passages) * index.end  # most blocks are passed over without being scored


def test_edge_cases(spark):
    item = "What is the capital of the far northern land? It is the city of snow and wind."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "?!"), (None, "one two three four five six seven")], "item_id long, text string")
    texts = [None, "", "x", item, "a " * 40_000 + item.upper() + " b" * 40_000, "one two three four five six seven", item[:40]]
    docs = documents(spark, texts).withColumn("item_id", F.lit("x")).withColumn("score", F.lit(1))
    got = sorted((r.doc_id, r.item_id or -1) for r in dc.contaminated(docs.unionAll(docs), bench).collect())
    assert got == sorted([(3, 1), (4, 1), (5, -1)] * 2)
    left = dc.clean(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 6]
    assert dc.contaminated(docs.limit(0), bench).count() == 0
    assert dc.contaminated(docs, bench.limit(0)).count() == 0
    assert dc.clean(docs, bench.limit(0)).count() == 7


def test_slices_change_neither_hits_nor_scores(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(80)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30)))) for k in range(60)]
    bench = spark.createDataFrame(items + items[:3], "item_id long, text string")
    texts = [t for _, t in items] + ["nothing"]
    for _ in range(80):  # quotes in part, near both thresholds
        words = rng.choice(items)[1].split()
        for k in range(len(words)):
            if rng.random() < 0.04:
                words[k] = rng.choice(vocabulary)
        texts.append(" ".join(words[rng.randint(0, 2) : len(words) - rng.randint(0, 4)] + [rng.choice(vocabulary) for _ in range(50)]))
    docs = documents(spark, texts)
    whole = sorted(map(tuple, dc.contaminated(docs, bench).collect()))
    kept = sorted(r.doc_id for r in dc.clean(docs, bench).collect())
    monkeypatch.setattr(dc, "SLICE_BYTES", 600)
    slices = dc.item_slices(bench)
    assert len(slices) > 5 and sorted(x for s, _ in slices for x in s) == items
    assert {(stats.items, stats.longest) for _, stats in slices} == {(60, max(len(t.split()) for _, t in items))}
    assert sorted(map(tuple, dc.contaminated(docs, bench).collect())) == whole
    assert sorted(r.doc_id for r in dc.clean(docs, bench).collect()) == kept
    assert {(k, k) for k in range(60)} <= {x[:2] for x in whole} and 60 in kept and 70 < len(whole)
