import os
import random
import re
import sys

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from helpers import documents, union_components  # noqa: E402

from lattica.llm import simhash  # noqa: E402

SF = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    links = [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    return [ids[r] for r in union_components(len(ids), links)]


def test_covering_masks_meet_every_pair_within_the_radius():
    rng = random.Random(1)
    masks = [m & (2**64 - 1) for m in simhash.covering_masks(list(range(64)))]
    assert len(masks) == 31
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(m & diff == 0 for m in masks)


def test_fingerprints_and_components_equal_brute_force_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], prints)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert [got[r.doc_id].fp & (2**64 - 1) for r in rows] == prints
    assert [got[r.doc_id].component_id for r in rows] == want


@pytest.mark.parametrize("hot", [4096, 3])
def test_links_of_random_near_fingerprints(spark, hot):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(20)]
    for _ in range(300):
        x = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        prints.append(x)
    prints = sorted(set(prints))
    fps = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in prints], "fp long")
    links = simhash.fingerprint_links(fps, hot_bucket=hot).collect()
    at = {x: i for i, x in enumerate(prints)}
    pairs = [(at[r.u & (2**64 - 1)], at[r.v & (2**64 - 1)]) for r in links]
    assert union_components(len(prints), pairs) == brute_components(list(range(len(prints))), prints)


def test_edge_cases(spark):
    texts = [None, "", " \n", "One two", "one TWO", "É a b c d", "x" * 200_000, "w " * 90_000]
    docs = documents(spark, texts).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs.unionAll(docs)).collect()}
    assert len(got) == 8
    assert [got[i].fp & (2**64 - 1) for i in range(8)] == [brute_fingerprint(t) for t in texts]
    assert [got[i].component_id for i in range(5)] == [0, 0, 0, 3, 3]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    nulls = documents(spark, ["a b", "a b"], ids=[None, None])
    assert [r.component_id for r in simhash.near_duplicates(nulls).collect()] == [None, None]
