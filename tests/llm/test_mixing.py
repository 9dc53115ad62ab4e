import os
import re
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from helpers import documents  # noqa: E402

from lattica.llm import mixing  # noqa: E402

SF = "/root/testdata/sf0.01"


def water_fill(sizes):
    """Targets by resharing the excess round by round."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    capped = {}
    total = sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return capped | target
        capped |= {s: 3 * sizes[s] for s in over}


def check(rows, docs):
    sizes = Counter()
    count = {}
    for d in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        sizes[d.source] += n
        count[d.doc_id] = n
    want = water_fill(sizes)
    taken = Counter()
    source = {d.doc_id: d.source for d in docs}
    for r in rows:
        s = source[r.doc_id]
        assert r.size == count[r.doc_id] and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 5 * mixing.BLOCK, (s, taken[s], want[s])


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    check(rows, docs.select("doc_id", "text", "source").collect())
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_schedule_ranks_are_dense_and_near_the_shares(spark):
    targets = spark.createDataFrame([(0, 700.0), (1, 290.0), (2, 10.0)], "sid int, target double")
    rows = mixing.schedule(targets, 40_000 * 32, 32).collect()
    assert len({r.slot for r in rows}) == len(rows) == 40_000
    for sid, share in ((0, 0.7), (1, 0.29), (2, 0.01)):
        own = sorted((r.slot, r["rank"]) for r in rows if r.sid == sid)
        assert [k for _, k in own] == list(range(len(own)))
        assert abs(len(own) - share * 40_000) <= 5


def test_edge_cases(spark):
    texts = [None, "", "a b c " * 300, "d e", "x " * 20_000, "same text", "same text", "z " * 50]
    sources = ["b", "b", "a", None, "c", "c", "c", "empty"]
    docs = documents(spark, texts, sources=sources).withColumn("size", F.lit("x")).withColumn("target", F.lit(0))
    rows = mixing.mix(docs).collect()
    assert len(rows) == 8
    check(rows, docs.select("doc_id", "text", "source").collect())
    doubled = mixing.mix(docs.unionAll(docs))
    assert doubled.count() == 16
    assert mixing.mix(docs.limit(0)).count() == 0
    blank = mixing.mix(documents(spark, [None, ""], ids=[None, None])).collect()
    assert [r.taken for r in blank] == [0, 0]


def test_main_path_is_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
