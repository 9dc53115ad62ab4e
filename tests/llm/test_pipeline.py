import os
import re
import sys

sys.path.insert(0, os.path.dirname(__file__))
import corpus_pipeline  # noqa: E402
from helpers import documents  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_decontamination import brute_hits  # noqa: E402
from test_line_dedup import brute as brute_lines  # noqa: E402
from test_mixing import check as check_mix  # noqa: E402
from test_simhash import brute_components, brute_fingerprint  # noqa: E402

from lattica.llm import language_id  # noqa: E402
from lattica.session import materialize, table  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_each_stage_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            model = language_id.fit(docs)
        docs = materialize(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(after)
        if name != "mixing":
            assert docs.columns == columns
        if name == "language_id":
            found = {d: model.predict(r.text) for d, r in before.items()}
            long_enough = lambda t: [x for n, x in zip(language_id.EXAMPLE_WORDS, model.thresholds) if n <= max(1, len(t.split()))][-1]
            assert after == {d: r for d, r in before.items() if found[d][0] != "und" and found[d][1] >= long_enough(r.text)}
            assert len(after) >= 0.98 * len(before)
        elif name == "line_dedup":
            want = brute_lines([(d, r.text) for d, r in before.items()])
            assert {d: r.text for d, r in after.items()} == {d: k for d, (_, _, k) in want.items()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "near_dedup":
            ids = sorted(before)
            heads = brute_components(ids, [brute_fingerprint(before[d].text) for d in ids])
            assert after == {d: before[d] for d, h in zip(ids, heads) if d == h}
        elif name == "decontamination":
            seven = lambda t: [" ".join(w[:7]) for w in [re.findall(r"\w+", t.lower())]] + [" ".join(re.findall(r"\w+", t.lower())[-7:])]
            marks = [m for _, t in items for m in seven(t)]
            flat = {d: " ".join(re.findall(r"\w+", r.text.lower())) for d, r in before.items()}
            bad = {d for d, r in before.items() if any(m in flat[d] for m in marks) and brute_hits(items, r.text)}
            assert after == {d: r for d, r in before.items() if d not in bad}
        else:
            sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for d, r in before.items()}
            assert set(after) <= {d for d, n in sizes.items() if n}
            from lattica.llm import mixing

            mixed = mixing.mix(materialize(spark.createDataFrame(list(before.values()), spark.read.parquet(f"{SF}/documents.parquet").schema), "x"))
            check_mix(mixed.collect(), before.values())
            assert {r.doc_id: r.taken for r in mixed.collect() if r.taken} == {d: r.taken for d, r in after.items()}


def test_run_writes_and_rereads_each_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert 0 < rows.count() <= table(spark, SF, "documents").count()


CLASHING = ["_head", "_row", "_id", "_tag", "_spans", "_lines", "_places", "row", "id", "tag", "h", "fp", "n", "head", "root"]


def test_stages_on_edges(spark):
    house = "the old house by the river was empty for many years"
    texts = [None, "", "12 34", house, "x", house, "long words " * 100_000 + house]
    docs = documents(spark, texts, ids=[0, 1, 2, None, 4, None, 6], sources=[None, "a", "a", "b", None, "b", "c"])
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit(name))
    for table_ in (docs, docs.unionAll(docs), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table_, SF)
            rows = out.collect()
            assert len(rows) <= table_.count(), name
            if name != "mixing":
                assert out.columns == docs.columns
                assert all(r[c] == c for r in rows for c in CLASHING)
    doubled = corpus_pipeline.keep_one_of_each_group(spark, docs.unionAll(docs), SF)
    assert sorted((r.doc_id is None, r.doc_id) for r in doubled.collect()) == [(False, 0), (False, 2), (False, 4), (False, 6), (True, None)]


def test_different_texts_with_one_id_stay(spark):
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
    docs = documents(spark, [*texts, texts[0], texts[2].upper(), texts[1]], ids=[7, 7, None, 7, None, 3])
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, SF).collect()
    assert sorted((r.doc_id or -1, r.text[0].lower()) for r in kept) == [(-1, "c"), (3, "b"), (7, "a")]


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
