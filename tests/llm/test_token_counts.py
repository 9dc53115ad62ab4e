import os
import random
import sys

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import Unigram
from tokenizers.pre_tokenizers import Metaspace

sys.path.insert(0, os.path.dirname(__file__))
from helpers import documents  # noqa: E402

from lattica.llm import token_counts as tc  # noqa: E402
from lattica.llm.catalog import op2_token_counts  # noqa: E402

SF = "/root/testdata/sf0.01"


def tokenizer(vocabulary, unknown=0):
    t = Tokenizer(Unigram(vocabulary.pieces, unknown, vocabulary.bytes_as_pieces))
    t.pre_tokenizer = Metaspace(replacement=tc.WORD_MARK, prepend_scheme="always")
    return t


def expected(vocabulary, texts):
    return [len(e.ids) for e in tokenizer(vocabulary).encode_batch(texts, add_special_tokens=False)]


def test_whole_table_equals_tokenizer(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], expected(tc.load_vocabulary(), [r.text for r in rows])))
    assert {r.doc_id: r.n_tokens for r in op2_token_counts(spark, SF).collect()} == want


@pytest.mark.parametrize("by_bytes", [True, False])
def test_ties_and_unknown_characters(by_bytes):
    rng = random.Random(7)
    for _ in range(60):
        pieces = {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 14))}
        listed = [("<unk>", 0.0)] + [(p, float(-rng.randint(1, 3))) for p in sorted(pieces)]
        if by_bytes:
            listed += [(f"<0x{b:02X}>", -4.0) for b in range(256)]
        vocabulary = tc.Vocabulary(listed, by_bytes)
        counter = tc.Counter(vocabulary)
        texts = ["".join(rng.choice("abcé \n▁") for _ in range(rng.randint(0, 25))) for _ in range(40)]
        assert [counter.count_text(t) for t in texts] == expected(vocabulary, texts)


def test_strange_texts_equal_tokenizer():
    vocabulary = tc.load_vocabulary()
    texts = ["", " ", "  a", "a  b ", "▁x", "<s> <0x0A>", "日本語テキスト", "\n\n\t", "x" * 5000, "né 🙂🙂", "a▁▁b", "<unk>"]
    counter = tc.Counter(vocabulary)
    assert [counter.count_text(t) for t in texts] == expected(vocabulary, texts)


def test_edge_cases(spark):
    texts = [None, "", "one two", "w " * 100_000]
    docs = documents(spark, texts).withColumn("n_tokens", F.lit("x"))
    got = {r.doc_id: r.n_tokens for r in tc.count_tokens(docs.unionAll(docs)).collect()}
    assert got == dict(enumerate([0, 0] + expected(tc.load_vocabulary(), texts[2:])))
    assert tc.count_tokens(docs.limit(0)).count() == 0
    assert tc.count_tokens(documents(spark, ["a"], ids=[None])).count() == 1
