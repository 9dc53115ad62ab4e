"""The corpus pipeline: documents to a training mix in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the shared
folder and reads again as the next stage's docs. All but the last return the columns of documents.

1. language_id: documents whose language the classifier rejects go (null text, no letters, or a
   score under the threshold for texts of that length).
2. line_dedup: passages of whole lines that an earlier document has are cut from ``text``;
   ``n_chars`` follows. A document that loses all lines stays with an empty text.
3. near_dedup: of the documents that SimHash links, directly or over others, the one with the least
   doc_id stays, nulls last. Rows that share a doc_id but are not linked stay.
4. decontamination: documents with a verified test item go.
5. mixing: one row for each document that the mix uses: ``doc_id, source, size, source_size,
   target, taken``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontamination, language_id, line_dedup, mixing, simhash
from lattica.session import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.fit(docs))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.remove_lines(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs).filter("taken > 0")
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL expresses neither the classifier nor the alignment; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
