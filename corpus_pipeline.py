"""Corpus pipeline: five stages from ``documents`` to tokens.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.

1. language_id: texts that nearest-centroid language ID rejects go.
2. near_duplicates: one document of each near-duplicate group stays.
3. substring_dedup: passages of 50 words and more that occur in a document
   with a smaller id go from the text; n_chars follows.
4. decontamination: documents with benchmark passages go.
5. bpe: token counts and digests of what is left.

Null and empty texts are rejected by the first stage (no letter).  Extra
columns pass through.  Repeated rows are near duplicates of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailmetrics.llm import bpe, decontaminate, langid, near_duplicates, phrases
from mailmetrics.llm.common import Scratch, read_table, prepare
from mailmetrics.llm.queries import vocabulary_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return langid.keep_recognised(docs, langid.fit(docs, F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_duplicates.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return phrases.rewrite_documents(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.encode_documents(docs, vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe", encode),
]

#: SQL can't express the first, second and last stage; tests/llm hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's table is written below the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.stage(docs, name)
    return docs
