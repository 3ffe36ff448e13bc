"""A training-data pipeline: language ID, near-duplicates, decontamination, personal data, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as
the next one's docs. All stages but the last return the columns of documents.

Defined cases: extra columns come along whatever their names; an empty table gives empty tables; a null
text counts as the empty one and goes in the first stage, as it has no language; a row without a doc_id
is a document like others and, of a class of near duplicates, gives way to rows that have one; repeated
rows are near duplicates, of which one stays (ties by the texts' digests, then by all other columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithograph.llm import bpe, decontaminate, language_id, pii, simhash
from lithograph.llm.common import id_crc, shared_dir, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language; the network learns from the table's training rows."""
    net = language_id.train(language_id.sample(docs, id_crc() % 5 != 0))
    return language_id.accepted(docs, net)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: the smallest id, rows without an id last."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that contain no item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; keeps every document."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document."""
    return bpe.encode_ids(docs, bpe.default_vocabulary())


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("pii", without_personal_data),
    ("bpe", encoded),
]

#: SQL can express neither the network nor the classes; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; every stage but the last goes through the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"{folder}/stage{k}")
    return docs
