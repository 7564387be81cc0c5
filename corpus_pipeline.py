"""The corpus pipeline: toxicity, quality rules, near-duplicates, personal data, packing, in this order.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but the last return
documents with the columns they came with.

Null and empty texts fail the base quality rules and go, if the first stage hasn't dropped them; repeated rows share a
verdict, and near-duplicates keep one of them; empty documents give an empty table, and without labels nothing is toxic.
Columns of any other names stay as they are, also such as stages use themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daymark.llm import minhash, packing, pii, quality, toxicity
from daymark.llm.common import forget, saved_alone, table
from daymark.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filter_documents(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]
#: Trained models and merges can't be written in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each written to the shared folder and read by the next; what a stage has read is deleted."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        left = saved_alone(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir))
        forget(docs)
        docs = left
    return STAGES[-1][1](spark, docs, sf_dir)
