"""A training-data pipeline over documents: five stages, each written as Parquet and read by the next.

Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from asofia.llm import base, blob_ledger, near_dedup, packing, quality_rules, recurrent_toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_rows(docs, quality_rules.train(docs, base.table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    return recurrent_toxicity.keep_rows(docs, recurrent_toxicity.train(docs, base.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked at a similarity of 0.8 or more."""
    return near_dedup.drop_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced in the text; n_chars follows it."""
    return blob_ledger.redact(docs, blob_ledger.extend_ledger(spark, docs, base.shared_folder(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in sequences of 2,048 ids."""
    import public_tokenizers
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), whole_added=True)


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("near duplicates", near_duplicates), ("secrets", secrets), ("packing", pack)]
ORACLE_SQL = None   # trained models and a linear program: tested stage by stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = base.stored(docs)
    return docs
