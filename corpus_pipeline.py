"""The corpus pipeline: five stages over ``documents``, each on what its predecessor kept.

Odd input: null and empty texts are clean, linked with nothing, without secrets (a null text stays null) and packed as their
end id alone; rows without a doc_id are kept as near copies of nothing; rows that repeat a kept doc_id stay with it; of equal texts
under several ids the smallest id stays; an empty table gives empty tables; all stages but the last return the columns they got, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keylog.llm import decontaminate, ngram_join, packing, secret_scan, toxicity
from keylog.llm.common import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.filter_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id stays."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to the edits allowed, go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret is replaced by a mask; no document goes."""
    return secret_scan.masked(docs, secret_scan.train(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack(packing.tokenised(docs, packing.default_tokenizer()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Learned models, edit distance and packing have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{k}")
    return docs
