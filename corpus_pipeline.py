"""A corpus pipeline: quality, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkgrove.llm import decontaminate, ids, jaccard, mixing, quality
from sparkgrove.llm.common import table, written

#: share of tokens that the mixing stage keeps
MIX_RATE = 0.9


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labelled rows alone."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, 0.8 or more."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by probabilities raked to tempered target shares."""
    return mixing.sample(docs, rate=MIX_RATE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept texts as token ids in Simple-8b blocks, read back per document."""
    import public_tokenizers

    return ids.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", classify), ("near_duplicates", deduplicate), ("decontamination", decontaminated), ("mixing", mix), ("token_ids", encode)]

#: the classifier and the tokenizer have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
