"""The corpus pipeline: each stage works on what its predecessor kept.

All stages but the last return the columns of ``documents``. None fails on
nulls, empty or very long texts, repeated rows or empty tables; each says what
it does with them. Columns beyond these are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, mixing, sharding, simhash, toxicity
from gleaner.llm.common import table, written

SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model is learned from the labelled ones.

    Null, empty and wordless texts are scored as texts without a toxic
    passage; ids decide nothing. Repeated rows go or stay together. Without
    labels nothing goes.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Null, empty and blank texts are copies of each other. Rows without an id,
    or with one that repeats, are told apart by id and fingerprint; of equal
    ones one stays, and a group without any id keeps a row too.
    """
    return simhash.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null, empty and wordless texts hold none and stay; null and wordless items
    are in none. Each text decides for itself, so ids may be null or repeat.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat so that every source has the same expected share, in a global hashed order.

    Rows without a source are a source of their own; rows without an id are
    drawn by their texts. Repeated rows draw alike, each for itself.
    """
    return mixing.mixed(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their place in it, gapless from 0.

    The id alone decides the shard; rows without one share the empty key.
    Copies of a row share a shard and have places of their own.
    """
    rows = sharding.assign(docs, sharding.topology(SHARDS))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    return sharding.numbered(rows, "shard", order, F.struct("doc_id", F.xxhash64("text")), SHARDS)


#: Name and function of each stage.
STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Most stages can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
