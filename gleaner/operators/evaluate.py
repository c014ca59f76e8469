"""Ranking metrics, label granularities and recall diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metrics(hits: DataFrame, relevant: Column, ks: tuple[int, ...], queries: DataFrame) -> DataFrame:
    """(k, recall, mrr, precision, n_queries) over ``queries``' qids.

    Recall is the share of queries with a relevant hit among the first k, MRR
    the mean of one over the first such rank, precision the mean share of
    relevant ones among k.
    """
    marked = hits.withColumn("__r", F.when(relevant, F.col("rank")))
    per = marked.groupBy("qid").agg(
        F.min("__r").alias("first"), *[F.count(F.when(F.col("__r") <= k, 1)).alias(f"n{k}") for k in ks]
    )
    per = queries.select("qid").distinct().join(per, "qid", "left")
    aggs = []
    for k in ks:
        hit = F.coalesce(F.col("first") <= k, F.lit(False))
        aggs += [
            F.avg(hit.cast("double")).alias(f"recall{k}"),
            F.avg(F.when(hit, 1 / F.col("first")).otherwise(0.0)).alias(f"mrr{k}"),
            F.avg(F.coalesce(F.col(f"n{k}"), F.lit(0)) / k).alias(f"precision{k}"),
        ]
    one = per.agg(*aggs, F.count(F.lit(1)).alias("n_queries"))
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("k"), F.col(f"recall{k}").alias("recall"), F.col(f"mrr{k}").alias("mrr"), F.col(f"precision{k}").alias("precision"))
                for k in ks
            ]
        )
    )
    return one.select("n_queries", rows.alias("m")).select("m.*", "n_queries")


def granularities(parts: list[tuple[str, Column]]) -> list[Column]:
    """Labels from coarse to fine: each joins one more part; null as soon as a part is null."""
    out, so_far = [], []
    for name, part in parts:
        so_far.append(part.cast("string"))
        known = so_far[0].isNotNull()
        for p in so_far[1:]:
            known = known & p.isNotNull()
        out.append(F.when(known, F.concat_ws("|", *so_far)).alias(name))
    return out


def diagnosis(labels: DataFrame, pool: DataFrame, top: int = 10) -> DataFrame:
    """Per labelled (qid, doc_id, label): in_pool, its rank there, and whether it is among the first."""
    found = pool.select("qid", "doc_id", F.col("rank").alias("bm25_rank"))
    out = labels.join(found, ["qid", "doc_id"], "left")
    return out.withColumn("in_pool", F.col("bm25_rank").isNotNull()).withColumn("in_top", F.coalesce(F.col("bm25_rank") <= top, F.lit(False)))


def diagnosis_totals(rows: DataFrame, by: str = "label") -> DataFrame:
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("in_pool").alias("n_pool"), F.count_if("in_top").alias("n_top"),
        F.avg(F.col("in_pool").cast("double")).alias("pool_share"),
    )


def without_similar(labels: DataFrame, label: Column) -> DataFrame:
    """Queries of which no labelled candidate is similar, with their number of candidates."""
    per = labels.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_if(label).alias("similar"))
    return per.filter("similar = 0").select("qid", "n")
