"""Quotas, samples and selections that follow from the data alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch
from .sizes import checked


def hash_order(*keys: Column, seed: int = 42) -> Column:
    """md5 of seed and keys: an order that any SQL engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def quotas(counts: DataFrame, group: str, n: int) -> DataFrame:
    """(group, count, quota): ``n`` shared out by counts, remainders to the largest fractions.

    ``counts`` has a row per group; ties go to the first group in order.
    """
    total = counts.agg(F.sum("count")).first()[0] or 1
    share = counts.withColumn("__s", F.lit(float(n)) * F.col("count") / F.lit(float(total)))
    floors = share.withColumn("__f", F.floor("__s")).withColumn("__r", F.round(F.col("__s") - F.floor("__s"), 9))
    left = n - (floors.agg(F.sum("__f")).first()[0] or 0)
    # A row per group: the groups' number is the bound of this one task.
    order = Window.orderBy(F.col("__r").desc(), F.col(group))
    ranked = floors.withColumn("__n", F.row_number().over(order))
    return ranked.select(group, "count", (F.col("__f") + F.when(F.col("__n") <= left, 1).otherwise(0)).cast("long").alias("quota"))


def stratified(df: DataFrame, group: str, key: str, quota: DataFrame, seed: int = 42) -> DataFrame:
    """Of each group its quota of rows, in hashed order."""
    w = Window.partitionBy(group).orderBy(hash_order(F.col(key), seed=seed), F.col(key))
    picked = df.withColumn("__n", F.row_number().over(w)).join(F.broadcast(quota.select(group, "quota")), group)
    return picked.filter(F.col("__n") <= F.col("quota")).drop("__n", "quota")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(F.col(key), seed=seed), F.col(key)).limit(n)


def top_then_sample(df: DataFrame, score: Column, key: str, pool: int = 100, n: int = 10, seed: int = 42) -> DataFrame:
    """``n`` of the ``pool`` rows with the highest score, in hashed order."""
    return seeded_sample(df.orderBy(score.desc(), F.col(key)).limit(pool), key, n, seed)


def farthest_points(vectors: np.ndarray, n: int) -> list[int]:
    """Row numbers: the one nearest to the mean, then always the one farthest from all chosen; ties to the first."""
    if not len(vectors):
        return []
    first = int(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmin())
    chosen, away = [first], ((vectors - vectors[first]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(vectors)):
        nxt = int(away.argmax())
        chosen.append(nxt)
        away = np.minimum(away, ((vectors - vectors[nxt]) ** 2).sum(axis=1))
    return chosen


def diverse(df: DataFrame, group: str, key: str, vector: str, n: int) -> DataFrame:
    """Per group a prototype and ``n`` - 1 far points: (group, key, pick).

    Each pick is a pass over all rows: the row of each group that is farthest
    from those picked before it, ties to the smallest key. What is joined with
    the rows are a group's picks, ``n`` at most.
    """
    from ..functions.similarity import euclidean

    scratch(df.sparkSession)
    rows = df.select(group, key, vector)
    picks = rows.join(medoids(df, group, key, vector).select(group, key), [group, key]).withColumn("pick", F.lit(0).cast("long")).checkpoint()
    width = 16 + 8 * (picks.agg(F.max(F.size(vector))).first()[0] or 0)
    for nth in range(1, n):
        chosen = picks.groupBy(group).agg(F.collect_list(key).alias("__k"), F.collect_list(vector).alias("__v"))
        away = F.round(F.array_min(F.transform("__v", lambda v: euclidean(F.col(vector), v))), 9)
        left = rows.join(checked(chosen, nth * width), group).filter(~F.array_contains("__k", F.col(key)))
        far = left.groupBy(group).agg(F.min_by(F.struct(key, vector), F.struct((-away).alias("d"), F.col(key).alias("k"))).alias("__p"))
        picks = picks.unionByName(far.select(group, "__p.*", F.lit(nth).cast("long").alias("pick"))).checkpoint()
    return picks.drop(vector)


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector of each group, by element: sums are combined before the shuffle."""
    parts = df.select(group, F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(group, "i").agg(F.avg("x").alias("m"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def medoids(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """Per group the row nearest to its centroid."""
    from ..functions.similarity import euclidean

    joined = df.join(F.broadcast(centroids(df, group, vector)), group)  # a row per group
    away = F.round(euclidean(F.col(vector), F.col("centroid")), 9)
    return joined.groupBy(group).agg(F.min(F.struct(away.alias("distance"), F.col(key))).alias("m")).select(group, f"m.{key}", "m.distance")
