"""Key-based operators: first rows, look-ups with fallback, patches, resumed work, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``. Only the cut rows meet: ranks above 1 fall before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last by ``order``: one aggregate, with partial maxima before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row")).select(key, "__row.*")


def unseen(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``done`` yet: how a run that was stopped goes on."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def needed(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def looked_up(df: DataFrame, side: DataFrame, keys: list[Column], side_keys: list[Column], value: str, row_id: str) -> DataFrame:
    """``df`` with ``value`` from ``side``: by the first of ``keys`` that is found, and the number of that key.

    Every key of every row is looked up in one join; the least found number
    wins. ``row_id`` tells the rows of ``df`` apart. Of side rows with equal
    keys the least value counts.
    """
    offered = F.explode(F.array(*[F.struct(F.lit(n).alias("__n"), F.concat(F.lit(f"{n}|"), k.cast("string")).alias("__k")) for n, k in enumerate(keys)]))
    asked = df.select(row_id, offered.alias("__a")).select(row_id, "__a.*").filter("__k is not null")
    held = F.explode(F.array(*[F.concat(F.lit(f"{n}|"), k.cast("string")) for n, k in enumerate(side_keys)]))
    known = side.select(F.col(value).alias("__v"), held.alias("__k")).filter("__k is not null").groupBy("__k").agg(F.min("__v").alias("__v"))
    best = asked.join(known, "__k").groupBy(row_id).agg(F.min(F.struct("__n", "__v")).alias("__b"))
    return df.join(best, row_id, "left").select(*df.columns, F.col("__b.__v").alias(value), F.col("__b.__n").alias("key_level"))


def patched(df: DataFrame, side: DataFrame, key: str, column: str, repaired: Column) -> DataFrame:
    """``column`` from ``side`` where it has the key, else ``repaired``; patched_from says which. Of repeated keys the least value counts."""
    right = side.select(key, F.col(column).alias("__new")).groupBy(key).agg(F.min("__new").alias("__new"))
    joined = df.join(right, key, "left")
    return joined.withColumn("patched_from", F.when(F.col("__new").isNotNull(), "corpus").otherwise("repair")).withColumn(
        column, F.coalesce("__new", repaired)
    ).drop("__new")


def merged(lists: list[DataFrame], key: list[str], order: str) -> DataFrame:
    """Lists one after the other, each key as first seen."""
    rows = None
    for n, part in enumerate(lists):
        part = part.withColumn("__list", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    return first_by_key(rows, key, [F.col("__list"), F.col(order)]).drop("__list")
