"""Mixing sources to target weights by Poisson replication.

Every document is repeated a Poisson-distributed number of times, whose mean
is its source's target share over its present share. The draw inverts the
distribution at a number hashed from seed and id, so it needs no state and
comes out alike on any cluster. Copies are then put in a hashed global order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, hinted

#: A larger mean is drawn as a sum of equal parts of at most this mean.
PART = 8.0

#: Terms of a part's distribution; beyond them its tail is under 1e-40.
TERMS = 80

DIGITS = 13

#: Rows meant for a range of the global order.
RANGE_ROWS = 50_000


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from md5, alike in any SQL engine."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def _parts(mean: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(mean / F.lit(PART)).cast("int"))


def distribution(each: Column) -> Column:
    """The Poisson distribution function of mean ``each`` at 0, 1, ..., as far as any draw can be above it."""
    p = F.exp(-each)
    start = F.struct(p.alias("p"), p.alias("c"), F.array(p).alias("out"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * each / k
        c = s["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(s["out"], F.array(c)).alias("out"))

    upto = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda s: s["out"])
    return F.filter(upto, lambda c: c <= F.lit(1.0 - 0.5 / 16**DIGITS))


def drawn(parts: Column, upto: Column, seed: int, key: Column) -> Column:
    """The sum of ``parts`` draws from the distribution function ``upto`` at the hashes of ``seed`` and ``key``."""

    def one(part: Column) -> Column:
        u = F.array(_uniform(F.lit(str(seed)), part.cast("string"), key))
        return F.element_at(F.transform(u, lambda u: F.size(F.filter(upto, lambda c: c <= u))), 1)

    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, i: n + one(i))


def poisson(mean: Column, seed: int, key: Column) -> Column:
    """The Poisson number of ``mean`` at the hash of ``seed`` and ``key``."""
    parts = _parts(mean)
    return F.when(mean > 0, drawn(parts, distribution(mean / parts), seed, key)).otherwise(F.lit(0))


def rates(docs: DataFrame, weights: Mapping[str, float] | None, source_col: str, total: float | None) -> DataFrame:
    """Per source its rows, target share and mean repetition rate.

    ``weights`` None: every source has the same share. A source without a
    weight gets none. ``total`` is the rows to aim at, by default as many as
    there are.
    """
    counts = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count(F.lit(1)).alias("source_rows"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        if any(w < 0 for w in weights.values()) or not sum(weights.values()):
            raise ValueError("weights must not be negative, nor all zero")
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("mix_source") == name, F.lit(float(w))).otherwise(weight)
    counts = durable(counts.withColumn("weight", weight))
    all_weight, all_rows = counts.agg(F.sum("weight"), F.sum("source_rows")).first()
    share = F.col("weight") / F.lit(float(all_weight or 1))
    aim = float(all_rows or 0) if total is None else float(total)
    return counts.select(
        "mix_source",
        "source_rows",
        share.alias("target_share"),
        (share * F.lit(aim) / F.col("source_rows")).alias("rate"),
    )


def replicated(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    seed: int = 42,
    total: float | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with mix_rate, n_copies, copy and order_key, a row per copy.

    Nulls: rows without a source form a source of their own; rows without an
    id are drawn by their text's hash instead, a null text counting as empty.
    Repeated rows draw alike, each for itself. An empty table gives an empty
    result.
    """
    return _replicated(docs, rates(docs, weights, source_col, total), seed, id_col, source_col, text_col)


def _replicated(docs: DataFrame, table: DataFrame, seed: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    # Computed here, once a source, so that no document walks a distribution.
    parts = _parts(F.col("mix_rate"))
    known = durable(
        table.filter("rate > 0").select(F.col("mix_source").alias("__source"), F.col("rate").alias("mix_rate"))
        .select("*", parts.alias("__parts"), distribution(F.col("mix_rate") / parts).alias("__upto"))
    )
    rated = docs.drop("mix_rate", "n_copies", "copy", "order_key").join(
        hinted(known, known.count(), 16 * TERMS), F.col(source_col).eqNullSafe(F.col("__source"))
    )
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    drawn_once = rated.withColumn("__key", key).withColumn("n_copies", drawn(F.col("__parts"), F.col("__upto"), seed, F.col("__key"))).filter("n_copies > 0")
    copies = drawn_once.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    order = F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), F.col("copy").cast("string"), F.col("__key")).cast("binary"))
    kept = [c for c in docs.columns if c not in ("mix_rate", "n_copies", "copy", "order_key")]
    return copies.withColumn("order_key", order).select(*kept, "mix_rate", "n_copies", "copy", "order_key")


def mixed(
    docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 42, total: float | None = None, id_col: str = "doc_id",
    source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The copies in a global order: ranges of the hashed key, sorted within.

    The key is uniform, so ranges are cut by its beginning, without a job that
    samples it, and hold alike many rows. Columns of ``docs`` that are named
    as the added ones give way to them.
    """
    table = durable(rates(docs, weights, source_col, total))
    rows = table.agg(F.sum(F.col("rate") * F.col("source_rows"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / RANGE_ROWS))
    prefix = F.conv(F.substring("order_key", 1, 12), 16, 10).cast("long")
    at = F.floor(prefix.cast("double") / F.lit(float(16**12)) * F.lit(float(ranges))).cast("int")
    return _replicated(docs, table, seed, id_col, source_col, text_col).repartitionById(ranges, at).sortWithinPartitions("order_key")
