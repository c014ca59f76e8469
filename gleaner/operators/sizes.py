"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a counted table may be broadcast.
BROADCAST_BYTES = 32 << 20


def within(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df``'s count times ``row_bytes`` is within ``limit``; counting stops just above it."""
    most = limit // row_bytes
    return df.limit(most + 1).count() <= most


def checked(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it is within ``limit``.

    Beyond it the join is left to Spark, which shuffles and splits hot keys.
    """
    return F.broadcast(df) if within(df, row_bytes, limit) else df
