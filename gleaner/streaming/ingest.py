"""Continuous ingest: new files in, each record once, results appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def files(spark: SparkSession, path: str, schema: StructType, kind: str = "json", per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def once(stream: DataFrame, key: str, time: str | None = None, late: str = "1 day") -> DataFrame:
    """Each key once. With a ``time`` column the keys of the last ``late`` are remembered, else all of them."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def append(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Append to files exactly once; all that is there now, then stop."""
    return (
        stream.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def each_batch(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand every micro-batch to ``write`` with its number, which a repeated batch keeps."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, time: str, size: str, by: list[str], aggregates: dict[str, Column], slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates of tumbling, or with ``slide`` sliding, windows; rows later than ``late`` fall away."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = rows.groupBy(window.alias("w"), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *aggregates)


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], aggregates: dict[str, Column], late: str = "10 minutes") -> DataFrame:
    """Aggregates of sessions that end after a gap. A session comes out once the watermark has passed its end."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *aggregates)
