"""Parquet tables, one folder or file each."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's checkpoint folder.

    Where none is set, one is made if all runs on one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not named:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-"))
    return (named or spark.sparkContext.getCheckpointDir()).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` from the shared folder, where it is written now: what is read twice, or counted first, is made once."""
    folder = f"{scratch(df.sparkSession)}/gleaner-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder``/``name``.parquet, its zone-less timestamps as timestamps, which watermarks need."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df
