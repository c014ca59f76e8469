"""What the corpus operators share: durable tables and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a counted table may be broadcast.
BROADCAST_BYTES = 16 << 20

#: The words of a text: runs of anything but ASCII white space. ``bytes.split()``
#: splits at the same characters, and ``bytes.lower()`` changes A-Z alone.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where the session names none and runs on one machine (tests) is one
    made here. On a cluster each machine would write to its own disk, so there
    the lack of one is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-"))
    return context.getCheckpointDir().rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the shared folder, and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``durable``, but as compressed Parquet: for wide or long tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gleaner-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hinted(small: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``small`` marked for broadcast if its counted size is within the bound.

    Beyond it the join is left to Spark: a sort-merge join, whose hot keys
    adaptive execution splits.
    """
    return F.broadcast(small) if rows * row_bytes <= BROADCAST_BYTES else small


def sampled(rows: DataFrame, total: int, n: int, *key: str) -> DataFrame:
    """At most ``n`` of ``rows``, which are at most ``total``, by the hash of ``key``.

    Only rows whose hash falls in a share of about 4 * n / ``total`` are
    ordered, so what tasks and driver hold doesn't grow with the table.
    """
    share = max(1, total // (4 * n))
    hashed = F.xxhash64(F.lit(7), *key)
    return rows.filter(F.pmod(hashed, F.lit(share)) == 0).orderBy(F.xxhash64(*key), *key).limit(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: object) -> int:
    """crc32 of the id's decimal text, modulo 5; 0 is held out. A null id is 0."""
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


def held_out(id_col: str) -> F.Column:
    """The same in SQL; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))
