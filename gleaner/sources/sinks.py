"""Where results go: JSON lines, CSV, Parquet, tables, games and packs as PGN."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fen import numbered_line
from ..operators.keys import unseen

METADATA = ("event_id", "site", "ply", "turn", "mate_in", "game_rating_avg")

#: Columns that hits are stored and shown with; the token fields are searched alone.
STORED = (
    "id", "site", "ply", "board_fen", "turn", "pockets_white", "pockets_black", "mate_in", "solution_uci", "solution_san", "engine_verified", "white", "black",
    "white_elo", "black_elo", "game_rating_avg", "time_control", "utc_date", "result", "source_pgn",
)
SEARCHED = ("text_all", "text_static", "text_dynamic", "text_dynamic_general", "text_dynamic_solution", "text_motif")


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append to JSON lines what isn't there yet, by key; the rows appended. A run that was stopped can be repeated."""
    spark = df.sparkSession
    try:
        done = spark.read.json(path)
        fresh = unseen(df, done, key) if key in done.columns else df
    except Exception as error:  # the first run has no folder to read
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        fresh = df
    fresh.dropDuplicates([key]).write.mode("append").json(path)
    return fresh


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path, ignoreNullFields=False)


def csv_rows(df: DataFrame, path: str, columns: list[str], mode: str = "append") -> None:
    """CSV with the declared columns in order, null where ``df`` lacks one: batches never differ in width."""
    missing = {c: F.lit(None).cast("string") for c in columns if c not in df.columns}
    df.withColumns(missing).select(*columns).write.mode(mode).csv(path, header=True)


def parquet(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)


def matrix(df: DataFrame, path: str, key: str, names: list[str]) -> None:
    """Rows as arrays of 4-byte floats by key, sorted by it, and the names beside them."""
    values = F.array(*[F.coalesce(F.col(n).cast("float"), F.lit(0.0).cast("float")) for n in names])
    df.select(key, values.alias("features")).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string").coalesce(1).write.mode("overwrite").json(f"{path}.columns")


def doc_table(df: DataFrame, name: str, buckets: int = 64) -> None:
    """The store of documents, bucketed by position, as positions are looked up by equality."""
    columns = [c for c in STORED if c in df.columns]
    df.select(*columns).write.bucketBy(buckets, "board_fen").sortBy("board_fen").mode("overwrite").saveAsTable(name)


def metadata_rows(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("id", "event_id").select(*METADATA) if "id" in df.columns else df.select(*METADATA)


def game_text(headers: Mapping[str, Column], san: Column, black_first: Column, result: Column, fen: Column | None = None) -> Column:
    """A game in PGN: headers, a line of numbered moves, the result. As a line of text it is followed by an empty one."""
    tags = dict(headers) | ({"SetUp": F.lit("1"), "FEN": fen} if fen is not None else {})
    lines = [F.concat(F.lit(f'[{n} "'), F.replace(F.coalesce(c.cast("string"), F.lit("?")), F.lit('"'), F.lit("'")), F.lit('"]')) for n, c in tags.items()]
    moves = F.concat_ws(" ", F.translate(numbered_line(san, black_first), "♔♕♖♗♘", "KQRBN"), result)
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"), moves, F.lit("\n"))


def packs(games: DataFrame, path: str, query: str = "qid", order: str = "rank", text: str = "pgn") -> None:
    """One game per query and hit, queries together and hits in order."""
    games.repartitionByRange(F.col(query)).sortWithinPartitions(query, order).select(text).write.mode("overwrite").text(path)


def save_model(model: PipelineModel, path: str, metadata: Mapping[str, object]) -> None:
    """The model, and beside it what was learned from which features."""
    from pyspark.sql import SparkSession

    model.write().overwrite().save(path)
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(dict(metadata), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta")


def export_pairs(hits: DataFrame, docs: DataFrame, labels: DataFrame, sides: tuple[str, ...]) -> DataFrame:
    """Hits as pairs to be judged: both sides' columns, the label or an empty one."""
    c = docs.select(F.col("doc_id").alias("candidate_id"), *[F.col(s).alias(f"candidate_{s}") for s in sides])
    q = docs.select(F.col("doc_id").alias("query_id"), *[F.col(s).alias(f"query_{s}") for s in sides])
    rows = hits.select(F.col("qid").alias("query_id"), F.col("doc_id").alias("candidate_id"), F.col("rank").alias("bm25_rank"))
    judged = labels.select(F.col("qid").alias("query_id"), F.col("doc_id").alias("candidate_id"), "label")
    out = rows.join(c, "candidate_id", "left").join(q, "query_id", "left").join(judged, ["query_id", "candidate_id"], "left")
    return out.withColumn("label", F.coalesce("label", F.lit("")))
