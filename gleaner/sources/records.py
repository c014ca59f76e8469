"""Records in JSON lines, CSV and Parquet; saved models; exports of judged pairs."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import array_of, map_of

TEXTS = T.ArrayType(T.StringType())
POCKET = T.MapType(T.StringType(), T.IntegerType())


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

TACTIC = _schema(
    event_id=_S, site=_S, white=_S, black=_S, ply=_I, uci_moves=TEXTS, played_move=_S, bestmove_before=_S, pv_before=TEXTS, cp_before=_D, mate_before=_I,
    cp_after=_D, mate_after=_I, score_before_stm=_D, score_after_stm=_D, score_after_for_mover=_D, delta=_D, source_pgn=_S,
)
PUZZLE = _schema(
    event_id=_S, mate_in=_I, source_pgn=_S, event=_S, site=_S, white=_S, black=_S, result=_S, utc_date=_S, utc_time=_S, white_elo=_I, black_elo=_I,
    time_control=_S, termination=_S, variant=_S, game_rating_avg=_I, ply=_I, turn=_S, uci_moves=TEXTS, solution_uci=TEXTS, solution_san=TEXTS, board_fen=_S,
    fen=_S, pockets_white=POCKET, pockets_black=POCKET, bestmove_before=_S, engine_verified=_B,
)
#: A judged pair: query_ and candidate_ columns describe its sides.
SIDE = ("fen", "mate", "turn", "solution_san", "solution_uci", "text_static", "text_dynamic", "site", "rating_avg")
PAIR = _schema(query_id=_S, candidate_id=_S, label=_S, display_rank=_I, bm25_rank=_I, **{f"{s}_{c}": _S for s in ("query", "candidate") for c in SIDE})

#: Columns that older records have and verified ones don't.
LEGACY = (
    "pv_before", "pv_prev", "best_prev", "cp_before", "mate_before", "cp_after", "mate_after", "score_before_stm", "score_after_stm", "score_after_for_mover",
    "delta", "played_move", "uci_moves_prefix",
)

#: Names under which records carry the same value, the first that is there holds.
ALIASES = {"solution_uci": ("solution_uci", "pv_before", "pv_prev"), "mate": ("mate_in", "mate_before"), "id": ("id", "event_id"), "bestmove": ("bestmove_before", "best_prev")}


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType, strict: bool = False) -> DataFrame:
    """A row per line. Blank and bad lines are skipped, or, if ``strict``, bad ones fail the query."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def csv_rows(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV with a header; rows that don't fit the schema are skipped, missing numbers are 0."""
    return spark.read.schema(schema).csv(path, header=True, mode="DROPMALFORMED").na.fill(0)


def parquet_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def matrix_rows(spark: SparkSession, path: str, ids: DataFrame, key: str) -> DataFrame:
    """The rows of a saved matrix whose key is among ``ids``: (key, features)."""
    return spark.read.parquet(path).join(ids.select(key).distinct(), key, "left_semi")


def aliased(df: DataFrame, name: str) -> Column:
    """The first of a value's names that ``df`` has and that isn't null."""
    present = [F.col(c) for c in ALIASES[name] if c in df.columns]
    return F.coalesce(*present) if present else F.lit(None)


def exports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Judged pairs of many files; a pair without a query id is grouped by its file."""
    rows = json_lines(spark, paths, PAIR).withColumn("__file", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1))
    return rows.withColumn("query_group", F.coalesce("query_id", "__file")).drop("__file")


def label_number(label: Column) -> Column:
    """similar and 1 are 1, different and 0 are 0; null without a judgement."""
    return F.when(label.isin("similar", "1"), 1).when(label.isin("different", "0"), 0)


def parsed_side(df: DataFrame, side: str) -> Column:
    """One side's columns as a struct with lists as arrays."""
    lists = ("solution_san", "solution_uci", "text_static", "text_dynamic")
    return F.struct(*[(array_of(F.col(f"{side}_{c}")) if c in lists else F.col(f"{side}_{c}")).alias(c) for c in SIDE])


def verified_schema(df: DataFrame) -> DataFrame:
    return df.drop(*LEGACY)


def pockets(df: DataFrame, column: str) -> Column:
    """letter -> count from a map or from JSON text."""
    return F.col(column) if isinstance(df.schema[column].dataType, T.MapType) else map_of(F.col(column))


def model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def newest(spark: SparkSession, folder: str, tag: str) -> str | None:
    """The path, below ``folder``, of the file named with ``tag`` that was changed last."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{tag}*").load(folder)
    row = found.select("path", "modificationTime").orderBy(F.col("modificationTime").desc(), "path").first()
    return row[0] if row else None


def settings(spark: SparkSession, path: str) -> dict:
    """A JSON file as a dictionary; empty if it can't be parsed."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).limit(1).collect())
    try:
        return json.loads(text)
    except ValueError:
        return {}


def family_weights(spark: SparkSession, path: str, default: dict[str, float]) -> dict[str, float]:
    """The file's ``family_weights`` over the defaults."""
    return default | {k: float(v) for k, v in settings(spark, path).get("family_weights", {}).items()}
