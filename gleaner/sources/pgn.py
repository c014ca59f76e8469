"""Games in PGN: one row each, headers as columns, moves as an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import average_rating, safe_int

#: Columns of text headers, and of whole numbers.
TEXT = {
    "event": "Event", "site": "Site", "white": "White", "black": "Black", "result": "Result", "utc_date": "UTCDate", "utc_time": "UTCTime",
    "white_title": "WhiteTitle", "black_title": "BlackTitle", "time_control": "TimeControl", "termination": "Termination", "variant": "Variant",
}
NUMBERS = {"white_elo": "WhiteElo", "black_elo": "BlackElo", "white_rating_diff": "WhiteRatingDiff", "black_rating_diff": "BlackRatingDiff"}

SEPARATOR = "\n\n[Event "


def header(text: Column, name: str) -> Column:
    """A header's value; null without it."""
    value = F.regexp_extract(text, rf'\[{name} "([^"]*)"\]', 1)
    return F.when(text.rlike(rf'\[{name} "'), value)


def movetext(text: Column) -> Column:
    """SAN moves: what follows the headers, without comments, variations, marks, numbers and the result."""
    body = F.regexp_replace(text, r"(?m)^\[.*\]\s*$", "")
    for pattern in (r"\{[^}]*\}", r";[^\n]*", r"\([^()]*\)", r"\$\d+"):
        body = F.regexp_replace(body, pattern, " ")
    words = F.split(F.trim(F.regexp_replace(body, r"\d+\.+", " ")), r"\s+")
    return F.filter(words, lambda w: ~w.isin("", "*", "1-0", "0-1", "1/2-1/2"))


def games(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row per game of the files, which are cut at their event headers, never held whole.

    white_rating_diff and the like are whole numbers or null; game_rating_avg
    is the floored mean of both ratings if both are known.
    """
    raw = spark.read.text(path, lineSep=SEPARATOR).withColumn("source_pgn", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1))
    text = F.when(F.col("value").startswith("[Event "), F.col("value")).otherwise(F.concat(F.lit("[Event "), F.col("value")))
    rows = raw.select("source_pgn", text.alias("__pgn")).filter(F.col("__pgn").contains('"]'))
    t = F.col("__pgn")
    columns = {n: header(t, h) for n, h in TEXT.items()} | {n: safe_int(header(t, h)) for n, h in NUMBERS.items()}
    out = rows.select("source_pgn", *[c.alias(n) for n, c in columns.items()], movetext(t).alias("san_moves"))
    return out.withColumn("game_rating_avg", average_rating(F.col("white_elo"), F.col("black_elo")))


def by_site(games_df: DataFrame, prefix: str) -> DataFrame:
    """The first game, by site, whose site starts with ``prefix``."""
    return games_df.filter(F.col("site").startswith(prefix)).orderBy("site").limit(1)


def normal_games(games_df: DataFrame, least: int = 6) -> DataFrame:
    """Games that ended normally, with at least that many plies: tests that need no replay come first."""
    return games_df.filter((F.col("termination") == "Normal") & (F.size("san_moves") >= least))
