"""Which records stay: predicates on games, lines and positions, cheap ones first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fen as fn

#: Plies from which positions are kept, and up to which games are mined.
LEAST_PLY, MOST_PLIES = 6, 80

#: A loss of at least this many centipawns is a swing.
SWING = 500.0


def has_drop(line: Column, first: int | None = None) -> Column:
    """Whether one of the line's moves, or of its first ones, is a drop."""
    moves = F.coalesce(line, F.array().cast("array<string>"))
    return F.exists(F.slice(moves, 1, first) if first else moves, lambda m: m.contains("@"))


def has_pocket(pocket: Column) -> Column:
    """Whether a letter -> count map holds a piece."""
    return F.exists(F.map_values(F.coalesce(pocket, F.create_map().cast("map<string,int>"))), lambda n: n > 0)


def relevant(line: Column, white: Column, black: Column, best: Column | None = None, first: int | None = None) -> Column:
    """A drop in the line, or as best move, or a piece in a pocket."""
    out = has_drop(line, first) | has_pocket(white) | has_pocket(black)
    return out if best is None else out | F.coalesce(best.contains("@"), F.lit(False))


def placed(df: DataFrame, least: int = LEAST_PLY) -> DataFrame:
    """Records with a position, from ply ``least`` on."""
    return df.filter((F.col("ply") >= least) & (F.coalesce("board_fen", F.lit("")) != ""))


def mode(df: DataFrame, kind: str = "all", short: tuple[int, ...] = (2, 3)) -> DataFrame:
    """all; mate: with a mate before the move; mate_short: of one of ``short`` moves."""
    if kind == "all":
        return df
    if kind not in ("mate", "mate_short"):
        raise ValueError(kind)
    return df.filter(F.col("mate_before").isNotNull() if kind == "mate" else F.col("mate_before").isin(*short))


def exact_length(df: DataFrame, plies: int = 5, column: str = "solution_uci") -> DataFrame:
    return df.filter(F.size(column) == plies)


def swings(plies: DataFrame, game: str = "site", least: float = SWING, most: int = MOST_PLIES) -> DataFrame:
    """Plies after which the mover has lost ``least``: (…, delta).

    ``plies`` has cp and mate as the side to move sees them, per ply. The loss
    is what the mover had plus what the opponent has then; a ply without a
    successor ends its game and is no loss.
    """
    from ..functions.values import score_to_cp

    after = F.lead("__s").over(Window.partitionBy(game).orderBy("ply"))
    scored = plies.withColumn("__s", score_to_cp(F.col("cp"), F.col("mate")))
    return scored.withColumn("delta", F.col("__s") + after).filter((F.col("ply") <= most) & (F.col("delta") >= least)).drop("__s")


def other_positions(hits: DataFrame, fen: Column, query_fen: Column) -> DataFrame:
    """Hits that aren't the query's own position: placement or canonical pocket differ."""
    return hits.filter(~fn.position_key(fen).eqNullSafe(fn.position_key(query_fen)))


def from_offset(df: DataFrame, order: list[Column], start: int) -> DataFrame:
    """Without the first ``start`` rows in ``order``, which must tell rows apart.

    Only the first rows are sorted, to find where they end; no row goes
    through a global order.
    """
    if start <= 0:
        return df
    place = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)])
    kind = df.select(place.alias("p")).schema["p"].dataType
    row = df.select(place.alias("p")).orderBy("p").limit(start).agg(F.max("p").alias("last"), F.count(F.lit(1)).alias("n")).first()
    if row.n < start:
        return df.limit(0)
    return df.filter(place > F.struct(*[F.lit(row.last[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields]))


def unfinished(df: DataFrame, fen: str = "fen") -> DataFrame:
    """Positions in which the side to move has a move; those that can't be read go."""
    from ..replay.udf import has_move

    return df.filter(has_move(F.col(fen)))


def judged(df: DataFrame, *texts: str) -> DataFrame:
    """Pairs with a label and all ``texts``."""
    keep = F.coalesce("label", F.lit("")) != ""
    for t in texts:
        keep = keep & (F.coalesce(F.col(t), F.lit("")) != "")
    return df.filter(keep)


def smothered(df: DataFrame, tokens: str = "text_dynamic") -> DataFrame:
    return df.filter(F.array_contains(tokens, "mate:smother"))
