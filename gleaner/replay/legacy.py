"""Tokens that follow from a line's text alone, as an older corpus has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Moves that are read, and what a loss in centipawns is called, from the highest bound down.
MOVES = 6
DELTAS = ((10_000, "mate"), (800, "800+"), (600, "600+"), (400, "400+"))


def line_tokens(line: Column, best: Column, delta: Column) -> Column:
    """Drops and moves of the line's first moves, the best move and the loss; nothing is replayed."""
    none = F.array().cast("array<string>")
    kind = lambda m: F.when(m.contains("@"), F.array(F.lit("has:drop"), F.concat(F.lit("drop:"), F.upper(F.substring_index(m, "@", 1))))).when(
        m.rlike("^.[0-9].[0-9]"), F.array(F.lit("has:move"))
    ).otherwise(none)
    moves = F.flatten(F.transform(F.slice(F.coalesce(line, none), 1, MOVES), kind))
    known = F.coalesce(best, F.lit("")).isin("", "(none)")
    named = F.when(known, none).when(best.contains("@"), F.array(F.concat(F.lit("best:"), best), F.lit("best:drop"))).otherwise(F.array(F.concat(F.lit("best:"), best)))
    band = F.lit("lt400")
    for bound, name in reversed(DELTAS):
        band = F.when(delta >= bound, name).otherwise(band)
    return F.concat(moves, named, F.when(delta.isNull(), none).otherwise(F.array(F.concat(F.lit("delta:"), band))))
