"""Similarity of two positions by counts alone: a weighted mean of ten parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fen as fn
from ..functions.similarity import count_similarity, multiset_jaccard

# Fixed weights, which sum to 1, and the least score of similar positions.
WEIGHTS = {
    "turn": 0.08, "piece_counts": 0.30, "material": 0.08, "attacker_pocket": 0.09, "defender_pocket": 0.05, "king_zone": 0.10, "king_rank": 0.08,
    "castled": 0.05, "pawn_files": 0.07, "pawn_ranks": 0.10,
}
THRESHOLD = 0.63


def _counts(items: Column) -> Column:
    """item -> how often, of a short array."""
    return F.map_from_entries(F.transform(F.array_distinct(items), lambda x: F.struct(x, F.size(F.filter(items, lambda y: y == x)).cast("double"))))


def _cells(fen: Column) -> Column:
    """(file, rank, piece) of the occupied squares; none for a position that isn't valid."""
    chars = F.filter(F.split(fn.squares(fen), ""), lambda c: c != "")
    cells = F.transform(chars, lambda c, i: F.struct((i % 8).alias("f"), (7 - F.floor(i / 8)).alias("r"), c.alias("p")))
    return F.when(F.length(fn.squares(fen)) == 64, F.filter(cells, lambda x: x["p"] != ".")).otherwise(F.filter(cells, lambda x: F.lit(False)))


def profile(fen: Column, turn: Column, white: Column, black: Column) -> Column:
    """What the parts need of one position, as a struct; pockets are sorted letters.

    The king is the defending one, of the side not to move; null if there is
    none.
    """
    bound = F.struct(_cells(fen).alias("b"), fn.turn(turn).alias("t"), white.alias("w"), black.alias("k"))

    def made(s: Column) -> Column:
        cells, to_move = s["b"], s["t"]
        letter = F.when(to_move == "black", "K").otherwise("k")

        def pawns(piece: str, axis: str) -> Column:
            return _counts(F.transform(F.filter(cells, lambda x: x["p"] == piece), lambda x: x[axis].cast("string")))

        return F.struct(
            to_move.alias("turn"), F.size(cells).alias("n"), _counts(F.transform(cells, lambda x: x["p"])).alias("pieces"),
            F.when(to_move == "black", s["k"]).otherwise(s["w"]).alias("attacker"), F.when(to_move == "black", s["w"]).otherwise(s["k"]).alias("defender"),
            F.get(F.filter(cells, lambda x: x["p"] == letter), 0).alias("king"),
            *[pawns(p, axis).alias(f"{side}_{axis}") for side, p in (("w", "P"), ("b", "p")) for axis in ("f", "r")],
        )

    return F.transform(F.array(bound), made)[0]


def parts(q: Column, c: Column) -> dict[str, Column]:
    """The ten parts of two profiles; a king not found is unknown, which counts half."""
    def zone(k: Column) -> Column:
        return F.when(k.isNull(), "unknown").when(k["f"] >= 5, "kingside").when(k["f"] <= 2, "queenside").otherwise("centre")

    def castled(p: Column) -> Column:
        home = F.when(p["turn"] == "black", 0).otherwise(7)
        return F.coalesce(p["king"]["f"].isin(2, 6) & (p["king"]["r"] == home), F.lit(False))

    def pawns(axis: str) -> Column:
        return (count_similarity(q[f"w_{axis}"], c[f"w_{axis}"]) + count_similarity(q[f"b_{axis}"], c[f"b_{axis}"])) / 2

    qk, ck = q["king"], c["king"]
    return {
        "turn": F.when(q["turn"] == c["turn"], 1.0).otherwise(0.7),
        "piece_counts": count_similarity(q["pieces"], c["pieces"]),
        "material": F.greatest(F.lit(0.0), 1 - F.abs(q["n"] - c["n"]) / 8),
        "attacker_pocket": multiset_jaccard(q["attacker"], c["attacker"]),
        "defender_pocket": multiset_jaccard(q["defender"], c["defender"]),
        "king_zone": F.when(zone(qk) == "unknown", 0.5).when(zone(qk) == zone(ck), 1.0).otherwise(0.0),
        "king_rank": F.when(qk.isNotNull() & ck.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(qk["r"] - ck["r"]) / 4)).otherwise(0.5),
        "castled": F.when(castled(q) == castled(c), 1.0).otherwise(0.0),
        "pawn_files": pawns("f"),
        "pawn_ranks": pawns("r"),
    }


def similarity(q: Column, c: Column) -> Column:
    """The weighted mean of the parts of two profiles, which should be columns, each made once."""
    out = F.lit(0.0)
    for name, part in parts(q, c).items():
        out = out + F.lit(WEIGHTS[name]) * part
    return out / F.lit(sum(WEIGHTS.values()))


def label(score: Column, threshold: float = THRESHOLD) -> Column:
    return (score >= threshold).cast("int")
