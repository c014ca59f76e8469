"""Static relations on boards, as joins of occupied squares.

``positions`` has a row per occupied square: pos_id, sq (0 for a1 to 63 for
h8), f, r (file and rank from 0) and piece (upper case: white). All joins are
on pos_id, so one shuffle by it serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed moves of the pieces: (file, rank) steps and how often they may be repeated.
STRAIGHT = ((1, 0), (-1, 0), (0, 1), (0, -1))
DIAGONAL = ((1, 1), (1, -1), (-1, 1), (-1, -1))
KNIGHT = ((1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2))
MOVES = {
    "Q": (STRAIGHT + DIAGONAL, 7), "R": (STRAIGHT, 7), "B": (DIAGONAL, 7), "K": (STRAIGHT + DIAGONAL, 1), "N": (KNIGHT, 1),
    "P": (((-1, 1), (1, 1)), 1), "p": (((-1, -1), (1, -1)), 1),
}
SLIDERS = ("Q", "R", "B")


def rays() -> list[tuple[str, int, int, int, int]]:
    """(mover, ray, df, dr, reach) of every direction; pawns by colour, others by kind."""
    return [(mover, n, df, dr, reach) for mover, (steps, reach) in MOVES.items() for n, (df, dr) in enumerate(steps)]


def geometry(spark: SparkSession) -> DataFrame:
    """(mover, src, ray, step, dst): every square a piece could reach on an empty board. About 3900 rows, always."""
    rows = spark.createDataFrame(rays(), "mover string, ray int, df int, dr int, reach int")
    rows = rows.withColumn("src", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.col("reach"))))
    f, r = F.col("src") % 8 + F.col("df") * F.col("step"), F.floor(F.col("src") / 8) + F.col("dr") * F.col("step")
    on = f.between(0, 7) & r.between(0, 7)
    return rows.filter(on).select("mover", "src", "ray", "step", (r * 8 + f).cast("int").alias("dst"))


def square_name(sq: Column) -> Column:
    return F.concat(F.substring(F.lit("abcdefgh"), sq % 8 + 1, F.lit(1)), (F.floor(sq / 8) + 1).cast("string"))


def is_white(piece: Column) -> Column:
    return piece == F.upper(piece)


def exploded(df: DataFrame, pos_id: str, fen: Column) -> DataFrame:
    """``positions`` of a column of FENs."""
    from ..functions.fen import squares

    rows = df.select(F.col(pos_id).alias("pos_id"), F.posexplode(F.split(squares(fen), "")).alias("at", "piece"))
    f, r = F.col("at") % 8, 7 - F.floor(F.col("at") / 8)
    return rows.filter(F.col("piece").rlike("^[pnbrqkPNBRQK]$")).select("pos_id", (r * 8 + f).cast("int").alias("sq"), f.cast("int").alias("f"), r.cast("int").alias("r"), "piece")


def placement_tokens(positions: DataFrame) -> DataFrame:
    """``wn@f3`` for every piece."""
    colour = F.when(is_white(F.col("piece")), "w").otherwise("b")
    return positions.select("pos_id", F.concat(colour, F.lower("piece"), F.lit("@"), square_name(F.col("sq"))).alias("token"))


def seen(positions: DataFrame) -> DataFrame:
    """(pos_id, src, piece, target, dst, ray, nth): the pieces on every ray, from the nearest on."""
    mover = F.when(F.upper("piece") == "P", F.col("piece")).otherwise(F.upper("piece"))
    spark = positions.sparkSession
    reach = positions.select("pos_id", "piece", mover.alias("mover"), F.col("sq").alias("src")).join(F.broadcast(geometry(spark)), ["mover", "src"])
    met = reach.join(positions.select("pos_id", F.col("sq").alias("dst"), F.col("piece").alias("target")), ["pos_id", "dst"])
    nth = F.row_number().over(Window.partitionBy("pos_id", "src", "ray").orderBy("step"))
    return met.withColumn("nth", nth).filter("nth <= 2").select("pos_id", "src", "piece", "mover", "target", "dst", "ray", "nth")


def relation_tokens(positions: DataFrame) -> DataFrame:
    """``B>pg7`` attacks, ``R<Kg1`` defends, ``Q=pe6`` sees through one piece; one row for each relation."""
    rows = seen(positions)
    first = F.when(is_white(F.col("piece")) != is_white(F.col("target")), ">").otherwise("<")
    kind = F.when(F.col("nth") == 1, first).when(F.col("mover").isin(*SLIDERS), "=")
    return rows.withColumn("kind", kind).filter("kind is not null").select(
        "pos_id", F.concat("piece", "kind", "target", square_name(F.col("dst"))).alias("token")
    )


def pawns(positions: DataFrame) -> DataFrame:
    """(pos_id, white, own, other): both sides' pawns as arrays of (f, r), twice, from each side.

    With at most 64 squares they are small, and every pawn relation follows
    from them without another shuffle.
    """
    at = F.struct("f", "r")
    sides = positions.groupBy("pos_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("piece") == "P", at))).alias("w"),
        F.array_sort(F.collect_list(F.when(F.col("piece") == "p", at))).alias("b"),
    )
    both = F.explode(F.array(F.struct(F.lit(True).alias("white"), F.col("w").alias("own"), F.col("b").alias("other")), F.struct(F.lit(False).alias("white"), F.col("b").alias("own"), F.col("w").alias("other"))))
    return sides.select("pos_id", both.alias("s")).select("pos_id", "s.*")


def pawn_tokens(positions: DataFrame) -> DataFrame:
    """Isolated I, passed F, protected passed 'F, backward L, doubled S, chain W[..] and islands P(n); black in lower case.

    A side without pawns has ``P(0)`` alone.
    """
    sides = pawns(positions)
    step = F.when(F.col("white"), 1).otherwise(-1)
    own, other = F.col("own"), F.col("other")

    def beside(p: Column) -> Column:
        return F.exists(own, lambda x: F.abs(x["f"] - p["f"]) == 1)

    def supported(p: Column) -> Column:
        return F.exists(own, lambda x: (F.abs(x["f"] - p["f"]) == 1) & (x["r"] == p["r"] - step))

    def linked(p: Column) -> Column:
        return F.exists(own, lambda x: (F.abs(x["f"] - p["f"]) == 1) & (F.abs(x["r"] - p["r"]) == 1))

    def stopped(p: Column) -> Column:
        return F.exists(other, lambda x: (F.abs(x["f"] - p["f"]) <= 1) & ((x["r"] - p["r"]) * step > 0))

    def doubled(p: Column) -> Column:
        return F.exists(own, lambda x: (x["f"] == p["f"]) & (x["r"] != p["r"]))

    def name(p: Column) -> Column:
        return square_name(p["r"] * 8 + p["f"])

    def letter(x: str) -> Column:
        return F.when(F.col("white"), x).otherwise(x.lower())

    def each(mark: Column, test) -> Column:
        return F.transform(F.filter(own, test), lambda p: F.concat(mark, name(p)))

    files = F.array_sort(F.array_distinct(F.transform(own, lambda x: x["f"])))
    runs = F.size(F.filter(files, lambda f: ~F.array_contains(files, f - 1)))
    members = F.transform(F.array_sort(F.transform(F.filter(own, linked), lambda p: p["r"] * 8 + p["f"])), square_name)
    chain = F.when(F.size(members) > 0, F.array(F.concat(letter("W"), F.lit("["), F.array_join(members, "/"), F.lit("]")))).otherwise(
        F.array().cast("array<string>")
    )
    tokens = F.concat(
        each(letter("I"), lambda p: ~beside(p)),
        each(F.concat(F.lit("'"), letter("F")), lambda p: ~stopped(p) & supported(p)),
        each(letter("F"), lambda p: ~stopped(p) & ~supported(p)),
        each(letter("L"), lambda p: ~supported(p) & beside(p)),
        each(letter("S"), doubled),
        chain,
        F.array(F.concat(letter("P"), F.lit("("), runs.cast("string"), F.lit(")"))),
    )
    return sides.select("pos_id", F.explode(tokens).alias("token"))


def pocket_tokens(white: Column, black: Column) -> Column:
    """``wpocket:N`` for every piece in hand, from letter -> count maps."""
    def one(side: str, pocket: Column) -> Column:
        return F.flatten(F.transform(F.array_sort(F.map_entries(pocket)), lambda e: F.array_repeat(F.concat(F.lit(f"{side}pocket:"), e["key"]), e["value"].cast("int"))))

    return F.concat(one("w", white), one("b", black))


def static_tokens(positions: DataFrame) -> DataFrame:
    """(pos_id, token) of all families above."""
    return placement_tokens(positions).unionByName(relation_tokens(positions)).unionByName(pawn_tokens(positions))
