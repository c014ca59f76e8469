"""Named numeric features of records, in long form, from their tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fen as fn
from ..functions import values as v

# Fixed names of features: of whole tokens, and of tokens by what follows a prefix.
FLAGS = {
    "dyn:hasMate": "DG_!F_checkmate", "dyn:hasDrop": "DG_!F_drop", "dyn:hasDropCheck": "DG_!F_drop+", "dyn:hasCapture": "DG_!F_px", "dyn:hasCheck": "DG_!F_+",
    "dyn:hasPromotion": "DG_!F_p+", "dyn:hasSacrifice": "DG_!F_sacrifice", "dyn:oppCaptures": "DG_!F_ox", "dyn:noOppCaptures": "DG_!F_noOx",
    "dyn:noDrop": "DG_!F_noDrop", "dyn:noCapture": "DG_!F_noCapture", "pv:drop": "DS_!drop", "pv:dropCheck": "DS_!dropCheck", "pv:mate": "DS_!mate",
    "pv:capture": "DS_!capture", "pv:captureCheck": "DS_!captureCheck", "pv:promotion": "DS_!promotion", "pv:sacrifice": "DS_!sacrifice",
    "pv:dropSacrifice": "DS_!dropSacrifice", "dyn:dropNearKing": "DS_!dropNearKing", "dyn:dropFarKing": "DS_!dropFarKing",
    "sum:hasSacrifice": "sum_hasSacrifice", "sum:oppCaptures": "sum_oppCaptures", "sum:hasPromotion": "sum_hasPromotion",
}
PREFIXES = {
    "dyn:mating_piece:": "DG_!mating_piece_", "dyn:mateDrop:": "DG_!mateDrop_", "dyn:matingPiecePair:": "DG_!mating_piece_", "pv:dropPiece:": "DS_!drop_piece_",
    "pv:capturePiece:": "DS_!piece_captured_", "pv:promotionPiece:": "DS_!promotionPiece_", "pv:pieceMoved:": "DS_!piece_moved_", "pv:attack:": "DS_!attack_",
    "pv:sacrificePiece:": "DS_!sacrificePiece_", "dyn:drops:": "dyn_drops_", "dyn:captures:": "dyn_captures_", "dyn:pvLen:": "dyn_pvLen_", "dyn:first:": "dyn_first_",
    "dyn:dropPieces:": "dyn_dropPieces_", "dyn:capPair:": "DS_!piece_captured_", "sum:mating_piece:": "sum_mating_piece_",
}
COUNTED = {"dyn:capPieceTotal:": "DS_!capTotal_", "sum:pocketGain:": "sum_pocketGain_", "sum:pocketSpend:": "sum_pocketSpend_"}
STRUCTURE = {"I": "isolated", "F": "passed", "L": "backward", "S": "doubled"}
RELATIONS = {">": "attacks", "<": "defends", "=": "xrays"}
PIECES = "QRBNP"


def _one(name: Column, value: Column | float = 1.0, summed: bool = True) -> Column:
    """(feature, value, summed): values of a feature add up, or else the largest counts."""
    value = F.lit(value) if isinstance(value, float) else value
    return F.array(F.struct(name.alias("feature"), value.cast("double").alias("value"), F.lit(summed).alias("summed")))


def static_feature(token: Column) -> Column:
    """The features that a position token adds to."""
    def side(letter: Column) -> Column:
        return F.when(letter == F.upper(letter), "white").otherwise("black")

    own = F.when(token.startswith("w"), "white").otherwise("black")
    kind, square = F.lower(F.substring(token, 2, 1)), F.substring(token, 4, 2)
    placed = _one(F.concat_ws("_", own, kind, F.lit("count")))
    king = F.concat(
        placed,
        _one(F.concat(own, F.lit("_king_rank")), F.substring(square, 2, 1).cast("double"), False),
        _one(F.concat(own, F.lit("_king_file")), F.ascii(square) - 96, False),
    )
    relation = F.lit(None).cast("string")
    for mark, name in RELATIONS.items():
        relation = F.when(F.substring(token, 2, 1) == mark, F.lit(name)).otherwise(relation)
    letter = F.regexp_extract(token, "^'?([A-Za-z])", 1)
    structure = F.lit(None).cast("string")
    for mark, name in STRUCTURE.items():
        structure = F.when(F.upper(letter) == mark, F.lit(name)).otherwise(structure)
    structure = F.when(token.startswith("'"), F.concat(F.lit("protected_"), structure)).otherwise(structure)
    members = F.size(F.split(token, "/")).cast("double")
    return (
        F.when(token.rlike("^[wb][kK]@[a-h][1-8]"), king)
        .when(token.rlike("^[wb][QRBNPqrbnp]@[a-h][1-8]"), placed)
        .when(token.rlike("^[wb]pocket:[QRBNP]$"), _one(F.concat(F.lit("PK_"), own, F.lit("_"), F.substring(token, -1, 1))))
        .when(token.rlike("^[A-Za-z][<>=][A-Za-z][a-h][1-8]$"), _one(F.concat_ws("_", side(F.substring(token, 1, 1)), relation)))
        .when(token.rlike("^'?[IiFfLlSs][a-h][1-8]$"), _one(F.concat_ws("_", side(letter), structure)))
        .when(token.rlike(r"^[Ww]\["), _one(F.concat(side(letter), F.lit("_pawn_chain")), members))
        .when(token.rlike(r"^[Pp]\(\d+\)$"), _one(F.concat(side(letter), F.lit("_pawn_islands")), F.regexp_extract(token, r"(\d+)", 1).cast("double"), False))
    )


def dynamic_feature(token: Column) -> Column:
    """The features that a line token sets; a token counts once, however often it occurs."""
    out = F.lit(None).cast("array<struct<feature:string,value:double,summed:boolean>>")
    for name, feature in FLAGS.items():
        out = F.when(token == name, _one(F.lit(feature), summed=False)).otherwise(out)
    for prefix, feature in PREFIXES.items():
        rest = F.substring(token, len(prefix) + 1, 1000)
        made = _one(F.concat(F.lit(feature), rest), summed=False)
        if prefix == "dyn:mateDrop:":
            made = F.concat(made, _one(F.lit("DG_!F_mateByDrop"), summed=False))
        if prefix == "dyn:dropPieces:":
            letters = F.filter(F.split(rest, ""), lambda c: c != "")
            made = F.concat(
                made, F.transform(letters, lambda c: F.struct(F.concat(F.lit("dyn_dropHas_"), c).alias("feature"), F.lit(1.0).alias("value"), F.lit(False).alias("summed")))
            )
        out = F.when(token.startswith(prefix), made).otherwise(out)
    for prefix, feature in COUNTED.items():
        piece, count = F.substring(token, len(prefix) + 1, 1), F.substring(token, len(prefix) + 2, 1).try_cast("double")
        out = F.when(token.startswith(prefix), _one(F.concat(F.lit(feature), piece), F.coalesce(count, F.lit(1.0)))).otherwise(out)
    zone = fn.zone(F.substring(token, len("pv:dropSq:") + 1, 2))
    return F.when(token.startswith("pv:dropSq:"), _one(F.concat(F.lit("DS_!drop_sq_zone_"), zone), summed=False)).otherwise(out)


def long_features(records: DataFrame, key: str, static: str, dynamic: str) -> DataFrame:
    """(key, feature, value) of token arrays; sums are combined before the shuffle by record."""
    s = records.select(key, F.explode(static).alias("t")).select(key, F.inline(static_feature(F.col("t"))))
    d = records.select(key, F.explode(F.array_distinct(dynamic)).alias("t")).select(key, F.inline(dynamic_feature(F.col("t"))))
    value = F.when(F.first("summed"), F.sum("value")).otherwise(F.max("value"))
    return s.unionByName(d).groupBy(key, "feature").agg(value.alias("value"))


def metadata(df: DataFrame) -> dict[str, Column]:
    """Clipped metadata features, of the columns that ``df`` has."""
    clip = {"meta_delta": "delta", "meta_cp_before": "cp", "meta_estimated_time": "time"} | {
        f"meta_{n}_rating": "rating" for n in ("avg", "solver", "white", "black")
    }
    out = {c: v.clipped(F.col(c).cast("double"), *v.CLIPS[kind]) for c, kind in clip.items() if c in df.columns}
    out |= {c: F.col(c).cast("double") for c in ("meta_length", "meta_clock_initial", "meta_clock_inc") if c in df.columns}
    if "meta_mate_in" in df.columns:
        out["meta_mate_in"] = F.coalesce(F.col("meta_mate_in").cast("double"), F.lit(0.0))
    if "meta_speed" in df.columns:
        out["meta_speed_ord"] = F.when(F.col("meta_speed").isNotNull(), v.ordinal(F.col("meta_speed"), v.SPEEDS).cast("double"))
    return out


def wide(long: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One column per declared name, 0 where a record lacks the feature."""
    per = long.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    return per.select(key, *[F.coalesce(F.element_at("m", n), F.lit(0.0)).alias(n) for n in names])


def pocket_totals(wide_df: DataFrame, turn: Column) -> DataFrame:
    """PK_total_white, _black, _solver and _opponent from the pocket columns."""
    white, black = [sum((F.col(f"PK_{s}_{p}") for p in PIECES[1:]), F.col(f"PK_{s}_Q")) for s in ("white", "black")]
    first = fn.turn(turn) == "white"
    return wide_df.withColumns(
        {
            "PK_total_white": white, "PK_total_black": black,
            "PK_total_solver": F.when(first, white).otherwise(black), "PK_total_opponent": F.when(first, black).otherwise(white),
        }
    )


def board_features(fen: Column) -> Column:
    """name -> value of a position's pieces, pawns, kings and pockets, without a token or a shuffle.

    ``fen`` should be a column, not an expression; the occupied squares are
    listed once, and all features follow from that list.
    """
    return F.transform(F.array(F.struct(occupied(fen).alias("cells"), fen.alias("fen"))), lambda s: _board_features(s["cells"], s["fen"]))[0]


def occupied(fen: Column) -> Column:
    """(f, r, p) of the occupied squares, files and ranks from 1."""
    chars = F.filter(F.split(fn.squares(fen), ""), lambda c: c != "")
    cells = F.transform(chars, lambda c, i: F.struct((i % 8 + 1).alias("f"), (8 - F.floor(i / 8)).cast("int").alias("r"), c.alias("p")))
    return F.filter(cells, lambda x: x["p"] != ".")


def _board_features(cells: Column, fen: Column) -> Column:
    entries: list[tuple[str, Column]] = []
    value = {"Q": 9, "R": 5, "B": 3, "N": 3, "P": 1}
    sides: dict[str, dict[str, Column]] = {}

    def number(x: Column) -> Column:
        return F.size(x).cast("double")

    def of(piece: str) -> Column:
        return F.filter(cells, lambda x: x["p"] == piece)

    def ahead_of(own: Column, up: bool) -> Column:
        return F.aggregate(own, F.lit(0), lambda t, x: t + (x["r"] if up else 9 - x["r"]))

    def free_of(own: Column, other: Column, up: bool) -> Column:
        def stops(x: Column, y: Column) -> Column:
            return (F.abs(y["f"] - x["f"]) <= 1) & ((y["r"] > x["r"]) if up else (y["r"] < x["r"]))

        return F.filter(own, lambda x: ~F.exists(other, lambda y: stops(x, y)))

    def alone(files: Column) -> Column:
        return F.filter(files, lambda f: ~F.array_contains(files, f - 1) & ~F.array_contains(files, f + 1))

    def in_hand(letters: Column, piece: str) -> Column:
        return F.filter(letters, lambda c: c == piece)

    pawns = {"w": of("P"), "b": of("p")}
    for s, upper in (("w", True), ("b", False)):
        own, other = pawns[s], pawns["b" if s == "w" else "w"]
        counts = {p: number(of(p if upper else p.lower())) for p in "KQRBNP"}
        held = {p: number(in_hand(fn.pocket_letters(fen, upper), p)) for p in PIECES}
        entries += [(f"{s}_{p}_count", n) for p, n in counts.items()] + [(f"{s}_pocket_{p}", n) for p, n in held.items()]
        king = F.get(of("K" if upper else "k"), 0)
        entries += [
            (f"{s}_king_file", king["f"].cast("double")), (f"{s}_king_rank", king["r"].cast("double")), (f"{s}_king_kingside", (king["f"] >= 5).cast("double")),
            (f"{s}_king_center_dist", F.abs(king["f"] - 4.5) + F.abs(king["r"] - 4.5)),
        ]
        files = F.transform(own, lambda x: x["f"])
        distinct = F.array_distinct(files)
        n = F.greatest(F.size(own), F.lit(1))
        ahead = ahead_of(own, upper)
        free = free_of(own, other, upper)
        entries += [
            (f"{s}_pawn_count", number(own)), (f"{s}_doubled_pawns", (F.size(files) - F.size(distinct)).cast("double")),
            (f"{s}_isolated_pawns", number(alone(files))),
            (f"{s}_passed_pawns", number(free)), (f"{s}_pawn_advancement", ahead / n),
            (f"{s}_pawn_spread", F.coalesce(F.array_max(files) - F.array_min(files), F.lit(0)).cast("double")),
            (f"{s}_pawn_center", number(F.filter(files, lambda f: f.isin(4, 5)))),
        ]
        sides[s] = {
            "total_pieces": sum((counts[p] for p in "QRBNP"), counts["K"]), "pocket_total": sum((held[p] for p in "RBNP"), held["Q"]),
            "material": sum((counts[p] * value[p] for p in "RBNP"), counts["Q"] * 9), "pocket_material": sum((held[p] * value[p] for p in "RBNP"), held["Q"] * 9),
        }
        entries += [(f"{s}_{k}", x) for k, x in sides[s].items()]
    tension = F.aggregate(
        pawns["w"], F.lit(0), lambda t, x: t + F.size(F.filter(pawns["b"], lambda y: (F.abs(y["f"] - x["f"]) == 1) & (y["r"] == x["r"] + 1)))
    )
    entries += [
        ("pawn_tension", tension.cast("double")), ("total_pieces_on_board", sides["w"]["total_pieces"] + sides["b"]["total_pieces"]),
        ("material_balance", sides["w"]["material"] - sides["b"]["material"]), ("total_pawns", number(pawns["w"]) + number(pawns["b"])),
    ]
    filled = F.create_map(*[x for name, c in entries for x in (F.lit(name), c)])
    return F.map_filter(filled, lambda _, x: x.isNotNull())


def differences(a: Column, b: Column) -> Column:
    """diff_<name> -> |a - b| over both maps' names."""
    zero = F.lit(0.0)
    apart = F.map_zip_with(a, b, lambda _, x, y: F.abs(F.coalesce(x, zero) - F.coalesce(y, zero)))
    return F.transform_keys(apart, lambda k, _: F.concat(F.lit("diff_"), k))


def cluster_name(means: Column) -> Column:
    """A name for a cluster from its mean features, given as a map."""
    def m(name: str) -> Column:
        return F.coalesce(F.element_at(means, name), F.lit(0.0))

    firsts = F.array_sort(
        F.transform(
            F.map_entries(F.map_filter(means, lambda k, x: k.startswith("dyn_first_") & (x > 0.3))),
            lambda e: F.struct((-e["value"]).alias("v"), F.regexp_replace(e["key"], "^dyn_first_", "first:").alias("n")),
        )
    )
    pocket = m("PK_total_solver")
    parts = [
        F.get(firsts, 0)["n"], F.when(m("DG_!F_drop") > 0.5, "hasDrop").otherwise("noDrop"), F.when(m("DG_!F_drop+") > 0.4, "dropCheck"),
        F.when(pocket > 2, F.concat(F.lit("pocket>"), F.format_number(pocket, 1))).when(pocket < 0.5, "emptyPocket"),
        F.when(m("dyn_pvLen_short") > 0.5, "shortMate").when(m("dyn_pvLen_long") > 0.4, "longMate"),
        *[F.when(m(f"dyn_dropHas_{p}") > 0.4, f"drops{p}") for p in "NBRQP"],
    ]
    return F.concat_ws(" | ", *parts)
