"""Positions as text: placement, pockets, turn, and their normal forms.

Pockets come as ``placement[pocket]`` or as a ninth rank ``placement/pocket``;
every function here takes either.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed order of pocket letters, and values of pieces.
POCKET_ORDER = "QRBNP"
VALUES = {"P": 1.0, "N": 3.0, "B": 3.0, "R": 5.0, "Q": 9.0}


def _field(fen: Column) -> Column:
    return F.substring_index(F.trim(F.coalesce(fen, F.lit(""))), " ", 1)


def placement(fen: Column) -> Column:
    """The eight ranks alone."""
    ranks = F.split(F.substring_index(_field(fen), "[", 1), "/")
    return F.array_join(F.slice(ranks, 1, 8), "/")


def is_valid(fen: Column) -> Column:
    """Eight ranks of pieces and digits."""
    return F.size(F.split(placement(fen), "/")) == 8


def pocket(fen: Column) -> Column:
    """The pocket's letters as they are; empty without one."""
    field = _field(fen)
    ranks = F.split(field, "/")
    return F.when(field.contains("["), F.regexp_extract(field, r"\[([^\]]*)\]?", 1)).otherwise(
        F.when(F.size(ranks) == 9, F.element_at(ranks, -1)).otherwise(F.lit(""))
    )


def pocket_letters(fen: Column, white: bool) -> Column:
    """One side's pocket as sorted upper-case letters, repeats included."""
    own = F.filter(F.split(pocket(fen), ""), lambda c: c.rlike("^[A-Z]$" if white else "^[a-z]$"))
    return F.array_sort(F.transform(own, F.upper))


def pocket_counts(fen: Column, white: bool) -> Column:
    """letter -> count."""
    letters = pocket_letters(fen, white)
    return F.map_from_entries(
        F.transform(F.array_distinct(letters), lambda c: F.struct(c, F.size(F.filter(letters, lambda x: x == c))))
    )


def canonical_pocket(fen: Column) -> Column:
    """White's letters in upper case, then black's in lower case, each by QRBNP."""
    return pocket_from_counts(pocket_counts(fen, True), pocket_counts(fen, False))


def pocket_from_counts(white: Column, black: Column) -> Column:
    """The same from two letter -> count maps."""
    parts = []
    for counts, lower in ((white, False), (black, True)):
        for piece in POCKET_ORDER:
            n = F.coalesce(F.element_at(counts, piece), F.lit(0))
            parts.append(F.repeat(F.lit(piece.lower() if lower else piece), n))
    return F.concat(*parts)


def turn(value: Column) -> Column:
    """white, unless the value starts with a b in either case."""
    return F.when(F.lower(F.coalesce(value, F.lit("white"))).startswith("b"), "black").otherwise("white")


def side(fen: Column, value: Column | None = None) -> Column:
    """w or b: the FEN's second field, else ``value``."""
    second = F.get(F.split(F.trim(F.coalesce(fen, F.lit(""))), " "), 1)
    other = F.substring(turn(value if value is not None else F.lit(None).cast("string")), 1, 1)
    return F.when(second.isin("w", "b"), second).otherwise(other)


def full(fen: Column, pocket_text: Column, turn_value: Column) -> Column:
    """``placement/pocket turn - - 0 1``; no ninth rank for an empty pocket."""
    ninth = F.when(pocket_text != "", F.concat(F.lit("/"), pocket_text)).otherwise("")
    return F.concat(placement(fen), ninth, F.lit(" "), F.substring(turn(turn_value), 1, 1), F.lit(" - - 0 1"))


def bracketed(fen: Column, turn_value: Column | None = None) -> Column:
    """``placement[pocket] turn - - 0 1``; null for an empty FEN."""
    text = F.concat(placement(fen), F.lit("["), pocket(fen), F.lit("] "), side(fen, turn_value), F.lit(" - - 0 1"))
    return F.when(_field(fen) != "", text)


def position_key(fen: Column) -> Column:
    """Placement and canonical pocket: equal for what is the same position to an expert."""
    return F.concat_ws("|", placement(fen), canonical_pocket(fen))


def squares(fen: Column) -> Column:
    """64 characters from a8 to h1, ``.`` for an empty square, promotion marks dropped."""
    text = F.replace(F.replace(placement(fen), F.lit("/"), F.lit("")), F.lit("~"), F.lit(""))
    for n in range(8, 0, -1):
        text = F.replace(text, F.lit(str(n)), F.lit("." * n))
    return text


def piece_at(board: Column, file: Column, rank: Column) -> Column:
    """The character of ``squares`` at file and rank 0-7; ``#`` off the board."""
    on = file.between(0, 7) & rank.between(0, 7)
    return F.when(on, F.substring(board, ((7 - rank) * 8 + file + 1).cast("int"), F.lit(1))).otherwise("#")


def material(fen: Column) -> Column:
    """Summed values on the board and in both pockets; either FEN form gives the same."""
    letters = F.split(F.upper(F.concat(placement(fen), pocket(fen))), "")
    value = F.create_map(*[F.lit(x) for pair in VALUES.items() for x in pair])
    return F.aggregate(letters, F.lit(0.0), lambda s, c: s + F.coalesce(F.element_at(value, c), F.lit(0.0)))


def _let(value: Column, then) -> Column:
    """``then(value)``, with ``value`` written and worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def _of_king(fen: Column, turn_value: Column, then) -> Column:
    """``then`` of a struct: the board's squares, whether white moves, and where (from 0) the king of the other side stands, -1 without one."""
    seen = F.struct(squares(fen).alias("board"), (side_to_move(fen, turn_value) == "w").alias("white"))
    placed = lambda x: F.struct(x["board"], x["white"], (F.instr(x["board"], F.when(x["white"], "k").otherwise("K")) - 1).alias("at"))
    return _let(seen, lambda x: _let(placed(x), then))


def mated_king(fen: Column, turn_value: Column) -> Column:
    """Position in ``squares`` (from 1) of the king of the side not to move; 0 without one."""
    return _of_king(fen, turn_value, lambda x: x["at"] + 1)


def side_to_move(fen: Column, turn_value: Column) -> Column:
    """``turn_value`` if there is one, else the FEN's field, else w."""
    own = F.lower(F.coalesce(turn_value, F.lit("")))
    second = F.lower(F.coalesce(F.get(F.split(F.trim(F.coalesce(fen, F.lit(""))), " "), 1), F.lit("w")))
    return F.when(F.when(own != "", own).otherwise(second).startswith("w"), "w").otherwise("b")


def _around(x: Column) -> Column:
    """The eight characters around the king of ``_of_king``; null without one."""
    file, rank = x["at"] % 8, 7 - F.floor(x["at"] / 8)
    return F.when(x["at"] >= 0, F.array(*[piece_at(x["board"], file + df, rank + dr) for dr in (1, 0, -1) for df in (-1, 0, 1) if df or dr]))


def around_king(fen: Column, turn_value: Column) -> Column:
    """The eight characters around the mated king, ``#`` off the board; null without a king."""
    return _of_king(fen, turn_value, _around)


def king_box(fen: Column, turn_value: Column) -> Column:
    """own_adj and empty_adj (0: up to 1, 1: up to 3, 2: more), edge, corner of the mated king; empty map without one."""
    bucket = lambda n: F.when(n <= 1, 0).when(n <= 3, 1).otherwise(2)

    def box(x: Column) -> Column:
        edge_f, edge_r = (x["at"] % 8).isin(0, 7), F.floor(x["at"] / 8).isin(0, 7)

        def counted(around: Column) -> Column:
            own = F.filter(around, lambda c: F.when(x["white"], c.rlike("^[a-z]$")).otherwise(c.rlike("^[A-Z]$")))
            return F.create_map(
                F.lit("own_adj"), bucket(F.size(own)), F.lit("empty_adj"), bucket(F.size(F.filter(around, lambda c: c == "."))),
                F.lit("edge"), (edge_f | edge_r).cast("int"), F.lit("corner"), (edge_f & edge_r).cast("int"),
            )

        return F.when(x["at"] >= 0, _let(_around(x), counted)).otherwise(F.create_map().cast("map<string,int>"))

    return _of_king(fen, turn_value, box)


def king_shelter(fen: Column, turn_value: Column) -> Column:
    """Pawns of the mated king's side next to it; null without a king."""
    return _of_king(fen, turn_value, lambda x: F.size(F.filter(_around(x), lambda c: c == F.when(x["white"], "p").otherwise("P"))))


def zone(square: Column) -> Column:
    """back_rank for ranks 1 and 8, else kingside for files e-h and queenside for a-d."""
    return F.when(F.substring(square, 2, 1).isin("1", "8"), "back_rank").when(F.substring(square, 1, 1).between("e", "h"), "kingside").otherwise("queenside")


def square_index(square: Column) -> Column:
    """0 for a1 to 63 for h8; null for anything else."""
    index = (F.ascii(F.substring(square, 2, 1)) - 49) * 8 + F.ascii(square) - 97
    return F.when(square.rlike("^[a-h][1-8]$"), index)


def chebyshev(a: Column, b: Column) -> Column:
    """King moves between two square indices."""
    return F.greatest(F.abs(F.floor(a / 8) - F.floor(b / 8)), F.abs(a % 8 - b % 8)).cast("int")


def normal_uci(move: Column) -> Column:
    """Trimmed, without check marks; null for none."""
    text = F.regexp_replace(F.trim(move), "[+#]", "")
    return F.when(~text.isin("", "--", "..."), text)


def destination(move: Column) -> Column:
    """The square a move or drop goes to."""
    return F.when(move.contains("@"), F.substring(F.substring_index(move, "@", -1), 1, 2)).otherwise(F.substring(move, 3, 2))


def drop_san_repaired(san: Column, uci: Column) -> Column:
    """SAN moves in which a pawn's drop has its letter again: ``@h3`` becomes ``P@h3``."""
    return F.zip_with(
        san, uci, lambda s, u: F.when(s.startswith("@"), F.concat(F.when(u.contains("@"), F.upper(F.substring_index(u, "@", 1))).otherwise("P"), s)).otherwise(s)
    )


# Fixed figurines of the pieces.
FIGURINES = ("KQRBN", "♔♕♖♗♘")


def numbered_line(san: Column, black_first: Column) -> Column:
    """``1. e4 e5 2. ...`` with figurines; a line that black begins starts with ``1...``."""
    shift = F.when(black_first, 1).otherwise(0)
    moves = F.transform(
        san,
        lambda s, i: F.concat(
            F.when((i + shift) % 2 == 0, F.concat((F.floor((i + shift) / 2) + 1).cast("string"), F.lit(". ")))
            .when(i == 0, F.lit("1... "))
            .otherwise(""),
            F.translate(s, *FIGURINES),
        ),
    )
    return F.array_join(moves, " ")
