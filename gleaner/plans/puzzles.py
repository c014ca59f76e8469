"""Games cut into mate puzzles, encoded, compared and searched: fixed openings known from any primer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fen as fn
from ..functions import text as tx
from ..operators import board, features, pairs, search, static_similarity
from ..operators import index as ix
from ..replay import udf
from .boards import BASE, positions
from .retrieval import rounded

# Fixed games: scholar's, Legal's, smothered and Blackburne's mate.
GAMES = {
    "scholar": "e4 e5 Bc4 Nc6 Qh5 Nf6 Qxf7#",
    "legal": "e4 e5 Nf3 d6 Bc4 Bg4 Nc3 g6 Nxe5 Bxd1 Bxf7+ Ke7 Nd5#",
    "smothered": "e4 c6 d4 d5 Nc3 dxe4 Nxe4 Nd7 Qe2 Ngf6 Nd6#",
    "blackburne": "e4 e5 Nf3 Nc6 Bc4 Nd4 Nxe5 Qg5 Nxf7 Qxg2 Rf1 Qxe4+ Be2 Nf3#",
}


def games(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(GAMES.items()), "site string, moves string")
    return rows.select("site", F.split("moves", " ").alias("san_moves"))


def records(spark: SparkSession) -> DataFrame:
    """The puzzles with their token fields, as a corpus."""
    puzzles = udf.mate_puzzles(games(spark))
    cells = board.exploded(puzzles, "event_id", F.col("fen"))
    static = board.static_tokens(cells).groupBy("pos_id").agg(F.array_sort(F.collect_list("token")).alias("static"))
    rows = puzzles.join(static, F.col("event_id") == F.col("pos_id")).drop("pos_id")
    return udf.corpus(rows, F.col("static"), fn.pocket_counts(F.col("fen"), True), fn.pocket_counts(F.col("fen"), False))


def mate_puzzles(spark: SparkSession, sf: str) -> DataFrame:
    return udf.mate_puzzles(games(spark)).select("event_id", "ply", "turn", "fen", F.array_join("solution_san", " ").alias("solution"))


def puzzle_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of every token of the corpus, with its family."""
    rows = records(spark).select("event_id", F.explode("text_all").alias("token", "weight"))
    return rows.withColumn("family", tx.family(F.col("token")))


def puzzle_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.long_features(records(spark), "event_id", "text_static", "text_dynamic")


def puzzle_search(spark: SparkSession, sf: str) -> DataFrame:
    """Each puzzle against the others by weighted tokens."""
    built = ix.build_weighted(records(spark), {"text_all": F.col("text_all")}, doc_id="event_id")
    terms = built.postings.select(F.col("doc_id").alias("qid"), "field", "token", F.col("tf").cast("double").alias("qtf"))
    return rounded(search.search(built, terms, 3, exclude=F.col("qid") == F.col("doc_id")))


def puzzle_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pair features of each puzzle and the next by name, in long form."""
    rows = records(spark).withColumn("stats", udf.line_stats("fen", "solution_uci"))
    given = {
        "static": F.col("text_static"), "dynamic": F.col("text_dynamic"), "solution_uci": F.col("solution_uci"), "mate": F.col("mate_plies"),
        "turn": F.col("turn"), "fen": F.col("fen"), "stats": F.col("stats"),
    }
    sides = rows.select("event_id", pairs.profile(pairs.record(**given)).alias("r"))
    order = sorted(f"{n}_mate5" for n in GAMES)
    follows = F.create_map(*[F.lit(x) for a, b in zip(order, order[1:]) for x in (a, b)])
    q = sides.select(F.col("event_id").alias("qid"), F.col("r").alias("q"), F.element_at(follows, F.col("event_id")).alias("event_id"))
    both = q.join(sides.withColumnRenamed("r", "c"), "event_id")
    found = pairs.features(F.col("q"), F.col("c"))
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.round(c.cast("double"), 6).alias("value")) for n, c in found.items()]))
    return both.select("qid", "event_id", long.alias("f")).select("qid", "event_id", "f.*")


def verified_mates(spark: SparkSession, sf: str) -> DataFrame:
    """Puzzles whose last three plies are a forced mate, found by search."""
    puzzles = udf.mate_puzzles(games(spark), last=1)
    return udf.verified(puzzles, lambda: udf.MateSearch(1), plies=1)


def fens(spark: SparkSession, sf: str) -> DataFrame:
    """(pos_id, fen): the synthetic positions as text."""
    cells = F.collect_list(F.struct((F.lit(7) - F.col("r")).alias("r"), "f", "piece"))
    per = positions(spark, sf).groupBy("pos_id").agg(cells.alias("cells"))
    text = F.aggregate(
        "cells", F.lit("." * 64), lambda s, c: F.overlay(s, c["piece"], (c["r"] * 8 + c["f"] + 1).cast("int"))
    )
    rows = F.concat_ws("/", *[F.substring(text, 8 * k + 1, 8) for k in range(8)])
    for n in range(8, 0, -1):
        rows = F.replace(rows, F.lit("." * n), F.lit(str(n)))
    return per.select("pos_id", rows.alias("fen"))


def fen_text(spark: SparkSession, sf: str) -> DataFrame:
    """Positions written as FEN, read back, and their material."""
    f = F.concat(F.col("fen"), F.lit("/QNp w - - 0 1"))
    return fens(spark, sf).select(
        "pos_id", fn.placement(f).alias("placement"), fn.canonical_pocket(f).alias("pocket"), fn.material(f).alias("material"),
        fn.bracketed(f).alias("bracketed"), fn.squares(f).alias("squares"),
    )


def _fen_sql() -> str:
    rows = "string_agg(coalesce(piece, '.'), '' order by sq % 8)"
    for n in range(8, 0, -1):
        rows = f"replace({rows}, '{'.' * n}', '{n}')"
    value = "case upper(piece) when 'P' then 1 when 'N' then 3 when 'B' then 3 when 'R' then 5 when 'Q' then 9 else 0 end"
    return f"""with {BASE}, grid as (select d.pos_id, s.sq, p.piece from (select distinct pos_id from p) d, range(0, 64) as s(sq) left join p on p.pos_id = d.pos_id and p.sq = s.sq),
ranks as (select pos_id, sq // 8 as r, {rows} as row, string_agg(coalesce(piece, '.'), '' order by sq % 8) as cells from grid group by all),
m as (select pos_id, sum({value}) + 13 as material from p group by 1)
select pos_id, string_agg(row, '/' order by r desc) as placement, 'QNp' as pocket, max(material)::double as material,
string_agg(row, '/' order by r desc) || '[QNp] w - - 0 1' as bracketed, string_agg(cells, '' order by r desc) as squares from ranks join m using (pos_id) group by pos_id"""


def static_similarities(spark: SparkSession, sf: str) -> DataFrame:
    """Each synthetic position against the next one: score and label."""
    none = F.array().cast("array<string>")
    a = fens(spark, sf).select("pos_id", static_similarity.profile(F.col("fen"), F.lit("white"), none, none).alias("q"))
    b = a.select((F.col("pos_id") - 1).alias("pos_id"), F.col("q").alias("c"))
    score = static_similarity.similarity(F.col("q"), F.col("c"))
    out = a.join(b, "pos_id").select("pos_id", F.round(score, 6).alias("score"))
    return out.withColumn("label", static_similarity.label(F.col("score")))


def _similarity_sql() -> str:
    def part(key: str, where: str = "true") -> str:
        return f"""(select coalesce(1 - sum(abs(coalesce(x.n, 0) - coalesce(y.n, 0))) / nullif(sum(greatest(coalesce(x.n, 0), coalesce(y.n, 0))), 0), 1)
 from (select {key} as k, count(*) as n from n where n.pos_id = q.pos_id and {where} group by 1) x full join (select {key} as k, count(*) as n from n where n.pos_id = q.pos_id + 1 and {where} group by 1) y on x.k = y.k)"""

    pawns = lambda key: f"({part(key, chr(39).join(['piece = ', 'P', '']))} + {part(key, chr(39).join(['piece = ', 'p', '']))}) / 2"
    return f"""with {BASE}, d as (select pos_id, count(*) as n from p group by 1), q as (select a.pos_id, a.n as na, b.n as nb from d a join d b on b.pos_id = a.pos_id + 1),
s as (select pos_id, 0.08 + 0.30 * {part("piece")} + 0.08 * greatest(0, 1 - abs(na - nb) / 8) + 0.09 * 0.5 + 0.05 * 0.5 + 0.10 * 0.5 + 0.08 * 0.5 + 0.05 * 1.0
 + 0.07 * {pawns("f")} + 0.10 * {pawns("r")} as score from q)
select pos_id, round(score, 6) as score, cast(round(score, 6) >= 0.63 as int) as label from s"""


def board_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Named features of every synthetic position, in long form."""
    found = fens(spark, sf).select("pos_id", F.explode(features.board_features(F.col("fen"))).alias("feature", "value"))
    return rounded(found, "value")


def _board_sql() -> str:
    """The same by sides: pieces and pawns counted as rows. These positions have no kings and no pockets."""
    value = {"Q": 9, "R": 5, "B": 3, "N": 3, "P": 1}
    count = {p: f"count(*) filter (upper(piece) = '{p}')" for p in "KQRBNP"}
    pawn = "filter (upper(piece) = 'P')"
    total, material = " + ".join(count.values()), " + ".join(f"{x} * {count[p]}" for p, x in value.items())
    own = {f"{p}_count": count[p] for p in "KQRBNP"} | {f"pocket_{p}": "0" for p in "QRBNP"} | {
        "pawn_count": count["P"], "doubled_pawns": f"{count['P']} - count(distinct f) {pawn}", "isolated_pawns": "count(*) filter (upper(piece) = 'P' and not beside)",
        "passed_pawns": "count(*) filter (upper(piece) = 'P' and not stopped)", "pawn_advancement": f"coalesce(sum(case when white then r + 1 else 8 - r end) {pawn}, 0) / greatest({count['P']}, 1)",
        "pawn_spread": f"coalesce(max(f) {pawn} - min(f) {pawn}, 0)", "pawn_center": "count(*) filter (upper(piece) = 'P' and f in (3, 4))", "total_pieces": total, "pocket_total": "0",
        "material": material, "pocket_material": "0",
    }
    listed = ", ".join(f"{{'feature': side || '_{n}', 'value': cast({n} as double)}}" for n in own)
    return f"""with {BASE}, sides as (select d.pos_id, s.white from (select distinct pos_id from p) d, (values (true), (false)) as s(white)),
x as (select s.pos_id, s.white, n.piece, n.f, n.r,
  exists (select 1 from n y where y.pos_id = n.pos_id and y.piece = n.piece and abs(y.f - n.f) = 1) as beside,
  exists (select 1 from n y where y.pos_id = n.pos_id and upper(y.piece) = 'P' and y.white <> n.white and abs(y.f - n.f) <= 1 and (y.r - n.r) * case when n.white then 1 else -1 end > 0) as stopped
  from sides s left join n on n.pos_id = s.pos_id and n.white = s.white),
w as (select pos_id, case when white then 'w' else 'b' end as side, {", ".join(f"{x} as {n}" for n, x in own.items())} from x group by pos_id, white),
tension as (select a.pos_id, count(*) as t from n a join n b on b.pos_id = a.pos_id and a.piece = 'P' and b.piece = 'p' and abs(a.f - b.f) = 1 and b.r = a.r + 1 group by 1),
every as (select pos_id, unnest([{listed}], recursive := true) from w
union all select pos_id, 'total_pieces_on_board', cast(sum(total_pieces) as double) from w group by pos_id
union all select pos_id, 'total_pawns', cast(sum(pawn_count) as double) from w group by pos_id
union all select pos_id, 'material_balance', cast(sum(case side when 'w' then material else -material end) as double) from w group by pos_id
union all select distinct w.pos_id, 'pawn_tension', cast(coalesce(t, 0) as double) from w left join tension on tension.pos_id = w.pos_id)
select pos_id, feature, round(value, 6) as value from every"""


QUERIES = {
    "mate_puzzles": (mate_puzzles, None),
    "puzzle_tokens": (puzzle_tokens, None),
    "puzzle_features": (puzzle_features, None),
    "puzzle_search": (puzzle_search, None),
    "puzzle_pairs": (puzzle_pairs, None),
    "verified_mates": (verified_mates, None),
    "fen_text": (fen_text, _fen_sql()),
    "static_similarities": (static_similarities, _similarity_sql()),
    "board_vectors": (board_vectors, _board_sql()),
}
