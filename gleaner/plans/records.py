"""Records made of order lines: moves, filters, position texts, and what is written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fen as fn
from ..functions import values as v
from ..operators import filters as fl
from ..operators import search as se
from ..sources import pgn, sinks
from ..sources import records as rc
from ..sources.tables import scratch, table
from .boards import BASE
from .puzzles import fens


def square(x: str) -> str:
    """The name of a square's number, in any SQL."""
    return f"substr('abcdefgh', {x} % 8 + 1, 1) || cast(cast(floor({x} / 8) as int) + 1 as varchar(1))"


MOVES = f"""select k, n, a, b, c, d, case when c < 3 then substr('PNB', c + 1, 1) || '@' || {square("b")} else {square("a")} || {square("b")} || case when c = 5 then 'q' else '' end end as uci
from (select l_orderkey as k, cast(l_linenumber as int) as n, cast(min(l_partkey) % 64 as int) as a, cast((min(l_suppkey) * 7 + l_linenumber * 3) % 64 as int) as b,
  cast(min(l_partkey) % 11 as int) as c, cast(min(l_suppkey) % 13 as int) as d from {{lineitem}} group by l_orderkey, l_linenumber) t"""


def moves(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(MOVES.format(lineitem="{lineitem}"), lineitem=table(spark, sf, "lineitem"))


SQL_MOVES = f"mv as ({MOVES.format(lineitem='lineitem')})"


def move_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Every move, written with marks and blanks, in its normal form; where it goes, and how far."""
    rows = moves(spark, sf).withColumn("raw", F.when(F.col("n") == 7, " -- ").otherwise(F.concat(F.lit(" "), "uci", F.when(F.col("d") < 3, "+").when(F.col("d") < 5, "#").otherwise(" "))))
    to = fn.destination(F.col("uci"))
    return rows.select(
        "k", "n", fn.normal_uci(F.col("raw")).alias("move"), to.alias("dest"), fn.zone(to).alias("zone"), fn.square_index(to).cast("int").alias("idx"),
        fn.chebyshev(F.col("a"), F.col("b")).alias("away"),
    )


MOVE_FIELDS = f"""with {SQL_MOVES}
select k, n, case when n <> 7 then uci end as move, {square("b")} as dest, case when b // 8 in (0, 7) then 'back_rank' when b % 8 >= 4 then 'kingside' else 'queenside' end as zone,
b as idx, cast(greatest(abs(a // 8 - b // 8), abs(a % 8 - b % 8)) as int) as away from mv"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """A record per order: its moves in order, pockets, ply, mate, texts and a label."""
    rows = moves(spark, sf).groupBy("k").agg(
        F.array_sort(F.collect_list(F.struct("n", "uci"))).alias("m"), F.count_if(F.col("c") == 4).cast("int").alias("N"), F.count_if(F.col("c") == 6).cast("int").alias("P"),
        F.max("d").alias("d"), F.min("a").alias("a"),
    )
    k = F.col("k")
    return rows.select(
        "k", F.transform("m", lambda x: x["uci"]).alias("solution_uci"), F.create_map(F.lit("N"), "N").alias("white"), F.create_map(F.lit("P"), "P").alias("black"),
        (F.size("m") * 2).alias("ply"), F.when(k % 7 > 0, "8/8/8/8/8/8/8/8").alias("board_fen"), F.when(F.col("d") > 8, F.col("d") - 9).alias("mate_before"),
        F.when(F.col("a") < 8, "Q@a1").when(F.col("a") < 16, "a1a2").alias("bestmove_before"), F.when(k % 3 == 0, "similar").when(k % 3 == 1, "").alias("label"),
        F.when(k % 5 > 0, "words").alias("text"), F.when(k % 4 == 0, F.array(F.lit("mate:smother"), F.lit("x"))).otherwise(F.array(F.lit("x"))).alias("text_dynamic"),
    )


def record_filters(spark: SparkSession, sf: str) -> DataFrame:
    """(filter, k): which records each filter keeps."""
    rows = lines(spark, sf)
    line, pockets = F.col("solution_uci"), (F.col("white"), F.col("black"))
    kept = {
        "has_drop": rows.filter(fl.has_drop(line)), "early_drop": rows.filter(fl.has_drop(line, 2)), "relevant": rows.filter(fl.relevant(line, *pockets)),
        "relevant_early": rows.filter(fl.relevant(line, *pockets, best=F.col("bestmove_before"), first=2)), "placed": fl.placed(rows), "mate": fl.mode(rows, "mate"),
        "mate_short": fl.mode(rows, "mate_short"), "exact": fl.exact_length(rows, 5), "offset": fl.from_offset(rows, [F.col("k")], 100),
        "judged": fl.judged(rows, "text"), "smothered": fl.smothered(rows),
    }
    out = None
    for name, part in kept.items():
        part = part.select(F.lit(name).alias("filter"), "k")
        out = part if out is None else out.unionByName(part)
    return out


RECORD_FILTERS = f"""with {SQL_MOVES}, r as (
  select k, count(*) as size, bool_or(c < 3) as drops, bool_or(c < 3 and nth <= 2) as early, bool_or(c = 4 or c = 6) as holds, max(d) as d, min(a) as a
  from (select *, row_number() over (partition by k order by n) as nth from mv) group by k)
select 'has_drop' as filter, k from r where drops union all select 'early_drop', k from r where early union all select 'relevant', k from r where drops or holds
union all select 'relevant_early', k from r where early or holds or a < 8 union all select 'placed', k from r where size >= 3 and k % 7 > 0
union all select 'mate', k from r where d > 8 union all select 'mate_short', k from r where d in (11, 12) union all select 'exact', k from r where size = 5
union all select 'offset', k from (select k from r order by k offset 100) union all select 'judged', k from r where k % 3 = 0 and k % 5 > 0 union all select 'smothered', k from r where k % 4 = 0"""


#: Pockets, as written after a position, and what they come to; by position.
POCKETS = (("[NpQ]", "NQ", "P", "QNp"), ("/pqPN", "NP", "PQ", "NPqp"), ("", "", "", ""), ("[bbR]", "R", "BB", "Rbb"))
TURNS = ("white", "Black", "b", "W")


def _by_place(values: list[str | None], at: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (at % len(values) + 1).cast("int"))


def position_text(spark: SparkSession, sf: str) -> DataFrame:
    """Positions with pockets in either notation: assembled, keyed, and their parts."""
    at = F.col("pos_id")
    rows = fens(spark, sf).select("pos_id", F.concat("fen", _by_place([p[0] for p in POCKETS], at)).alias("f"), _by_place(list(TURNS), at).alias("t"))
    f, t = F.col("f"), F.col("t")
    counts = fn.pocket_counts(f, True)
    return rows.select(
        "pos_id", fn.full(f, fn.canonical_pocket(f), t).alias("full_fen"), fn.turn(t).alias("turn"), fn.position_key(f).alias("key"), fn.is_valid(f).alias("valid"),
        F.array_join(fn.pocket_letters(f, True), "").alias("white_pocket"), F.array_join(fn.pocket_letters(f, False), "").alias("black_pocket"),
        v.pocket_text(counts).alias("shown"), fl.has_pocket(counts).alias("holds"), fn.mated_king(f, t).cast("int").alias("king"),
    )


def _position_sql() -> str:
    row = "string_agg(coalesce(piece, '.'), '' order by sq % 8)"
    for n in range(8, 0, -1):
        row = f"replace({row}, '{'.' * n}', '{n}')"
    held = ", ".join(f"({i}, '{w}', '{b}', '{c}', '{t}')" for i, ((_, w, b, c), t) in enumerate(zip(POCKETS, TURNS)))
    return f"""with {BASE}, grid as (select d.pos_id, s.sq, p.piece from (select distinct pos_id from p) d, range(0, 64) as s(sq) left join p on p.pos_id = d.pos_id and p.sq = s.sq),
ranks as (select pos_id, sq // 8 as r, {row} as row, string_agg(coalesce(piece, '.'), '' order by sq % 8) as cells from grid group by all),
x as (select pos_id, string_agg(row, '/' order by r desc) as pl, string_agg(cells, '' order by r desc) as cells from ranks group by 1),
h as (select * from (values {held}) as t(i, white, black, canon, t))
select pos_id, pl || case when canon <> '' then '/' || canon else '' end || ' ' || case when lower(t) like 'b%' then 'b' else 'w' end || ' - - 0 1' as full_fen,
case when lower(t) like 'b%' then 'black' else 'white' end as turn, pl || '|' || canon as key, true as valid, white as white_pocket, black as black_pocket,
case when white = '' then '-' else array_to_string(list_transform(string_split(white, ''), lambda c: c || '1'), ' ') end as shown, white <> '' as holds,
cast(position(case when lower(t) like 'w%' then 'k' else 'K' end in cells) as int) as king from x join h on i = pos_id % {len(POCKETS)}"""


HEADERS = {"Event": "event", "Site": "site", "White": "white", "Black": "black", "WhiteElo": "white_elo", "BlackElo": "black_elo", "Result": "result", "Termination": "termination"}
#: Moves that games take turns with.
SAN = ("e4", "Nf6", "P@h3+", "O-O", "Qxd5", "R@a1#")


def pgn_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a game, written as text, read back, and filtered by how it ended."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = orders.select(
        k.alias("qid"), F.lit(1).alias("rank"), F.lit("Rated game").alias("event"), F.concat(F.lit("https://games.example/"), k).alias("site"), F.concat(F.lit("w"), c).alias("white"),
        F.concat(F.lit("b"), c % 97).alias("black"), F.when(c % 10 > 0, (1000 + c % 900).cast("string")).otherwise("?").alias("white_elo"), (1500 + k % 400).alias("black_elo"),
        F.lit("1-0").alias("result"), F.when(k % 3 > 0, "Normal").otherwise("Time forfeit").alias("termination"),
        F.transform(F.sequence(F.lit(0), (k % 12).cast("int")), lambda i: F.element_at(F.array(*[F.lit(m) for m in SAN]), (i % len(SAN) + 1).cast("int"))).alias("san"),
    )
    text = sinks.game_text({h: F.col(name) for h, name in HEADERS.items()}, F.col("san"), F.lit(False), F.col("result"))
    path = f"{scratch(spark)}/pgn-{uuid.uuid4().hex}"
    sinks.packs(rows.withColumn("pgn", text), path)
    games = pgn.normal_games(pgn.games(spark, path))
    return games.select("site", "white", "black", "white_elo", "black_elo", "game_rating_avg", "result", F.array_join("san_moves", " ").alias("san"))


_SAN_SQL = "[" + ", ".join(f"'{m}'" for m in SAN) + "]"
PGN = f"""select 'https://games.example/' || o_orderkey as site, 'w' || o_custkey as white, 'b' || (o_custkey % 97) as black,
cast(case when o_custkey % 10 > 0 then 1000 + o_custkey % 900 end as int) as white_elo, cast(1500 + o_orderkey % 400 as int) as black_elo,
cast(case when o_custkey % 10 > 0 then (1000 + o_custkey % 900 + 1500 + o_orderkey % 400) // 2 end as int) as game_rating_avg, '1-0' as result,
array_to_string(list_transform(range(0, o_orderkey % 12 + 1), lambda i: ({_SAN_SQL})[i % {len(SAN)} + 1]), ' ') as san
from orders where o_orderkey % 3 > 0 and o_orderkey % 12 >= 5"""

ROW = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderpriority", T.StringType()), T.StructField("o_totalprice", T.DoubleType())])


def round_trips(spark: SparkSession, sf: str) -> DataFrame:
    """(format, o_orderkey, o_orderpriority, o_totalprice): orders written and read back in every format; appended ones come once."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    path = f"{scratch(spark)}/trip-{uuid.uuid4().hex}"
    columns = rows.columns
    sinks.json_lines(rows, f"{path}/json")
    sinks.csv_rows(rows, f"{path}/csv", columns)
    sinks.csv_rows(rows.drop("o_orderpriority"), f"{path}/csv_missing", columns)
    sinks.parquet(rows, f"{path}/parquet", by="o_orderpriority")
    sinks.append_new(rows.filter("o_orderkey % 2 = 0"), f"{path}/append", "o_orderkey")
    sinks.append_new(rows, f"{path}/append", "o_orderkey")
    sinks.matrix(rows, f"{path}/matrix", "o_orderkey", ["o_totalprice"])
    asked = rows.filter("o_orderkey % 10 = 0").select("o_orderkey")
    read = {
        "json": rc.json_lines(spark, f"{path}/json", ROW), "csv": rc.csv_rows(spark, f"{path}/csv", ROW), "csv_missing": rc.csv_rows(spark, f"{path}/csv_missing", ROW),
        "parquet": rc.parquet_columns(spark, f"{path}/parquet", columns), "append": rc.json_lines(spark, f"{path}/append", ROW, strict=True),
        "matrix": rc.matrix_rows(spark, f"{path}/matrix", asked, "o_orderkey").select(
            "o_orderkey", F.lit(None).cast("string").alias("o_orderpriority"), F.get("features", 0).cast("double").alias("o_totalprice")
        ),
    }
    out = None
    for name, part in read.items():
        part = part.select(F.lit(name).alias("format"), *columns)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("o_totalprice", F.round("o_totalprice", 0))


_TRIP = "select '{}' as format, o_orderkey, {} as o_orderpriority, round({}, 0) as o_totalprice from orders{}"
ROUND_TRIPS = " union all ".join(
    _TRIP.format(name, "null" if name in ("csv_missing", "matrix") else "o_orderpriority", "o_totalprice::float::double" if name == "matrix" else "o_totalprice", " where o_orderkey % 10 = 0" if name == "matrix" else "")
    for name in ("json", "csv", "csv_missing", "parquet", "append", "matrix")
)


def legacy_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """(k, token, n): what a line's text alone says of it, without a replay."""
    from ..replay.legacy import line_tokens

    delta = F.when(F.col("k") % 6 < 5, (F.col("k") % 6) * 300.0 - 100.0 + F.when(F.col("k") % 24 == 4, 20_000.0).otherwise(0.0))
    rows = lines(spark, sf).select("k", F.explode(line_tokens(F.col("solution_uci"), F.col("bestmove_before"), delta)).alias("token"))
    return rows.groupBy("k", "token").agg(F.count(F.lit(1)).alias("n"))


LEGACY_TOKENS = f"""with {SQL_MOVES}, o as (select *, row_number() over (partition by k order by n) as nth from mv), f as (select * from o where nth <= 6),
b as (select k, case when min(a) < 8 then 'Q@a1' when min(a) < 16 then 'a1a2' end as best from mv group by k),
d as (select distinct k, case when k % 6 < 5 then (k % 6) * 300 - 100 + case when k % 24 = 4 then 20000 else 0 end end as delta from mv),
t as (select k, 'has:drop' as token from f where c < 3 union all select k, 'drop:' || substr(uci, 1, 1) from f where c < 3 union all select k, 'has:move' from f where c >= 3
  union all select k, 'best:' || best from b where best is not null union all select k, 'best:drop' from b where best like '%@%'
  union all select k, 'delta:' || case when delta >= 10000 then 'mate' when delta >= 800 then '800+' when delta >= 600 then '600+' when delta >= 400 then '400+' else 'lt400' end from d where delta is not null)
select k, token, count(*) as n from t group by all"""


def shown_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring records as hits, in the columns that a hit is shown with."""
    docs = lines(spark, sf).select(
        F.concat(F.lit("g"), "k").alias("event_id"), F.concat(F.lit("https://lichess.org/study/g"), "k").alias("site"), "ply", "board_fen", "mate_before", "solution_uci",
        F.transform("solution_uci", lambda m: F.when(m.contains("@"), F.concat(F.lit("@"), F.substring_index(m, "@", -1))).otherwise(m)).alias("solution_san"),
        F.col("white").alias("pockets_white"), F.col("text_dynamic"), F.lit(None).cast("int").alias("game_rating_avg"), (F.col("ply") * 100).alias("meta_avg_rating"),
    )
    hits = docs.select(F.col("event_id").alias("doc_id"), F.lit("q").alias("qid"), F.lit(1).alias("rank"), F.lit(1.23456).alias("score"))
    out = se.shown(hits, docs)
    kept = ["id", "rank", "score", "site", "ply", "url", "board_fen", "turn", "mate_in", "mate_before", "engine_verified", "game_rating_avg", "bestmove", "white", "delta"]
    return out.select(*kept, F.array_join("solution_san", " ").alias("san"), F.array_join("pv", " ").alias("pv"), F.lit(len(out.columns)).alias("width"))


SHOWN = f"""with {SQL_MOVES}, r as (select k, count(*) * 2 as ply, max(d) as d, string_agg(uci, ' ' order by n) as san, arg_min(uci, n) as first from mv group by k)
select 'g' || k as id, 1 as rank, 1.235::double as score, 'https://lichess.org/study/g' || k as site, cast(ply as int) as ply, 'https://lichess.org/g' || k || '#' || ply as url,
case when k % 7 > 0 then '8/8/8/8/8/8/8/8' else '' end as board_fen, 'white' as turn, cast(case when d > 8 then d - 9 end as int) as mate_in, cast(case when d > 8 then d - 9 end as int) as mate_before,
false as engine_verified, cast(ply * 100 as int) as game_rating_avg, first as bestmove, null::varchar as white, null::double as delta, san, san as pv, 33 as width from r"""

QUERIES = {
    "move_fields": (move_fields, MOVE_FIELDS),
    "record_filters": (record_filters, RECORD_FILTERS),
    "position_text": (position_text, _position_sql()),
    "pgn_round_trip": (pgn_round_trip, PGN),
    "round_trips": (round_trips, ROUND_TRIPS),
    "legacy_tokens": (legacy_tokens, LEGACY_TOKENS),
    "shown_hits": (shown_hits, SHOWN),
}
