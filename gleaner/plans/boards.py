"""Board algebra on synthetic positions that any SQL engine can make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import board
from ..sources.tables import table

POSITIONS = """select pos_id, sq, cast(sq % 8 as int) f, cast(floor(sq/8) as int) r,
       substr('PPPPNBRQppppnbrq', cast(min(pc) as int)+1, 1) piece
from (select cast(floor(l_orderkey/6) as bigint) pos_id, cast((l_partkey*7+l_suppkey*13+l_linenumber*5) % 64 as int) sq,
             l_partkey % 16 pc from {lineitem}) t
group by pos_id, sq"""


def positions(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(POSITIONS.format(lineitem="{lineitem}"), lineitem=table(spark, sf, "lineitem"))


BASE = f"""p as ({POSITIONS.format(lineitem="lineitem")}),
n as (select *, chr(97 + f) || (r + 1) as name, piece = upper(piece) as white from p)"""

GEOMETRY = (
    "g as (select mover, src, ray, step, cast((src // 8 + dr * step) * 8 + src % 8 + df * step as int) as dst from (values "
    + ", ".join(f"('{m}', {n}, {df}, {dr}, {reach})" for m, n, df, dr, reach in board.rays())
    + ") as t(mover, ray, df, dr, reach), range(0, 64) as s(src), range(1, 8) as u(step) where step <= reach and src % 8 + df * step between 0 and 7 and src // 8 + dr * step between 0 and 7)"
)

SEEN = f"""{BASE}, {GEOMETRY},
seen as (select * from (select a.pos_id, a.piece, a.white, mover, t.piece as target, t.white as target_white, t.name, row_number() over (partition by a.pos_id, a.sq, ray order by step) as nth
  from n a join g on mover = case when upper(piece) = 'P' then piece else upper(piece) end and src = sq join n t on t.pos_id = a.pos_id and t.sq = dst) where nth <= 2)"""

PAWNS = f"""{BASE}, w as (select *, case when white then 1 else -1 end as d from n where upper(piece) = 'P'),
x as (select a.*, (select count(*) from w b where b.pos_id = a.pos_id and b.white = a.white and abs(b.f - a.f) = 1) as beside,
  (select count(*) from w b where b.pos_id = a.pos_id and b.white = a.white and abs(b.f - a.f) = 1 and b.r = a.r - a.d) as support,
  (select count(*) from w b where b.pos_id = a.pos_id and b.white = a.white and abs(b.f - a.f) = 1 and abs(b.r - a.r) = 1) as linked,
  (select count(*) from w b where b.pos_id = a.pos_id and b.white = a.white and b.f = a.f and b.r <> a.r) as same_file,
  (select count(*) from w b where b.pos_id = a.pos_id and b.white <> a.white and abs(b.f - a.f) <= 1 and (b.r - a.r) * a.d > 0) as stopped from w a)"""


def counted(df: DataFrame) -> DataFrame:
    """Tokens of a position with how often they occur."""
    return df.groupBy("pos_id", "token").agg(F.count(F.lit(1)).alias("n"))


def fen_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Placement tokens of every position."""
    return board.placement_tokens(positions(spark, sf))


def attack_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return counted(board.relation_tokens(positions(spark, sf)))


RELATIONS = f"""with {SEEN}
select pos_id, token, count(*) as n from (
  select pos_id, piece || case when nth = 2 then '=' when white <> target_white then '>' else '<' end || target || name as token
  from seen where nth = 1 or mover in ('Q', 'R', 'B')) group by all"""


def pawn_structure(spark: SparkSession, sf: str) -> DataFrame:
    return counted(board.pawn_tokens(positions(spark, sf)))


PAWN_TOKENS = f"""with {PAWNS},
t as (select pos_id, case when white then 'I' else 'i' end || name as token from x where beside = 0
union all select pos_id, case when support > 0 then '''' else '' end || case when white then 'F' else 'f' end || name from x where stopped = 0
union all select pos_id, case when white then 'L' else 'l' end || name from x where support = 0 and beside > 0
union all select pos_id, case when white then 'S' else 's' end || name from x where same_file > 0
union all select pos_id, case when white then 'W' else 'w' end || '[' || string_agg(name, '/' order by sq) || ']' from x where linked > 0 group by pos_id, white
union all select s.pos_id, case when s.white then 'P' else 'p' end || '(' || coalesce(runs, 0) || ')' from
  (select pos_id, white from (select distinct pos_id from n), (values (true), (false)) as v(white)) s left join
  (select pos_id, white, count(*) as runs from (select *, f - lag(f) over (partition by pos_id, white order by f) as gap from (select distinct pos_id, white, f from x))
   where gap is null or gap > 1 group by all) i on i.pos_id = s.pos_id and i.white = s.white)
select pos_id, token, count(*) as n from t group by all"""


def synthetic_isolated(spark: SparkSession, sf: str) -> DataFrame:
    """Isolated pawns by an anti-join on neighbouring files."""
    own = positions(spark, sf).filter("upper(piece) = 'P'").select("pos_id", "piece", "f", "sq")
    near = own.select("pos_id", "piece", F.explode(F.array(F.col("f") - 1, F.col("f") + 1)).alias("f")).distinct()
    return own.join(near, ["pos_id", "piece", "f"], "left_anti").select("pos_id", "piece", "sq")


def synthetic_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Islands of pawn files per colour: gaps and islands by a window."""
    from pyspark.sql import Window

    files = positions(spark, sf).filter("upper(piece) = 'P'").select("pos_id", "piece", "f").distinct()
    gap = F.col("f") - F.lag("f").over(Window.partitionBy("pos_id", "piece").orderBy("f"))
    return files.withColumn("new", F.when(gap == 1, 0).otherwise(1)).groupBy("pos_id", "piece").agg(F.sum("new").alias("islands"))


def material_sums(spark: SparkSession, sf: str) -> DataFrame:
    value = F.create_map(*[F.lit(x) for p in {"P": 1, "N": 3, "B": 3, "R": 5, "Q": 9}.items() for x in p])
    rows = positions(spark, sf)
    return rows.groupBy("pos_id").agg(
        F.sum(F.when(board.is_white(F.col("piece")), F.element_at(value, F.upper("piece"))).otherwise(0)).alias("white"),
        F.sum(F.when(board.is_white(F.col("piece")), 0).otherwise(F.element_at(value, F.upper("piece")))).alias("black"),
    )


VALUE = "case upper(piece) when 'P' then 1 when 'N' then 3 when 'B' then 3 when 'R' then 5 else 9 end"

QUERIES = {
    "fen_expand": (fen_expand, f"with {BASE} select pos_id, case when white then 'w' else 'b' end || lower(piece) || '@' || name as token from n"),
    "attack_tokens": (attack_tokens, RELATIONS),
    "pawn_structure": (pawn_structure, PAWN_TOKENS),
    "synthetic_isolated": (synthetic_isolated, f"with {BASE} select pos_id, piece, sq from n a where upper(piece) = 'P' and not exists (select 1 from n b where b.pos_id = a.pos_id and b.piece = a.piece and abs(b.f - a.f) = 1)"),
    "synthetic_islands": (synthetic_islands, f"with {BASE}, d as (select distinct pos_id, piece, f from n where upper(piece) = 'P') select pos_id, piece, count(*) as islands from (select *, f - lag(f) over (partition by pos_id, piece order by f) as gap from d) where gap is null or gap > 1 group by all"),
    "material_sums": (material_sums, f"with {BASE} select pos_id, cast(sum(case when white then {VALUE} else 0 end) as bigint) as white, cast(sum(case when white then 0 else {VALUE} end) as bigint) as black from n group by 1"),
}
