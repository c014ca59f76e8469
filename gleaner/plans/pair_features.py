"""All pair features of records made of order lines, each order against the next, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import features, pairs
from ..sources.tables import table
from .records import MOVES, square


def letter(of: str, x: str) -> str:
    return f"substr('{of}', {x} % {len(of)} + 1, 1)"


def choice(x: str, *values: str) -> str:
    return f"case {x} % {len(values)} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


PICTURES = ("##.K.p###", "K..##....", ".P.PKP#n#", "###PK#.q.")

#: Tokens of a line by what they are made of: (part, token, condition), in any SQL.
TOKENS = (
    ("static", f"'w' || {letter('PNBRQK', 'a')} || '@' || {square('b')}", "true"), ("static", f"{letter('QRB', 'c')} || '>' || {letter('PNR', 'd')} || {square('a')}", "c % 2 = 0"),
    ("static", "'open_' || cast(a % 5 as varchar(2))", "d % 2 = 0"), ("static", f"'pocket:' || {letter('PNBRQ', 'b')} || cast(a % 3 as varchar(2))", "c % 4 = 0"),
    ("dynamic", f"'pv:capturePiece:' || {letter('QRBNP', 'a')}", "c % 2 = 1"), ("dynamic", f"'pv:attack:' || {letter('QRB', 'b')} || '>' || {letter('PNQ', 'a')}", "d % 2 = 1"),
    ("dynamic", f"'pv:pieceMoved:' || {letter('PNBRQK', 'b')}", "true"), ("dynamic", f"'dyn:capPair:' || {letter('QRP', 'a')} || {letter('NBP', 'b')}", "c % 3 = 0"),
    ("dynamic", f"'dyn:first:' || {choice('d', 'check', 'dropCheck', 'capture')}", "n = 1"), ("dynamic", f"'dyn:mating_piece:' || {letter('QRN', 'a')}", "n = 2 and c % 2 = 0"),
    ("dynamic", f"'sum:mating_piece:' || {letter('QRN', 'b')}", "n = 2"), ("dynamic", f"'dyn:dropPieces:' || {choice('a', 'N', 'NQ', 'PR')}", "n = 3 and d % 2 = 0"),
    ("dynamic", f"'pv:dropPiece:' || {letter('PNB', 'c')}", "c < 3"), ("dynamic", "'pv:promotion'", "a % 16 = 0"), ("dynamic", "'dyn:hasDropCheck'", "b % 16 = 0"),
    ("dynamic", "'pv:dropSacrifice'", "a % 16 = 1"), ("dynamic", f"'dyn:mateDrop:' || {letter('NQ', 'a')}", "b % 16 = 1"), ("dynamic", "'dyn:dropNearKing'", "a % 16 = 2"),
    ("dynamic", f"'mate:pic:' || {choice('d', *PICTURES)}", "n = 1 and k % 3 > 0"), ("dynamic", f"'mate:region:' || {choice('a', 'edge', 'center')}", "n = 1 and k % 3 > 0"),
    ("dynamic", f"'mate:checker:' || {choice('b', 'N', 'Q', '?')}", "n = 1 and k % 3 > 0"), ("dynamic", f"'mate:cage:' || {choice('c', 'PPR', 'none', 'P')}", "n = 1 and k % 3 > 0"),
    ("dynamic", f"'mate:net:' || {choice('a', 'NQ', 'R', 'none')}", "n = 1 and k % 3 > 0"), ("dynamic", "'mate:smother'", "n = 1 and c % 5 = 0"),
    ("dynamic", f"'km:line:' || {choice('a', 'rank-file-file', 'none', 'diag')}", "n = 2 and k % 4 > 0"), ("dynamic", f"'km:checkers:' || {choice('b', 'Q-Q', 'none', 'N-R-Q')}", "n = 2 and k % 4 > 0"),
    ("dynamic", "'km:disp:' || cast(b % 9 as varchar(2))", "n = 2 and k % 4 > 0"), ("dynamic", "'km:sameline:' || cast(a % 3 as varchar(2))", "n = 2 and k % 4 > 0"),
    ("dynamic", "'km:samepiece:' || cast(b % 3 as varchar(2))", "n = 2 and k % 4 > 0"), ("dynamic", "'km:samesquare:' || cast(c % 2 as varchar(2))", "n = 2 and k % 4 > 0"),
    ("dynamic", f"'km:coop:' || {choice('d', 'AQDPP', 'none', 'ANRD')}", "n = 2 and k % 4 > 0"), ("dynamic", "'km:matebydrop'", "n = 2 and c % 3 = 0"),
)

#: A move of a line, its letter, and what a replay would say of it.
LINE = f"""select k, n, a, b, c, d, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', a % 26 + 1, 1) as move,
case when c < 3 then 'D' else 'M' end || case when a % 3 = 0 then 'x' else '' end || case when b % 4 = 0 then '=' else '' end || {choice('d', '+', '#', '', '', '')} as action from ({MOVES}) m"""

#: Fixed positions, and what each side's view of them comes to: own and free squares beside the king (0: up to 1, 1: up to 3, 2: more),
#: edge, corner, pawns beside it, the mover's pocket; then the material.
FENS = ("4k3/3ppp2/8/8/8/8/8/4K3[Nq]", "7k/6pp/8/8/8/8/PP6/K7[PPr]", "8/8/3k4/8/8/8/8/6K1[]")
VIEWS = (
    (0, "w", 1, 1, 1, 0, 3, "N", 15), (0, "b", 0, 2, 1, 0, 0, "Q", 15), (1, "w", 1, 0, 1, 1, 2, "PP", 11), (1, "b", 1, 0, 1, 1, 2, "R", 11),
    (2, "w", 0, 2, 0, 0, 0, "", 0), (2, "b", 0, 2, 1, 0, 0, "", 0),
)

ASIDE = """select k, case k % 4 when 0 then 0 when 1 then 1 when 2 then 2 end as fi, case k % 5 when 0 then 'white' when 1 then 'black' when 2 then 'Black' when 3 then '' end as turn,
case when k % 7 > 0 then min(d) end as mate, case when k % 8 > 0 then cast(min(a) * 10 as double) end as rating from lines group by k"""


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """(k, p): every order's profile."""
    rows = spark.sql(LINE.format(lineitem="{lineitem}"), lineitem=table(spark, sf, "lineitem"))
    token = F.array(*[F.when(F.expr(when), F.struct(F.lit(part).alias("part"), F.expr(text).alias("token"))) for part, text, when in TOKENS])
    per = rows.withColumn("t", F.filter(token, lambda t: t.isNotNull())).groupBy("k").agg(
        F.array_sort(F.collect_list(F.struct("n", "move", "action"))).alias("m"), F.flatten(F.collect_list("t")).alias("t"), F.count_if(F.col("c") < 3).cast("int").alias("drops"),
        F.sum(F.when(F.col("d") % 2 == 0, 1.0).otherwise(0.0)).alias("loss"), F.count_if(F.col("a") % 3 == 0).cast("int").alias("own"), F.count_if(F.col("b") % 3 == 0).cast("int").alias("other"),
        F.min("a").alias("king"), F.max("b").alias("sq"), F.collect_set(F.when(F.col("a") % 3 == 0, F.col("a"))).alias("caps"),
        F.collect_set(F.when(F.col("d") % 5 == 0, F.expr(letter("QRN", "b")))).alias("checkers"),
    )
    aside = rows.sparkSession.sql(ASIDE.replace("from lines", "from {lines}"), lines=rows)
    of = lambda name: F.transform(F.filter("t", lambda t: t["part"] == name), lambda t: t["token"])
    mated = F.col("k") % 5 > 0
    stats = F.struct(
        F.transform("m", lambda m: m["action"]).alias("actions"), F.col("drops"), F.col("loss"), F.col("own").alias("own_captures"), F.col("other").alias("other_captures"),
        F.when(mated, F.col("king")).alias("mate_king"), F.when(mated, F.col("sq")).alias("mate_square"), F.col("caps").alias("capture_squares"), "checkers",
    )
    fen = F.get(F.array(*[F.lit(f) for f in FENS]), F.col("fi"))
    made = pairs.record(
        static=of("static"), dynamic=of("dynamic"), solution_uci=F.transform("m", lambda m: F.concat(F.lit("m"), m["move"])), mate=F.col("mate"), turn=F.col("turn"),
        rating=F.col("rating"), fen=fen, stats=F.when(F.col("k") % 6 > 0, stats),
    )
    # A row per order, so that a profile is made once and not for each feature that reads it.
    return per.join(aside, "k").select("k", made.alias("r")).groupBy("k").agg(F.first(pairs.profile(F.col("r"))).alias("p"))


def pair_features(spark: SparkSession, sf: str) -> DataFrame:
    """Every feature of each order and the one with the next key, as columns."""
    rows = profiles(spark, sf)
    both = rows.select((F.col("k") + 1).alias("k"), F.col("p").alias("q")).join(rows.withColumnRenamed("p", "c"), "k")
    found = pairs.features(F.col("q"), F.col("c"))
    return both.select("k", *[F.round(c.cast("double"), 6).alias(n) for n, c in found.items()])


def _sql() -> str:
    tokens = " union all ".join(f"select k, '{part}' as part, {text} as token from lines where {when}" for part, text, when in TOKENS)
    views = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in v) + ")" for v in VIEWS)
    codes = [p + x + e + s for p in "DM" for x in ("", "x") for e in ("", "=") for s in ("", "+", "#")]
    code = "case action " + " ".join(f"when '{a}' then '{chr(65 + i)}'" for i, a in enumerate(codes)) + " end"
    fam = {f: f"coalesce(list(distinct token) filter (family = '{f}'), [])" for f in tx.FAMILIES}
    lined = "family in ('pv', 'dyn', 'sum')"

    def suffix(prefix: str) -> str:
        return f"coalesce(list(distinct upper(substr(token, {len(prefix) + 1}))) filter ({lined} and starts_with(token, '{prefix}')), [])"

    def least(prefix: str) -> str:
        return f"coalesce(upper(min(substr(token, {len(prefix) + 1})) filter ({lined} and starts_with(token, '{prefix}'))), '')"

    def any_of(*prefixes: str) -> str:
        return "coalesce(bool_or(" + " or ".join(f"starts_with(token, '{p}')" for p in prefixes) + f") filter ({lined}), false)"

    def told(prefix: str, none: str) -> str:
        return f"coalesce(nullif(max(substr(token, {len(prefix) + 1})) filter (part = 'dynamic' and starts_with(token, '{prefix}')), '{none}'), '')"

    columns = {f"fam_{f}": x for f, x in fam.items()} | {
        "every": "list(distinct token)", "dynm": least("dyn:mating_piece:"), "summ": least("sum:mating_piece:"), "first": least("dyn:first:"), "named": least("dyn:dropPieces:"),
        "dropped": suffix("pv:dropPiece:"), "captured": suffix("pv:capturePiece:"), "cappair": suffix("dyn:capPair:"), "attack": suffix("pv:attack:"), "moved": suffix("pv:pieceMoved:"),
        "promo": any_of("pv:promotion"), "drop_check": any_of("dyn:hasDropCheck", "pv:dropCheck"), "drop_sac": any_of("pv:dropSacrifice", "dyn:dropSacrifice"),
        "mate_drop": any_of("dyn:mateDrop"), "near": any_of("dyn:dropNearKing"), "pic": told("mate:pic:", ""), "region": told("mate:region:", ""), "checker": told("mate:checker:", "?"),
        "cage": told("mate:cage:", "none"), "net": told("mate:net:", "none"), "smother": "coalesce(bool_or(token = 'mate:smother'), false)", "kline": told("km:line:", "none"),
        "kcheck": told("km:checkers:", "none"), "disp": "coalesce(" + told("km:disp:", "") + "::varchar, '')", "sline": told("km:sameline:", ""), "spiece": told("km:samepiece:", ""),
        "ssq": told("km:samesquare:", ""), "coop": told("km:coop:", "none"), "by_drop": "coalesce(bool_or(token = 'km:matebydrop'), false)",
    }
    chars = lambda x: f"case when {x} = '' then [] else string_split({x}, '') end"
    parts = lambda x: f"case when {x} = '' then [] else string_split({x}, '-') end"
    number = lambda x: f"coalesce(try_cast({x} as int), 0)"
    ok = "k % 6 > 0"
    record = f"""with mv as ({LINE.format(lineitem="lineitem")}), lines as (select * from mv), tok as (
select *, case when regexp_matches(token, '^(mate|km|pv|dyn|sum):') then split_part(token, ':', 1) when contains(token, 'pocket:') then 'pocket'
  when regexp_matches(token, '^[wbWB][pnbrqkPNBRQK]@') then 'placement' when regexp_matches(token, '[<>=]') then 'relation' else 'motif' end as family from ({tokens})),
t as (select k, {", ".join(f"{x} as {n}" for n, x in columns.items())} from tok group by k),
l as (select k, string_agg(move, '' order by n) as moves, count(*) as size, string_agg({code}, '' order by n) as codes, arg_max(action, n) as last, arg_min(action, n) as begins,
  count(*) filter (c < 3) as drops, cast(count(*) filter (d % 2 = 0) as double) as loss, count(*) filter (a % 3 = 0) as own, count(*) filter (b % 3 = 0) as other, min(a) as king, max(b) as sq,
  coalesce(list(distinct a) filter (a % 3 = 0), []) as caps, coalesce(list(distinct {letter("QRN", "b")}) filter (d % 5 = 0), []) as checkers,
  least(2, count(*) filter (starts_with(action, 'D'))) as s_drops, least(2, count(*) filter (contains(action, '+') or contains(action, '#'))) as s_checks,
  least(2, count(*) filter (contains(action, 'x'))) as s_caps, bool_or(contains(action, '=')) as eq from lines group by k),
aside as ({ASIDE}), views as (select * from (values {views}) as t(i, side, own_adj, empty_adj, edge, corner, shelter, pocket, material)),
r as (select t.*, l.moves, l.size, case when {ok} then codes else '' end as codes, case when {ok} then last else '' end as last, case when {ok} then drops else 0 end as n_drops,
  case when {ok} then loss end as loss, case when {ok} then own end as own, case when {ok} then other end as other, case when {ok} and k % 5 > 0 then king end as king,
  case when {ok} and k % 5 > 0 then sq end as sq, case when {ok} then caps else [] end as caps, case when {ok} then checkers else [] end as checkers, {ok} as has_stats,
  case when {ok} then substr(begins, 1, 2) end as s_first, s_drops, s_checks, s_caps, {ok} and eq as eq, case when {ok} then starts_with(last, 'D') and contains(last, '#') end as s_ends,
  coalesce(mate, 0) as mate, lower(coalesce(substr(turn, 1, 1), '')) as turn1, coalesce(rating, 0) as rating, own_adj, empty_adj, edge, corner, shelter, coalesce(material, 0) as material,
  {chars("coalesce(pocket, '')")} as pockets, case when dynm <> '' then dynm else summ end as mating, case when named <> '' then list_distinct(string_split(named, '')) else dropped end as dset,
  {chars("cage")} as cages, {chars("net")} as nets, {parts("kline")} as klines, {parts("kcheck")} as kchecks, {chars("coop")} as coops, {number("disp")} as dispn, {number("sline")} as slinen,
  {number("spiece")} as spiecen, {number("ssq")} as ssqn
  from t join l using (k) join aside using (k) left join views on i = fi and side = case when lower(coalesce(turn, '')) like 'b%' then 'b' else 'w' end),
p as (select c.k, q, c from r as q join r as c on c.k = q.k + 1)"""

    def both(f):
        return lambda n, *a: f(f"q.{n}", f"c.{n}", *a)

    shared = lambda a, b: f"len(list_intersect({a}, {b}))"
    union = lambda a, b: f"len(list_distinct(list_concat({a}, {b})))"
    jac = both(lambda a, b, empty=0: f"case when {union(a, b)} > 0 then {shared(a, b)} / {union(a, b)} else {empty} end")
    ovl = both(lambda a, b: f"case when least(len({a}), len({b})) > 0 then {shared(a, b)} / least(len({a}), len({b})) else 0 end")
    count = lambda x, y: f"len(list_filter({x}, lambda y: y = {y}))"

    def multiset(a: str, b: str) -> str:
        def total(f: str) -> str:
            return f"list_sum(list_transform(list_distinct(list_concat({a}, {b})), lambda x: {f}({count(a, 'x')}, {count(b, 'x')})))"

        return f"case when len({a}) + len({b}) > 0 then {total('least')} / {total('greatest')} else 0.5 end"

    ms = both(multiset)
    yes = lambda x: f"case when {x} then 1 else 0 end"
    alike = both(lambda a, b: yes(f"{a} = {b}"))
    tri = both(lambda a, b: f"case when {a} = '' or {b} = '' then 0.5 when {a} = {b} then 1 else 0 end")
    edits = both(lambda a, b: f"case when {a} = '' and {b} = '' then 1 when {a} = '' or {b} = '' then 0 else 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) end")
    sign = both(lambda a, b: f"case when {a} is null or {b} is null then 0.5 else {yes(f'({a} > 0) = ({b} > 0)')} end")
    apart = both(lambda a, b: f"abs({a} - {b})")
    agree = lambda names, have: f"case when q.{have} is not null and c.{have} is not null then ({' + '.join(alike(n) for n in names)}) / {len(names)} else 0.5 end"
    pic, km = "q.pic <> '' and c.pic <> ''", "len(q.klines) + len(q.kchecks) > 0 and len(c.klines) + len(c.kchecks) > 0"
    within = lambda have, x, other="0.5": f"case when {have} then {x} else {other} end"
    out = {}
    for f in tx.FAMILIES:
        out |= {f"jac_{f}": jac(f"fam_{f}"), f"ovl_{f}": ovl(f"fam_{f}"), f"nshare_{f}": both(shared)(f"fam_{f}")}
    out |= {"jac_all": jac("every"), "move_lev": edits("moves"), "pvlen_q": "q.size", "pvlen_diff": apart("size"), "mating_match": tri("mating"), "first_match": tri("first")}
    out |= {"drop_jac": jac("dset", 0.5), "captured_jac": jac("captured", 0.5), "captured_msjac": ms("captured")}
    out |= {f"capt_{x}_match": yes(f"list_contains(q.captured, '{x}') = list_contains(c.captured, '{x}')") for x in "QRBNP"}
    dropped = lambda s: f"({s}.mate_drop or coalesce({s}.s_ends, false))"
    out |= {
        "cappair_jac": jac("cappair", 0.5), "attack_jac": jac("attack", 0.5), "attack_ovl": ovl("attack"), "moved_jac": jac("moved", 0.5), "promo_match": yes("(q.promo or q.eq) = (c.promo or c.eq)"),
        "player_cap_match": sign("own"), "opp_cap_match": sign("other"), "drops_diff": apart("n_drops"), "drop_count_match": alike("n_drops"), "drop_check_match": alike("drop_check"),
        "drop_sac_match": alike("drop_sac"), "mate_drop_match": yes(f"{dropped('q')} = {dropped('c')}"), "drop_near_king_match": alike("near"), "pocket_jac": ms("pockets"),
        "pocket_size_diff": "abs(len(q.pockets) - len(c.pockets))", "mate_diff": apart("mate"), "turn_match": yes("q.turn1 <> '' and q.turn1 = c.turn1"), "movetype_sim": edits("codes"),
        "mech_match": agree(["s_ends", "s_drops", "s_checks", "s_caps", "s_first"], "s_first"), "king_box_sim": agree(["own_adj", "empty_adj", "edge", "corner"], "own_adj"), "sac_match": sign("loss"),
        "king_shelter_sim": "coalesce(1 - abs(q.shelter - c.shelter) / 8, 0.5)", "board_material_diff": "abs(q.material - c.material) / 10", "rating_absdiff": "abs(q.rating - c.rating) / 1000",
        "fb_same_mate_sq": yes("q.king = c.king"), "fb_same_mate_rank": yes("q.king // 8 = c.king // 8"), "fb_same_mate_file": yes("q.king % 8 = c.king % 8"), "fb_same_matepiece_sq": yes("q.sq = c.sq"),
        "fb_capsq_jac": jac("caps"), "fb_checker_jac": jac("checkers"),
    }
    cells = "list_sum(list_transform(range(1, 10), lambda i: case when substr(q.pic, i, 1) = substr(c.pic, i, 1) then 1 else 0 end)) / 9"
    out |= {
        "mp_pic_match": within(pic, alike("pic")), "mp_pic_cellsim": within(pic, cells), "mp_region_match": within(pic, alike("region")), "mp_checker_match": within(pic, tri("checker")),
        "mp_smother_match": within(pic, alike("smother")), "mp_both_smother": within(pic, yes("q.smother and c.smother"), "0"), "mp_cage_sim": within(pic, ms("cages")), "mp_net_sim": within(pic, ms("nets")),
        "km_line_seq_match": within(km, alike("klines")), "km_checker_seq_match": within(km, alike("kchecks")), "km_line_jac": within(km, ms("klines")), "km_checker_jac": within(km, ms("kchecks")),
        "km_disp_sim": within(km, "1 - least(abs(q.dispn - c.dispn), 7) / 7"), "km_sameline_match": within(km, alike("slinen")), "km_samepiece_match": within(km, alike("spiecen")),
        "km_samesquare_match": within(km, alike("ssqn")), "km_coop_sim": within(km, ms("coops")), "km_drop_mate_match": within(km, alike("by_drop")),
    }
    return f"{record}\nselect k, " + ",\n".join(f"round(cast({x} as double), 6) as {n}" for n, x in out.items()) + " from p"


#: More tokens, of what features are named by.
NAMED_TOKENS = (
    ("static", f"{letter('wb', 'a')} || 'pocket:' || {letter('QRBNP', 'b')}", "c % 2 = 0"), ("static", f"{letter('Qn', 'a')} || {letter('<=', 'b')} || {letter('pR', 'c')} || {square('a')}", "true"),
    ("static", f"case when c % 3 = 0 then chr(39) else '' end || {letter('IfLs', 'd')} || {square('b')}", "true"), ("static", f"{letter('Ww', 'd')} || '[' || {square('a')} || '/' || {square('b')} || ']'", "c % 3 = 0"),
    ("static", f"{letter('Pp', 'c')} || '(' || cast(a % 4 as varchar(2)) || ')'", "true"), ("dynamic", f"'pv:dropSq:' || {square('b')}", "c < 3"),
    ("dynamic", f"'dyn:capPieceTotal:' || {letter('QRB', 'a')} || cast(b % 4 as varchar(2))", "c % 2 = 0"), ("dynamic", f"'sum:pocketGain:' || {letter('NP', 'b')} || cast(a % 3 as varchar(2))", "c % 2 = 1"),
    ("dynamic", choice("a", "dyn:hasMate", "dyn:hasDrop", "pv:drop", "dyn:oppCaptures", "pv:mate", "sum:hasSacrifice"), "true"), ("dynamic", f"'dyn:drops:' || {choice('b', '0', '1', '2', '3plus')}", "n = 1"),
    ("dynamic", f"'dyn:pvLen:' || {choice('d', 'short', 'med', 'long')}", "n = 2"),
)


def token_features(spark: SparkSession, sf: str) -> DataFrame:
    """(k, feature, value) of every order's tokens."""
    rows = spark.sql(LINE.format(lineitem="{lineitem}"), lineitem=table(spark, sf, "lineitem"))
    token = F.array(*[F.when(F.expr(when), F.struct(F.lit(part).alias("part"), F.expr(text).alias("token"))) for part, text, when in (*TOKENS, *NAMED_TOKENS)])
    per = rows.select("k", F.filter(token, lambda t: t.isNotNull()).alias("t")).groupBy("k").agg(F.flatten(F.collect_list("t")).alias("t"))
    of = lambda name: F.transform(F.filter("t", lambda t: t["part"] == name), lambda t: t["token"])
    out = features.long_features(per.select("k", of("static").alias("s"), of("dynamic").alias("d")), "k", "s", "d")
    return out.withColumn("value", F.round("value", 6))


def _token_sql() -> str:
    tokens = " union all ".join(f"select k, '{part}' as part, {text} as token from lines where {when}" for part, text, when in (*TOKENS, *NAMED_TOKENS))
    case = lambda x: f"case when {x} = upper({x}) then 'white' else 'black' end"
    side = "case when token like 'w%' then 'white' else 'black' end"
    first = "substr(token, 1, 1)"
    mark = "substr(ltrim(token, chr(39)), 1, 1)"
    # (condition, feature, value, whether values add up)
    static = [
        ("regexp_matches(token, '^[wb][KQRBNPkqrbnp]@[a-h][1-8]')", f"{side} || '_' || lower(substr(token, 2, 1)) || '_count'", "1", True),
        ("regexp_matches(token, '^[wb][Kk]@[a-h][1-8]')", f"{side} || '_king_rank'", "cast(substr(token, 5, 1) as double)", False),
        ("regexp_matches(token, '^[wb][Kk]@[a-h][1-8]')", f"{side} || '_king_file'", "ascii(substr(token, 4, 1)) - 96", False),
        ("regexp_matches(token, '^[wb]pocket:[QRBNP]$')", f"'PK_' || {side} || '_' || token[-1]", "1", True),
        ("regexp_matches(token, '^[A-Za-z][<>=][A-Za-z][a-h][1-8]$')", f"{case(first)} || case substr(token, 2, 1) when '>' then '_attacks' when '<' then '_defends' else '_xrays' end", "1", True),
        (
            "regexp_matches(token, '^\\x27?[IiFfLlSs][a-h][1-8]$')",
            f"{case(mark)} || case when ascii(token) = 39 then '_protected_' else '_' end || case upper({mark}) when 'I' then 'isolated' when 'F' then 'passed' when 'L' then 'backward' else 'doubled' end", "1", True,
        ),
        ("regexp_matches(token, '^[Ww]\\[')", f"{case(first)} || '_pawn_chain'", "len(string_split(token, '/'))", True),
        ("regexp_matches(token, '^[Pp]\\([0-9]+\\)$')", f"{case(first)} || '_pawn_islands'", "cast(regexp_extract(token, '[0-9]+') as double)", False),
    ]
    starts = lambda p: f"starts_with(token, '{p}')"
    dynamic = [(f"token = '{t}'", f"'{f}'", "1", False) for t, f in features.FLAGS.items()]
    dynamic += [(starts(p), f"'{f}' || substr(token, {len(p) + 1})", "1", False) for p, f in features.PREFIXES.items()]
    dynamic += [(starts("dyn:mateDrop:"), "'DG_!F_mateByDrop'", "1", False), (starts("dyn:dropPieces:"), "'dyn_dropHas_' || unnest(string_split(substr(token, 16), ''))", "1", False)]
    dynamic += [(starts(p), f"'{f}' || substr(token, {len(p) + 1}, 1)", f"cast(substr(token, {len(p) + 2}, 1) as double)", True) for p, f in features.COUNTED.items()]
    zone = "case when token[-1] in ('1', '8') then 'back_rank' when token[-2] between 'e' and 'h' then 'kingside' else 'queenside' end"
    dynamic.append((starts("pv:dropSq:"), f"'DS_!drop_sq_zone_' || {zone}", "1", False))
    rows = [f"select k, {f} as feature, cast({v} as double) as value, {str(s).lower()} as summed from st where {c}" for c, f, v, s in static]
    rows += [f"select k, {f}, cast({v} as double), {str(s).lower()} from dy where {c}" for c, f, v, s in dynamic]
    return f"""with mv as ({LINE.format(lineitem="lineitem")}), lines as (select * from mv), tok as ({tokens}),
st as (select * from tok where part = 'static'), dy as (select distinct * from tok where part = 'dynamic'), x as ({" union all ".join(rows)})
select k, feature, round(case when bool_or(summed) then sum(value) else max(value) end, 6) as value from x group by all"""


QUERIES = {"pair_features": (pair_features, _sql()), "token_features": (token_features, _token_sql())}
