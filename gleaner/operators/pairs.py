"""Features of (query, candidate) pairs as column expressions.

A record has static and dynamic (token arrays), solution_uci, mate, turn,
rating, fen, pockets (sorted letters of the side to move) and stats (what a
replay of its line showed). What a feature needs of one side is computed once
per record, as its profile; pairs then compare profiles. So neither Python nor
token parsing runs per pair.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fen as fn
from ..functions import similarity as sim
from ..functions import text as tx

def record(**columns: Column) -> Column:
    """The struct of a record from columns; what isn't given is null or empty."""
    kinds = {
        "static": "array<string>", "dynamic": "array<string>", "solution_uci": "array<string>", "mate": "int", "turn": "string", "rating": "double",
        "fen": "string", "pockets": "array<string>",
        "stats": "struct<actions:array<string>,drops:int,loss:double,own_captures:int,other_captures:int,mate_king:int,mate_square:int,capture_squares:array<int>,checkers:array<string>>",
    }
    lists = {"static", "dynamic", "solution_uci"}
    out = []
    for name, kind in kinds.items():
        c = columns.get(name, F.lit(None)).cast(kind)
        out.append((F.coalesce(c, F.array().cast(kind)) if name in lists else c).alias(name))
    return F.struct(*out)


# --- what tokens say


def after(tokens: Column, prefix: str) -> Column:
    """What follows ``prefix`` in the first token, by order, that has it; empty if none."""
    return F.coalesce(F.get(tx.suffixes(F.array_sort(tokens), prefix), 0), F.lit(""))


def mating_piece(tokens: Column) -> Column:
    dyn = after(tokens, "dyn:mating_piece:")
    return F.when(dyn != "", dyn).otherwise(after(tokens, "sum:mating_piece:"))


def first_action(tokens: Column) -> Column:
    return after(tokens, "dyn:first:")


def drop_pieces(tokens: Column) -> Column:
    named = after(tokens, "dyn:dropPieces:")
    return F.when(named != "", F.array_distinct(sim.letters(named))).otherwise(F.array_distinct(tx.suffixes(tokens, "pv:dropPiece:")))


def _text_after(tokens: Column, prefix: str, none: str) -> Column:
    """As ``after`` with the case kept, and ``none`` read as empty."""
    found = F.get(F.filter(tokens, lambda t: t.startswith(prefix)), 0)
    value = F.substring(found, len(prefix) + 1, 10_000)
    return F.when(found.isNull() | (value == none), F.lit("")).otherwise(value)


def picture(tokens: Column) -> dict[str, Column]:
    """The mating picture that mate: tokens hold; pic is empty without one."""
    return {
        "pic": _text_after(tokens, "mate:pic:", ""), "region": _text_after(tokens, "mate:region:", ""), "checker": _text_after(tokens, "mate:checker:", "?"),
        "cage": _text_after(tokens, "mate:cage:", "none"), "net": _text_after(tokens, "mate:net:", "none"), "smother": F.array_contains(tokens, "mate:smother"),
    }


def march(tokens: Column) -> dict[str, Column]:
    """The king march that km: tokens hold."""
    def steps(prefix: str) -> Column:
        text = _text_after(tokens, prefix, "none")
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "-"))

    def number(prefix: str) -> Column:
        return F.coalesce(_text_after(tokens, prefix, "").try_cast("int"), F.lit(0))

    return {
        "lines": steps("km:line:"), "checkers": steps("km:checkers:"), "disp": number("km:disp:"), "same_line": number("km:sameline:"),
        "same_piece": number("km:samepiece:"), "same_square": number("km:samesquare:"), "coop": _text_after(tokens, "km:coop:", "none"),
        "by_drop": F.array_contains(tokens, "km:matebydrop"),
    }


def yes(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def picture_features(q: Column, c: Column) -> dict[str, Column]:
    """0.5 each, and 0 for both being smothered, unless both sides have a picture."""
    have = (q["pic"] != "") & (c["pic"] != "")
    neutral = lambda x, other=0.5: F.when(have, x).otherwise(F.lit(other))
    return {
        "mp_pic_match": neutral(yes(q["pic"] == c["pic"])), "mp_pic_cellsim": neutral(sim.cell_similarity(q["pic"], c["pic"])),
        "mp_region_match": neutral(yes(q["region"] == c["region"])), "mp_checker_match": neutral(sim.tri_state(q["checker"], c["checker"])),
        "mp_smother_match": neutral(yes(q["smother"] == c["smother"])), "mp_both_smother": neutral(yes(q["smother"] & c["smother"]), 0.0),
        "mp_cage_sim": neutral(sim.multiset_jaccard(sim.letters(q["cage"]), sim.letters(c["cage"]))),
        "mp_net_sim": neutral(sim.multiset_jaccard(sim.letters(q["net"]), sim.letters(c["net"]))),
    }


def march_features(q: Column, c: Column) -> dict[str, Column]:
    """0.5 each unless both sides have checks."""
    def some(m: Column) -> Column:
        return (F.size(m["lines"]) > 0) | (F.size(m["checkers"]) > 0)

    have = some(q) & some(c)
    neutral = lambda x: F.when(have, x).otherwise(F.lit(0.5))
    return {
        "km_line_seq_match": neutral(yes(q["lines"] == c["lines"])), "km_checker_seq_match": neutral(yes(q["checkers"] == c["checkers"])),
        "km_line_jac": neutral(sim.multiset_jaccard(q["lines"], c["lines"])), "km_checker_jac": neutral(sim.multiset_jaccard(q["checkers"], c["checkers"])),
        "km_disp_sim": neutral(1 - F.least(F.abs(q["disp"] - c["disp"]), F.lit(7)) / 7.0), "km_sameline_match": neutral(yes(q["same_line"] == c["same_line"])),
        "km_samepiece_match": neutral(yes(q["same_piece"] == c["same_piece"])), "km_samesquare_match": neutral(yes(q["same_square"] == c["same_square"])),
        "km_coop_sim": neutral(sim.multiset_jaccard(sim.letters(q["coop"]), sim.letters(c["coop"]))), "km_drop_mate_match": neutral(yes(q["by_drop"] == c["by_drop"])),
    }


def signature(actions: Column) -> Column:
    """How a line is built, regardless of order: a map of small numbers, empty without moves."""
    def count(test) -> Column:
        return F.least(F.size(F.filter(actions, test)), F.lit(2)).cast("string")

    last = F.element_at(actions, -1)
    made = F.create_map(
        F.lit("ends_drop_mate"), (last.startswith("D") & last.contains("#")).cast("string"), F.lit("drops"), count(lambda a: a.startswith("D")),
        F.lit("checks"), count(lambda a: a.contains("+") | a.contains("#")), F.lit("caps"), count(lambda a: a.contains("x")),
        F.lit("first"), F.substring(F.get(actions, 0), 1, 2),
    )
    return F.when(F.size(actions) > 0, made).otherwise(F.create_map().cast("map<string,string>"))


def profile(r: Column, families: tuple[str, ...] = tx.FAMILIES) -> Column:
    """What features need of one record, as a struct.

    Tokens are told apart by family once; what is read several times is bound
    to a lambda's variable, so that the expression stays small.
    """
    tokens = F.concat(r["static"], r["dynamic"])
    told = F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("t"), tx.family(t).alias("f")))
    base = F.struct(
        told.alias("told"), r["dynamic"].alias("dynamic"), r["solution_uci"].alias("solution_uci"), r["stats"].alias("stats"), r["turn"].alias("turn"),
        r["fen"].alias("fen"), r["pockets"].alias("pockets"), r["mate"].alias("mate"), r["rating"].alias("rating"),
        F.coalesce(r["stats"]["actions"], F.array().cast("array<string>")).alias("actions"),
    )
    lined = F.struct(base.alias("r"), F.transform(F.filter(base["told"], lambda e: e["f"].isin("pv", "dyn", "sum")), lambda e: e["t"]).alias("lined"))
    return F.transform(F.array(lined), lambda x: _profile(x["r"], x["lined"], families))[0]


def _profile(r: Column, lined: Column, families: tuple[str, ...]) -> Column:
    stats, actions = r["stats"], r["actions"]
    last = F.coalesce(F.when(F.size(actions) > 0, F.element_at(actions, -1)), F.lit(""))
    own = F.when(fn.turn(r["turn"]) == "white", fn.pocket_letters(r["fen"], True)).otherwise(fn.pocket_letters(r["fen"], False))
    empty_int, empty_text = F.array().cast("array<int>"), F.array().cast("array<string>")

    def of(name: str) -> Column:
        return F.transform(F.filter(r["told"], lambda e: e["f"] == name), lambda e: e["t"])

    out = {f"fam_{name}": of(name) for name in families} | {
        "all": F.transform(r["told"], lambda e: e["t"]), "uci": r["solution_uci"], "mating": mating_piece(lined), "first": first_action(lined), "drops": drop_pieces(lined),
        "captured": tx.suffixes(lined, "pv:capturePiece:"), "cappair": tx.suffixes(lined, "dyn:capPair:"),
        "attack": F.array_distinct(tx.suffixes(lined, "pv:attack:")), "moved": tx.suffixes(lined, "pv:pieceMoved:"),
        "promo": F.exists(actions, lambda x: x.contains("=")) | tx.has_prefix(lined, "pv:promotion"),
        "drop_check": tx.has_prefix(lined, "dyn:hasDropCheck", "pv:dropCheck"), "drop_sac": tx.has_prefix(lined, "pv:dropSacrifice", "dyn:dropSacrifice"),
        "mate_drop": tx.has_prefix(lined, "dyn:mateDrop") | (last.startswith("D") & last.contains("#")), "near": tx.has_prefix(lined, "dyn:dropNearKing"),
        "actions": actions, "n_drops": F.coalesce(stats["drops"], F.lit(0)), "own_captures": stats["own_captures"], "other_captures": stats["other_captures"],
        "loss": stats["loss"], "mate_king": stats["mate_king"], "mate_square": stats["mate_square"],
        "capture_squares": F.coalesce(stats["capture_squares"], empty_int), "checkers": F.coalesce(stats["checkers"], empty_text),
        "pockets": F.coalesce(r["pockets"], own, empty_text), "mate": F.coalesce(r["mate"], F.lit(0)),
        "turn": F.substring(F.lower(F.coalesce(r["turn"], F.lit(""))), 1, 1), "signature": signature(actions), "box": fn.king_box(r["fen"], r["turn"]),
        "shelter": fn.king_shelter(r["fen"], r["turn"]), "material": fn.material(r["fen"]), "rating": F.coalesce(r["rating"], F.lit(0.0)),
    }
    if "mate" in families:
        out["pic"] = F.struct(*[c.alias(n) for n, c in picture(r["dynamic"]).items()])
    if "km" in families:
        out["km"] = F.struct(*[c.alias(n) for n, c in march(r["dynamic"]).items()])
    return F.struct(*[c.alias(n) for n, c in out.items()])


def features(q: Column, c: Column, families: tuple[str, ...] = tx.FAMILIES) -> dict[str, Column]:
    """All features by name, in their fixed order, of two profiles.

    Profiles should be columns of tables that are joined, not expressions, so
    that each is computed once. Fewer ``families`` leave out theirs, and what
    is read from the tokens of those left out.
    """
    out: dict[str, Column] = {}
    for name in families:
        a, b = q[f"fam_{name}"], c[f"fam_{name}"]
        out |= {f"jac_{name}": sim.jaccard(a, b), f"ovl_{name}": sim.overlap(a, b), f"nshare_{name}": sim.shared(a, b).cast("double")}
    out["jac_all"] = sim.jaccard(q["all"], c["all"])
    out["move_lev"] = sim.edit_similarity(q["uci"], c["uci"])
    out["pvlen_q"] = F.size(q["uci"]).cast("double")
    out["pvlen_diff"] = F.abs(F.size(q["uci"]) - F.size(c["uci"])).cast("double")
    out["mating_match"] = sim.tri_state(q["mating"], c["mating"])
    out["first_match"] = sim.tri_state(q["first"], c["first"])

    def either(name: str) -> Column:
        return sim.jaccard(q[name], c[name], empty=0.5)

    def alike(name: str) -> Column:
        return yes(q[name] == c[name])

    def both(name: str) -> Column:
        known = q[name].isNotNull() & c[name].isNotNull()
        return F.when(known, yes((q[name] > 0) == (c[name] > 0))).otherwise(F.lit(0.5))

    def apart(name: str) -> Column:
        return F.abs(q[name] - c[name]).cast("double")

    out["drop_jac"] = either("drops")
    out["captured_jac"] = either("captured")
    out["captured_msjac"] = sim.multiset_jaccard(q["captured"], c["captured"])
    for piece in "QRBNP":
        out[f"capt_{piece}_match"] = yes(F.array_contains(q["captured"], piece) == F.array_contains(c["captured"], piece))
    out["cappair_jac"] = either("cappair")
    out["attack_jac"] = either("attack")
    out["attack_ovl"] = sim.overlap(q["attack"], c["attack"])
    out["moved_jac"] = either("moved")
    out["promo_match"] = alike("promo")
    out["player_cap_match"] = both("own_captures")
    out["opp_cap_match"] = both("other_captures")
    out["drops_diff"] = apart("n_drops")
    out["drop_count_match"] = alike("n_drops")
    out["drop_check_match"] = alike("drop_check")
    out["drop_sac_match"] = alike("drop_sac")
    out["mate_drop_match"] = alike("mate_drop")
    out["drop_near_king_match"] = alike("near")
    out["pocket_jac"] = sim.multiset_jaccard(q["pockets"], c["pockets"])
    out["pocket_size_diff"] = F.abs(F.size(q["pockets"]) - F.size(c["pockets"])).cast("double")
    out["mate_diff"] = apart("mate")
    out["turn_match"] = yes((q["turn"] != "") & (q["turn"] == c["turn"]))
    out["movetype_sim"] = sim.edit_similarity(q["actions"], c["actions"])
    out["mech_match"] = sim.agreement(q["signature"], c["signature"])
    out["king_box_sim"] = sim.agreement(q["box"], c["box"])
    out["sac_match"] = both("loss")
    out["king_shelter_sim"] = F.coalesce(1 - F.abs(q["shelter"] - c["shelter"]) / 8.0, F.lit(0.5))
    out["board_material_diff"] = apart("material") / 10.0
    out["rating_absdiff"] = apart("rating") / 1000.0
    kq, kc = q["mate_king"], c["mate_king"]
    known = kq.isNotNull() & kc.isNotNull()
    out["fb_same_mate_sq"] = yes(known & (kq == kc))
    out["fb_same_mate_rank"] = yes(known & (F.floor(kq / 8) == F.floor(kc / 8)))
    out["fb_same_mate_file"] = yes(known & (kq % 8 == kc % 8))
    out["fb_same_matepiece_sq"] = yes(q["mate_square"].isNotNull() & (q["mate_square"] == c["mate_square"]))
    out["fb_capsq_jac"] = sim.jaccard(q["capture_squares"], c["capture_squares"])
    out["fb_checker_jac"] = sim.jaccard(q["checkers"], c["checkers"])
    if "mate" in families:
        out |= picture_features(q["pic"], c["pic"])
    if "km" in families:
        out |= march_features(q["km"], c["km"])
    return out


def feature_names(families: tuple[str, ...] = tx.FAMILIES) -> list[str]:
    """The names in their fixed order."""
    blank = F.struct(F.lit(None).alias("static"))
    return list(features(blank, blank, families))


#: The families of the older feature set.
BASIC_FAMILIES = tuple(f for f in tx.FAMILIES if f not in ("mate", "km"))
