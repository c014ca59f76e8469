import pytest
from pyspark.sql import functions as F

from gleaner.functions import fen as fn
from gleaner.functions import text as tx
from gleaner.operators import board as bd
from gleaner.operators import features, pairs, static_similarity
from gleaner.replay import lines, udf
from gleaner.replay.board import Board, Move, perft

# Published counts of legal moves of standard chess positions.
PERFT = [
    ("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", 3, 8902), ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", 2, 191),
    ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", 1, 48), ("rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8", 1, 44),
]


@pytest.mark.parametrize("fen,depth,count", PERFT)
def test_move_generation(fen, depth, count):
    assert perft(Board.parse(fen), depth) == count


def play(*moves, fen=None):
    board = Board.parse(fen) if fen else Board.start()
    for m in moves:
        board.push(board.uci(m))
    return board


def test_pockets_promotions_and_drops():
    board = play("e2e4", "d7d5", "e4d5", "d8d5")
    assert board.fen().startswith("rnb1kbnr/ppp1pppp/8/3q4/8/8/PPPP1PPP/RNBQKBNR[Pp] w")
    board = play("a7a8q", fen="8/P6k/8/8/8/8/7K/1r6 w - - 0 1")
    assert 56 in board.promoted and "Q~" in board.fen()
    board = play("a7a8q", "b1b8", "h2h3", "b8a8", fen="8/P6k/8/8/8/8/7K/1r6 w - - 0 1")
    assert board.pockets[False] == {"P": 1}  # a promoted queen is a pawn again
    board = Board.parse("4k3/8/8/8/8/8/8/4K3[Pn] w - - 0 1")
    assert not any(m.drop and m.dst // 8 in (0, 7) for m in board.legal()) and board.is_legal(Move.parse("P@e7"))
    with pytest.raises(ValueError):
        board.uci("N@e4")
    board.push(board.uci("P@e7"))
    assert board.cells[52] == "P" and not board.pockets[True]["P"]


def test_castling_and_en_passant():
    fen = "r3k2r/8/8/8/8/8/8/R3K2R w KQkq - 0 1"
    assert play("e1g1", fen=fen).fen().split("[")[0].endswith("R4RK1") and play("e1c1", "e8g8", fen=fen).fen().startswith("r4rk1/")
    assert play("e1c1", fen=fen).rights == "kq" == play("e1e2", fen=fen).rights and play("a1a8", fen=fen).rights == "Kk"
    with pytest.raises(ValueError):
        play("e1c1", "e8c8", fen=fen)  # through a square that is attacked
    board = play("e2e4", "a7a6", "e4e5", "d7d5")
    assert board.takes(board.uci("e5d6")) == "P" and play("e2e4", "a7a6", "e4e5", "d7d5", "e5d6").cells[35] == ""


def test_drops_can_parry_a_mate():
    back = "6k1/5ppp/8/8/8/8/8/R5K1[{}] w - - 0 1"
    assert play("a1a8", fen=back.format("")).is_checkmate() and not play("a1a8", fen=back.format("n")).is_checkmate()


def test_san_both_ways():
    board = Board.parse("r3k2r/8/8/8/1N3N2/8/8/4K3[P] w - - 0 1")
    for text in ("Nbd5", "Nfd5", "Nb4d5"):
        assert board.from_san(text).dst == 35
    for move in list(board.legal()):
        assert board.from_san(board.san(move)) == move
    with pytest.raises(ValueError):
        board.from_san("Nd5")
    assert board.san(Move.parse("P@e4")) == "@e4"


@pytest.mark.parametrize("bad", ["", "8/8/8", "9/8/8/8/8/8/8/8", "x7/8/8/8/8/8/8/8"])
def test_bad_positions_raise(bad):
    with pytest.raises(ValueError):
        Board.parse(bad)


def test_fen_round_trip():
    for fen in ("r3k2r/8/8/8/8/8/8/R3K2R[QNpp] b Kq - 0 1", "4k3/8/8/8/8/8/8/Q~3K3[] w - - 0 1"):
        assert Board.parse(fen).fen() == fen
    assert Board.parse("4k3/8/8/8/8/8/8/4K3/Pn b").fen() == "4k3/8/8/8/8/8/8/4K3[Pn] b - - 0 1"


SMOTHERED = {"fen": "6rk/6pp/8/4N3/8/8/8/K7[] w - - 0 1", "solution_uci": ["e5f7"], "turn": "white"}


def test_tokens_of_a_smothered_mate():
    got = lines.dynamic_tokens(SMOTHERED)
    assert {"pv:pieceMoved:N", "pv:attack:N>K", "pv:mate", "dyn:mating_piece:N", "dyn:hasMate", "dyn:noDrop", "dyn:first:mate", "dyn:pvLen:short", "sum:mating_piece:N"} <= set(got)
    motif = lines.motif_tokens(SMOTHERED)
    assert "mate:smother" in motif and "mate:region:corner" in motif and "mate:checker:N" in motif and "km:line:knight" in motif
    assert [t for t in motif if t.startswith("mate:cage:")] == ["mate:cage:PPR"]


def test_pictures_ignore_colour_and_corner():
    black = {"fen": "k7/8/8/8/4n3/8/6PP/6RK[] b - - 0 1", "solution_uci": ["e4f2"]}
    left = {"fen": "kr6/pp6/8/3N4/8/8/8/7K[] w - - 0 1", "solution_uci": ["d5c7"]}
    forms = {next(t for t in lines.motif_tokens(r) if t.startswith("mate:pic:")) for r in (SMOTHERED, black, left)}
    assert len(forms) == 1


def test_starts_and_failures():
    assert lines.dynamic_tokens({}) == ["dyn:start_fail:missing_startpos"]
    assert lines.dynamic_tokens({"uci_moves": ["e2e5"]}) == ["dyn:start_fail:uci_replay_fail:ValueError"]
    assert lines.dynamic_tokens({"uci_moves_prefix": ["zz"]}) == ["dyn:start_fail:prefix_fail:ValueError"]
    board = lines.event_board({"uci_moves": ["e2e4", "e7e5", "g1f3"], "ply": 3})
    assert board.white and board.cells[5 + 16] == ""
    got = lines.dynamic_tokens({"uci_moves": [], "solution_uci": ["e2e4", "--", "e7e6", "a1a8"], "bestmove_before": "d2d4"})
    assert "dyn:pv_parse_fail:e2e4" in got  # the best move goes first, so that it is white's move no more
    got = lines.dynamic_tokens({"uci_moves": [], "solution_uci": ["e2e4", "--", "e7e6", "a1a8"]})
    assert got.count("dyn:pv_skip") == 1 and "dyn:pv_parse_fail:a1a8" in got


def test_line_statistics():
    got = lines.line_stats(Board.parse("4k3/8/8/3p4/4P3/8/8/4K3[N] w - - 0 1"), ["e4d5", "e8d7", "N@e5", "zz"])
    assert got["actions"] == ["Mx", "M", "D+", "M"] and got["drops"] == 1 and got["own_captures"] == 1 and got["loss"] == 0.0 and got["checkers"] == ["N"]
    assert lines.line_stats(None, ["N@e5", "e7e8q"])["actions"] == ["D", "M="] and lines.line_stats(None, ["a"])["loss"] is None


def test_check_lines_and_runs():
    assert [lines.check_line(0, s) for s in (1, 9, 16, 2, 18, 10, 17, 0, 37)] == ["adjacent", "adjacent", "file", "rank", "diag", "knight", "knight", "other", "other"]
    assert lines.longest_run([1, 1, 2, 2, 2, 1]) == 3 and lines.longest_run([]) == 0


def test_mates_are_searched():
    found = udf.MateSearch(3).find_mate("7k/8/5K2/6Q1/8/8/8/8[] w - - 0 1")
    assert lines.until_mate(Board.parse("7k/8/5K2/6Q1/8/8/8/8[] w - - 0 1"), found)
    assert udf.MateSearch(1).find_mate("7k/8/8/8/8/8/8/K7[] w - - 0 1") is None


def test_board_tokens_of_a_known_position(spark):
    df = spark.createDataFrame([(1, "4k3/8/8/3p4/2P1P3/8/8/R3K2R")], "id long, fen string")
    got = {r.token for r in bd.static_tokens(bd.exploded(df, "id", F.col("fen"))).collect()}
    assert {"wr@a1", "bk@e8", "P>pd5", "p>Pc4", "p>Pe4", "R<Ke1", "R=Rh1", "R=Ra1", "K<Ra1"} - got == {"K<Ra1"}
    assert {"Ic4", "Ie4", "id5", "P(2)", "p(1)"} <= got


def test_positions_without_pawns(spark):
    df = spark.createDataFrame([(1, "4k3/8/8/8/8/8/8/4K3")], "id long, fen string")
    assert sorted(r.token for r in bd.pawn_tokens(bd.exploded(df, "id", F.col("fen"))).collect()) == ["P(0)", "p(0)"]


# Fixed cases: a position against itself, the other side to move, the first position, a like one and an end game.
REFERENCE = ("r3kbnr/1pp2ppp/p1p2q2/4p3/4P3/2NP1B2/PPP2PRp/R1BQK3", "black", ["B", "N", "P"], [])
CASES = [
    (REFERENCE, 0.9550, 1), (("r3kbnr/1pp2ppp/p1p2q2/4p3/4P3/2NP1B2/PPP2PRp/R1BQK3", "white", ["B", "N", "P"], []), 0.7560, 1),
    (("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR", "white", [], []), 0.6280, 0),
    (("r3kbnr/1pp2ppp/p1p2q2/4p3/4P3/2NP1B2/PPP2P1p/R1BQK2R", "black", ["N", "P"], []), 0.9383, 1), (("6k1/5ppp/8/8/8/8/5PPP/6K1", "black", [], []), 0.3484, 0),
]


def test_static_similarity_cases(spark):
    rows = [(i, *REFERENCE, *c, s, y) for i, (c, s, y) in enumerate(CASES)]
    kind = "{0}_fen string, {0}_turn string, {0}_white array<string>, {0}_black array<string>"
    df = spark.createDataFrame(rows, f"i int, {kind.format('q')}, {kind.format('c')}, want double, label int")
    for s in "qc":
        df = df.withColumn(s, static_similarity.profile(*[F.col(f"{s}_{c}") for c in ("fen", "turn", "white", "black")]))
    score = static_similarity.similarity(F.col("q"), F.col("c"))
    for r in df.withColumn("score", score).withColumn("got", static_similarity.label(F.col("score"))).collect():
        assert r.score == pytest.approx(r.want, abs=1e-4) and r.got == r.label


def test_pair_features_of_a_record_with_itself(spark):
    df = spark.createDataFrame([(1, SMOTHERED["fen"], SMOTHERED["solution_uci"], lines.dynamic_tokens(SMOTHERED) + lines.motif_tokens(SMOTHERED))], "i int, fen string, uci array<string>, dyn array<string>")
    df = df.withColumn("stats", udf.line_stats("fen", "uci"))
    given = {"static": F.array(F.lit("wn@e5")), "dynamic": F.col("dyn"), "solution_uci": F.col("uci"), "mate": F.lit(1), "turn": F.lit("white"), "fen": F.col("fen"), "stats": F.col("stats")}
    p = df.select(pairs.profile(pairs.record(**given)).alias("q"), pairs.profile(pairs.record(**given)).alias("c"), pairs.profile(pairs.record()).alias("n"))
    found = pairs.features(F.col("q"), F.col("c"))
    got = p.select(*[c.cast("double").alias(n) for n, c in found.items()]).first().asDict()
    assert len(got) == 89 == len(pairs.feature_names()) and len(pairs.feature_names(pairs.BASIC_FAMILIES)) == 65
    assert list(got)[:4] == ["jac_placement", "ovl_placement", "nshare_placement", "jac_relation"] and list(got)[-1] == "km_drop_mate_match"
    ones = [n for n in got if n.endswith(("_match", "_sim", "cellsim")) and n not in ("sac_match",)]
    assert all(got[n] == 1.0 for n in ones), {n: got[n] for n in ones if got[n] != 1.0}
    assert got["mp_both_smother"] == 1.0 and got["fb_same_mate_sq"] == 1.0 and got["jac_mate"] == 1.0 and got["pocket_jac"] == 0.5
    blank = p.select(*[c.cast("double").alias(n) for n, c in pairs.features(F.col("n"), F.col("n")).items()]).first().asDict()
    assert blank["jac_all"] == 0.0 and blank["move_lev"] == 1.0 and blank["drop_jac"] == 0.5 and blank["mp_pic_match"] == 0.5 and blank["king_shelter_sim"] == 0.5


def test_features_by_name(spark):
    tokens = ["wk@e1", "wp@a2", "wp@b3", "wpocket:N", "B>pg7", "q=Ra1", "Ia2", "'Fb3", "W[a2/b3]", "P(2)"]
    moves = ["pv:drop", "pv:drop", "pv:dropSq:h3", "dyn:capPieceTotal:P2", "dyn:mateDrop:Q", "dyn:dropPieces:NQ", "pv:attack:Q>K", "sum:pocketGain:P3"]
    df = spark.createDataFrame([(1, tokens, moves)], "i int, s array<string>, d array<string>")
    got = {r.feature: r.value for r in features.long_features(df, "i", "s", "d").collect()}
    assert got == {
        "white_k_count": 1, "white_king_rank": 1, "white_king_file": 5, "white_p_count": 2, "PK_white_N": 1, "white_attacks": 1, "black_xrays": 1, "white_isolated": 1,
        "white_protected_passed": 1, "white_pawn_chain": 2, "white_pawn_islands": 2, "DS_!drop": 1, "DS_!drop_sq_zone_kingside": 1, "DS_!capTotal_P": 2,
        "DG_!mateDrop_Q": 1, "DG_!F_mateByDrop": 1, "dyn_dropPieces_NQ": 1, "dyn_dropHas_N": 1, "dyn_dropHas_Q": 1, "DS_!attack_Q>K": 1, "sum_pocketGain_P": 3,
    }
    wide = features.wide(features.long_features(df, "i", "s", "d"), "i", [f"PK_{s}_{p}" for s in ("white", "black") for p in features.PIECES] + ["white_p_count"])
    row = features.pocket_totals(wide, F.lit("black")).first()
    assert (row.PK_total_white, row.PK_total_solver, row.PK_total_opponent, row.white_p_count) == (1, 0, 1, 2)


def test_position_features(spark):
    df = spark.createDataFrame([("4k3/8/8/3p4/2P1P3/4P3/8/R3K3/Qp",)], "fen string")
    got = df.select(features.board_features(F.col("fen")).alias("m")).first().m
    want = {"w_P_count": 3, "w_doubled_pawns": 1, "w_isolated_pawns": 3, "w_passed_pawns": 0, "b_passed_pawns": 0, "pawn_tension": 2, "w_material": 8, "w_pocket_material": 9, "w_king_file": 5, "total_pawns": 4, "w_pawn_center": 2}
    assert {k: got[k] for k in want} == want


def test_cluster_names(spark):
    means = F.create_map(*[F.lit(x) for p in {"dyn_first_drop": 0.6, "dyn_first_mate": 0.4, "DG_!F_drop": 0.9, "PK_total_solver": 3.0, "dyn_pvLen_short": 0.7, "dyn_dropHas_N": 0.5}.items() for x in p])
    assert spark.range(1).select(features.cluster_name(means).alias("n")).first().n == "first:drop | hasDrop | pocket>3.0 | shortMate | dropsN"


def test_corpus_of_puzzles(spark):
    from gleaner.plans import puzzles

    rows = {r.event_id: r for r in puzzles.records(spark).collect()}
    assert len(rows) == 4
    r = rows["smothered_mate5"]
    assert r.solution_san[-1] == "Nd6#" and r.text_all["dyn:hasMate"] == 3 and r.text_all["pv:mate"] == 2 and set(r.text_motif) <= set(r.text_dynamic)
    assert spark.createDataFrame([(r.fen,)], "f string").select(fn.is_valid(F.col("f")).alias("v")).first().v
    assert all(t for t in r.text_static) and spark.createDataFrame([(r.text_static,)], "t array<string>").select(F.size(tx.of_family(F.col("t"), "relation")).alias("n")).first().n > 10


STUB = """#!{python}
import sys
for line in sys.stdin:
    word = line.split()[:1]
    if word == ["uci"]:
        print("id name stub\\nuciok", flush=True)
    elif word == ["isready"]:
        print("readyok", flush=True)
    elif word == ["position"]:
        fen = line.split("fen ")[1]
    elif word == ["go"]:
        if "4k3/8" in fen:
            sys.exit(3)
        kind = "mate 1" if fen.startswith("6k1/5ppp") else "cp -31"
        print("info depth 1 score cp 5 pv a1a2\\ninfo depth 9 score " + kind + " pv a1a8\\nbestmove a1a8", flush=True)
    elif word == ["quit"]:
        break
"""


def test_uci_engine_over_a_stub_process(spark, tmp_path):
    import sys

    from gleaner.replay import udf

    binary = tmp_path / "engine"
    binary.write_text(STUB.replace("{python}", sys.executable))
    binary.chmod(0o755)
    back_rank, quiet, broken = "6k1/5ppp/8/8/8/8/8/R5K1[] w - - 0 1", "6k1/8/8/8/8/8/8/R5K1[] w - - 0 1", "4k3/8/8/8/8/8/8/R5K1[] w - - 0 1"
    engine = udf.UciEngine(str(binary), {"Threads": 1}, movetime_ms=10)
    assert engine.analyse(back_rank) == {"cp": None, "mate": 1, "pv": ["a1a8"]} and engine.find_mate(back_rank) == ["a1a8"]
    assert engine.analyse(quiet) == {"cp": -31, "mate": None, "pv": ["a1a8"]} and engine.find_mate(quiet) is None
    engine.close()
    assert engine.process.returncode == 0
    puzzles = spark.createDataFrame([("p1", back_rank), ("p2", quiet), ("p3", broken), ("p4", back_rank)], "event_id string, fen string").coalesce(1)
    found = {r.event_id: (r.solution_uci, r.solution_san) for r in udf.verified(puzzles, lambda: udf.UciEngine(str(binary)), plies=1).collect()}
    assert found == {"p1": (["a1a8"], ["Ra8#"]), "p4": (["a1a8"], ["Ra8#"])}


def test_finished_positions_are_left_out(spark):
    from gleaner.operators import filters

    fens = ["6k1/5ppp/8/8/8/8/8/R5K1[] w - - 0 1", "R5k1/5ppp/8/8/8/8/8/6K1[] b - - 0 1", "7k/5Q2/6K1/8/8/8/8/8[] b - - 0 1", "nonsense", None]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(fens)], "i int, fen string")
    assert [r.i for r in filters.unfinished(rows).collect()] == [0]
