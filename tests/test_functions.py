import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import fen as fn
from gleaner.functions import grids, text
from gleaner.functions import similarity as sim
from gleaner.functions import values as v

ARRAYS = [([], []), ([], ["a"]), (["a", "a", "b"], ["a", "c"]), (["x", "y", "z"], ["x", "z", "y", "y"]), (["a"], ["a"]), (["q"] * 5, ["q"] * 2)]


def plain_edit(a, b):
    rows = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, rows[0] = rows[0], i
        for j, y in enumerate(b, 1):
            last, rows[j] = rows[j], min(rows[j] + 1, rows[j - 1] + 1, last + (x != y))
    return rows[-1]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(1)
    more = [([rng.choice("abcd") for _ in range(rng.randrange(7))], [rng.choice("abcd") for _ in range(rng.randrange(7))]) for _ in range(60)]
    rows = ARRAYS + more
    return rows, spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<string>, b array<string>")


def results(df, **columns):
    got = {r["i"]: r for r in df.select("i", *[c.alias(n) for n, c in columns.items()]).collect()}
    return [got[i] for i in sorted(got)]


def test_set_and_multiset_measures(pairs):
    rows, df = pairs
    a, b = F.col("a"), F.col("b")
    got = results(df, jac=sim.jaccard(a, b), back=sim.jaccard(b, a), ovl=sim.overlap(a, b), n=sim.shared(a, b), ms=sim.multiset_jaccard(a, b))
    for (x, y), r in zip(rows, got):
        sx, sy = set(x), set(y)
        assert r.jac == r.back == pytest.approx(len(sx & sy) / len(sx | sy) if sx | sy else 0.0)
        assert r.ovl == pytest.approx(len(sx & sy) / min(len(sx), len(sy)) if sx and sy else 0.0) and r.n == len(sx & sy)
        low, high = (sum(f(x.count(k), y.count(k)) for k in sx | sy) for f in (min, max))
        assert r.ms == pytest.approx(low / high if high else 0.5)


def test_sequence_measures(pairs):
    rows, df = pairs
    got = results(df, lev=sim.edit_similarity(F.col("a"), F.col("b")), run=sim.longest_run(F.col("a")))
    for (x, y), r in zip(rows, got):
        want = 1.0 if not x and not y else 0.0 if not x or not y else 1 - plain_edit(x, y) / max(len(x), len(y))
        assert r.lev == pytest.approx(want)
        best = run = 0
        for k, c in enumerate(x):
            run = run + 1 if k and x[k - 1] == c else 1
            best = max(best, run)
        assert r.run == best


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_maps_and_states(spark):
    m = lambda d: F.create_map(*[F.lit(x) for p in d.items() for x in p]) if d else F.create_map().cast("map<string,int>")
    assert one(spark, sim.count_similarity(m({"a": 2, "b": 1}), m({"a": 1, "c": 1}))) == pytest.approx(1 - 3 / 4)
    assert one(spark, sim.count_similarity(m({}), m({}))) == 1.0
    assert one(spark, sim.agreement(m({"a": 1, "b": 2}), m({"a": 1, "b": 3, "c": 0}))) == 0.5
    assert one(spark, sim.agreement(m({"a": 1}), m({"b": 1}))) == 0.5 and one(spark, sim.agreement(m({"a": 1}), m({"a": 1}))) == 1.0
    assert [one(spark, sim.tri_state(F.lit(a), F.lit(b).cast("string"))) for a, b in (("x", "x"), ("x", "y"), ("", "y"), ("x", None))] == [1.0, 0.0, 0.5, 0.5]
    assert one(spark, sim.cell_similarity(F.lit("abc/d"), F.lit("abd/d"))) == pytest.approx(0.8)
    assert one(spark, sim.rating_similarity(F.lit(1500), F.lit(1750))) == 0.5 and one(spark, sim.rating_similarity(F.lit(None).cast("int"), F.lit(1))) == 0.5
    assert one(spark, sim.length_similarity(F.lit(3), F.lit(4))) == 0.5


def test_vectors(spark):
    a, b = (F.array(*map(F.lit, x)) for x in ([1.0, -2.0, 0.0], [0.0, 2.0, 3.0]))
    assert one(spark, sim.euclidean(a, b)) == pytest.approx(math.sqrt(26)) and one(spark, sim.binary_jaccard(a, b)) == 0.0
    assert one(spark, sim.difference_vector(a, b)) == [1.0, 4.0, 3.0, 1.0, -2.0, 0.0, 0.0, 2.0, 3.0]


TOKENS = {
    "mate:pic:x": ("mate", "motif"), "km:disp:1": ("km", "motif"), "pv:drop": ("pv", "pv"), "dyn:hasDrop": ("dyn", "dyn"), "sum:hasMate": ("sum", "sum"),
    "wpocket:N": ("pocket", "pocket"), "wn@f3": ("placement", "placement"), "B>pg7": ("relation", "relation"), "Ia2": ("motif", "motif"), "P(2)": ("motif", "motif"),
}


def test_families(spark):
    df = spark.createDataFrame([(t,) for t in TOKENS], "t string")
    got = {r.t: (r.a, r.b) for r in df.select("t", text.family(F.col("t")).alias("a"), text.serve_family(F.col("t")).alias("b")).collect()}
    assert got == TOKENS and one(spark, text.family(F.lit(""))) is None


def test_tokens_and_bags(spark):
    assert one(spark, text.whitespace_tokens(F.lit("  a  B\tc\n"))) == ["a", "B", "c"] and one(spark, text.whitespace_tokens(F.lit(None).cast("string"))) == []
    assert one(spark, text.word_tokens(F.lit("Ab-c 12é"))) == ["ab", "c", "12"]
    ab, b = F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.array(F.lit("b"))
    assert one(spark, text.weighted_bag([(ab, 3), (b, 2)])) == {"a": 6, "b": 5}
    assert one(spark, text.suffixes(F.array(F.lit("x:q"), F.lit("y:z")), "x:")) == ["Q"]
    assert one(spark, text.repaired(F.lit("w n @ f 3"))) == "wn@f3" and one(spark, text.repaired(F.lit("two words"))) == "two words"


SLASH, BRACKET = "r3k2r/8/8/8/8/8/8/R3K2R/QNpp b - - 0 1", "r3k2r/8/8/8/8/8/8/R3K2R[NQpp] b - - 0 1"


def test_both_fen_forms_mean_the_same(spark):
    for f in (fn.placement, fn.canonical_pocket, fn.material, fn.position_key, fn.squares, fn.side):
        assert one(spark, f(F.lit(SLASH))) == one(spark, f(F.lit(BRACKET)))
    assert one(spark, fn.canonical_pocket(F.lit(SLASH))) == "QNpp" and one(spark, fn.material(F.lit(SLASH))) == 34.0
    assert one(spark, fn.pocket_counts(F.lit(BRACKET), False)) == {"P": 2} and one(spark, fn.pocket_letters(F.lit(SLASH), True)) == ["N", "Q"]
    assert one(spark, fn.bracketed(F.lit(SLASH))) == "r3k2r/8/8/8/8/8/8/R3K2R[QNpp] b - - 0 1"
    assert one(spark, fn.full(F.lit(BRACKET), F.lit("QN"), F.lit("Black"))) == "r3k2r/8/8/8/8/8/8/R3K2R/QN b - - 0 1"


def test_kings_and_squares(spark):
    smothered = F.lit("6rk/5Npp/8/8/8/8/8/K7 w - - 0 1")
    assert one(spark, fn.king_box(smothered, F.lit("white"))) == {"own_adj": 1, "empty_adj": 0, "edge": 1, "corner": 1}
    assert one(spark, fn.king_shelter(smothered, F.lit("white"))) == 2 and one(spark, fn.king_box(F.lit("8/8/8/8/8/8/8/8"), F.lit("w"))) == {}
    assert [one(spark, fn.zone(F.lit(s))) for s in ("a1", "h8", "e4", "d4")] == ["back_rank", "back_rank", "kingside", "queenside"]
    assert one(spark, fn.chebyshev(F.lit(0), F.lit(63))) == 7 and one(spark, fn.square_index(F.lit("h8"))) == 63 and one(spark, fn.square_index(F.lit("i9"))) is None
    assert one(spark, fn.destination(F.lit("N@f3"))) == "f3" and one(spark, fn.destination(F.lit("e7e8q"))) == "e8"
    assert one(spark, fn.normal_uci(F.lit(" e2e4+ "))) == "e2e4" and one(spark, fn.normal_uci(F.lit("--"))) is None
    san, uci = F.array(F.lit("@h3+"), F.lit("Nf3")), F.array(F.lit("P@h3"), F.lit("g1f3"))
    assert one(spark, fn.drop_san_repaired(san, uci)) == ["P@h3+", "Nf3"]
    assert one(spark, fn.numbered_line(san, F.lit(True))) == "1... @h3+ 2. ♘f3"


@settings(max_examples=60, deadline=None)
@given(st.text("ABC.", min_size=9, max_size=9))
def test_canonical_grids_ignore_turns_and_mirrors(cells):
    form = grids.least_form(cells)
    assert all(grids.least_form("".join(cells[k] for k in s)) == form for s in grids.SYMMETRIES)
    assert len(set(grids.SYMMETRIES)) == 8


def test_canonical_column(spark):
    assert one(spark, grids.canonical(F.lit("abcdefghi"))) == grids.least_form("abcdefghi")


def test_values(spark):
    assert one(spark, v.array_of(F.lit('["a", "b"]'))) == ["a", "b"] and one(spark, v.array_of(F.lit("a b"))) == ["a", "b"] and one(spark, v.array_of(F.lit(None))) == []
    assert one(spark, v.map_of(F.lit('{"P": 2, "N": 0}'))) == {"P": 2} and one(spark, v.map_of(F.lit(None).cast("string"))) == {}
    assert one(spark, v.safe_int(F.lit(" 12 "))) == 12 and one(spark, v.safe_int(F.lit("?"))) is None
    assert one(spark, v.average_rating(F.lit(1501), F.lit(1500))) == 1500 and one(spark, v.average_rating(F.lit(0), F.lit(1500))) is None
    assert one(spark, v.score_to_cp(F.lit(5), F.lit(-2))) == -100000.0 and one(spark, v.score_to_cp(F.lit(5), F.lit(None).cast("int"))) == 5.0
    assert one(spark, v.url_parameters(F.lit("q=a%20b&k=10&x"))) == {"q": "a b", "k": "10"}
    assert one(spark, v.pocket_text(F.create_map(F.lit("P"), F.lit(1), F.lit("N"), F.lit(2)))) == "N2 P1"
    assert one(spark, v.source_site(F.lit("abc_mate5"))) == "abc" and one(spark, v.ply_of(F.lit("abc_12"))) == 12
    assert one(spark, v.game_url(F.lit("https://x.org/abc#9"), F.lit(12))) == "https://x.org/abc#12"
    assert [one(spark, v.count_bucket(F.lit(n))) for n in (0, 2, 5)] == ["0", "2", "3plus"]
