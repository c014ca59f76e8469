import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.operators import evaluate, index, keys, rerank, sampling, search

DOCS = {1: "a b c", 2: "a a b", 3: "c d", 4: "a b c", 5: "e", 6: "", 7: "b b b b c"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t.split()) for i, t in DOCS.items()], "doc_id long, tokens array<string>")


@pytest.fixture(scope="module")
def built(docs):
    return index.build(docs, {"t": F.col("tokens")})


def plain(query, scheme="lucene"):
    bags = {i: Counter(t.split()) for i, t in DOCS.items() if t}
    n, avg = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    if scheme == "lucene":
        idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    else:
        raw = {w: math.log((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
        floor = 0.25 * sum(raw.values()) / len(raw)
        idf = {w: floor if x < 0 else x for w, x in raw.items()}
    out = {}
    for i, bag in bags.items():
        dl, s, hit = sum(bag.values()), 0.0, False
        for w, q in Counter(query.split()).items():
            if tf := bag.get(w):
                k1, top = (1.2, 1.0) if scheme == "lucene" else (1.5, 2.5)
                s += q * idf[w] * tf * top / (tf + k1 * (0.25 + 0.75 * dl / avg))
                hit = True
        if hit:
            out[i] = round(s, 9)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def terms(spark, queries):
    rows = spark.createDataFrame([(q, t.split()) for q, t in queries.items()], "qid long, tokens array<string>")
    return search.query_terms(rows, {"t": F.col("tokens")})


def listed(hits, qid):
    return [(r.doc_id, r.score) for r in sorted(hits.collect(), key=lambda r: r["rank"]) if r.qid == qid]


@pytest.mark.parametrize("scheme", ["lucene", "okapi"])
def test_scores_ties_and_batches(spark, built, scheme):
    queries = {10: "a b b", 11: "c d zzz", 12: "e"}
    hits = search.search(built, terms(spark, queries), 5, scheme)
    for q, t in queries.items():
        want = plain(t, scheme)[:5]
        got = listed(hits, q)
        assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])


def test_exclusion_leaves_full_lists_and_zeros_follow(spark, built, docs):
    t = terms(spark, {1: "a b"})
    assert [i for i, _ in listed(search.search(built, t, 3, exclude=F.col("doc_id") == 2), 1)] == [i for i, _ in plain("a b") if i != 2][:3]
    got = listed(search.search_all(built, terms(spark, {1: "e"}), docs, 4), 1)
    assert [i for i, _ in got] == [5, 1, 2, 3] and got[1][1] == 0.0


def test_rank_fusion(spark):
    rows = spark.createDataFrame([(i, ["x"] * (i % 3 + 1), ["y"] * (4 - i % 4) + ["z"]) for i in range(12)], "doc_id long, f array<string>, g array<string>")
    built = index.build(rows, {"f": F.col("f"), "g": F.col("g")})
    q = spark.createDataFrame([(1, ["x"], ["y"])], "qid long, f array<string>, g array<string>")
    t = search.query_terms(q, {"f": F.col("f"), "g": F.col("g")}, distinct=True)
    per = {n: [r.doc_id for r in sorted(search.search(built.only(n), t.filter(F.col("field") == n), 100).collect(), key=lambda r: r["rank"])] for n in "fg"}
    want = Counter()
    for name, w in (("f", 1.0), ("g", 2.0)):
        for r, i in enumerate(per[name], 1):
            want[i] += w / (60 + r)
    got = search.rrf(built, t, {"f": 1.0, "g": 2.0}, 3, exclude=F.col("doc_id") == max(want, key=want.get)).collect()
    best = sorted(want, key=lambda i: (-round(want[i], 9), i))[1:4]
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == best


def test_weighted_bags_equal_repetition(spark):
    rows = spark.createDataFrame([(1, {"a": 3, "b": 1}), (2, {"b": 2})], "doc_id long, bag map<string,int>")
    same = spark.createDataFrame([(1, ["a", "a", "a", "b"]), (2, ["b", "b"])], "doc_id long, tokens array<string>")
    a, b = index.build_weighted(rows, {"t": F.col("bag")}), index.build(same, {"t": F.col("tokens")})
    t = terms(spark, {1: "a b"})
    assert listed(search.search(a, t, 5), 1) == listed(search.search(b, t, 5), 1)


def test_saved_index_is_opened_again(spark, docs):
    made = []

    def make():
        made.append(1)
        return index.build(docs, {"t": F.col("tokens")})

    t = terms(spark, {1: "a b"})
    first = listed(search.search(index.open_or_build(spark, "test_index", make), t, 5), 1)
    assert listed(search.search(index.open_or_build(spark, "test_index", make), t, 5), 1) == first == [(i, pytest.approx(s)) for i, s in plain("a b")]
    assert made == [1]


def test_base_ids(spark):
    ids = ["abc_12", "a_b_3", "abc", "_3", "x_"]
    got = [r.b for r in spark.createDataFrame([(i,) for i in ids], "i string").select(search.base_id(F.col("i")).alias("b")).collect()]
    assert got == ["abc", "a_b", "abc", "_3", "x"]


def test_cascade_and_first_seen(spark):
    hits = spark.createDataFrame([(1, 5, 1, "x"), (1, 6, 2, "y"), (2, 7, 1, "z")], "qid long, doc_id long, rank int, kind string")
    best = search.matched(hits, [("exact", F.col("kind") == "y"), ("any", F.lit(True))]).collect()
    assert {(r.qid, r.doc_id, r.match_kind) for r in best} == {(1, 6, "exact"), (2, 7, "any")}
    assert {r.doc_id for r in search.first_seen(hits, "qid", [F.col("rank")]).collect()} == {5, 7}


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False), (2, 2, True)], "qid long, rank int, ok boolean")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    got = {r.k: r for r in evaluate.metrics(hits, F.col("ok"), (1, 3), queries).collect()}
    assert got[1].recall == pytest.approx(1 / 3) and got[3].recall == pytest.approx(2 / 3)
    assert got[3].mrr == pytest.approx((1 + 0.5) / 3) and got[3].precision == pytest.approx((2 / 3 + 1 / 3) / 3) and got[1].n_queries == 3


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 1, 4.0, 1, 0.0), (1, 2, 2.0, 2, 1.0), (1, 3, 1.0, 3, 1.0), (2, 9, 0.0, 1, 0.3)], "qid long, doc_id long, score double, rank int, x double")
    parts = {"bm25": rerank.normalized(), "tactic": F.col("x")}
    got = {(r.qid, r.doc_id): (r.new_rank, r.rerank_score) for r in rerank.reranked(hits, parts, {"bm25": 1.0, "tactic": 3.0}).collect()}
    assert got[(1, 2)] == (1, pytest.approx(0.875)) and got[(1, 1)] == (3, 0.25) and got[(2, 9)][1] == pytest.approx(0.225)
    got = {r.doc_id: r.new_rank for r in rerank.reranked(hits, parts, {"tactic": 1.0}, reference=True).filter("qid = 1").collect()}
    assert got == {1: 1, 2: 2, 3: 3}


def test_quotas_and_far_points(spark):
    import numpy as np

    counts = spark.createDataFrame([("a", 10), ("b", 10), ("c", 1)], "g string, count long")
    assert {r.g: r.quota for r in sampling.quotas(counts, "g", 8).collect()} == {"a": 4, "b": 4, "c": 0}
    for n in range(1, 30):
        assert sum(r.quota for r in sampling.quotas(counts, "g", n).collect()) == n
    points = np.array([[0.0], [1.0], [2.0], [10.0]])
    assert sampling.farthest_points(points, 3) == [2, 3, 0] and sampling.farthest_points(points[:0], 3) == []


def test_lookup_patch_and_merge(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "i long, k string")
    side = spark.createDataFrame([("a", "A"), ("zb", "B"), ("zb", "A2")], "k string, v string")
    got = {r.i: (r.v, r.key_level) for r in keys.looked_up(rows, side, [F.col("k"), F.concat(F.lit("z"), "k")], [F.col("k")] * 2, "v", "i").collect()}
    assert got == {1: ("A", 0), 2: ("A2", 1), 3: (None, None)}
    patched = keys.patched(rows.withColumn("v", F.lit(None).cast("string")), side, "k", "v", F.lit("?"))
    assert {r.i: (r.v, r.patched_from) for r in patched.collect()} == {1: ("A", "corpus"), 2: ("?", "repair"), 3: ("?", "repair")}
    assert {r.k for r in keys.unseen(rows, side, "k").collect()} == {"b", "c"} and keys.needed(rows, side, "k").count() == 1
    merged = keys.merged([rows.filter("i > 1"), rows.withColumn("k", F.lit("late"))], ["i"], "k")
    assert {r.i: r.k for r in merged.collect()} == {1: "late", 2: "b", 3: "c"}
