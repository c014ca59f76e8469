import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.llm import mixing


def plain_count(rate, seed, key):
    if rate <= 0:
        return 0
    parts = max(1, math.ceil(rate / mixing.PART))
    total = 0
    for part in range(1, parts + 1):
        digest = hashlib.md5(f"{seed}|{part}|{key}".encode()).hexdigest()
        u = (int(digest[: mixing.DIGITS], 16) + 0.5) / 16**mixing.DIGITS
        p = c = math.exp(-rate / parts)
        n = 0
        while c <= u and n < mixing.TERMS:
            n += 1
            p *= rate / parts / n
            c += p
        total += n
    return total


def test_counts_equal_plain_version(spark):
    docs = spark.createDataFrame([(i, f"s{int(i % 10 > 6) + int(i == 5) * 2}", "x") for i in range(600)], "doc_id long, source string, text string")
    weights = {"s0": 0.2, "s1": 0.7, "s2": 0.1}
    rows = mixing.replicated(docs, weights, seed=9).collect()
    got = Counter(r.doc_id for r in rows)
    n = Counter(r.source for r in docs.collect())
    for d in docs.collect():
        assert got[d.doc_id] == plain_count(weights[d.source] * 600 / n[d.source], 9, str(d.doc_id))
    assert got[5] > mixing.PART  # one document must make up a whole source: drawn in parts
    for r in rows:
        assert 0 <= r.copy < r.n_copies == got[r.doc_id]


def test_poisson_moments(spark):
    for rate in (0.3, 2.5, 40.0):
        n = mixing.poisson(F.lit(rate), 1, F.col("id").cast("string"))
        mean, var = spark.range(4000).select(n.alias("n")).agg(F.avg("n"), F.variance("n")).first()
        assert mean == pytest.approx(rate, abs=5 * math.sqrt(rate / 4000)) and var == pytest.approx(rate, rel=0.15)


def test_default_weights_even_out_sources_in_a_global_order(spark):
    docs = spark.createDataFrame([(i, "big" if i % 10 else "small", "x") for i in range(5000)], "doc_id long, source string, text string")
    rows = mixing.mixed(docs).collect()
    share = Counter(r.source for r in rows)
    assert share["small"] / len(rows) == pytest.approx(0.5, abs=0.06)
    keys = [r.order_key for r in rows]
    assert keys == sorted(keys)
    first = Counter(r.source for r in rows[: len(rows) // 4])
    assert first["small"] / sum(first.values()) == pytest.approx(0.5, abs=0.1)


def test_rows_without_ids_are_drawn_by_their_texts(spark):
    rows = [(None, f"text {i}", "a") for i in range(1000)] + [(i, "x", "b") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs, {"a": 0.5, "b": 0.5}).collect()
    share = Counter(r.source for r in got)
    assert share["a"] == pytest.approx(2000, rel=0.1) and share["b"] == pytest.approx(2000, rel=0.1)
    assert len({r.order_key for r in got if r.doc_id is None}) == share["a"]
    for r in got[::50]:
        key = str(r.doc_id) if r.doc_id is not None else "text:" + hashlib.md5(r.text.encode()).hexdigest()
        assert r.n_copies == plain_count(r.mix_rate, 42, key)


def test_plan_draws_once(spark):
    """No second pass over the documents for the global order: ranges are cut without a sample."""
    docs = spark.range(100).selectExpr("id as doc_id", "'a' as source", "'x' as text")
    plan = mixing.mixed(docs)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan.lower()


def test_edges(edge_docs, no_docs):
    rows = mixing.mixed(edge_docs)
    own = ["mix_rate", "n_copies", "copy", "order_key"]
    assert rows.columns == [c for c in edge_docs.columns if c not in own] + own
    assert {r.source for r in rows.collect()} <= {None, "a", "b"}
    assert mixing.mixed(no_docs).count() == 0
    assert mixing.mixed(edge_docs, weights={"b": 1.0}).filter("source <> 'b' or source is null").count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(edge_docs, weights={"a": -1.0})
