import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner import plans
from gleaner.operators import blocks, index, search
from tests.test_plans import FOLDER, plan_of, pytestmark  # noqa: F401


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    words = [f"w{int(draw.paretovariate(0.5)) % 400}" for _ in range(6000)]
    texts = [draw.sample(words, draw.randint(1, 60)) for _ in range(300)]
    # Copies tie; some have no token.
    return [(i, texts[i % 7] if i % 5 == 0 else [] if i % 41 == 0 else t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(5)


def terms(docs):
    return search.query_terms(docs.filter("doc_id % 10 = 0"), {"t": F.col("tokens")}, qid="doc_id")


def listed(hits):
    return sorted((r.qid, r["rank"], r.doc_id, round(r.score, 8)) for r in hits.collect())


@pytest.mark.parametrize("scheme", ["lucene", "okapi"])
@pytest.mark.parametrize("k", [1, 10, 1000])
def test_blocks_find_what_a_table_of_pairs_finds(docs, scheme, k):
    built = index.build(docs, {"t": F.col("tokens")})
    want = search.search(built, terms(docs), k, scheme, exclude=F.col("qid") == F.col("doc_id"))
    assert listed(search.top(docs, F.col("tokens"), terms(docs), k, scheme, apart=("qid", "doc_id"))) == listed(want)


def test_scores_of_zero_and_less_are_hits(spark):
    few = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["a", "c"]), (4, [])], "doc_id long, tokens array<string>")
    built = index.build(few, {"t": F.col("tokens")})
    asked = search.query_terms(few, {"t": F.col("tokens")}, qid="doc_id")
    assert listed(search.top(few, F.col("tokens"), asked, 5, "okapi")) == listed(search.search(built, asked, 5, "okapi"))
    assert listed(search.top_all(few, F.col("tokens"), asked, 3)) == listed(search.search_all(built, asked, few, 3))


def test_queries_in_parts(docs, monkeypatch):
    want = listed(search.top(docs, F.col("tokens"), terms(docs), 5))
    monkeypatch.setattr(blocks, "MOST_TERMS", 200)
    assert listed(search.top(docs, F.col("tokens"), terms(docs), 5)) == want


def test_groups_are_kept_apart(spark):
    rows = spark.createDataFrame([("a_1", ["x"]), ("a_2", ["x"]), ("b_1", ["x"]), ("b", ["x", "y"])], "doc_id string, tokens array<string>")
    asked = search.query_terms(rows, {"t": F.col("tokens")}, qid="doc_id")
    got = search.top(rows, F.col("tokens"), asked, 5, apart=(search.base_id(F.col("qid")), search.base_id(F.col("doc_id"))))
    assert {(r.qid, r.doc_id) for r in got.collect()} == {(q, d) for q in ("a_1", "a_2") for d in ("b_1", "b")} | {(q, d) for q in ("b_1", "b") for d in ("a_1", "a_2")}


#: Queries of every fiftieth row against all rows.
MANY = ["bm25_topk", "recall_diagnosis", "bm25_okapi_topk", "bm25_family_weighted", "bm25_group_exclusion", "field_comparison", "retrieve_by_id", "rrf_two_fields", "recall_diagnosis_totals", "tri_state_match", "position_cascade", "recall_mrr_p_at_k", "jaccard_pairs", "overlap_pairs", "reference_rerank", "weighted_rerank"]


@pytest.mark.parametrize("name", MANY)
def test_no_table_of_pairs(spark, name):
    """Neither postings nor pairs of query and document are grouped, which shuffles them."""
    text = plan_of(plans.catalogue()[name][0](spark, FOLDER))
    # Pooled pairs read their hits from the shared folder; others score in the plan itself.
    assert ("MapInArrow" in text or name in ("jaccard_pairs", "overlap_pairs", "weighted_rerank", "reference_rerank")) and not re.search(r"keys=\[(qid#\w+, )?field#\w+, (token#\w+, )?doc_id#", text)


@pytest.mark.parametrize("name", ["jaccard_pairs"])
def test_texts_stay_where_they_are(spark, name):
    """Hits go to the documents: no text is dealt out by its id."""
    text = plan_of(plans.catalogue()[name][0](spark, FOLDER))
    assert not [line for line in text.splitlines() if "Exchange hashpartitioning(doc_id" in line] and "BroadcastHashJoin [doc_id" in text


def nodes(plan):
    yield plan
    for n in range(plan.children().size()):
        yield from nodes(plan.children().apply(n))


@pytest.mark.parametrize("name", ["overlap_pairs", "reference_rerank", "weighted_rerank"])
def test_tokens_are_not_shuffled(spark, name, monkeypatch):
    """Neither windows nor shuffled joins meet tokens, even where these are beyond a broadcast's bound; then parts give the same rows."""
    from gleaner.plans import retrieval

    run, before = plans.catalogue()[name][0], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = sorted(run(spark, FOLDER).collect())
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 2000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = run(spark, FOLDER)
        dealt = [n for n in nodes(got._jdf.queryExecution().sparkPlan()) if n.nodeName() in ("Window", "SortMergeJoin", "Sort")]
        assert not [n.nodeName() for n in dealt if "ArrayType" in n.schema().toString()]
        assert want and sorted(got.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
