"""Every query with SQL against DuckDB, on the smallest tables where they are."""

import math
import os

import duckdb
import pytest

from gleaner import plans

FOLDER = os.environ.get("GLEANER_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CATALOGUE = plans.catalogue()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOGUE.items() if sql])
def test_equals_sql(spark, duck, name):
    run, sql = CATALOGUE[name]
    df = run(spark, FOLDER)
    rel = duck.sql(sql)
    order = sorted(rel.columns)
    assert sorted(df.columns) == order
    at = [rel.columns.index(c) for c in order]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect()) == want


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOGUE.items() if not sql])
def test_runs(spark, name):
    assert CATALOGUE[name][0](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 * 4 and set(CATALOGUE) <= set(__spark_entry__.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_searches_shuffle_no_text(spark):
    from gleaner.plans import retrieval

    for run in (retrieval.bm25_topk, retrieval.bm25_batch_queries, retrieval.rrf_two_fields):
        text = plan_of(run(spark, FOLDER))
        exchanged = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
        assert not any("text" in line or "tokens" in line or "body" in line for line in exchanged)


def test_plans_prune_and_cut(spark):
    """Columns and filters reach the scan; ranks are cut before the shuffle."""
    from gleaner.plans import relational, retrieval

    text = plan_of(relational.pricing_summary(spark, FOLDER))
    assert "l_comment" not in text and "PushedFilters: [IsNotNull(l_shipdate)" in text
    assert "WindowGroupLimit" in plan_of(retrieval.bm25_batch_queries(spark, FOLDER))
    assert "TakeOrderedAndProject" in plan_of(relational.most_common(spark, FOLDER))
    assert "CartesianProduct" not in "".join(plan_of(run(spark, FOLDER)) for n, (run, _) in CATALOGUE.items() if n.startswith(("bm25", "rrf", "jaccard")))
