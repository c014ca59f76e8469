import zlib

import pytest
from pyspark.sql import functions as F

from gleaner.llm import common, mixing, sharding, simhash, warc


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def docs(spark):
    text = "if(id % 4 = 0, 'the same words in every copy of it', concat_ws(' ', 'words', id, id * 7, id % 13, 'end'))"
    return spark.range(400).selectExpr("id as doc_id", f"{text} as text", "if(id % 3 = 0, 'a', 'b') as source")


def test_results_are_the_same_without_any_broadcast(spark, docs, monkeypatch):
    pages = docs.selectExpr("doc_id as page_id", "'u' as url", "repeat(text, 40) as html")
    runs = {
        "simhash": lambda: simhash.near_duplicates(docs), "dedup": lambda: simhash.deduplicated(docs), "sharding": lambda: sharding.sharded(docs),
        "mixing": lambda: mixing.replicated(docs), "warc": lambda: warc.archived(pages),
    }
    before = {name: rows_of(run()) for name, run in runs.items()}
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {name: rows_of(run()) for name, run in runs.items()} == before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hints_follow_the_count(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    small = spark.range(10)
    assert "ResolvedHint" in plan(common.hinted(small, 10, 8)) or "broadcast" in plan(common.hinted(small, 10, 8))
    assert plan(common.hinted(small, 10, common.BROADCAST_BYTES)) == plan(small)


def test_samples_are_bounded_and_repeatable(docs):
    one = rows_of(common.sampled(docs, 400, 20, "doc_id"))
    assert len(one) == 20 == len(set(one)) and rows_of(common.sampled(docs.repartition(7), 400, 20, "doc_id")) == one
    assert common.sampled(docs, 400, 1000, "doc_id").count() == 400 and common.sampled(docs.limit(0), 0, 5, "doc_id").count() == 0


def test_folds_agree(spark):
    ids = [None, 0, 7, -3, 10**15]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", common.held_out("doc_id").alias("h")).collect()
    assert {r.doc_id: r.h for r in got} == {i: i is None or zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}
    assert all((common.fold_of(i) == 0) == h for i, h in ((r.doc_id, r.h) for r in got))


def test_tables_in_the_shared_folder(spark, docs):
    made = common.written(docs.withColumn("x", F.lit(1)))
    assert made.count() == 400 and common.shared_dir(spark).split(":")[-1].lstrip("/") in made.inputFiles()[0]
    assert common.durable(docs).count() == 400
