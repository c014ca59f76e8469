import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gleaner import api
from gleaner.operators import filters, pairs
from gleaner.plans import puzzles


@pytest.fixture(scope="module")
def corpus(spark):
    records = puzzles.records(spark).persist()
    made = api.Corpus.of(records)
    return api.Corpus(records, made.index.persist(), made.profiles.persist())


@pytest.fixture(scope="module")
def queries(spark, corpus):
    fens = corpus.records.filter("event_id <> 'legal_mate5'").select("fen", "solution_uci")
    return api.position_records(fens.unionByName(fens.limit(1)).unionByName(spark.createDataFrame([("8/8", ["e2e4"])], fens.schema))).persist()


def test_queries_are_encoded_once(queries):
    assert queries.count() == 3 and all(r.event_id.startswith("qfen_") and "dyn:hasMate" in r.text_dynamic for r in queries.collect())


def test_search_and_retrieve(corpus, queries):
    hits = api.search_fields(corpus, queries, k=4).collect()
    assert len(hits) == 12
    own = api.search_fields(corpus, queries, k=1, weights={"pv": 2.0}).join(queries.select(F.col("event_id").alias("qid"), "fen"), "qid")
    found = own.join(corpus.records.select(F.col("event_id").alias("doc_id"), F.col("fen").alias("f")), "doc_id").collect()
    assert all(r.fen == r.f for r in found) and len(found) == 3
    like = [r.doc_id for r in api.retrieve_by_id(corpus, "legal_mate5").collect()]
    assert len(like) == 3 and "legal_mate5" not in like


def test_positions_with_and_without_a_model(spark, corpus, queries):
    plain = api.search_position(corpus, queries, k=2).collect()
    fens = {r.event_id: r.fen for r in corpus.records.collect()} | {r.event_id: r.fen for r in queries.collect()}
    assert plain and all(fens[r.qid] != fens[r.doc_id] for r in plain)
    table = api.pair_table(corpus, queries, api.search_fields(corpus, queries, k=4))
    rows = spark.createDataFrame(table.collect(), table.schema).withColumn("features", array_to_vector(F.array(*pairs.feature_names())))
    rows = rows.withColumn("label", (F.col("move_lev") > 0.3).cast("int"))
    model = Pipeline(stages=[LogisticRegression(featuresCol="features", labelCol="label", regParam=0.1)]).fit(rows)
    scored = api.search_position(corpus, queries, k=2, model=model).collect()
    assert len(scored) == 6 and all(0 <= r.model_prob <= 1 for r in scored) and {r["rank"] for r in scored} == {1, 2}
    out = api.rerank_search(corpus, queries, k=3).collect()
    assert len(out) == 9 and all(0 <= r.rerank_score <= 1 for r in out)


def test_rerank_of_hits(corpus, queries):
    hits = api.search_fields(corpus, queries, k=4)
    rows = api.rerank_hits(corpus, hits, {"move": 1.0, "tactic": 1.0}).collect()
    assert all(r.rerank_score == 1.0 and r.new_rank == 1 for r in rows if r.bm25_rank == 1) and len(rows) == 12


def test_diagnosis_and_census(spark, corpus, queries):
    q = queries.first().event_id
    labels = spark.createDataFrame([(q, "legal_mate5", "similar"), (q, "nowhere_1", "different")], "qid string, doc_id string, label string")
    for fields in (None, {"text_dynamic": 1.0, "text_motif": 2.0}):
        rows = {r.doc_id: r for r in api.diagnose(corpus, queries, labels, fields=fields).collect()}
        assert rows["legal_mate5"].in_pool and not rows["nowhere_1"].in_pool and not rows["legal_mate5"].own_game
    got = {(r.kind, r.value): r.n for r in api.census(corpus).collect()}
    assert sum(n for (k, _), n in got.items() if k == "region") == 4 and got[("checker", "N")] == 3
    labels = api.similarity_labels(corpus, queries).collect()
    assert labels and all(r.label == int(r.static_sim_score >= 0.63) for r in labels)


def test_weak_training(spark):
    rows = [(f"p{i}", i % 3, [float(i % 3) * 4 + (i * 7 % 5) / 5, (i * 3 % 7) / 7]) for i in range(150)]
    df = spark.createDataFrame(rows, "puzzle_id string, cluster int, features array<double>")
    _, quality = api.train_weak(df, skip=(2,))
    assert quality["auc"] > 0.9


def test_replay():
    got = api.replay_game(["e2e4", "e7e5", "e4e6"])
    assert [g["san"] for g in got] == ["e4", "e5"] and got[1]["fen"].startswith("rnbqkbnr/pppp1ppp/8/4p3/4P3")


def test_filters(spark):
    schema = "i int, line array<string>, w map<string,int>, b map<string,int>, best string, ply int, board_fen string, mate_before int"
    rows = [(1, ["e2e4"], {}, {}, None, 6, "x", 2), (2, ["e2e4", "N@f3"], None, {}, None, 9, "", 5), (3, None, {"P": 0}, {"Q": 1}, None, 5, "x", None), (4, [], {}, {}, "P@e4", 7, "x", None)]
    df = spark.createDataFrame(rows, schema)
    c = F.col
    ids = lambda d: sorted(r.i for r in d.collect())
    assert ids(df.filter(filters.relevant(c("line"), c("w"), c("b")))) == [2, 3]
    assert ids(df.filter(filters.relevant(c("line"), c("w"), c("b"), c("best"), first=1))) == [3, 4]
    assert ids(filters.placed(df)) == [1, 4] and ids(filters.mode(df, "mate")) == [1, 2] and ids(filters.mode(df, "mate_short")) == [1] and ids(filters.mode(df)) == [1, 2, 3, 4]
    assert ids(filters.exact_length(df, 2, "line")) == [2] and ids(filters.from_offset(df, [c("i")], 2)) == [3, 4]
    with pytest.raises(ValueError):
        filters.mode(df, "none")
    plies = spark.createDataFrame([("g", 1, 30, None), ("g", 2, 20, None), ("g", 3, 600, None), ("g", 4, None, -3), ("g", 5, None, 2)], "site string, ply int, cp int, mate int")
    got = {r.ply: r.delta for r in filters.swings(plies).collect()}
    assert got == {2: 620.0} and {r.ply for r in filters.swings(plies, most=1).collect()} == set()
    judged = spark.createDataFrame([("similar", "t"), ("", "t"), (None, "t"), ("different", None)], "label string, t string")
    assert filters.judged(judged, "t").count() == 1
    smother = spark.createDataFrame([(["mate:smother"],), (["mate:pic:x"],)], "text_dynamic array<string>")
    assert filters.smothered(smother).count() == 1
