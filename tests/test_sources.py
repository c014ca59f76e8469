import json

import pytest
from pyspark.sql import functions as F

from gleaner.sources import pgn, records, sinks
from gleaner.streaming import ingest

PGN = """[Event "Rated game"]
[Site "https://x.org/abc"]
[White "a"]
[Black "b \\"c\\""]
[Result "1-0"]
[WhiteElo "1501"]
[BlackElo "?"]
[Termination "Normal"]

1. e4 { [%clk 0:01:00] } e5 2. Bc4 (2. Nf3 Nc6) Nc6 3. Qh5 $1 Nf6 4. Qxf7# 1-0

[Event "Second"]
[Site "https://x.org/def"]
[Result "1/2-1/2"]
[WhiteElo "1500"]
[BlackElo "1501"]
[Termination "Time forfeit"]

1. d4 d5
2. N@f3 @e4 1/2-1/2
"""


@pytest.fixture()
def games(spark, tmp_path):
    (tmp_path / "2020-01.pgn").write_text(PGN)
    return pgn.games(spark, str(tmp_path / "*.pgn"))


def test_games(games):
    rows = {r.site: r for r in games.collect()}
    a, b = rows["https://x.org/abc"], rows["https://x.org/def"]
    assert a.san_moves == ["e4", "e5", "Bc4", "Nc6", "Qh5", "Nf6", "Qxf7#"] and b.san_moves == ["d4", "d5", "N@f3", "@e4"]
    assert (a.white_elo, a.black_elo, a.game_rating_avg, b.game_rating_avg, a.source_pgn) == (1501, None, None, 1500, "2020-01.pgn")
    assert pgn.normal_games(games).count() == 1 and pgn.by_site(games, "https://x.org/d").first().event == "Second"


def test_games_become_puzzles(games):
    from gleaner.replay import udf

    rows = udf.mate_puzzles(pgn.normal_games(games)).collect()
    assert [r.event_id for r in rows] == ["https://x.org/abc_mate5"] and rows[0].solution_uci == ["f1c4", "b8c6", "d1h5", "g8f6", "h5f7"] and rows[0].mate_moves == 3


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"event_id": "a", "ply": 3}\n\nnot json\n{"event_id": "b", "ply": 4}\n')
    assert sorted(r.event_id for r in records.json_lines(spark, str(path), records.TACTIC).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        records.json_lines(spark, str(path), records.TACTIC, strict=True).collect()


def test_appended_once(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.append_new(df, path, "k")
    sinks.append_new(df.union(spark.createDataFrame([("c", 3), ("c", 3)], df.schema)), path, "k")
    assert sorted(r.k for r in spark.read.json(path).collect()) == ["a", "b", "c"]


def test_csv_has_declared_columns(spark, tmp_path):
    path = str(tmp_path / "csv")
    sinks.csv_rows(spark.createDataFrame([(1, 2)], "a int, b int"), path, ["a", "b", "c"])
    sinks.csv_rows(spark.createDataFrame([(5, 3)], "c int, a int"), path, ["a", "b", "c"])
    got = records.csv_rows(spark, path, spark.createDataFrame([], "a int, b int, c int").schema)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 0), (3, 0, 5)]


def test_matrix_and_settings(spark, tmp_path):
    sinks.matrix(spark.createDataFrame([("x", 1.5, None)], "id string, a double, b double"), str(tmp_path / "m"), "id", ["a", "b"])
    assert spark.read.parquet(str(tmp_path / "m")).first().features == [1.5, 0.0]
    (tmp_path / "w.json").write_text(json.dumps({"family_weights": {"pv": 2}}))
    assert records.family_weights(spark, str(tmp_path / "w.json"), {"pv": 1.0, "dyn": 3.0}) == {"pv": 2.0, "dyn": 3.0}
    (tmp_path / "bad.json").write_text("{")
    assert records.settings(spark, str(tmp_path / "bad.json")) == {}
    assert records.newest(spark, str(tmp_path), "bad").endswith("bad.json")


def test_exports(spark, tmp_path):
    hits = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "qid long, doc_id long, rank int")
    docs = spark.createDataFrame([(1, "q"), (2, "c")], "doc_id long, fen string")
    labels = spark.createDataFrame([(1, 2, "similar")], "qid long, doc_id long, label string")
    rows = {r.candidate_id: r for r in sinks.export_pairs(hits, docs, labels, ("fen",)).collect()}
    assert (rows[2].label, rows[2].candidate_fen, rows[2].query_fen) == ("similar", "c", "q") and (rows[3].label, rows[3].candidate_fen) == ("", None)
    sinks.json_lines(sinks.export_pairs(hits, docs, labels, ("fen",)), str(tmp_path / "e"))
    read = records.exports(spark, [str(tmp_path / "e")])
    got = read.select(records.label_number(F.col("label")).alias("y"), "query_group").collect()
    assert sorted(str(r.y) for r in got) == ["1", "None"] and all(r.query_group == "1" for r in got)


def test_game_text_is_read_again(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, ["e4", "e5", "Nf3"])], "qid int, rank int, san array<string>")
    text = sinks.game_text({"Event": F.lit("x"), "Site": F.lit('s"1')}, F.col("san"), F.lit(False), F.lit("*"))
    sinks.packs(df.withColumn("pgn", text), str(tmp_path / "p"))
    got = pgn.games(spark, str(tmp_path / "p")).first()
    assert got.san_moves == ["e4", "e5", "Nf3"] and got.site == "s'1"


def test_model_round_trip(spark, tmp_path):
    from gleaner.operators import learn

    df = learn.vectors(spark.createDataFrame([([float(i), 1.0], int(i > 5), i) for i in range(12)], "x array<double>, label int, i int"), "x")
    model = learn.train(df, "tree")
    sinks.save_model(model, str(tmp_path / "model"), {"features": ["a", "b"]})
    scored = learn.probability(records.model(str(tmp_path / "model")), df)
    assert learn.quality(scored)["auc"] == 1.0 and learn.importances(model, ["a", "b"])[0] == ("a", 1.0)
    assert records.settings(spark, str(tmp_path / "model.meta")) == {"features": ["a", "b"]}


def test_learning_pieces(spark):
    import numpy as np

    from gleaner.operators import learn

    assert learn.components_for(np.array([0.5, 0.3, 0.15, 0.05])) == 3
    rows = [(i, i % 2, [float(i % 2) * 10 + (i * 7 % 5) / 10, float(i % 2) * 5 + (i * 3 % 7) / 10]) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, g int, x array<double>")
    found = learn.cluster(learn.vectors(df, "x"), "i", k=2, elbow=(2, 3), share=0.99)
    assert found.silhouette > 0.5 and found.costs[0][1] >= found.costs[1][1]
    sizes = found.assign(learn.vectors(df, "x")).groupBy("cluster", "g").count().collect()
    assert sum(r["count"] for r in sizes) == 120
    pairs = learn.neighbour_pairs(df, "i", "g", "x").collect()
    g = {i: k for i, k, _ in rows}
    assert all((g[p.a] == g[p.b]) == bool(p.label) for p in pairs) and {p.label for p in pairs} == {0, 1} and len(pairs) <= 4 * 120
    parts = spark.range(1).select(learn.contributions(F.array(F.lit(3.0), F.lit(1.0)), [1.0, 0.0], [2.0, 0.0], [0.5, 9.0]).alias("c")).first().c
    assert parts == [0.5, 0.0]
    assert learn.numeric_columns(df, {"i"}) == ["g"]


def test_streams_equal_their_batches(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i // 60 % 24:02}:{i % 60:02}:00", "ab"[i % 2], 1.0) for i in range(0, 600, 7)]
    df = spark.createDataFrame(rows, "event_id long, t string, kind string, value double").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    for n in range(3):
        df.union(df.limit(5)).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: ingest.files(spark, str(tmp_path / "in"), df.schema, "parquet", per_trigger=1)
    ingest.append(ingest.once(stream(), "event_id", "ts"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == df.count() == got.select("event_id").distinct().count()
    ingest.append(ingest.once(stream(), "event_id", "ts"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.count()  # a second run finds nothing new

    aggregates = {"n": F.count(F.lit(1)), "total": F.sum("value")}
    want = {}
    for i, t, kind, _ in rows:
        want[(t[:13], kind)] = want.get((t[:13], kind), 0) + 1
    once = spark.read.parquet(str(tmp_path / "out"))
    batch = {(str(r.start)[:13], r.kind): r.n for r in ingest.windowed(once, "ts", "1 hour", ["kind"], aggregates).collect()}
    assert batch == want
    rows = []
    source = ingest.files(spark, str(tmp_path / "out"), once.schema, "parquet")
    ingest.each_batch(ingest.windowed(source, "ts", "1 hour", ["kind"], aggregates), str(tmp_path / "c2"), lambda b, _: rows.extend(b.collect())).awaitTermination()
    streamed = {(str(r.start)[:13], r.kind): r.n for r in rows}
    assert streamed and all(want[k] == n for k, n in streamed.items())
    assert ingest.sessions(once, "ts", "30 minutes", ["kind"], aggregates).count() == 2


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("i", "s", 1, "p", "white")], "id string, site string, ply int, board_fen string, turn string")
    sinks.doc_table(df, "stored_docs")
    assert spark.table("stored_docs").columns == ["id", "site", "ply", "board_fen", "turn"]
    assert set(records.verified_schema(df.withColumn("delta", F.lit(1))).columns) == set(df.columns)
    assert df.select(records.aliased(df, "id").alias("x")).first().x == "i"
