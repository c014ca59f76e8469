"""The engine's end points as functions over a corpus.

A corpus is a table of records with event_id, fen, turn, solution_uci and the
token fields of ``replay.udf.corpus``. Queries are such records too, so one
call answers any number of them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import fen as fn
from .functions import similarity as sim
from .functions import values
from .operators import evaluate as ev
from .operators import filters, index, learn, pairs, rerank, search
from .operators import board as bd
from .replay import lines, udf
from .sources.sinks import export_pairs

__all__ = [
    "Corpus", "census", "diagnose", "export_pairs", "position_records", "replay_game", "rerank_hits", "rerank_search", "retrieve_by_id", "search_fields",
    "search_position", "train_weak",
]

FIELDS = ("text_static", "text_dynamic", "text_dynamic_general", "text_dynamic_solution", "text_motif")

#: Candidates that are retrieved before they are scored.
POOL = 300

#: Weights of the query's parts when candidates are retrieved for a re-rank.
QUERY_WEIGHTS = {"text_dynamic": 3.0, "text_static": 1.0}


@dataclass(frozen=True)
class Corpus:
    """Records, their index over all token fields, and their profiles for pair features."""

    records: DataFrame
    index: index.Index
    profiles: DataFrame

    @classmethod
    def of(cls, records: DataFrame) -> "Corpus":
        built = index.build(records, {f: F.col(f) for f in FIELDS}, doc_id="event_id")
        weighted = index.build_weighted(records, {"text_all": F.col("text_all")}, doc_id="event_id")
        both = index.Index(*[getattr(built, p).unionByName(getattr(weighted, p)) for p in ("postings", "terms", "fields")])
        return cls(records, both, profiles(records))


def profiles(records: DataFrame) -> DataFrame:
    """(doc_id, p): replay statistics and all that pair features need, once per record."""
    rows = records.withColumn("__stats", udf.line_stats("fen", "solution_uci"))
    rating = F.col("game_rating_avg").cast("double") if "game_rating_avg" in records.columns else F.lit(None).cast("double")
    given = {
        "static": F.col("text_static"), "dynamic": F.col("text_dynamic"), "solution_uci": F.col("solution_uci"), "mate": F.floor((F.size("solution_uci") + 1) / 2),
        "turn": F.col("turn"), "rating": rating, "fen": F.col("fen"), "stats": F.col("__stats"),
    }
    return rows.select(F.col("event_id").alias("doc_id"), pairs.profile(pairs.record(**given)).alias("p"))


def position_records(positions: DataFrame) -> DataFrame:
    """Records with token fields from positions (fen, solution_uci): ids are hashes of the FEN, invalid ones fall away."""
    rows = positions.filter(fn.is_valid(F.col("fen"))).withColumn("event_id", values.query_id(F.col("fen")))
    rows = rows.withColumn("turn", fn.turn(fn.side(F.col("fen")))).dropDuplicates(["event_id"])
    static = bd.static_tokens(bd.exploded(rows, "event_id", F.col("fen"))).groupBy("pos_id").agg(F.array_sort(F.collect_list("token")).alias("__static"))
    rows = rows.join(static, F.col("event_id") == F.col("pos_id"), "left").drop("pos_id")
    tokens = F.coalesce("__static", F.array().cast("array<string>"))
    return udf.corpus(rows, tokens, fn.pocket_counts(F.col("fen"), True), fn.pocket_counts(F.col("fen"), False)).drop("__static")


def _terms(queries: DataFrame, weights: Mapping[str, float], field: str) -> DataFrame:
    """Query terms of weighted token columns, all asked of one field."""
    out = None
    for column, w in weights.items():
        part = search.query_terms(queries, {field: F.col(column)}, qid="event_id").withColumn("qtf", F.col("qtf") * w)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("qid", "field", "token").agg(F.sum("qtf").alias("qtf"))


def search_fields(
    corpus: Corpus, queries: DataFrame, field: str = "text_all", k: int = 10, weights: Mapping[str, float] | None = None, exclude: Column | None = None
) -> DataFrame:
    """The ``k`` best records of each query by one field; a token counts by its family's weight."""
    terms = _terms(queries, {"text_static": 1.0, "text_dynamic": 1.0}, field)
    terms = search.weighted(terms, weights) if weights else terms
    return search.search(corpus.index.only(field), terms, k, exclude=exclude)


def retrieve_by_id(corpus: Corpus, doc_id: str, field: str = "text_all", k: int = 10) -> DataFrame:
    """Records like a stored one, without its own game."""
    ids = corpus.records.filter(F.col("event_id") == doc_id).select(F.col("event_id").alias("qid"), F.col("event_id").alias("doc_id"))
    same = search.same_group(F.col("qid"), F.col("doc_id"))
    return search.search(corpus.index.only(field), search.terms_of(corpus.index, field, ids), k, exclude=same)


def pair_table(corpus: Corpus, queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``hits`` with a column for every pair feature."""
    q = profiles(queries).select(F.col("doc_id").alias("qid"), F.col("p").alias("__q"))
    both = hits.join(corpus.profiles.withColumnRenamed("p", "__c"), "doc_id").join(q, "qid")
    found = pairs.features(F.col("__q"), F.col("__c"))
    return both.select(*hits.columns, *[c.cast("double").alias(n) for n, c in found.items()])


def search_position(corpus: Corpus, queries: DataFrame, k: int = 10, pool: int = POOL, model: PipelineModel | None = None) -> DataFrame:
    """Retrieve a pool, drop the query's own position, score pairs with ``model`` and keep ``k``; without a model the retrieval's order stands."""
    hits = search_fields(corpus, queries, "text_all" if model else "text_static", pool if model else k + 2, exclude=F.col("qid") == F.col("doc_id"))
    fens = corpus.records.select(F.col("event_id").alias("doc_id"), F.col("fen").alias("__c"))
    asked = queries.select(F.col("event_id").alias("qid"), F.col("fen").alias("__q"))
    hits = filters.other_positions(hits.join(fens, "doc_id").join(asked, "qid"), F.col("__c"), F.col("__q")).drop("__c", "__q")
    if model is None:
        return search.ranked(hits.drop("rank"), k)
    table = pair_table(corpus, queries, hits)
    vectors = table.withColumn("features", array_to_vector(F.array(*pairs.feature_names())))
    scored = learn.probability(model, vectors).select("qid", "doc_id", "score", F.col("rank").alias("bm25_rank"), F.round("model_prob", 9).alias("model_prob"))
    return search.ranked(scored, k, score="model_prob")


def components() -> dict[str, Column]:
    """The re-rank's parts, of a pair table."""
    return {
        "bm25": rerank.normalized(), "tactic": F.col("jac_dyn"), "move": F.col("move_lev"), "mating_piece": F.col("mating_match"), "first_action": F.col("first_match"),
        "pv_length": F.greatest(F.lit(0.0), 1 - 0.5 * F.col("pvlen_diff")), "pocket": F.col("pocket_jac"), "placement": F.col("jac_placement"),
    }


def rerank_search(
    corpus: Corpus, queries: DataFrame, weights: Mapping[str, float] | None = None, candidates: int = 50, k: int = 10, model: PipelineModel | None = None
) -> DataFrame:
    """Retrieve by weighted parts, then order by the weighted mean of the components."""
    terms = _terms(queries, QUERY_WEIGHTS, "text_all")
    hits = search.search(corpus.index.only("text_all"), terms, candidates, exclude=F.col("qid") == F.col("doc_id"))
    table, parts = pair_table(corpus, queries, hits), components()
    if model is not None:
        table = learn.probability(model, table.withColumn("features", array_to_vector(F.array(*pairs.feature_names())))).drop("features")
        parts["model"] = F.col("model_prob")
    out = rerank.reranked(table, parts, weights or rerank.SEARCH_WEIGHTS, k)
    return out.select("qid", "doc_id", "score", "bm25_rank", "new_rank", "rerank_score", *parts)


def rerank_hits(corpus: Corpus, hits: DataFrame, weights: Mapping[str, float], k: int | None = None) -> DataFrame:
    """Hits by their likeness to their query's first hit, which stays first."""
    first = hits.filter("rank = 1").select("qid", F.col("doc_id").alias("__first"))
    own = corpus.profiles
    both = hits.join(own.withColumnRenamed("p", "__c"), "doc_id").join(first, "qid")
    both = both.join(own.select(F.col("doc_id").alias("__first"), F.col("p").alias("__q")), "__first")
    found = pairs.features(F.col("__q"), F.col("__c"))
    table = both.select(*hits.columns, *[c.cast("double").alias(n) for n, c in found.items()])
    parts = components() | {"rating": F.greatest(F.lit(0.0), 1 - F.col("rating_absdiff") * 2)}
    out = rerank.reranked(table, parts, weights, k, reference=True)
    return out.select("qid", "doc_id", "score", "bm25_rank", "new_rank", "rerank_score", *parts)


def diagnose(corpus: Corpus, queries: DataFrame, labels: DataFrame, pool: int = 100, fields: Mapping[str, float] | None = None) -> DataFrame:
    """Per judged candidate whether the pool, of rank fusion over ``fields`` or of text_all, has it, and where.

    A candidate of the query's own game is marked: it shows nothing.
    """
    if fields:
        terms = search.query_terms(queries, {f: F.col(f) for f in fields}, qid="event_id", distinct=True)
        hits = search.rrf(corpus.index, terms, fields, pool)
    else:
        hits = search_fields(corpus, queries, k=pool)
    return ev.diagnosis(labels, hits).withColumn("own_game", search.same_group(F.col("qid"), F.col("doc_id")))


def census(corpus: Corpus, top: int = 8) -> DataFrame:
    """(kind, value, n): regions, checkers and smothered mates of all pictures, and the commonest pictures."""
    tokens = corpus.records.select(F.explode("text_motif").alias("t")).filter(F.col("t").startswith("mate:"))
    parts = tokens.select(F.split("t", ":", 3).alias("p")).select(F.col("p")[1].alias("kind"), F.coalesce(F.get("p", 2), F.lit("yes")).alias("value"))
    counts = parts.filter(F.col("kind").isin("pic", "region", "checker", "smother")).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    pictures = counts.filter("kind = 'pic'").orderBy(F.col("n").desc(), "value").limit(top)
    return counts.filter("kind <> 'pic'").unionByName(pictures)


def train_weak(rows: DataFrame, key: str = "puzzle_id", group: str = "cluster", vector: str = "features", skip: tuple[int, ...] = (), kind: str = "rf") -> tuple[PipelineModel, dict]:
    """A classifier of pairs within clusters against pairs across, and its held-out quality."""
    table = learn.neighbour_pairs(rows.filter(~F.col(group).isin(*skip)) if skip else rows, key, group, vector)
    train, test = learn.split(learn.vectors(table, "pair"), F.concat_ws("|", "a", "b"))
    model = learn.train(train, kind)
    return model, learn.quality(learn.probability(model, test))


def replay_game(moves: list[str]) -> list[dict]:
    """Ply, UCI, SAN and position of every legal move of one game."""
    return [dict(zip(("ply", "uci", "san", "fen"), p)) for p in lines.game_plies(moves)]


def similarity_labels(corpus: Corpus, queries: DataFrame, k: int = 10) -> DataFrame:
    """Each query's ``k`` static neighbours, labelled by the similarity of the positions."""
    from .operators import static_similarity as ss

    hits = search_fields(corpus, queries, "text_static", k, exclude=search.same_group(F.col("qid"), F.col("doc_id")))

    def sides(records: DataFrame, key: str, name: str) -> DataFrame:
        fen = F.col("fen")
        held = [fn.pocket_letters(fen, white) for white in (True, False)]
        return records.select(F.col("event_id").alias(key), ss.profile(fen, F.col("turn"), *held).alias(name))

    rows = hits.join(sides(corpus.records, "doc_id", "__c"), "doc_id").join(sides(queries, "qid", "__q"), "qid")
    score = F.round(ss.similarity(F.col("__q"), F.col("__c")), 9)
    out = rows.withColumn("static_sim_score", score).withColumn("label", ss.label(F.col("static_sim_score")))
    return out.select("qid", "doc_id", "rank", "static_sim_score", "label")


def move_similarity(a: Column, b: Column) -> Column:
    """Of two lines of moves."""
    return sim.edit_similarity(a, b)
