"""Ranked retrieval over an index, for any number of queries at once.

Queries are tables of (qid, field, token, qtf). They are joined with the
postings by token, so only matching postings are read on; scores are summed
per query and document before the shuffle; ranks are cut per query as they are
numbered. Ties go to the smaller id. Many queries against texts without an
index, where pairs of query and document would be too many for a table, go by
``top``, ``top_all`` and ``rrf_of``: see ``blocks``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fen import drop_san_repaired
from ..functions.text import by_family_weight, serve_family
from .blocks import DIGITS, LUCENE_B, LUCENE_K1, OKAPI_B, OKAPI_FLOOR, OKAPI_K1, best
from .index import Index
from .sizes import within

RRF_K = 60


def query_terms(queries: DataFrame, fields: Mapping[str, Column], qid: str = "qid", distinct: bool = False) -> DataFrame:
    """(qid, field, token, qtf) of token arrays; a repeated token counts as often unless ``distinct``."""
    parts = F.array(*[F.struct(F.lit(name).alias("field"), tokens.alias("tokens")) for name, tokens in fields.items()])
    rows = queries.select(F.col(qid).alias("qid"), F.inline(parts)).select("qid", "field", F.explode("tokens").alias("token"))
    counted = rows.groupBy("qid", "field", "token").agg(F.count(F.lit(1)).cast("double").alias("qtf"))
    return counted.withColumn("qtf", F.lit(1.0)) if distinct else counted


def weighted(terms: DataFrame, weights: Mapping[str, float], default: float = 1.0, of: Callable[[Column], Column] = serve_family) -> DataFrame:
    """Query terms times the weight of their token's family, which ``of`` names; those of weight 0 go."""
    return terms.withColumn("qtf", F.col("qtf") * by_family_weight(F.col("token"), weights, default, of)).filter("qtf > 0")


def idf(index: Index, scheme: str = "lucene") -> DataFrame:
    """(field, token, idf, avgdl)."""
    # One row per field: a field's statistics, whose number is a parameter.
    joined = index.terms.join(F.broadcast(index.fields), "field")
    n, df = F.col("n"), F.col("df")
    if scheme == "lucene":
        return joined.select("field", "token", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"), "avgdl")
    raw = joined.select("field", "token", F.log((n - df + 0.5) / (df + 0.5)).alias("raw"), "avgdl")
    mean = raw.groupBy("field").agg((F.avg("raw") * OKAPI_FLOOR).alias("floor"))
    return raw.join(F.broadcast(mean), "field").select(
        "field", "token", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"), "avgdl"
    )


def weight(scheme: str = "lucene") -> Column:
    """A term's weight in a document, from idf, tf, dl and avgdl."""
    tf, ratio = F.col("tf"), F.col("dl") / F.col("avgdl")
    if scheme == "lucene":
        return F.col("idf") * tf / (tf + LUCENE_K1 * (1 - LUCENE_B + LUCENE_B * ratio))
    if scheme == "okapi":
        return F.col("idf") * tf * (OKAPI_K1 + 1) / (tf + OKAPI_K1 * (1 - OKAPI_B + OKAPI_B * ratio))
    raise ValueError(scheme)


def scores(index: Index, terms: DataFrame, scheme: str = "lucene") -> DataFrame:
    """(qid, field, doc_id, score) of every document that shares a token with the query.

    Query terms within the bound are broadcast, so that postings stay where
    their documents are and a document's scores add up there; more of them are
    joined by a shuffle on tokens.
    """
    wanted = terms.join(idf(index, scheme), ["field", "token"])
    if within(terms, 96):
        wanted = F.broadcast(wanted)
    return (
        index.postings.join(wanted, ["field", "token"])
        .groupBy("qid", "field", "doc_id")
        .agg(F.round(F.sum(F.col("qtf") * weight(scheme)), DIGITS).alias("score"))
    )


def ranked(hits: DataFrame, k: int | None, by: tuple[str, ...] = ("qid",), score: str = "score", doc_id: str = "doc_id") -> DataFrame:
    """``hits`` with a rank from 1 for each of ``by``, the first ``k``."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(doc_id))
    out = hits.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.filter(F.col("rank") <= k)


def search(
    index: Index, terms: DataFrame, k: int = 10, scheme: str = "lucene", exclude: Column | None = None
) -> DataFrame:
    """(qid, doc_id, score, rank) of the ``k`` best documents over all fields in ``terms``.

    ``exclude`` is a condition on qid and doc_id that drops hits before ranks
    are numbered, so that a full list of ``k`` comes out.
    """
    hits = scores(index, terms, scheme).groupBy("qid", "doc_id").agg(F.round(F.sum("score"), DIGITS).alias("score"))
    if exclude is not None:
        hits = hits.filter(~F.coalesce(exclude, F.lit(False)))
    return ranked(hits, k)


def top(
    docs: DataFrame, tokens: Column, terms: DataFrame, k: int = 10, scheme: str = "lucene", apart: tuple[Column | str, Column | str] | None = None, doc_id: str = "doc_id"
) -> DataFrame:
    """As ``search``, over ``docs``' one field of ``tokens``: pairs of query and document stay in the tasks' memory.

    ``apart``, a column of the terms and one of ``docs``, drops hits whose
    values are the same before ranks are numbered.
    """
    return ranked(best(docs, tokens, terms, k, scheme, apart, doc_id), k)


def top_all(docs: DataFrame, tokens: Column, terms: DataFrame, k: int, scheme: str = "okapi") -> DataFrame:
    """As ``search_all``, over ``docs``' one field of ``tokens``."""
    spare = [r[0] for r in docs.select("doc_id").orderBy("doc_id").limit(2 * k).collect()]
    found = best(docs, tokens, terms, k, scheme)
    if not spare:
        return ranked(found, k)
    # A spare document that shares a token is a hit already, whether it is among the best or not.
    own = docs.filter(F.col("doc_id").isin(spare)).select("doc_id", F.explode(F.array_distinct(tokens)).alias("token"))
    met = terms.select("qid", "token").join(F.broadcast(own), "token").select("qid", "doc_id").distinct()
    zeros = (
        terms.select("qid").distinct().withColumn("doc_id", F.explode(F.array(*[F.lit(i) for i in spare])))
        .join(met, ["qid", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    )
    return ranked(found.unionByName(zeros.select("qid", "doc_id", "score")), k)


def search_all(index: Index, terms: DataFrame, docs: DataFrame, k: int, scheme: str = "okapi") -> DataFrame:
    """As ``search``, but documents without a shared token follow with score 0, by id.

    Only the first ``k`` ids can follow, plus those that hits may take, so no
    query meets more than 2 * k of them.
    """
    found = search(index, terms, None, scheme).drop("rank")
    spare = [F.lit(r[0]) for r in docs.select("doc_id").orderBy("doc_id").limit(2 * k).collect()]
    if not spare:
        return ranked(found, k)
    # Hits may be all among the spare ids; then fewer than k follow, but k hits precede them.
    zeros = (
        terms.select("qid").distinct().withColumn("doc_id", F.explode(F.array(*spare)))
        .join(found, ["qid", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    )
    return ranked(found.unionByName(zeros.select("qid", "doc_id", "score")), k)


def rrf(
    index: Index,
    terms: DataFrame,
    weights: Mapping[str, float],
    k: int = 10,
    constant: int = RRF_K,
    exclude: Column | None = None,
    scheme: str = "lucene",
) -> DataFrame:
    """(qid, doc_id, score, rank) by reciprocal rank fusion over fields.

    Each field's best ``20 * k + 100`` documents get weight / (constant +
    rank); what is excluded keeps its place in the fields' ranks.
    """
    return fused(ranked(scores(index.only(*weights), terms, scheme), 20 * k + 100, by=("qid", "field")), weights, k, constant, exclude)


def rrf_of(
    docs: DataFrame,
    fields: Mapping[str, Column],
    terms: DataFrame,
    weights: Mapping[str, float],
    k: int = 10,
    constant: int = RRF_K,
    exclude: Column | None = None,
    scheme: str = "lucene",
) -> DataFrame:
    """As ``rrf``, over ``docs``' fields of tokens, one after the other: see ``top``."""
    per = [top(docs, fields[n], terms.filter(F.col("field") == n), 20 * k + 100, scheme).withColumn("field", F.lit(n)) for n in weights]
    return fused(functools.reduce(DataFrame.unionByName, per), weights, k, constant, exclude)


def fused(cut: DataFrame, weights: Mapping[str, float], k: int, constant: int, exclude: Column | None) -> DataFrame:
    """The fusion of ranks by field in ``cut`` (qid, field, doc_id, rank)."""
    share = F.lit(0.0)
    for name, w in weights.items():
        share = F.when(F.col("field") == name, F.lit(float(w))).otherwise(share)
    hits = cut.groupBy("qid", "doc_id").agg(F.round(F.sum(share / (constant + F.col("rank"))), DIGITS).alias("score"))
    if exclude is not None:
        hits = hits.filter(~F.coalesce(exclude, F.lit(False)))
    return ranked(hits, k)


def base_id(doc_id: Column) -> Column:
    """What precedes the last ``_``; the whole id without one, or if it comes first."""
    head = F.regexp_extract(doc_id, "^(.+)_[^_]*$", 1)
    return F.when(head != "", head).otherwise(doc_id)


def same_group(a: Column, b: Column) -> Column:
    return base_id(a.cast("string")) == base_id(b.cast("string"))


def get_doc(docs: DataFrame, doc_id: object, id_col: str = "doc_id") -> DataFrame:
    """The document with that id, none or one."""
    return docs.filter(F.col(id_col) == doc_id).limit(1)


def terms_of(index: Index, field: str, ids: DataFrame) -> DataFrame:
    """Query terms from stored documents: their own tokens. ``ids``: (qid, doc_id)."""
    own = index.only(field).postings.join(ids, "doc_id")
    return own.select("qid", "field", "token", F.col("tf").cast("double").alias("qtf"))


#: Columns of a hit as it is shown, in order, with their types; what isn't known of a record is null unless SHOWN_DEFAULTS has it.
SHOWN = {
    "id": "string", "rank": "int", "score": "double", "site": "string", "ply": "int", "url": "string", "board_fen": "string", "fen": "string",
    "pockets_white": "map<string,int>", "pockets_black": "map<string,int>", "turn": "string", "mate_in": "int", "mate_before": "int", "solution_san": "array<string>",
    "solution_uci": "array<string>", "engine_verified": "boolean", "text_dynamic": "array<string>", "text_static": "array<string>", "white": "string", "black": "string",
    "white_elo": "int", "black_elo": "int", "game_rating_avg": "int", "time_control": "string", "utc_date": "string", "result": "string", "source_pgn": "string",
    "event": "string", "delta": "double", "bestmove": "string", "pv": "array<string>", "played_move": "string",
}
SHOWN_DEFAULTS = {"site": "", "ply": 0, "board_fen": "", "fen": "", "turn": "white", "engine_verified": False}


def shown(hits: DataFrame, docs: DataFrame, id_col: str = "event_id") -> DataFrame:
    """``hits`` joined with what is shown of their records: qid, then the columns of SHOWN.

    Older names of a column stand in for it where it is null; drops in SAN get
    their piece back; the line stands for the best move and the line ahead.
    """
    older = {"mate_in": ("mate_in", "mate_before"), "game_rating_avg": ("game_rating_avg", "meta_avg_rating"), "mate_before": ("mate_in", "mate_before")}
    rows = hits.select("qid", "doc_id", "rank", F.round("score", 3).alias("score")).join(docs, F.col("doc_id") == docs[id_col])

    def value(name: str) -> Column:
        known = [F.col(c) for c in older.get(name, (name,)) if c in docs.columns]
        default = SHOWN_DEFAULTS.get(name)
        return F.coalesce(*known, F.lit(default)) if known else F.lit(default)

    site, ply = value("site"), value("ply").cast("int")
    san = drop_san_repaired(value("solution_san").cast("array<string>"), value("solution_uci").cast("array<string>"))
    own = {
        "id": F.col("doc_id"), "rank": F.col("rank"), "score": F.col("score"), "solution_san": san, "pv": san, "bestmove": F.get(san, 0), "delta": F.lit(None), "played_move": F.lit(None),
        "url": F.when(site.contains("lichess.org"), F.concat(F.lit("https://lichess.org/"), F.substring_index(site, "/", -1), F.lit("#"), ply.cast("string"))).otherwise(""),
    }
    return rows.select("qid", *[(own[name] if name in own else value(name)).cast(kind).alias(name) for name, kind in SHOWN.items()])


def matched(hits: DataFrame, levels: list[tuple[str, Column]], by: str = "qid") -> DataFrame:
    """Per query the best hit by a cascade of conditions: the first that any hit fulfils, then the best rank."""
    level, name = F.lit(None).cast("int"), F.lit(None).cast("string")
    for n, (label, condition) in reversed(list(enumerate(levels))):
        level, name = F.when(condition, F.lit(n)).otherwise(level), F.when(condition, F.lit(label)).otherwise(name)
    order = Window.partitionBy(by).orderBy("match_level", "rank", "doc_id")
    rows = hits.withColumn("match_level", level).withColumn("match_kind", name).filter("match_level is not null")
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def first_seen(hits: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per ``key``, the first in ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    return hits.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
