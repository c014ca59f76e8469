"""Re-ranking of retrieved hits by weighted means of components and by models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import ranked

#: Weights of the search re-rank and of the re-rank against a reference hit; components left out weigh 0.
SEARCH_WEIGHTS = {"bm25": 0.25, "tactic": 0.30, "move": 0.25, "mating_piece": 0.10, "first_action": 0.05, "pv_length": 0.05, "model": 1.0}
COMPONENTS = ("bm25", "tactic", "move", "mating_piece", "first_action", "pv_length", "pocket", "rating", "placement", "model")


def normalized(score: str = "score", by: str = "qid") -> Column:
    """The score over its query's highest; where that is 0, over 1."""
    high = F.max(score).over(Window.partitionBy(by))
    return F.col(score) / F.when(high > 0, high).otherwise(F.lit(1.0))


def weighted_mean(components: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Sum of weight * component over the sum of the weights of the components given; 0 without weight."""
    used = {n: float(weights.get(n, 0.0)) for n in components}
    total = sum(used.values())
    if not total:
        return F.lit(0.0)
    out = F.lit(0.0)
    for name, column in components.items():
        if used[name]:
            out = out + F.lit(used[name]) * column
    return out / F.lit(total)


def reranked(
    hits: DataFrame, components: Mapping[str, Column], weights: Mapping[str, float], k: int | None = None, doc_id: str = "doc_id", reference: bool = False
) -> DataFrame:
    """``hits`` with components, rerank_score and new_rank.

    With ``reference`` each query's first hit keeps score 1 and so leads.
    """
    rows = hits.withColumns(dict(components))
    score = F.round(weighted_mean({n: F.col(n) for n in components}, weights), 9)
    if reference:
        score = F.when(F.col("rank") == 1, F.lit(1.0)).otherwise(score)
    rows = rows.withColumn("rerank_score", score)
    out = ranked(rows.withColumnRenamed("rank", "bm25_rank"), k, score="rerank_score", doc_id=doc_id)
    return out.withColumnRenamed("rank", "new_rank")


def feature_similarity(vectors: Column | None, tokens: Column | None) -> Column:
    """The vectors' similarity, else the tokens', else 0.5."""
    return F.coalesce(*[c for c in (vectors, tokens) if c is not None], F.lit(0.5))


def masked(columns: list[str], prefixes: tuple[str, ...] = ("DG_", "DS_", "dyn_", "sum_")) -> list[str]:
    """The columns whose names start with one of ``prefixes``."""
    return [c for c in columns if c.startswith(prefixes)]


def with_reference(hits: DataFrame, columns: list[str], by: str = "qid") -> DataFrame:
    """Each hit with its query's first hit's ``columns`` as ref_*: a window, so no query's hits are read twice."""
    w = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return hits.withColumns({f"ref_{c}": F.first(c).over(w) for c in columns})
