"""Clusters, pair classifiers, and streams that must equal their batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learn
from ..sources.tables import table
from .retrieval import rounded


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return learn.vectors(table(spark, sf, "embeddings"), "embedding")


def kmeans_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of ten clusters and their commonest label, after scaling and reduction."""
    rows = vectors(spark, sf)
    assigned = learn.cluster(rows, "vec_id", k=10).assign(rows)
    counts = assigned.groupBy("cluster", "label").count()
    return counts.groupBy("cluster").agg(F.sum("count").alias("n"), F.max_by("label", F.struct("count", -F.col("label"))).alias("main_label"))


def weak_label_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """AUC, precision, recall and F1 of pairs of vectors with the same label, held out by hash."""
    pairs = learn.neighbour_pairs(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")
    rows = learn.vectors(pairs, "pair")
    train, test = learn.split(rows, F.concat_ws("|", "a", "b"))
    judged = learn.probability(learn.train(train, "rf"), test).persist()
    try:
        scores = learn.quality(judged)
    finally:
        judged.unpersist()
    return spark.createDataFrame(sorted(scores.items()), "metric string, value double")


def weak_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs themselves, each with its label and the length of its feature vector."""
    pairs = learn.neighbour_pairs(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")
    return pairs.select("a", "b", "label", F.size("pair").cast("long").alias("width"))


def daily_events(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and sums by day and type: the batch twin of the windowed stream."""
    rows = table(spark, sf, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(rows.select(F.to_date("w.start").cast("string").alias("day"), "event_type", "n", "total"), "total")


WEAK_PAIRS = f"""with e as (select vec_id as a, label as g, len(embedding) as width, md5('42|' || vec_id) as h from embeddings),
s as (select *, ('0x' || substr(h, 1, 8))::bigint % greatest(1, (select count(*) from e) // {learn.SLICE_ROWS}) as slice from e),
w as (select *, k, lead(a, k) over (partition by k, slice, g order by h, a) as b1, lead(a, k) over (partition by k, slice order by h, a) as b0,
  lead(g, k) over (partition by k, slice order by h, a) as g0 from s, (values (1), (2)) as t(k))
select a, b1 as b, 1 as label, 3 * width as width from w where b1 is not null union all select a, b0, 0, 3 * width from w where b0 is not null and g0 <> g"""

DAILY = "select cast(cast(ts as date) as varchar) as day, event_type, count(*) as n, round(sum(value), 6) as total from events group by all"


def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a user, 30 minutes apart."""
    rows = table(spark, sf, "events").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


SESSIONS = """with g as (select user_id, ts, case when ts - lag(ts) over w <= interval 30 minutes then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
s as (select user_id, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g)
select user_id, count(*) as sessions, max(n) as longest from (select user_id, s, count(*) as n from s group by all) group by 1"""

QUERIES = {
    "kmeans_profile": (kmeans_profile, None),
    "weak_label_classifier": (weak_label_classifier, None),
    "weak_pairs": (weak_pairs, WEAK_PAIRS),
    "daily_events": (daily_events, DAILY),
    "session_counts": (session_counts, SESSIONS),
}
