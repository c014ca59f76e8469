"""Similarity queries: pairs come from retrieval or from neighbouring keys, never from whole groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..sources.tables import table, written
from .retrieval import documents, pool, query_hits, rounded, with_features


def pairs(spark: SparkSession, sf: str, features: dict[str, F.Column], k: int = 20) -> DataFrame:
    """(qid, doc_id) and ``features`` of pooled pairs, whose sets of tokens are q and c."""
    docs = documents(spark, sf).select("doc_id", "text")
    return with_features(written(query_hits(spark, sf, k)), docs, features, F.array_distinct).select("qid", "doc_id", *features)


SETS = f"""with {pool(20)},
sets as (select doc_id, token from toks group by all),
sizes as (select doc_id, count(*) as n from sets group by 1),
common as (select qid, p.doc_id, count(*) as shared from pool p join sets a on a.doc_id = p.qid join sets b on b.doc_id = p.doc_id and a.token = b.token group by all),
pairs as (select qid, c.doc_id, shared, a.n as na, b.n as nb from common c join sizes a on a.doc_id = qid join sizes b on b.doc_id = c.doc_id)"""


def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    q, c = F.col("q"), F.col("c")
    return rounded(pairs(spark, sf, {"jac": sim.jaccard(q, c), "shared": sim.shared(q, c)}), "jac")


def overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs(spark, sf, {"ovl": sim.overlap(F.col("q"), F.col("c"))}), "ovl")


def baskets(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(parts, "l_partkey").groupBy("l_orderkey").agg(F.collect_list("p_brand").alias("brands"))


def multiset_jaccard_baskets(spark: SparkSession, sf: str) -> DataFrame:
    """Brands of each order against those of the order with the next key."""
    a = baskets(spark, sf)
    b = a.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("brands").alias("next"))
    return rounded(a.join(b, "l_orderkey").select("l_orderkey", sim.multiset_jaccard(F.col("brands"), F.col("next")).alias("msjac")), "msjac")


BASKETS = """with b as (select l_orderkey as k, p_brand as x, count(*) as n from lineitem join part on p_partkey = l_partkey group by all),
o as (select distinct k from b), p as (select a.k from o a join o c on c.k = a.k + 1),
u as (select p.k, x, n, 0 as m from p join b on b.k = p.k union all select p.k, x, 0, n from p join b on b.k = p.k + 1),
s as (select k, x, sum(n) as n, sum(m) as m from u group by all)
select k as l_orderkey, round(sum(least(n, m)) / sum(greatest(n, m)), 6) as msjac from s group by k"""


def sequences(spark: SparkSession, sf: str, n: int = 10) -> DataFrame:
    """The first ``n`` event types of each user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").withColumn("at", F.row_number().over(w)).filter(F.col("at") <= n)
    return rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda s: s["event_type"]).alias("seq"))


def sequence_levenshtein(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's first ten events against the next user's."""
    a = sequences(spark, sf)
    b = a.select((F.col("user_id") - 1).alias("user_id"), F.col("seq").alias("next"))
    return rounded(a.join(b, "user_id").select("user_id", sim.edit_similarity(F.col("seq"), F.col("next")).alias("move_lev")), "move_lev")


SEQUENCES = """s as (select user_id, event_type, ts, event_id, row_number() over (partition by user_id order by ts, event_id) as pos from events),
codes as (select event_type, chr(cast(96 + row_number() over (order by event_type) as int)) as c from (select distinct event_type from events)),
seqs as (select user_id, string_agg(c, '' order by pos) as seq, count(*) as n from s join codes using (event_type) where pos <= 10 group by 1)"""

LEVENSHTEIN = f"""with {SEQUENCES}
select a.user_id, round(1 - levenshtein(a.seq, b.seq)::double / greatest(a.n, b.n), 6) as move_lev from seqs a join seqs b on b.user_id = a.user_id + 1"""


def longest_run_events(spark: SparkSession, sf: str) -> DataFrame:
    """The most equal events in a row of each user: gaps and islands."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").withColumn("new", F.when(F.lag("event_type").over(w).eqNullSafe(F.col("event_type")), 0).otherwise(1))
    runs = rows.withColumn("run", F.sum("new").over(w)).groupBy("user_id", "run").count()
    return runs.groupBy("user_id").agg(F.max("count").alias("longest"))


RUNS = """with r as (select user_id, event_type, ts, event_id, case when lag(event_type) over w is not distinct from event_type then 0 else 1 end as new
  from events window w as (partition by user_id order by ts, event_id)),
g as (select user_id, sum(new) over (partition by user_id order by ts, event_id) as run from r)
select user_id, max(n) as longest from (select user_id, run, count(*) as n from g group by all) group by 1"""


def sequence_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The same of the first ten events, as an array function."""
    return sequences(spark, sf).select("user_id", sim.longest_run(F.col("seq")).alias("longest"))


SEQUENCE_RUNS = """with t as (select * from (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as pos from events) where pos <= 10),
r as (select *, case when lag(event_type) over (partition by user_id order by pos) is not distinct from event_type then 0 else 1 end as new from t),
g as (select user_id, sum(new) over (partition by user_id order by pos) as run from r)
select user_id, cast(max(n) as int) as longest from (select user_id, run, count(*) as n from g group by all) group by 1"""


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").count()
    return counts.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "count"))).alias("profile"))


def count_similarity_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Order counts by priority, each customer against the next."""
    a = profiles(spark, sf)
    b = a.select((F.col("o_custkey") - 1).alias("o_custkey"), F.col("profile").alias("next"))
    return rounded(a.join(b, "o_custkey").select("o_custkey", sim.count_similarity(F.col("profile"), F.col("next")).alias("sim")), "sim")


PROFILES = """with c as (select o_custkey as k, o_orderpriority as x, count(*) as n from orders group by all), o as (select distinct k from c),
p as (select a.k from o a join o b on b.k = a.k + 1),
u as (select p.k, x, n, 0 as m from p join c on c.k = p.k union all select p.k, x, 0, n from p join c on c.k = p.k + 1),
s as (select k, x, sum(n) as n, sum(m) as m from u group by all)"""

COUNT_SIMILARITY = PROFILES + "\nselect k as o_custkey, round(1 - sum(abs(n - m)) / sum(greatest(n, m)), 6) as sim from s group by k"


def agreement_fraction(spark: SparkSession, sf: str) -> DataFrame:
    """Share of common priorities with the same count, each customer against the next."""
    a = profiles(spark, sf)
    b = a.select((F.col("o_custkey") - 1).alias("o_custkey"), F.col("profile").alias("next"))
    return rounded(a.join(b, "o_custkey").select("o_custkey", sim.agreement(F.col("profile"), F.col("next")).alias("agree")), "agree")


AGREEMENT = PROFILES + """
select k as o_custkey, round(coalesce(sum(case when n > 0 and m > 0 and n = m then 1 else 0 end)::double / nullif(sum(case when n > 0 and m > 0 then 1 else 0 end), 0), 0.5), 6) as agree
from s group by k"""


def tri_state_match(spark: SparkSession, sf: str) -> DataFrame:
    """Quality labels of pooled pairs: equal, different, or unknown on a side."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    q = labels.select(F.col("doc_id").alias("qid"), F.col("quality").alias("q_quality"))
    hits = query_hits(spark, sf, 20).join(labels, "doc_id", "left").join(q, "qid", "left")
    return hits.select("qid", "doc_id", sim.tri_state(F.col("q_quality"), F.col("quality")).alias("quality_match"))


TRI_STATE = f"""with {pool(20)}
select qid, p.doc_id, case when a.quality is null or b.quality is null then 0.5 when a.quality = b.quality then 1.0 else 0.0 end::double as quality_match
from pool p left join labels a on a.doc_id = p.qid left join labels b on b.doc_id = p.doc_id"""


def vector_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector against the next: distance, binary Jaccard, and the size of the difference vector."""
    a = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    x, y = F.col("a"), F.col("b")
    return rounded(
        a.join(b, "vec_id").select(
            "vec_id", sim.euclidean(x, y).alias("distance"), sim.binary_jaccard(x, y).alias("positive_jac"),
            F.aggregate(F.slice(sim.difference_vector(x, y), 1, F.size(x)), F.lit(0.0), lambda s, d: s + d).alias("l1"),
        ),
        "distance", "positive_jac", "l1",
    )


VECTORS = """with p as (select a.vec_id, unnest(a.embedding)::double as x, unnest(b.embedding)::double as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
select vec_id, round(sqrt(sum((x::float - y::float)::double * (x::float - y::float)::double)), 6) as distance,
round(sum(case when x > 0 and y > 0 then 1 else 0 end)::double / nullif(sum(case when x > 0 or y > 0 then 1 else 0 end), 0), 6) as positive_jac,
round(sum(abs(x::float - y::float)::double), 6) as l1 from p group by 1"""


def canonical_d4(spark: SparkSession, sf: str) -> DataFrame:
    """3x3 grids of characters, alike under turns and mirrors, by their least form."""
    from ..functions.grids import canonical

    rows = table(spark, sf, "orders").select("o_orderkey", F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 9).alias("cells"))
    return rows.select("o_orderkey", canonical(F.col("cells")).alias("canon"))


def _d4_sql() -> str:
    from ..functions.grids import SYMMETRIES

    forms = ", ".join(" || ".join(f"substr(c, {k + 1}, 1)" + (" || '/'" if i in (2, 5) else "") for i, k in enumerate(s)) for s in SYMMETRIES)
    return f"select o_orderkey, least({forms}) as canon from (select o_orderkey, substr(md5(o_orderkey::varchar), 1, 9) as c from orders)"


QUERIES = {
    "jaccard_pairs": (jaccard_pairs, SETS + "\nselect qid, doc_id, round(shared::double / (na + nb - shared), 6) as jac, cast(shared as int) as shared from pairs"),
    "overlap_pairs": (overlap_pairs, SETS + "\nselect qid, doc_id, round(shared::double / least(na, nb), 6) as ovl from pairs"),
    "multiset_jaccard_baskets": (multiset_jaccard_baskets, BASKETS),
    "sequence_levenshtein": (sequence_levenshtein, LEVENSHTEIN),
    "longest_run_events": (longest_run_events, RUNS),
    "sequence_runs": (sequence_runs, SEQUENCE_RUNS),
    "count_similarity_profiles": (count_similarity_profiles, COUNT_SIMILARITY),
    "agreement_fraction": (agreement_fraction, AGREEMENT),
    "tri_state_match": (tri_state_match, TRI_STATE),
    "vector_pairs": (vector_pairs, VECTORS),
    "canonical_d4": (canonical_d4, _d4_sql()),
}
