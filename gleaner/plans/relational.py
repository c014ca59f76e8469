"""Joins, windows, aggregates and scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import features, filters, keys
from ..sources.tables import table
from .retrieval import rounded


def patch_from_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with their documents' language; a label without document gets a repaired one."""
    labels = table(spark, sf, "labels").withColumn("lang", F.lit(None).cast("string"))
    docs = table(spark, sf, "documents").filter("doc_id % 7 <> 0").select("doc_id", "lang")
    return keys.patched(labels, docs, "doc_id", "lang", F.concat(F.lit("q"), F.col("quality").cast("string")))


PATCH = """select l.doc_id, quality, toxic, coalesce(d.lang, 'q' || quality) as lang, case when d.doc_id is null then 'repair' else 'corpus' end as patched_from
from labels l left join (select doc_id, lang from documents where doc_id % 7 <> 0) d using (doc_id)"""


def fallback_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's customer name: by user id, else by user id times ten, else by event id modulo 1000."""
    events = table(spark, sf, "events").select("event_id", "user_id")
    customers = table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select("c_custkey", "c_name")
    asked = [F.col("user_id"), F.col("user_id") * 10 + 1, F.col("event_id") % 1000]
    return keys.looked_up(events, customers, asked, [F.col("c_custkey")] * 3, "c_name", "event_id")


FALLBACK = """with c as (select c_custkey as k, c_name from customer where c_custkey % 3 <> 0)
select event_id, user_id, coalesce(a.c_name, b.c_name, d.c_name) as c_name,
case when a.k is not null then 0 when b.k is not null then 1 when d.k is not null then 2 end as key_level
from events e left join c a on a.k = user_id left join c b on b.k = user_id * 10 + 1 left join c d on d.k = event_id % 1000"""


def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Events of users that didn't occur in the first tenth: what a resumed run still has to do."""
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return keys.unseen(events, events.filter("event_id < 50"), "user_id")


def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    rich = table(spark, sf, "customer").filter("c_acctbal > 9000").select("c_custkey")
    return keys.needed(orders, rich, "c_custkey")


def dedup_first_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Of documents with the same text the one with the smallest id; texts meet by their digests."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), "source")
    return keys.first_by_key(docs, ["digest"], [F.col("doc_id")]).select("doc_id", "source")


def last_row_wins(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return keys.last_by_key(events, "user_id", "event_id")


def merged_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Error events, then clicks: one row per user, the first seen."""
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return keys.merged([events.filter("event_type = 'error'"), events.filter("event_type = 'click'")], ["user_id"], "event_id")


def elements(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))


def cluster_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(elements(spark, sf).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n")), "mean")


ELEMENTS = "x as (select vec_id, label, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding) as x from embeddings)"


def group_topk_features(spark: SparkSession, sf: str) -> DataFrame:
    """The ten features with the highest mean of each label."""
    means = elements(spark, sf).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("mean"))
    w = Window.partitionBy("label").orderBy(F.col("mean").desc(), "i")
    return rounded(means.withColumn("rank", F.row_number().over(w)).filter("rank <= 10"), "mean")


TOP_FEATURES = f"""with {ELEMENTS}, m as (select label, i, round(avg(x::double), 9) as mean from x group by all)
select label, cast(i as int) as i, round(mean, 6) as mean, cast(n as int) as rank from (select *, row_number() over (partition by label order by mean desc, i) as n from m) where n <= 10"""


def inverse_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Per feature one over its population standard deviation; 0 for a constant one."""
    std = F.round(F.stddev_pop(F.col("x").cast("double")), 9)
    return rounded(elements(spark, sf).groupBy("i").agg(F.when(std > 0, 1 / std).otherwise(0.0).alias("scale")), "scale")


#: Elements of a vector as features that clusters are named by, and what they are multiplied with.
NAMED = (
    ("DG_!F_drop", 4), ("DG_!F_drop+", 4), ("PK_total_solver", 9), ("dyn_pvLen_short", 4), ("dyn_pvLen_long", 4), ("dyn_first_check", 4), ("dyn_first_drop", 4),
    ("dyn_dropHas_N", 3), ("dyn_dropHas_B", 3), ("dyn_dropHas_R", 3), ("dyn_dropHas_Q", 3), ("dyn_dropHas_P", 3),
)


def cluster_names(spark: SparkSession, sf: str) -> DataFrame:
    """A name for each label from the means of its named features."""
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("times")) for n, x in NAMED])
    size = F.abs(F.col("x").cast("double"))
    means = elements(spark, sf).filter(F.col("i") < len(NAMED)).groupBy("label", "i").agg(F.round(F.avg(size), 9).alias("m"))
    named = means.withColumn("f", F.get(names, F.col("i")))
    per = named.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct(F.col("f.name"), (F.col("m") * F.col("f.times")).alias("v")))).alias("means"))
    return per.select("label", features.cluster_name(F.col("means")).alias("cluster_name"))


def _names_sql() -> str:
    m = {n: f"max(m) filter (i = {k}) * {x}" for k, (n, x) in enumerate(NAMED)}
    check, drop = m["dyn_first_check"], m["dyn_first_drop"]
    parts = [
        f"case when greatest({check}, {drop}) > 0.3 then case when {check} >= {drop} then 'first:check' else 'first:drop' end end",
        f"case when {m['DG_!F_drop']} > 0.5 then 'hasDrop' else 'noDrop' end", f"case when {m['DG_!F_drop+']} > 0.4 then 'dropCheck' end",
        f"case when {m['PK_total_solver']} > 2 then 'pocket>' || printf('%.1f', {m['PK_total_solver']}) when {m['PK_total_solver']} < 0.5 then 'emptyPocket' end",
        f"case when {m['dyn_pvLen_short']} > 0.5 then 'shortMate' when {m['dyn_pvLen_long']} > 0.4 then 'longMate' end",
        *[f"case when {m[f'dyn_dropHas_{p}']} > 0.4 then 'drops{p}' end" for p in "NBRQP"],
    ]
    return f"with {ELEMENTS}, a as (select label, i, round(avg(abs(x::double)), 9) as m from x group by all) select label, concat_ws(' | ', {', '.join(parts)}) as cluster_name from a group by label"


def swing_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of a user's value whose sum of now and then reaches 50, among a user's first events; every seventh is a mate."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").withColumn("ply", F.row_number().over(w))
    rows = rows.withColumns({"cp": F.when(F.col("event_id") % 7 > 0, F.col("value")), "mate": F.when(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 2 == 0, 3).otherwise(-2))})
    return rounded(filters.swings(rows, "user_id", 50.0).select("event_id", "user_id", "delta"), "delta")


SWING = f"""select event_id, user_id, round(s + t, 6) as delta from (select *, lead(s) over w as t, row_number() over w as ply from (
  select *, case when event_id % 7 > 0 then value when event_id % 2 = 0 then 100000 else -100000 end as s from events) window w as (partition by user_id order by ts, event_id))
where s + t >= 50 and ply <= {filters.MOST_PLIES}"""


def clip_and_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    price = v.clipped(F.col("o_totalprice"), 50_000, 250_000)
    codes = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": 2, "5-LOW": 1}
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select(
        "o_orderkey", price.alias("price"), v.ordinal(F.col("o_orderpriority"), codes).alias("priority"),
        v.count_bucket(F.col("n")).alias("bucket"), v.length_bucket(F.col("n")).alias("length"),
    )


CLIP = """select o_orderkey, greatest(50000, least(250000, o_totalprice)) as price,
case o_orderpriority when '1-URGENT' then 5 when '2-HIGH' then 4 when '3-MEDIUM' then 3 when '4-NOT SPECIFIED' then 2 when '5-LOW' then 1 else 0 end as priority,
case when n >= 3 then '3plus' else n::varchar end as bucket, case when n <= 3 then 'short' when n <= 7 then 'med' else 'long' end as length
from orders join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey"""


def json_props_parse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.element_at(v.map_of(F.col("props")), "k").alias("k"))


def islands(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of days in a row on which a user was active."""
    days = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    w = Window.partitionBy("user_id").orderBy("day")
    new = F.when(F.datediff("day", F.lag("day").over(w)) == 1, 0).otherwise(1)
    return days.withColumn("new", new).groupBy("user_id").agg(F.sum("new").alias("islands"), F.count(F.lit(1)).alias("days"))


ISLANDS = """with d as (select distinct user_id, cast(ts as date) as day from events),
n as (select *, case when day - lag(day) over (partition by user_id order by day) = 1 then 0 else 1 end as new from d)
select user_id, cast(sum(new) as bigint) as islands, count(*) as days from n group by 1"""


def conditional_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Per language: rows, labelled ones, toxic ones, and their share."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return rounded(
        rows.groupBy("lang").agg(
            F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"),
            F.avg("toxic").alias("toxic_share"), F.countDistinct("source").alias("sources"),
        ),
        "toxic_share",
    )


SHARES = """select lang, count(*) as n, count(quality) as labelled, count(*) filter (toxic = 1) as toxic, round(avg(toxic), 6) as toxic_share, count(distinct source) as sources
from documents left join labels using (doc_id) group by 1"""


def most_common(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_partkey").count().orderBy(F.col("count").desc(), "l_partkey").limit(8)


def id_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Ids made of key and line, taken apart again."""
    ids = table(spark, sf, "orders").select(F.concat(F.lit("game"), F.col("o_orderkey"), F.lit("_"), F.col("o_custkey")).alias("event_id"))
    c = F.col("event_id")
    return ids.select("event_id", v.source_site(c).alias("site"), v.ply_of(c).alias("ply"), v.query_id(c).alias("query_id"))


ID_PARTS = """select 'game' || o_orderkey || '_' || o_custkey as event_id, 'game' || o_orderkey as site, o_custkey::int as ply,
'qfen_' || substr(sha1('game' || o_orderkey || '_' || o_custkey), 1, 12) as query_id from orders"""


def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").filter("l_shipdate <= timestamp '1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rounded(
        lines.groupBy("l_returnflag", "l_linestatus").agg(
            F.sum("l_quantity").alias("sum_qty"), F.sum(price).alias("sum_disc_price"), F.avg("l_discount").alias("avg_disc"), F.count(F.lit(1)).alias("n")
        ),
        "avg_disc",
    ).withColumn("sum_disc_price", F.round("sum_disc_price", 2))


PRICING = """select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price,
round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all"""


def nation_revenue(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue by nation where customer and supplier share it: five joins, the small sides broadcast by Spark."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    joined = (
        lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return joined.groupBy("n_name").agg(revenue.alias("revenue"))


REVENUE = """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey group by 1"""

QUERIES = {
    "patch_from_corpus": (patch_from_corpus, PATCH),
    "fallback_key_lookup": (fallback_key_lookup, FALLBACK),
    "resume_antijoin": (resume_antijoin, "select event_id, user_id, event_type from events where user_id not in (select user_id from events where event_id < 50)"),
    "semi_join": (semi_join, "select o_custkey as c_custkey, o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 9000)"),
    "dedup_first_by_key": (dedup_first_by_key, "select doc_id, source from (select *, row_number() over (partition by text order by doc_id) as n from documents) where n = 1"),
    "last_row_wins": (last_row_wins, "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1"),
    "merged_lists": (merged_lists, "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_type <> 'error', event_id) as n from events where event_type in ('error', 'click')) where n = 1"),
    "cluster_means": (cluster_means, f"with {ELEMENTS} select label, cast(i as int) as i, round(avg(x::double), 6) as mean, count(*) as n from x group by label, i"),
    "group_topk_features": (group_topk_features, TOP_FEATURES),
    "inverse_scale": (inverse_scale, f"with {ELEMENTS} select cast(i as int) as i, round(case when round(stddev_pop(x::double), 9) > 0 then 1 / round(stddev_pop(x::double), 9) else 0 end, 6) as scale from x group by i"),
    "cluster_names": (cluster_names, _names_sql()),
    "swing_threshold": (swing_threshold, SWING),
    "clip_and_ordinal": (clip_and_ordinal, CLIP),
    "json_props_parse": (json_props_parse, "select event_id, nullif(greatest(cast(json_extract(props, '$.k') as int), 0), 0) as k from events"),
    "islands": (islands, ISLANDS),
    "conditional_shares": (conditional_shares, SHARES),
    "most_common": (most_common, "select l_partkey, count(*) as count from lineitem group by 1 order by 2 desc, 1 limit 8"),
    "id_parts": (id_parts, ID_PARTS),
    "pricing_summary": (pricing_summary, PRICING),
    "nation_revenue": (nation_revenue, REVENUE),
}
