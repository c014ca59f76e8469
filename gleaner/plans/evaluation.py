"""Ranking metrics, diagnosis, re-ranking and selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions.text import word_tokens
from ..operators import evaluate as ev
from ..operators import rerank as rr
from ..operators import sampling as sa
from ..sources.tables import table, written
from .retrieval import EVERY, NOT_ITSELF, PAGES, corpus, pool, query_hits, rounded, with_features
from .similarity import SETS

KS = (1, 5, 10)


def judged(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Hits with language and source on both sides."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    q = docs.select(F.col("doc_id").alias("qid"), F.col("lang").alias("q_lang"), F.col("source").alias("q_source"))
    return query_hits(spark, sf, k).join(docs, "doc_id").join(q, "qid")


def recall_mrr_p_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """Relevant is what has the query's source."""
    queries = table(spark, sf, "documents").filter(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("qid"))
    out = ev.metrics(judged(spark, sf, max(KS)), F.col("source") == F.col("q_source"), KS, queries)
    return rounded(out, "recall", "mrr", "precision")


METRICS = f"""with {pool(max(KS))},
m as (select p.qid, case when d.source = e.source then rank end as r from pool p join documents d on d.doc_id = p.doc_id join documents e on e.doc_id = p.qid),
per as (select doc_id as qid, k, min(r) as first, sum(case when r <= k then 1 else 0 end) as n
  from documents left join m on qid = doc_id, (values (1), (5), (10)) as t(k) where doc_id % {EVERY} = 0 group by all)
select k, round(avg(case when first <= k then 1.0 else 0.0 end), 6) as recall, round(avg(case when first <= k then 1.0::double / first else 0.0 end), 6) as mrr,
round(avg(n::double / k), 6) as precision, count(*) as n_queries from per group by k"""


def relevance_granularity(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the relevance classes, from coarse to fine labels."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    names = ["coarse", "medium", "fine", "finest"]
    parts = list(zip(names, [F.col("lang"), F.col("source"), F.col("quality"), F.col("toxic")]))
    rows = docs.select(F.explode(F.array(*[F.struct(F.lit(n).alias("level"), c.alias("label")) for n, c in zip(names, ev.granularities(parts))])).alias("x"))
    return rows.select("x.*").filter("label is not null").groupBy("level", "label").agg(F.count(F.lit(1)).alias("n"))


GRANULARITY = """with d as (select * from documents left join labels using (doc_id)),
x as (select 'coarse' as level, lang as label from d union all select 'medium', lang || '|' || source from d
union all select 'fine', lang || '|' || source || '|' || quality from d union all select 'finest', lang || '|' || source || '|' || quality || '|' || toxic from d)
select level, label, count(*) as n from x where label is not null group by all"""


def label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, doc_id, label): the ten documents after each query, similar if of its language and about its length."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    q = docs.filter(F.col("doc_id") % EVERY == 0).select(
        F.col("doc_id").alias("qid"), F.col("lang").alias("q_lang"), F.col("n_chars").alias("q_chars")
    )
    asked = q.withColumn("doc_id", F.explode(F.sequence(F.col("qid") + 1, F.col("qid") + 10)))
    similar = (F.col("lang") == F.col("q_lang")) & (4 * F.abs(F.col("n_chars") - F.col("q_chars")) <= F.col("q_chars"))
    return asked.join(docs, "doc_id").select("qid", "doc_id", F.when(similar, "similar").otherwise("different").alias("label"))


LABELS = f"""lab as (select q.doc_id as qid, d.doc_id, case when d.lang = q.lang and 4 * abs(d.n_chars - q.n_chars) <= q.n_chars then 'similar' else 'different' end as label
from documents q join documents d on d.doc_id between q.doc_id + 1 and q.doc_id + 10 where q.doc_id % {EVERY} = 0)"""


def recall_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    """Per labelled candidate whether the pool of 100 has it, and at which rank."""
    return ev.diagnosis(label_pairs(spark, sf), query_hits(spark, sf, 100))


DIAGNOSIS = f"""with {pool(100)}, {LABELS}
select lab.qid, lab.doc_id, label, cast(rank as int) as bm25_rank, rank is not null as in_pool, coalesce(rank <= 10, false) as in_top
from lab left join pool p on p.qid = lab.qid and p.doc_id = lab.doc_id"""


def recall_diagnosis_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.diagnosis_totals(recall_diagnosis(spark, sf)), "pool_share")


TOTALS = f"""with d as ({DIAGNOSIS})
select label, count(*) as n, count(*) filter (in_pool) as n_pool, count(*) filter (in_top) as n_top, round(avg(case when in_pool then 1.0 else 0.0 end), 6) as pool_share
from d group by 1"""


def zero_similar_report(spark: SparkSession, sf: str) -> DataFrame:
    return ev.without_similar(label_pairs(spark, sf), F.col("label") == "similar")


def field_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """A row of metrics per searched field of pages; relevant is the same host."""
    from ..operators import search as se
    from .retrieval import page_fields

    pages = page_fields(spark, sf)
    host = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1).alias("host"))
    q = host.select(F.col("doc_id").alias("qid"), F.col("host").alias("q_host"))
    queries = pages.filter(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("qid"))
    out = None
    for name in ("url", "body"):
        fields = {name: word_tokens(F.col(name))}
        terms = se.query_terms(pages.filter(F.col("doc_id") % EVERY == 0), fields, qid="doc_id")
        hits = se.top(pages, fields[name], terms, 10, apart=NOT_ITSELF)
        one = ev.metrics(hits.join(host, "doc_id").join(q, "qid"), F.col("host") == F.col("q_host"), (10,), queries).withColumn("field", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "recall", "mrr", "precision")


FIELD_COMPARISON = f"""with {corpus(PAGES)},
q as (select doc_id as qid, field, token, tf as qtf from post where doc_id % {EVERY} = 0),
per as (select qid, field, doc_id, round(sum(qtf * w), 9) as score from weighted join q using (field, token) where doc_id <> qid group by all),
hits as (select * from (select *, row_number() over (partition by qid, field order by score desc, doc_id) as r from per) where r <= 10),
host as (select page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) as host from pages),
m as (select h.qid, field, case when a.host = b.host then r end as r from hits h join host a on a.page_id = h.doc_id join host b on b.page_id = h.qid),
p as (select page_id as qid, f.field, min(r) as first, count(r) as n from pages cross join (values ('url'), ('body')) as f(field)
  left join m on m.qid = page_id and m.field = f.field where page_id % {EVERY} = 0 group by all)
select 10 as k, round(avg(case when first <= 10 then 1.0 else 0.0 end), 6) as recall, round(avg(case when first <= 10 then 1.0::double / first else 0.0 end), 6) as mrr,
round(avg(n::double / 10), 6) as precision, count(*) as n_queries, field from p group by field"""


RERANK_WEIGHTS = {"bm25": 0.25, "tactic": 0.30, "pv_length": 0.05, "rating": 0.10}


def weighted_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 over its maximum, token sets, lengths in hundreds of tokens and nearness of sizes, weighted."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    features = {
        "tactic": sim.jaccard(F.col("q"), F.col("c")),
        "pv_length": sim.length_similarity(F.size("q") / 100, F.size("c") / 100),
        "rating": sim.rating_similarity(F.col("q_n_chars"), F.col("n_chars")),
    }
    # The tokens are gone before ranks are numbered.
    hits = with_features(written(query_hits(spark, sf, 20)), docs, features)
    out = rr.reranked(hits, {"bm25": rr.normalized()} | {n: F.col(n) for n in features}, RERANK_WEIGHTS, 10)
    return rounded(out.select("qid", "doc_id", "bm25_rank", "new_rank", "rerank_score"), "rerank_score")


RERANK = SETS + f""",
lens as (select doc_id, dl from dls),
x as (select p.qid, p.doc_id, p.rank, score / max(score) over (partition by p.qid) as bm25, coalesce(shared::double / (na + nb - shared), 0) as tactic,
  greatest(0, 1 - 0.5 * abs(a.dl / 100 - b.dl / 100)) as pv_length, greatest(0, 1 - abs(e.n_chars - d.n_chars) / 500) as rating
  from pool p join pairs t on t.qid = p.qid and t.doc_id = p.doc_id join lens a on a.doc_id = p.qid join lens b on b.doc_id = p.doc_id
  join documents d on d.doc_id = p.doc_id join documents e on e.doc_id = p.qid),
y as (select *, round((0.25::double * bm25 + 0.30::double * tactic + 0.05::double * pv_length + 0.10::double * rating) / 0.7::double, 9) as s from x)
select qid, doc_id, cast(rank as int) as bm25_rank, cast(n as int) as new_rank, round(s, 6) as rerank_score
from (select *, row_number() over (partition by qid order by s desc, doc_id) as n from y) where n <= 10"""


def reference_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Hits against their query's first hit, which stays first."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    hits = written(query_hits(spark, sf, 20))
    firsts = rr.with_reference(hits, ["doc_id"]).select("qid", F.col("ref_doc_id").alias("doc_id")).distinct()
    features = {"tactic": sim.jaccard(F.col("q"), F.col("c")), "rating": sim.rating_similarity(F.col("q_n_chars"), F.col("n_chars"))}
    # The first hits' tokens stand for the queries', and are gone before ranks are numbered.
    hits = with_features(hits, docs, features, F.array_distinct, written(firsts))
    out = rr.reranked(hits, {n: F.col(n) for n in features}, {"tactic": 0.6, "rating": 0.4}, reference=True)
    return rounded(out.select("qid", "doc_id", "bm25_rank", "new_rank", "rerank_score"), "rerank_score")


REFERENCE = f"""with {pool(20)},
sets as (select doc_id, token from toks group by all), sizes as (select doc_id, count(*) as n from sets group by 1),
refs as (select qid, doc_id as ref from pool where rank = 1),
common as (select p.qid, p.doc_id, count(*) as shared from pool p join refs using (qid) join sets a on a.doc_id = ref join sets b on b.doc_id = p.doc_id and a.token = b.token group by all),
x as (select p.qid, p.doc_id, p.rank, coalesce(shared, 0)::double / (a.n + b.n - coalesce(shared, 0)) as tactic, greatest(0, 1 - abs(e.n_chars - d.n_chars) / 500) as rating
  from pool p join refs on refs.qid = p.qid left join common c on c.qid = p.qid and c.doc_id = p.doc_id join sizes a on a.doc_id = ref join sizes b on b.doc_id = p.doc_id
  join documents d on d.doc_id = p.doc_id join documents e on e.doc_id = ref),
y as (select *, case when rank = 1 then 1.0 else round((0.6::double * tactic + 0.4::double * rating) / 1.0::double, 9) end as s from x)
select qid, doc_id, cast(rank as int) as bm25_rank, cast(row_number() over (partition by qid order by s desc, doc_id) as int) as new_rank, round(s, 6) as rerank_score from y"""


def largest_remainder_quota(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "orders").groupBy("o_orderstatus").count()
    return sa.quotas(counts, "o_orderstatus", 100)


QUOTA = """with c as (select o_orderstatus, count(*) as count from orders group by 1),
s as (select *, 100.0::double * count / sum(count) over () as s from c),
r as (select *, floor(s) as f, row_number() over (order by round(s - floor(s), 9) desc, o_orderstatus) as n from s)
select o_orderstatus, count, cast(f + case when n <= 100 - (select sum(f) from r) then 1 else 0 end as bigint) as quota from r"""


def stratified_query_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty documents by language quota, in hashed order."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return sa.stratified(docs, "lang", "doc_id", sa.quotas(docs.groupBy("lang").count(), "lang", 50))


STRATIFIED = """with c as (select lang, count(*) as count from documents group by 1),
s as (select *, 50.0::double * count / sum(count) over () as s from c),
r as (select *, floor(s) as f, row_number() over (order by round(s - floor(s), 9) desc, lang) as n from s),
q as (select lang, f + case when n <= 50 - (select sum(f) from r) then 1 else 0 end as quota from r)
select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by md5('42|' || doc_id), doc_id) as n from documents) join q using (lang) where n <= quota"""


def query_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Ten of the hundred orders with the highest price, in hashed order."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sa.top_then_sample(orders, F.col("o_totalprice"), "o_orderkey")


SELECTION = """select o_orderkey, o_totalprice from (select * from orders order by o_totalprice desc, o_orderkey limit 100)
order by md5('42|' || o_orderkey), o_orderkey limit 10"""


def farthest_point_selection(spark: SparkSession, sf: str) -> DataFrame:
    return sa.diverse(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", 5)


def _farthest_sql(n: int) -> str:
    """A pick after the other: the least distance to those before it, the largest of these."""
    away = "round(sqrt(list_sum(list_transform(range(1, len(x.embedding) + 1), lambda i: (x.embedding[i] - p.embedding[i])::double * (x.embedding[i] - p.embedding[i])::double))), 9)"
    parts = [f"p0 as (select e.label, e.vec_id, e.embedding, 0 as pick from embeddings e join ({MEDOID}) m using (label, vec_id))"]
    for k in range(1, n):
        parts.append(f"""p{k} as (select label, vec_id, embedding, pick from p{k - 1} union all select label, vec_id, embedding, {k} from (
  select *, row_number() over (partition by label order by d desc, vec_id) as nth from (
    select x.label, x.vec_id, x.embedding, min({away}) as d from embeddings x join p{k - 1} p on p.label = x.label
    where not exists (select 1 from p{k - 1} y where y.label = x.label and y.vec_id = x.vec_id) group by all)) where nth = 1)""")
    return f"with {', '.join(parts)} select label, vec_id, cast(pick as bigint) as pick from p{n - 1}"


def prototype_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Per label the vector nearest to the mean."""
    return rounded(sa.medoids(table(spark, sf, "embeddings"), "label", "vec_id", "embedding"), "distance")


MEDOID = """with x as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings),
m as (select label, i, avg(x) as m from x group by all),
d as (select label, vec_id, round(sqrt(sum((x - m) * (x - m))), 9) as d from x join m using (label, i) group by all)
select label, vec_id, round(d, 6) as distance from (select *, row_number() over (partition by label order by d, vec_id) as n from d) where n = 1"""

QUERIES = {
    "recall_mrr_p_at_k": (recall_mrr_p_at_k, METRICS),
    "relevance_granularity": (relevance_granularity, GRANULARITY),
    "recall_diagnosis": (recall_diagnosis, DIAGNOSIS),
    "recall_diagnosis_totals": (recall_diagnosis_totals, TOTALS),
    "zero_similar_report": (zero_similar_report, f"with {LABELS} select qid, count(*) as n from lab group by qid having count(*) filter (label = 'similar') = 0"),
    "field_comparison": (field_comparison, FIELD_COMPARISON),
    "weighted_rerank": (weighted_rerank, RERANK),
    "reference_rerank": (reference_rerank, REFERENCE),
    "largest_remainder_quota": (largest_remainder_quota, QUOTA),
    "stratified_query_sample": (stratified_query_sample, STRATIFIED),
    "query_selection": (query_selection, SELECTION),
    "farthest_point_selection": (farthest_point_selection, _farthest_sql(5)),
    "prototype_selection": (prototype_selection, MEDOID),
}
