"""Retrieval queries over the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..operators import index as ix
from ..operators import search as se
from ..operators.sizes import BROADCAST_BYTES, checked
from ..sources.tables import scratch, table

#: Every row whose id is divisible by this is a query, where a query set is needed.
EVERY = 50


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def text_field() -> dict[str, F.Column]:
    """The one field of documents: their words."""
    return {"text": word_tokens(F.col("text"))}


def document_index(spark: SparkSession, sf: str, only: DataFrame | None = None) -> ix.Index:
    return ix.build(documents(spark, sf), text_field(), only=only)


#: A query is a document, and no hit of itself.
NOT_ITSELF = ("qid", "doc_id")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """``names`` to six digits, doubles as the SQL's engine rounds them: by what the product with 10**6 is, not by decimal digits.

    Nine digits that end in 500 are a half in decimal, and below or above it as a double.
    """

    def to_six(name: str) -> F.Column:
        x = F.col(name)
        if df.schema[name].dataType.simpleString() != "double":
            return F.round(x, 6)
        # Larger values, infinities and NaN would not fit the whole number.
        return F.when(F.abs(x) < 1e9, F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6).otherwise(F.round(x, 6))

    return df.withColumns({n: to_six(n) for n in names or ("score",)})


# --- SQL parts


def corpus(select: str, scheme: str = "lucene") -> str:
    """Common table expressions of an index over ``select``'s (field, doc_id, text)."""
    if scheme == "lucene":
        idf = "select field, token, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf from raw"
    else:
        idf = """select field, token, case when r < 0 then 0.25 * avg(r) over (partition by field) else r end as idf
  from (select *, ln((n - df + 0.5) / (df + 0.5)) as r from raw)"""
    w = (
        "idf * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
        if scheme == "lucene"
        else "idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))"
    )
    return f"""corpus as ({select}),
toks as (select field, doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as token from corpus),
dls as (select field, doc_id, count(*) as dl from toks group by all),
st as (select field, count(*) as n, avg(dl) as avgdl from dls group by all),
post as (select field, token, doc_id, count(*) as tf from toks group by all),
raw as (select field, token, df, n from (select field, token, count(*) as df from post group by all) join st using (field)),
idfs as ({idf}),
weighted as (select field, token, doc_id, {w} as w from post join dls using (field, doc_id) join st using (field) join idfs using (field, token))"""


DOCUMENTS = "select 'text' as field, doc_id, text from documents"

#: Ranks of scores(qid, doc_id, score).
TOP = "select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) as rank from scores"


def top(k: int, where: str = "true") -> str:
    return f"""select qid, doc_id, round(score, 6) as score, cast(rank as int) as rank
from (select * from (select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) as rank
from scores where {where})) where rank <= {k}"""


SCORES = "scores as (select qid, doc_id, round(sum(qtf * w), 9) as score from weighted join q using (field, token) group by all)"


# --- queries


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten documents most like every fiftieth one, without itself."""
    docs = documents(spark, sf)
    terms = se.query_terms(docs.filter(f"doc_id % {EVERY} = 0"), text_field(), qid="doc_id")
    return rounded(se.top(docs, text_field()["text"], terms, 10, apart=NOT_ITSELF))


BM25_TOPK = f"""with {corpus(DOCUMENTS)},
q as (select doc_id as qid, field, token, tf as qtf from post where doc_id % {EVERY} = 0), {SCORES}
{top(10, "qid <> doc_id")}"""


def bm25_okapi_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The other scheme, for every fiftieth document; lists that hits don't fill go on with score 0."""
    docs = documents(spark, sf)
    terms = se.query_terms(docs.filter(f"doc_id % {EVERY} = 0"), text_field(), qid="doc_id")
    return rounded(se.top_all(docs, text_field()["text"], terms, 10))


BM25_OKAPI_TOPK = f"""with {corpus(DOCUMENTS, "okapi")},
q as (select doc_id as qid, field, token, tf as qtf from post where doc_id % {EVERY} = 0),
hits as (select qid, doc_id, round(sum(qtf * w), 9) as score from weighted join q using (field, token) group by all),
spare as (select doc_id from documents order by doc_id limit 20),
scores as (select * from hits union all select qid, doc_id, 0.0 from (select distinct qid from q) as q cross join spare
  where not exists (select 1 from hits h where h.qid = q.qid and h.doc_id = spare.doc_id))
{top(10)}"""


def bm25_batch_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item's five best documents, in one job."""
    items = table(spark, sf, "benchmark")
    terms = se.query_terms(items, text_field(), qid="item_id")
    return rounded(se.search(document_index(spark, sf, terms), terms, 5))


BM25_BATCH = f"""with {corpus(DOCUMENTS)},
q as (select qid, 'text' as field, token, count(*) as qtf from (
  select item_id as qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from benchmark) group by all), {SCORES}
{top(5)}"""


def bm25_distinct_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """As the batch, but each distinct token is one clause."""
    items = table(spark, sf, "benchmark")
    terms = se.query_terms(items, text_field(), qid="item_id", distinct=True)
    return rounded(se.search(document_index(spark, sf, terms), terms, 5))


BM25_DISTINCT = BM25_BATCH.replace("count(*) as qtf from (\n  select item_id", "1.0 as qtf from (\n  select item_id")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.concat_ws("_", "conv_id", "turn").alias("doc_id"), "conv_id", "turn", "role", "text"
    )


def bm25_group_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    """For every turn of each fiftieth conversation, the five most similar turns of other conversations."""
    rows = turns(spark, sf)
    terms = se.query_terms(rows.filter(f"conv_id % {EVERY} = 0"), text_field(), qid="doc_id")
    return rounded(se.top(rows, text_field()["text"], terms, 5, apart=(se.base_id(F.col("qid")), se.base_id(F.col("doc_id")))))


BM25_GROUP = f"""with {corpus("select 'text' as field, conv_id || '_' || turn as doc_id, text from conversations")},
q as (select doc_id as qid, field, token, tf as qtf from post
      where doc_id in (select conv_id || '_' || turn from conversations where conv_id % {EVERY} = 0)), {SCORES}
{top(5, "split_part(qid, '_', 1) <> split_part(doc_id, '_', 1)")}"""


#: Families of plain words, by shape, and their weights.
SHAPES = {"number": 3.0, "short": 0.5, "long": 2.0, "mid": 1.0}


def shape(token: F.Column) -> F.Column:
    return (
        F.when(token.rlike("^[0-9]+$"), "number").when(F.length(token) <= 3, "short").when(F.length(token) >= 8, "long").otherwise("mid")
    )


def bm25_family_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Query terms weighted by family: every fiftieth document against all, ten hits."""
    docs = documents(spark, sf)
    terms = se.query_terms(docs.filter(f"doc_id % {EVERY} = 0"), text_field(), qid="doc_id")
    terms = se.weighted(terms, SHAPES, of=shape)
    return rounded(se.top(docs, text_field()["text"], terms, 10, apart=NOT_ITSELF))


SHAPE_SQL = "case when regexp_matches(token, '^[0-9]+$') then 3.0 when length(token) <= 3 then 0.5 when length(token) >= 8 then 2.0 else 1.0 end"

BM25_FAMILY = f"""with {corpus(DOCUMENTS)},
q as (select doc_id as qid, field, token, tf * {SHAPE_SQL}::double as qtf from post where doc_id % {EVERY} = 0), {SCORES}
{top(10, "qid <> doc_id")}"""


def page_fields(spark: SparkSession, sf: str) -> DataFrame:
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " ")
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), "url", plain.alias("body")
    )


RRF_WEIGHTS = {"url": 1.0, "body": 2.0}


def rrf_two_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by their addresses' and bodies' ranks fused; every fiftieth page is a query."""
    pages = page_fields(spark, sf)
    fields = {n: word_tokens(F.col(n)) for n in RRF_WEIGHTS}
    terms = se.query_terms(pages.filter(f"doc_id % {EVERY} = 0"), fields, qid="doc_id", distinct=True)
    return rounded(se.rrf_of(pages, fields, terms, RRF_WEIGHTS, 10, exclude=F.col("qid") == F.col("doc_id")))


PAGES = """select 'url' as field, page_id as doc_id, url as text from pages
union all select 'body', page_id, regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') from pages"""

RRF = f"""with {corpus(PAGES)},
q as (select doc_id as qid, field, token, 1.0 as qtf from post where doc_id % {EVERY} = 0),
per as (select qid, field, doc_id, round(sum(qtf * w), 9) as score from weighted join q using (field, token) group by all),
cut as (select * from (select *, row_number() over (partition by qid, field order by score desc, doc_id) as r from per) where r <= 300),
scores as (select qid, doc_id, round(sum(case field when 'url' then 1.0::double else 2.0::double end / (60 + r)), 9) as score from cut group by all)
{top(10, "qid <> doc_id")}"""


def token_postings_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per token its document frequency, occurrences and highest frequency."""
    postings = document_index(spark, sf).postings
    return postings.groupBy("token").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"), F.min("doc_id").alias("first_doc")
    )


POSTINGS = f"""with {corpus(DOCUMENTS)}
select token, count(*) as df, cast(sum(tf) as bigint) as cf, max(tf) as max_tf, min(doc_id) as first_doc from post group by token"""


def index_status(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ix.status(document_index(spark, sf)), "avgdl")


STATUS = f"""with {corpus(DOCUMENTS)}
select field, n, round(avgdl, 6) as avgdl, (select count(*) from raw) as n_terms from st"""


def retrieve_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """Stored documents' own tokens as queries, ten hits each."""
    docs = documents(spark, sf)
    stored = docs.filter(f"doc_id % {EVERY} = 0")
    ids = stored.select(F.col("doc_id").alias("qid"), "doc_id")
    terms = se.terms_of(ix.build(stored, text_field()), "text", ids)
    return rounded(se.top(docs, text_field()["text"], terms, 10, apart=NOT_ITSELF))


def query_hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """(qid, doc_id, score, rank): every fiftieth document's pool of ``k``."""
    docs = documents(spark, sf)
    terms = se.query_terms(docs.filter(f"doc_id % {EVERY} = 0"), text_field(), qid="doc_id")
    return se.top(docs, text_field()["text"], terms, k, apart=NOT_ITSELF)


def with_features(hits: DataFrame, docs: DataFrame, features: dict[str, F.Column], of=lambda tokens: tokens, sides: DataFrame | None = None) -> DataFrame:
    """``hits``, as ``written``, with ``features`` of the tokens q and c of query and document, and of both sides' other columns, the query's as q_*.

    ``sides``: (qid, doc_id), the documents that stand for the queries; else each query is its own document. Hits and queries' tokens go to the documents,
    a part within the bound after the other, and tokens end there: neither text nor token is shuffled. Documents are read for each part.
    """
    spark = hits.sparkSession
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    if sides is None:
        sides = docs.filter(f"doc_id % {EVERY} = 0").select(F.col("doc_id").alias("qid"), "doc_id")

    def made(hits: DataFrame, sides: DataFrame) -> DataFrame:
        q = docs.join(F.broadcast(sides), "doc_id").select("qid", of(word_tokens(F.col("text"))).alias("q"), *(F.col(c).alias(f"q_{c}") for c in more))
        both = docs.join(F.broadcast(hits), "doc_id").withColumn("c", of(word_tokens(F.col("text")))).drop("text").join(F.broadcast(q), "qid")
        return both.select(*hits.columns, *(value.alias(name) for name, value in features.items()))

    characters = docs.select("doc_id", F.length("text").alias("n")).join(checked(sides, 48), "doc_id").agg(F.sum("n")).first()[0] or 0
    # Tokens take some 3 bytes for each character of text.
    parts = max(1, -(-3 * characters // (2 * BROADCAST_BYTES)), -(-48 * hits.count() // BROADCAST_BYTES))
    if parts == 1:
        return made(hits, sides)
    folder, at = f"{scratch(spark)}/gleaner-{uuid.uuid4().hex}", F.pmod(F.xxhash64(F.col("qid").cast("string")), F.lit(parts))
    for n in range(parts):
        part = made(hits.filter(at == n), sides.filter(at == n))
        part.write.mode("append").parquet(folder)
    return spark.read.schema(part.schema).parquet(folder)


def pool(k: int) -> str:
    """The same in SQL, up to a table ``pool``."""
    return f"""{corpus(DOCUMENTS)},
q as (select doc_id as qid, field, token, tf as qtf from post where doc_id % {EVERY} = 0), {SCORES},
pool as (select * from ({TOP.replace("from scores", "from scores where qid <> doc_id")}) where rank <= {k})"""


def position_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Per query the hit that agrees most: language and source, else language, else any."""
    hits = query_hits(spark, sf, 20)
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    q = docs.select(F.col("doc_id").alias("qid"), F.col("lang").alias("q_lang"), F.col("source").alias("q_source"))
    joined = hits.join(docs, "doc_id").join(q, "qid")
    lang, source = F.col("lang") == F.col("q_lang"), F.col("source") == F.col("q_source")
    best = se.matched(joined, [("exact", lang & source), ("lang", lang), ("any", F.lit(True))])
    return rounded(best.select("qid", "doc_id", "score", "rank", "match_kind"))


CASCADE = f"""with {pool(20)}
select qid, doc_id, round(score, 6) as score, cast(rank as int) as rank, kind as match_kind from (
  select *, row_number() over (partition by qid order by level, rank, doc_id) as n from (
    select p.*, case when d.lang = e.lang and d.source = e.source then 0 when d.lang = e.lang then 1 else 2 end as level,
           case when d.lang = e.lang and d.source = e.source then 'exact' when d.lang = e.lang then 'lang' else 'any' end as kind
    from pool p join documents d on d.doc_id = p.doc_id join documents e on e.doc_id = p.qid)) where n = 1"""

QUERIES = {
    "bm25_topk": (bm25_topk, BM25_TOPK),
    "bm25_okapi_topk": (bm25_okapi_topk, BM25_OKAPI_TOPK),
    "bm25_batch_queries": (bm25_batch_queries, BM25_BATCH),
    "bm25_distinct_clauses": (bm25_distinct_clauses, BM25_DISTINCT),
    "bm25_group_exclusion": (bm25_group_exclusion, BM25_GROUP),
    "bm25_family_weighted": (bm25_family_weighted, BM25_FAMILY),
    "rrf_two_fields": (rrf_two_fields, RRF),
    "token_postings_stats": (token_postings_stats, POSTINGS),
    "index_status": (index_status, STATUS),
    "retrieve_by_id": (retrieve_by_id, BM25_TOPK),
    "position_cascade": (position_cascade, CASCADE),
}
