"""Inverted indexes as tables.

``postings`` has a row per field, token and document with its frequency and
the document's length; ``terms`` the document frequencies; ``fields`` the
number of documents and their mean length. For the tokens of given queries
alone no text is shuffled, only their counts; for a whole index documents are
shuffled once, by id, before their tokens are made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sizes import checked


@dataclass(frozen=True)
class Index:
    """Columns: postings(field, token, doc_id, tf, dl), terms(field, token, df), fields(field, n, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    fields: DataFrame

    def only(self, *names: str) -> "Index":
        keep = F.col("field").isin(*names)
        return Index(self.postings.filter(keep), self.terms.filter(keep), self.fields.filter(keep))

    def save(self, name: str, buckets: int = 256) -> None:
        """As tables bucketed by token: a search reads the buckets of its tokens, and joins without a shuffle."""
        for part, df in (("postings", self.postings), ("terms", self.terms)):
            df.write.bucketBy(buckets, "token").sortBy("token").mode("overwrite").saveAsTable(f"{name}_{part}")
        self.fields.write.mode("overwrite").saveAsTable(f"{name}_fields")

    def persist(self) -> "Index":
        return Index(self.postings.persist(), self.terms.persist(), self.fields.persist())


def lengths(docs: DataFrame, fields: dict[str, Column], doc_id: str) -> DataFrame:
    """(field, doc_id, tokens, dl): a row per field and document that has tokens."""
    parts = F.array(*[F.struct(F.lit(name).alias("field"), tokens.alias("tokens")) for name, tokens in fields.items()])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.inline(parts))
    return rows.withColumn("dl", F.size("tokens")).filter("dl > 0")


def build(docs: DataFrame, fields: dict[str, Column], doc_id: str = "doc_id", only: DataFrame | None = None) -> Index:
    """The index of ``docs``' token arrays, one field for each. Ids must be unique.

    With ``only``, a table of (field, token), nothing but those tokens'
    postings is made: what a search without a saved index needs. Lengths count
    all tokens all the same; statistics over all terms, as one scheme wants
    them, need the whole index.
    """
    # Asked-for tokens are few: they are shuffled, not texts. All of them are more than the texts, which then are shuffled instead, once.
    rows = lengths(docs if only is not None else docs.repartition(F.col(doc_id)), fields, doc_id)
    tokens = rows.select("field", "doc_id", "dl", F.explode("tokens").alias("token"))
    if only is not None:
        tokens = tokens.join(checked(only.select("field", "token").distinct(), 64), ["field", "token"], "left_semi")
    postings = tokens.groupBy("field", "token", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    return Index(
        postings,
        postings.groupBy("field", "token").agg(F.count(F.lit(1)).alias("df")),
        rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")),
    )


def build_weighted(docs: DataFrame, fields: dict[str, Column], doc_id: str = "doc_id") -> Index:
    """As ``build``, from token -> weight maps: a weight counts as that many repetitions."""
    parts = F.array(*[F.struct(F.lit(name).alias("field"), bag.alias("bag")) for name, bag in fields.items()])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.inline(parts)).withColumn(
        "dl", F.aggregate(F.map_values("bag"), F.lit(0).cast("long"), lambda n, w: n + w)
    ).filter("dl > 0")
    postings = rows.select("field", "doc_id", "dl", F.explode("bag").alias("token", "tf"))
    return Index(
        postings,
        postings.groupBy("field", "token").agg(F.count(F.lit(1)).alias("df")),
        rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")),
    )


def open_or_build(spark: SparkSession, name: str, make) -> Index:
    """The saved index ``name``; ``make()`` builds it if there is none."""
    if not spark.catalog.tableExists(f"{name}_postings"):
        make().save(name)
    return Index(*[spark.table(f"{name}_{part}") for part in ("postings", "terms", "fields")])


def status(index: Index) -> DataFrame:
    """(field, n, avgdl, n_terms)."""
    n_terms = index.terms.groupBy("field").agg(F.count(F.lit(1)).alias("n_terms"))
    return index.fields.join(n_terms, "field")
