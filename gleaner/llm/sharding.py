"""Shards by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws
``ln(u) / weight`` with u hashed from the row's key and the child's name, and
the largest draw wins. A child whose weight grows only ever draws larger, so
rows move into its subtree alone; no other subtree exchanges rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, hinted, written

#: Digits of md5 that make a draw: 13 hexadecimal digits fit a double exactly.
DIGITS = 13

#: Slices of a group at least, so that numbering it takes many tasks, and the
#: rows meant for one.
SLICES, SLICE_ROWS = 64, 50_000


@dataclass(frozen=True)
class Node:
    """A subtree: a shard if it has a number, else its children."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int | None = None
    own: float = field(default=1.0)

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def topology(shards: int, rack: int = 2, region: int = 4) -> Node:
    """``shards`` shards of weight 1, ``rack`` to a rack, ``region`` to a region."""
    if shards < 1:
        raise ValueError("at least one shard")
    regions: dict[int, dict[int, list[Node]]] = {}
    for s in range(shards):
        regions.setdefault(s // region, {}).setdefault(s // rack, []).append(Node(f"shard{s}", shard=s))
    return Node(
        "root",
        tuple(
            Node(f"region{r}", tuple(Node(f"rack{k}", tuple(leaves)) for k, leaves in racks.items()))
            for r, racks in regions.items()
        ),
    )


def _draw(key: Column, child: Node) -> Column:
    digest = F.md5(F.concat(key, F.lit(f"|{child.name}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**DIGITS))
    return F.log(u) / F.lit(float(child.weight))


def shard_of(key: Column, node: Node) -> Column:
    """The shard of a string ``key``; a null key is taken as the empty one."""
    key = F.coalesce(key, F.lit(""))
    if node.shard is not None:
        return F.lit(node.shard)
    children = [c for c in node.children if c.weight > 0]
    if not children:
        raise ValueError(f"{node.name} has no weight")
    if len(children) == 1:
        return shard_of(key, children[0])
    best = F.greatest(*[_draw(key, c) for c in children])
    out = shard_of(key, children[-1])
    for child in reversed(children[:-1]):
        out = F.when(_draw(key, child) == best, shard_of(key, child)).otherwise(out)
    return out


def assign(docs: DataFrame, tree: Node, id_col: str = "doc_id", out: str = "shard") -> DataFrame:
    """``docs`` with its shard as a column; the id alone decides."""
    return docs.withColumn(out, shard_of(F.col(id_col).cast("string"), tree).cast("int"))


def numbered(rows: DataFrame, group: str, order: list[Column], spread: Column, groups: int, out: str = "slot", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``rows`` with a gapless number from 0 within each of at most ``groups`` groups.

    Each group is cut by the hash ``spread`` into slices of about
    ``slice_rows``; slices are counted, a slice starts where those before it
    end, and only a slice's rows meet in one task. ``spread`` and ``order``
    must follow from the row's values; rows equal in both may swap numbers.
    So the numbers follow from the rows alone, and a lost task computed again
    gives the same. Where more rows than a slice should hold are equal in
    ``spread``, their place in the input, which must be files, deals them to
    slices of their own.
    """
    key, cut, at = f"__{out}_key", f"__{out}_slice", f"__{out}_start"
    rows = rows.withColumn(key, F.xxhash64(spread))
    counted = durable(rows.groupBy(F.col(group).alias("__group"), F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")))
    total, most = counted.agg(F.sum("__n"), F.max("__n")).first()
    slices = max(SLICES, math.ceil((total or 0) / groups / slice_rows))

    def slice_of(key: str, salt: Column) -> Column:
        return F.pmod(F.xxhash64(key, salt), F.lit(slices)).cast("int")

    whole = F.lit(0).cast("long")
    if (most or 0) > slice_rows:
        # One of slice_rows rows at most is a row here.
        hot = durable(counted.filter(F.col("__n") > slice_rows).withColumn("__n", F.ceil(F.col("__n") / slice_rows)))
        same = F.col(group).eqNullSafe(F.col("__group")) & (F.col(key) == F.col("__key"))
        rows = rows.withColumn(at, F.monotonically_increasing_id()).join(hinted(hot, hot.count(), 32), same, "left")
        salt = F.when(F.col("__n").isNotNull(), F.pmod(F.col(at), F.col("__n"))).otherwise(whole)
        rows = rows.withColumn(cut, slice_of(key, salt)).drop("__group", "__key", "__n", at)
        sizes = rows.groupBy(F.col(group).alias("__group"), F.col(cut).alias("__cut")).agg(F.count(F.lit(1)).alias("__n"))
    else:
        rows = rows.withColumn(cut, slice_of(key, whole))
        sizes = counted.groupBy("__group", slice_of("__key", whole).alias("__cut")).agg(F.sum("__n").alias("__n"))
    before = Window.partitionBy("__group").orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__group", "__cut", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(at))
    within = Window.partitionBy(group, cut).orderBy(*order)
    joined = rows.withColumn(out, F.row_number().over(within)).join(
        hinted(starts, slices * groups, 24), F.col(group).eqNullSafe(F.col("__group")) & (F.col(cut) == F.col("__cut"))
    )
    return joined.withColumn(out, (F.col(out) - 1 + F.col(at)).cast("long")).drop("__group", "__cut", key, cut, at)


def sharded(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the id and the number of shards decide. ``grown_shard``
    is the shard with one more, which stands in a region of its own if
    ``shards`` fills whole regions, so that rows move into it alone.

    Nulls: a null text has size 1 and the crc32 of no bytes (0); rows without
    an id share the empty key, hence one shard, where they are numbered in many
    slices. Repeated rows each get a slot. Extra columns are ignored; an empty
    table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = written(assign(assign(rows, topology(shards)), topology(shards + 1), out="grown_shard"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("text_crc32")]
    spread = F.struct("doc_id", "size", "text_crc32")
    return numbered(rows, "shard", order, spread, shards).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
