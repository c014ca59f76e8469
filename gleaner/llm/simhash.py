"""SimHash near-duplicates, found with vantage-point trees.

Every text gets a 64-bit fingerprint. Distinct fingerprints are dealt to
shards by a tree of vantage points: a node sends those nearer than its radius
to one child, the others to the second, and by the triangle bound only those
within the link distance of the boundary to both. So two fingerprints that
link meet in some shard; there the same tree goes on until the sets are small
enough to compare whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, hinted, sampled, written
from .graph import components

BITS = 64
SHINGLE = 3
SEED = 42
LINK = 3

#: Shingles whose bits are counted at once; bounds a worker's memory.
BLOCK = 1 << 18

#: Fingerprints meant for one shard, and the most shards there are.
SHARD_ROWS, MAX_SHARDS = 1 << 12, 16384

#: Fingerprints per shard on which the shards' tree is fitted.
SAMPLE_PER_SHARD = 128

#: A larger shard, which the tree could not split, is cut into parts of about
#: this size by hash, and every pair of parts is a task.
HEAVY = 1 << 15

#: Sets up to this size are compared whole.
LEAF = 512

#: Vantage points tried at each node.
TRIED = 6


def shingles(words: list[bytes], size: int = SHINGLE) -> list[bytes]:
    """Runs of ``size`` words joined by a space, repeats included; fewer words make one."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)))))


def bit_counts(hashes: bytes) -> np.ndarray:
    """How many of the big-endian 64-bit ``hashes`` have each bit, the highest first."""
    out = np.zeros(BITS, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, BITS // 8)
    for at in range(0, len(rows), BLOCK):
        out += np.unpackbits(rows[at : at + BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: bytes | None, digest=functools.partial(xxhash.xxh64_digest, seed=SEED)) -> int:
    """The signed 64-bit SimHash of a UTF-8 text; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    if n <= BLOCK:
        counts = bit_counts(b"".join(map(digest, shingles(words))))
    else:
        counts = np.zeros(BITS, np.int64)
        for at in range(0, n, BLOCK):
            counts += bit_counts(b"".join(map(digest, shingles(words[at : at + BLOCK + SHINGLE - 1]))))
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


@dataclass(frozen=True)
class Split:
    """Fingerprints within ``radius`` of ``vantage`` go to ``near``, others to ``far``.

    ``near`` also gets those up to ``link`` beyond the radius: of two that
    link, if one is within the radius, the other is at most so far beyond it.
    """

    vantage: int
    radius: int
    link: int

    def sides(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        away = np.bitwise_count(fps ^ np.uint64(self.vantage))
        return away <= self.radius + self.link, away > self.radius


def best_split(fps: np.ndarray, link: int) -> Split | None:
    """The split, of some vantage points, whose children are smallest; None if none shrinks them.

    A child of size s costs s squared: what comparing it whole would take.
    """
    best, least = None, 0.95 * float(len(fps)) ** 2
    for vantage in fps[np.linspace(0, len(fps) - 1, TRIED).astype(int)]:
        below = np.cumsum(np.bincount(np.bitwise_count(fps ^ vantage), minlength=BITS + 1)).astype(float)
        near = below[np.minimum(np.arange(BITS + 1) + link, BITS)]
        cost = near**2 + (len(fps) - below) ** 2
        at = int(cost.argmin())
        if cost[at] < least:
            best, least = Split(int(vantage), at, link), cost[at]
    return best


def fit(sample: np.ndarray, shards: int, link: int) -> list:
    """A tree of at most ``shards`` leaves, nested as [split, near, far]; a leaf is its number."""
    groups = [(len(sample), sample, path) for path in [()]]
    splits: dict[tuple, Split] = {}
    done = []
    while groups and len(groups) + len(done) < shards:
        groups.sort(key=lambda g: g[0])
        _, fps, path = groups.pop()
        split = best_split(fps, link) if len(fps) > 2 else None
        if split is None:
            done.append(path)
            continue
        splits[path] = split
        for side, mask in enumerate(split.sides(fps)):
            part = fps[mask]
            groups.append((len(part), part, (*path, side)))
    leaves = {path: n for n, path in enumerate([*done, *(g[2] for g in groups)])}

    def node(path: tuple) -> object:
        return leaves[path] if path in leaves else [splits[path], node((*path, 0)), node((*path, 1))]

    return node(())


def route(tree: object, fps: np.ndarray, at: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, positions in ``fps``) for every leaf that gets any."""
    at = np.arange(len(fps)) if at is None else at
    if not len(at):
        return
    if isinstance(tree, int):
        yield tree, at
        return
    for child, mask in zip(tree[1:], tree[0].sides(fps[at])):
        yield from route(child, fps, at[mask])


class Union:
    """Disjoint sets of positions; the smallest position is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = int(self.up[x])
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        """Parents come before children, so that one pass in order settles all."""
        up = self.up
        while (nxt := up[up]).tobytes() != up.tobytes():
            up = nxt
        return up


def _join_block(left: np.ndarray, right: np.ndarray, fps: np.ndarray, union: Union, link: int) -> None:
    close = np.bitwise_count(fps[left][:, None] ^ fps[right][None, :]) <= link
    a, b = np.nonzero(close)
    if not len(a):
        return
    # Pairs already joined fall away together: dense sets make many of them.
    roots = union.roots()
    a, b = roots[left[a]], roots[right[b]]
    keep = a != b
    if keep.any():
        low, high = np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])
        for x, y in np.unique(np.stack([low, high], 1), axis=0).tolist():
            union.join(x, y)


def join_within(fps: np.ndarray, link: int = LINK) -> np.ndarray:
    """For each of the distinct ``fps`` the position of its class's first member here."""
    union = Union(len(fps))
    stack = [np.arange(len(fps))]
    while stack:
        at = stack.pop()
        split = best_split(fps[at], link) if len(at) > LEAF else None
        if split is not None:
            stack += [at[mask] for mask in split.sides(fps[at]) if mask.any()]
            continue
        for i in range(0, len(at), LEAF):
            for j in range(i, len(at), LEAF):
                _join_block(at[i : i + LEAF], at[j : j + LEAF], fps, union, link)
    return union.roots()


def links(distinct: DataFrame, link: int = LINK) -> DataFrame:
    """Edges (a, b) between the distinct long ``fp``, enough to connect what links: no two in a class within a shard but the first."""
    n = distinct.count()
    shards = int(min(MAX_SHARDS, max(1, 2 ** int(np.ceil(np.log2(max(1, n / SHARD_ROWS)))))))
    sample = sampled(distinct.select("fp"), n, shards * SAMPLE_PER_SHARD, "fp")
    tree = fit(np.array([r[0] for r in sample.collect()], np.int64).view(np.uint64), shards, link)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for leaf, at in route(tree, fps.view(np.uint64)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), leaf, np.int32)), pa.array(fps[at])], ["shard", "fp"]
                )

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(rows["fp"].to_numpy(np.int64))
        roots = join_within(fps.view(np.uint64), link)
        tied = roots != np.arange(len(fps))
        return pd.DataFrame({"a": fps[roots[tied]], "b": fps[tied]})

    dealt = written(distinct.select("fp").mapInArrow(deal, "shard int, fp long"))
    return _paired(dealt).groupBy("shard", "i", "j").applyInPandas(meet, "a long, b long")


def _paired(dealt: DataFrame, heavy: int | None = None) -> DataFrame:
    """(shard, i, j, fp): every two fingerprints of a shard meet in a pair (i, j) of its parts; a shard of usual size has one part."""
    heavy = HEAVY if heavy is None else heavy
    # A row for each shard that is too large, MAX_SHARDS at most.
    sizes = durable(dealt.groupBy("shard").count().filter(F.col("count") > heavy).select("shard", F.ceil(F.col("count") / heavy).cast("int").alias("parts")))
    if sizes.isEmpty():
        return dealt.select("shard", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    rows = dealt.join(F.broadcast(sizes), "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return other.select("shard", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: int = LINK) -> DataFrame:
    """Per row doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable) and class_fingerprint (the least one, as a signed number, of the component).

    Nulls: a null, empty or blank text has fingerprint 0, which links like any
    other; a null id never is a component's id unless none of its rows has
    one. Repeated rows each get their row; extra columns are ignored; an empty
    table gives an empty result.
    """
    rows = written(fingerprints(docs, id_col, text_col))
    nodes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    tied = components(links(nodes, link))
    rooted = nodes.join(tied, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("child")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("size"))
    # A fingerprint of one row and without links is its row's own component.
    shared = durable(
        rooted.join(least, "root").filter("n > 1 or size > 1").select(F.col("fp").alias("__fp"), "component_id", "root")
    )
    return rows.join(hinted(shared, shared.count(), 40), F.col("fp") == F.col("__fp"), "left").select(
        "doc_id",
        _hex(F.col("fp")).alias("fingerprint"),
        F.when(F.col("__fp").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        _hex(F.coalesce("root", "fp")).alias("class_fingerprint"),
    )


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id's.

    Ids that repeat, or are null, don't tell rows apart; these rows are told
    apart by id and fingerprint. A component without any id keeps a row too.
    """
    found = written(near_duplicates(docs, id_col, text_col))
    repeats = durable(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__again")))
    again = hinted(repeats, repeats.count(), 16)
    spare = durable(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct())
    gone = hinted(spare, spare.count(), 16)
    plain = docs.filter(F.col(id_col).isNotNull()).join(again, F.col(id_col) == F.col("__again"), "left_anti")
    kept = plain.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
    if repeats.isEmpty() and found.filter("doc_id is null").isEmpty():
        return kept
    chosen = found.filter("doc_id <=> component_id").groupBy("class_fingerprint").agg(F.min(F.struct("fingerprint", "doc_id")).alias("c"))
    chosen = chosen.select(F.col("c.doc_id").alias("__id"), F.col("c.fingerprint").alias("__of"))

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint).astype("int64")

    alike = docs.join(again, F.col(id_col) == F.col("__again"), "left_semi").unionByName(docs.filter(F.col(id_col).isNull()))
    alike = alike.withColumn("__fp", _hex(simhash(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__of"))
    return kept.unionByName(alike.join(chosen, same, "left_semi").dropDuplicates([id_col, "__fp"]).drop("__fp"))
