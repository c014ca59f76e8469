import hashlib
import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from gleaner.llm import sharding


def plain_shard(key, node):
    if node.shard is not None:
        return node.shard

    def draw(child):
        n = int(hashlib.md5(f"{key}|{child.name}".encode()).hexdigest()[: sharding.DIGITS], 16)
        return math.log((n + 0.5) / 16**sharding.DIGITS) / child.weight

    return plain_shard(key, max(node.children, key=draw) if len(node.children) > 1 else node.children[0])


def test_equals_plain_version_and_law(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(4000)], "doc_id long, text string")
    rows = sharding.sharded(docs, 8).collect()
    assert len(rows) == 4000
    trees = sharding.topology(8), sharding.topology(9)
    for r in rows[::17]:
        assert (r.shard, r.grown_shard) == tuple(plain_shard(str(r.doc_id), t) for t in trees)
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    assert 300 < sum(r.grown_shard == 8 for r in rows) < 600
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) < 1.25 * 500
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert all(r["size"] == r.doc_id % 7 + 1 and r.text_crc32 == zlib.crc32(b"x" * (r.doc_id % 7)) for r in rows)
    again = {r.doc_id: r.slot for r in sharding.sharded(docs.repartition(3), 8).collect()}
    assert all(again[r.doc_id] == r.slot for r in rows)


def moved(before, after):
    return {(plain_shard(str(k), before), plain_shard(str(k), after)) for k in range(3000)} - {(s, s) for s in range(100)}


def test_weight_changes_move_rows_into_that_subtree_alone():
    tree = sharding.topology(8)
    region = tree.children[1]
    rack = region.children[0]
    heavier = sharding.Node(rack.children[0].name, shard=rack.children[0].shard, own=2.0)
    grown = sharding.Node("root", (tree.children[0], sharding.Node(region.name, (sharding.Node(rack.name, (heavier, rack.children[1])), region.children[1]))))
    moves = moved(tree, grown)
    assert moves and all(b in (4, 5, 6, 7) for _, b in moves)
    assert all(b in (4, 5) for a, b in moves if a in (6, 7)) and all(b == 4 for a, b in moves if a == 5)


def test_weightless_nodes_get_nothing(spark):
    tree = sharding.Node("root", (sharding.Node("a", shard=0, own=0.0), sharding.Node("b", shard=1, own=1.0)))
    assert {r.shard for r in sharding.assign(spark.range(50).withColumnRenamed("id", "doc_id"), tree).collect()} == {1}


def test_equal_rows_are_numbered_in_slices_of_their_own(spark, tmp_path):
    rows = [(7, "hot", 0)] * 900 + [(i, "x", i % 2) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    spread = F.struct("doc_id", "text")
    out = sharding.numbered(docs, "shard", [F.col("doc_id"), F.col("text")], spread, 2, slice_rows=20)
    for shard in (0, 1):
        slots = sorted(r.slot for r in out.filter(F.col("shard") == shard).collect())
        assert slots == list(range(sum(r[2] == shard for r in rows)))
    assert out.columns == ["doc_id", "text", "shard", "slot"]


def test_edges(edge_docs, no_docs):
    rows = sharding.sharded(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    null = next(r for r in rows if r.doc_id == 1)
    assert (null["size"], null.text_crc32) == (1, 0)
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert sharding.sharded(no_docs).count() == 0
