import random

import numpy as np
import xxhash

from gleaner.llm import graph, simhash
from gleaner.llm.simhash import Split, best_split, fingerprint, fit, join_within, route


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, groups_only=False):
    """Smallest id reachable by links of at most 3 bits, by comparing all pairs; or one id for each group."""
    fps = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    groups = {}
    for k, g in enumerate(label):
        groups.setdefault(g, []).append(rows[k][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    if groups_only:
        return sorted(least.values())
    return [(rows[k][0], format(fps[k], "016x"), least[label[k]]) for k in range(len(rows))]


def test_fingerprint_follows_the_contract():
    for text in ("", None, "  \t", "One", "one two", "One TWO three", "a b c a b c a b c", "é x y z w v", "x " * 50):
        assert fingerprint(None if text is None else text.encode()) & (2**64 - 1) == plain_fingerprint(text)


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(500)).encode()
    whole = fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert fingerprint(text) == whole


def clustered(n, seed):
    """Fingerprints in chains and dense balls among random ones."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        out.add(x)
        for _ in range(rng.choice([0, 0, 0, 5, 60])):
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return np.array(sorted(out), np.uint64)


def plain_roots(fps):
    n = len(fps)
    label = np.arange(n)
    while True:
        close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
        new = np.where(close, label[None, :], n).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_join_within_equals_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 16)
    for seed in range(4):
        fps = clustered(600, seed)
        assert (join_within(fps) == plain_roots(fps)).all()


def test_dense_sets_that_cannot_be_split(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 16)
    fps = np.array(sorted({(1 << a) | (1 << b) for a in range(20) for b in range(20)}), np.uint64)
    assert (join_within(fps) == 0).all()


def test_every_link_meets_in_a_leaf():
    fps = clustered(1500, 9)
    tree = fit(fps[::3], 32, 3)
    leaves = [set(at.tolist()) for _, at in route(tree, fps)]
    assert set().union(*leaves) == set(range(len(fps)))
    close = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    assert all(any(a in leaf and b in leaf for leaf in leaves) for a, b in close.tolist())


def test_split_sides_cover_and_overlap():
    fps = np.arange(256, dtype=np.uint64)
    near, far = Split(0, 3, 2).sides(fps)
    assert (near | far).all() and near.sum() + far.sum() > len(fps)
    assert best_split(np.zeros(5, np.uint64), 3) is None


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 202), (202, 203), (203, 201), (5, 5)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {202: 201, 203: 201}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def texts(n=120):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 5, 200, 400]))
        rows.append((3 * i, " ".join(words)))
        for _ in range(rng.choice([0, 0, 1, 3])):
            changed = words[:]
            changed[rng.randrange(len(words))] = "other"
            rows.append((3 * i + 1 + 3 * n * rng.randrange(1, 9), " ".join(changed)))
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = texts()
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(plain_components(rows))


def test_a_dense_ball_is_spread_over_tasks(spark, monkeypatch):
    """Fingerprints that no vantage point parts: pairs of parts are tasks, and no link is lost."""
    ball = sorted({(1 << a) ^ (1 << b) ^ (1 << c) for a in range(16) for b in range(16) for c in range(16)})
    chain = [(1 << 60) | sum(1 << k for k in range(20, 20 + n)) for n in range(0, 40, 3)]
    fps = spark.createDataFrame([(x,) for x in ball + chain], "fp long")
    want = {r["node"]: r["root"] for r in graph.components(simhash.links(fps)).collect()}
    monkeypatch.setattr(simhash, "HEAVY", 50)
    paired = simhash._paired(spark.createDataFrame([(0, x) for x in ball], "shard int, fp long"))
    sizes = [r["count"] for r in paired.groupBy("shard", "i", "j").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 200
    got = {r["node"]: r["root"] for r in graph.components(simhash.links(fps)).collect()}
    assert got == want and len({got[x] for x in ball if x in got}) == 1


def test_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = simhash.near_duplicates(edge_docs).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(plain_components(rows), key=key)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_deduplicated_keeps_one_of_each_component(spark, edge_docs, no_docs):
    rows = texts(40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.deduplicated(docs).collect())
    assert kept == plain_components(rows, groups_only=True)
    got = simhash.deduplicated(edge_docs)
    assert got.columns == edge_docs.columns
    # 1, 2, 3 and the null text are alike; 5, both 6 and the null id are alike.
    assert sorted(r.doc_id for r in got.collect()) == [1, 4, 5, 7, 8, 9, 10]
    assert simhash.deduplicated(no_docs).count() == 0


def test_rows_without_any_id(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "x y z")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.deduplicated(docs).collect()) == ["a b c d", "x y z"]
