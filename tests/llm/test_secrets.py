import hashlib
import math
import random
import re
from collections import Counter

from gleaner.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    text = text or ""
    base = {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8],
        "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16],
        "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32],
    }
    more = []
    for cls in secrets.CLASSES:
        for m in re.finditer(f"{cls.alphabet}{{{secrets.WINDOW},}}", text):
            if not all(re.search(n, m[0]) for n in cls.must) or any(re.search(a, m[0]) for a in secrets.ALLOWED):
                continue
            spans = []
            for i in range(len(m[0]) - secrets.WINDOW + 1):
                counts = Counter(m[0][i : i + secrets.WINDOW])
                bits = -sum(c / secrets.WINDOW * math.log2(c / secrets.WINDOW) for c in counts.values())
                if bits >= cls.threshold - 1e-9:
                    a, b = m.start() + i, m.start() + i + secrets.WINDOW
                    if spans and spans[-1][1] >= a:
                        spans[-1][1] = b
                    else:
                        spans.append([a, b])
            more += [(cls.kind, a, b) for a, b in spans]
    listed = [(k, a, b) for k, spans in base.items() for a, b in spans]
    order = lambda x: (x[1], secrets.KINDS.index(x[0]), x[2])
    more = [x for x in more if not any(a < x[2] and x[1] < b for _, a, b in listed)]
    join = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(xs, key=order))
    return (*(len(base[k]) for k in ("assign", "access", "hex")), hashlib.sha256(join(listed).encode()).hexdigest(), join(listed + more))


def random_text(rng):
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    mixed = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n))
    parts = [
        "été", "token", "=", ":", '"', "'", " ", "\n", "PassWord = ", "secret: ", "api_key='", "apikey=", "abc", "AKIA", "AKIA" + mixed(14).upper(), "ſecret=", "\U0001f600",
        hexes(31), hexes(32), hexes(40), mixed(8), mixed(7), mixed(24), mixed(45), mixed(20).lower(), "word-with-many-parts-in-it", "a" * 40,
        "123e4567-e89b-12d3-a456-426614174000", "DEADBEEF" * 4, "secret = token : abcdefghij", hexes(24).upper(),
    ]
    return "".join(rng.choices(parts, k=rng.randrange(0, 14)))


def test_equals_plain_version(spark):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(600)] + [None, "", "x" * 100_000, "AKIA" + "A" * 12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in secrets.scanned(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]
    assert any("entropy_base64" in g[-1] for g in got.values()) and any("entropy_hex" in g[-1] for g in got.values())


def test_long_runs_of_any_class(spark):
    rng = random.Random(8)
    base64 = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=60_000))
    texts = [
        "Ab1/" * 25_000, "Ab1/" * 25_000 + "A", "/" + "ab-" * 30_000 + "c", base64, "".join(rng.choices("0123456789abcdef", k=40_000)),
        "".join(rng.choices("0123456789ABCDEF", k=40_000)), "token=abcdefgh1 " * 5000, (base64[:25] + " ") * 3000, ("secret=" + base64[:30] + " " + base64[50:80] + "\n") * 1000,
        ("A1b2" * 8 + base64[:24]) * 300,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in secrets.scanned(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]


def test_ten_megabytes_of_one_run(spark):
    rng = random.Random(9)
    base64 = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=100_000))
    docs = spark.createDataFrame([(0, "Ab1/" * 2_500_000 + "Ab1"), (1, base64)], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.spans for r in secrets.scanned(docs).collect()}
    assert got[0] == "" and got[1].startswith("entropy_base64:0:")


def test_allow_list_suppresses(spark):
    docs = spark.createDataFrame([(0, "id 123e4567-e89b-12d3-a456-426614174000 end"), (1, "see Some-Quite-Long-Name-Of-Things2 here")], "doc_id long, text string")
    assert [r.spans for r in secrets.scanned(docs).collect()] == ["", ""]


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(0, "x")], "doc_id long, text string")
    plan = secrets.scanned(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edges(edge_docs, no_docs):
    rows = secrets.scanned(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(r.spans == "" for r in rows)
    assert secrets.scanned(no_docs).count() == 0


def test_sql_twin_equals_plain_version():
    import duckdb
    import pandas as pd

    from gleaner.llm import queries

    rng = random.Random(6)
    texts = [random_text(rng).replace("ſ", "s") for _ in range(400)] + ["", None]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    rel = con.sql(queries.oracle_sql()["op10_secrets"])
    got = {r[0]: r[1:] for r in rel.fetchall()}
    assert rel.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]
