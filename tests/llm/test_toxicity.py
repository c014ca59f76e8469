import math
import random
import zlib

import numpy as np
import pytest

from gleaner.llm import toxicity as tox


def plain_segments(scores):
    """All maximal segments by their definition: no proper subsegment scores as much, and none that has this holds it."""
    n, total = len(scores), np.concatenate([[0.0], np.cumsum(scores)])

    def proper(i, j):
        return all(total[k] > total[i] for k in range(i + 1, j + 1)) and all(total[k] < total[j] for k in range(i, j))

    found = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if proper(i, j)]
    return sorted((i, j) for i, j in found if not any(a <= i and j <= b and (a, b) != (i, j) for a, b in found))


def test_segments_are_all_the_maximal_ones():
    rng = random.Random(0)
    for _ in range(400):
        scores = np.array([rng.choice([-3, -2, -1, 1, 2, 5]) for _ in range(rng.randrange(1, 18))], float)
        got = tox.maximal_segments(scores)
        assert sorted((a, b) for a, b, _ in got) == plain_segments(scores)
        assert all(s == pytest.approx(scores[a:b].sum()) for a, b, s in got)
    assert tox.maximal_segments(np.array([-1.0, -2.0])) == []


def test_lambda_solves_its_equation():
    v, p = np.array([-1.0, 2.0]), np.array([0.8, 0.2])
    rate = tox.karlin_lambda(v, p)
    assert (p * np.exp(rate * v)).sum() == pytest.approx(1.0) and rate > 0.01


def plain_log_odds(texts, name):
    """Signed log-odds ratio of a feature under the Dirichlet prior, drawn towards 0 by its standard error."""
    n = [sum(1 for _, y in texts if y == c) for c in (0, 1)]
    y = [sum(1 for words, c in texts if c == k and any(name in tox.features(w) for w in words)) for k in (0, 1)]
    prior = tox.PRIOR * sum(y) / len(texts)
    side = [math.log((y[k] + prior) / (n[k] + tox.PRIOR - y[k] - prior + tox.LEAST)) for k in (0, 1)]
    odds = side[1] - side[0]
    score = abs(odds) - tox.CAUTION * math.sqrt(sum(1 / (y[k] + prior) for k in (0, 1)))
    return math.copysign(min(score, tox.MOST), odds) if score > 0 else 0.0


def test_log_odds_are_signed_and_equal_plain_ones():
    rng = random.Random(3)
    texts = [([rng.choice(["bad", "vile", "x", "y"]) for _ in range(9)] if i % 3 == 0 else [rng.choice(["kindness", "x", "y", "z"]) for _ in range(9)], int(i % 3 == 0)) for i in range(300)]
    scores = tox.log_odds(*tox._counted(texts))
    names = {f for words, _ in texts for w in words for f in tox.features(w)}
    assert all(scores.get(f, 0.0) == pytest.approx(plain_log_odds(texts, f)) for f in names)
    assert scores["bad"] > 1 and scores["kindness"] < -1 and abs(scores.get("x", 0.0)) < 0.1


def test_clean_words_end_a_passage():
    model = tox.Model({"bad": 3.0, "kind": -4.0}, 1.0, 0.1, -3.0, 2.0)
    assert [x[:2] for x in model.passages("bad bad o bad bad".split())] == [(0, 5)]
    assert [x[:2] for x in model.passages("bad bad kind kind bad bad".split())] == [(0, 2), (4, 6)]


def plain_probability(model, text):
    """From the definitions: all maximal segments by brute force, those above the length's floor, the logistic of their sum."""
    words = tox.tokens(text)
    values = np.array([tox.score_of(w, model.scores) for w in words])
    floor = math.log(max(model.scale * len(words), 1e-12)) if words else 0.0
    excess = [model.rate * values[a:b].sum() - floor for a, b in plain_segments(values)] if words else []
    z = model.bias + model.slope * math.log1p(sum(x for x in excess if x > 0))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def test_query_equals_plain_version(spark):
    rows = [(i, " ".join(t.split()[:30]), y) for i, t, y in corpus(500, 5)] + [(900, "", 0), (901, None, 0)]
    docs, labels = frames(spark, rows)
    model = tox.fit(tox.sample(docs, labels))
    got = {r.doc_id: r.score for r in tox.scored(docs, labels).collect()}
    assert all(got[i] == pytest.approx(plain_probability(model, t), abs=1e-9) for i, t, _ in rows)


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    clean = [f"word{i}" for i in range(800)]
    out = []
    for i in range(n):
        words = rng.choices(clean, k=rng.randrange(20, 300))
        bad = i % 6 == 0
        if bad:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(["vile", "nasty", "grunz" + rng.choice("abcdefgh") + rng.choice("klm")]) for _ in range(rng.randint(2, 5))]
        elif i % 37 == 0:
            words[3] = "nasty"
        out.append((i, " ".join(words), int(bad)))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy_and_passages(spark):
    rows = corpus()
    got = {r.doc_id: r for r in tox.scored(*frames(spark, rows)).collect()}
    held = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    right = sum(got[i].predicted == y for i, _, y in held)
    assert right / len(held) > 0.95
    for i, t, y in held:
        r = got[i]
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if y and r.predicted:
            assert r.n_passages == len(r.passages) and [x.excess for x in r.passages] == sorted((x.excess for x in r.passages), reverse=True)
            worst = tox.tokens(t)[r.passages[0].start : r.passages[0].stop]
            assert any(w in ("vile", "nasty") or w.startswith("grunz") for w in worst)


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = corpus(600)
    flipped = [(i, t, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, t, y in rows]
    a, b = ({r.doc_id: r.score for r in tox.scored(*frames(spark, x)).collect()} for x in (rows, flipped))
    assert a == b


def test_significant_passages_depend_on_length():
    model = tox.Model({"bad": 2.0}, 1.0, 0.1, -3.0, 2.0)
    short, long = ["bad", "bad"], ["bad", "bad"] + ["x"] * 5000
    assert model.passages(short) and not model.passages(long)
    assert len(model.passages((["bad"] * 8 + ["x"] * 400) * 3)) == 3


def test_without_toxic_keeps_clean_rows(spark):
    rows = corpus()
    docs, labels = frames(spark, rows)
    kept = {r.doc_id for r in tox.without_toxic(docs, docs, labels).collect()}
    toxic = {i for i, _, y in rows if y}
    assert len(kept & toxic) < 0.06 * len(toxic) and len(kept - toxic) > 0.97 * (len(rows) - len(toxic))


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (5, 0, 0), (None, 1, 1), (10, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    rows = tox.scored(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert tox.scored(no_docs, labels).count() == 0
    none = labels.filter("doc_id = -1")
    assert {r.predicted for r in tox.scored(edge_docs, none).collect()} == {0}
    assert tox.without_toxic(edge_docs, edge_docs, none).count() == edge_docs.count()
