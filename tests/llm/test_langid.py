import random
import zlib

import numpy as np
import pytest

from gleaner.llm import langid


def test_gradients_match_differences():
    net = langid.new_net(["a", "b", "c"], units=4)
    for name in ("tables", "recurrent"):
        setattr(net, name, [x.astype(np.float64) for x in getattr(net, name)])
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 5, (6, 9)).astype(np.uint8)
    target = np.array([0, 1, 2, 0, 1, 2])
    _, grads = langid._gradients(net, rows, target)
    for p, g in zip(net.parameters(), grads):
        at = np.unravel_index(np.abs(g).argmax(), p.shape)
        kept, step = p[at], 1e-2
        p[at] = kept + step
        up = langid._gradients(net, rows, target)[0]
        p[at] = kept - step
        down = langid._gradients(net, rows, target)[0]
        p[at] = kept
        assert g[at] == pytest.approx((up - down) / (2 * step), rel=0.02, abs=1e-5)


SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "eit"], "cc": ["é", "eau", "oi"]}


def texts(n=900, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        out.append((i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60))), lang))
    return out


def test_held_out_accuracy(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.languages(docs).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].lang_pred == y for i, y in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())


def test_sample_is_drawn_from_labelled_texts_of_each_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_TEXTS", 40)
    learned = [i for i in range(8000) if zlib.crc32(str(i).encode()) % 5]
    langs = dict.fromkeys(learned[:600], "many") | dict.fromkeys(learned[700:712], "few") | {learned[-1]: "one"}
    docs = spark.createDataFrame([(i, f"text {i}", langs.get(i)) for i in range(8000)], "doc_id long, text string, lang string")
    got = [y for _, y in langid.sample(docs, "doc_id", "text", "lang")]
    assert {y: got.count(y) for y in got} == {"many": 27, "few": 12, "one": 1}


def test_quotas_share_what_is_left():
    assert langid.quotas({"a": 1, "b": 100, "c": 100}, 41) == {"a": 1, "b": 20, "c": 20}
    assert langid.quotas({"a": 5, "b": 5}, 1) == {"a": 1, "b": 1}


def trained():
    return langid.train([(t.encode(), y) for _, t, y in texts(200)], updates=40)


def test_pooling_reads_whole_texts_and_does_not_mix_them(monkeypatch):
    net = trained()
    short, long = [t.encode() for _, t, _ in texts(40, 2)], ("ka lo " * 3000 + "schung " * 9000).encode()
    alone = np.concatenate([langid.pooled(net, [t]) for t in [*short, long]])
    monkeypatch.setattr(langid, "COLUMNS", 16)
    assert np.allclose(langid.pooled(net, [*short, long]), alone, atol=1e-4)
    p = langid.positions(net, langid.segments(long)).transpose(2, 0, 1).reshape(-1, len(net.labels))[: len(long)]
    assert np.allclose(alone[-1], p.mean(axis=0), atol=1e-3)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_directions_both_count():
    net = trained()
    rows = langid.segments(b"kaloschung eau" * 5)
    changed = rows.copy()
    changed[0, -1] ^= 1
    a, b = langid.positions(net, rows)[0], langid.positions(net, changed)[0]
    assert not np.allclose(a[:, 0], b[:, 0], atol=0) or net.recurrent[1].any()


def test_edges(spark, edge_docs, no_docs):
    rows = langid.languages(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i in (1, 2, 3, 9):
        assert (by[i][0].lang_pred, by[i][0].score) == ("und", 0.0)
    assert {r.lang_pred for r in rows} <= {"und", "en"}
    assert all(r.held_out for r in by[None])
    assert langid.languages(no_docs).count() == 0
    unlabelled = edge_docs.withColumn("lang", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("string"))
    assert {r.lang_pred for r in langid.languages(unlabelled).collect()} == {"und"}
