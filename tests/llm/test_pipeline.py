import random
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import sharding, toxicity
from gleaner.llm.common import table

from .test_mixing import plain_count
from .test_sharding import plain_shard
from .test_simhash import plain_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [" ".join(f"q{rng.randrange(500)}" for _ in range(20)) + ". " + " ".join(f"a{rng.randrange(500)}" for _ in range(8)) for _ in range(12)]
    docs, labels = [], []
    for i in range(500):
        words = [f"word{rng.randrange(900)}" for _ in range(rng.randrange(30, 160))]
        bad = i % 7 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "foul"]))
        if i % 11 == 3:
            words[5:5] = rng.choice(items).split()
        docs.append((i, " ".join(words), "en", "big" if i % 3 else f"s{i % 4}", None))
        labels.append((i, 1, int(bad)))
    for i in range(500, 560):  # copies, exact and near
        text = docs[rng.randrange(500)][1].split()
        if i % 2:
            text[len(text) // 2] = "other"
        docs.append((i, " ".join(text), "en", "copies", None))
    docs += [(560, None, None, None, None), (561, "", "en", "big", 0), (562, "", "en", "big", 0)]
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages_equal_plain_versions(spark, folder):
    docs = table(spark, folder, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    items = [r.text for r in table(spark, folder, "benchmark").collect()]
    model = toxicity.fit(toxicity.sample(docs, table(spark, folder, "labels")))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash_dedup", "decontamination", "mixing", "sharding"]

    clean = [r for r in rows if model.probability(r[1]) < 0.5]
    got = stages["toxicity"](spark, docs, folder)
    assert got.columns == COLUMNS and sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in clean)
    assert len(clean) < len(rows) - 50

    single = plain_components([r[:2] for r in clean], groups_only=True)
    got = stages["simhash_dedup"](spark, got, folder)
    assert got.columns == COLUMNS and sorted(r.doc_id for r in got.collect()) == single
    assert len(single) < len(clean) - 20

    kept = [r for r in clean if r[0] in set(single) and not any(f" {x} " in f" {r[1]} " for x in items)]
    got = stages["decontamination"](spark, got, folder)
    assert got.columns == COLUMNS and sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in kept)
    assert len(kept) < len(single) - 10

    n = Counter(r[2] for r in kept)
    want = Counter({r[0]: plain_count(len(kept) / len(n) / n[r[2]], 42, str(r[0])) for r in kept})
    got = stages["mixing"](spark, got, folder).persist()
    assert got.columns == COLUMNS and Counter(r.doc_id for r in got.collect()) == +want

    out = stages["sharding"](spark, got, folder).collect()
    tree = sharding.topology(8)
    assert all(r.shard == plain_shard(str(r.doc_id), tree) for r in out) and Counter(r.doc_id for r in out) == +want
    for s in range(8):
        own = sorted(r.slot for r in out if r.shard == s)
        assert own == list(range(len(own)))
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r.doc_id, r.shard, r.slot)
    assert sorted(map(key, whole)) == sorted(map(key, out))


def test_empty_documents(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, folder, name).filter(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_queries(spark, folder):
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == []
    assert names["op6_decontaminate"](spark, folder).count() > 20
