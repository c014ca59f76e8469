import math
import random
from collections import Counter

import pytest

from gleaner.llm import decontaminate as dc


def items(n, seed, vocabulary=300):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(20_000)]
    out = []
    for i in range(n):
        k = rng.randint(12, 60)
        at = rng.randrange(len(words) - k)
        text = " ".join(words[at : at + k // 2]) + ". " + " ".join(words[at + k // 2 : at + k])
        out.append((i, text.encode()))
    return out


def plain_scores(rows, terms):
    """BM25 shares of every item for distinct terms, straight from the formula."""
    docs = [dc.words_of(t) for _, t in rows]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))

    def weight(w, d):
        tf = d.count(w)
        return math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) if tf else 0.0

    return {i: sum(weight(w, d) for w in set(terms)) / sum(weight(w, d) for w in set(d)) for (i, _), d in zip(rows, docs)}


@pytest.mark.parametrize("threshold", [0.2, 0.35, 0.6])
def test_wand_retrieves_exactly_what_scores_enough(threshold):
    rows = items(150, 1)
    index = dc.Index(rows)
    rng = random.Random(2)
    found = 0
    for _ in range(120):
        passage = dc.words_of(rng.choice(rows)[1])[: rng.randint(5, 40)] + [f"w{int(rng.paretovariate(0.7)) % 300}".encode() for _ in range(40)]
        want = {i for i, s in plain_scores(rows, passage).items() if s >= threshold}
        terms = sorted({index.terms[w] for w in passage if w in index.terms})
        got = [x for length in range(len(index.longest)) for x in index.retrieve(length, terms, threshold)]
        assert {index.ids[i] for i, _ in got} == want and len(got) == len(want)
        found += len(want)
    assert found


def test_classes_cover_all_items_in_order_of_length():
    index = dc.Index(items(80, 3))
    assert [len(w) for w in index.words] == sorted(len(w) for w in index.words)
    assert index.longest == sorted(index.longest) and index.longest[-1] == len(index.words[-1])


def plain_common(a, b):
    if not a or not b:
        return 0
    if a[-1] == b[-1]:
        return 1 + plain_common(a[:-1], b[:-1])
    return max(plain_common(a[:-1], b), plain_common(a, b[:-1]))


def test_common_is_a_longest_subsequence():
    rng = random.Random(4)
    for _ in range(80):
        a, b = ([rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randrange(9))] for _ in range(2))
        at = dc.common(a, b)
        assert len(at) == plain_common(a, b) and at == sorted(set(at))


def test_common_of_long_items_is_quick():
    rng = random.Random(9)
    a = [b"w%d" % rng.randrange(3000) for _ in range(6000)]
    b = [x for x in a if rng.random() < 0.9]
    at = dc.common(a, b)
    assert len(at) == len(b) and [a[i] for i in at] == b


def best_common(part, passage):
    """The longest common subsequence with any of the windows that the operator looks at, by the plain recursion's table."""
    size, step, best = round(dc.SPREAD * len(part)), max(1, len(part) // 4), 0
    for at in range(0, max(1, len(passage) - size + step), step):
        row = [0] * (len(part) + 1)
        for y in passage[at : at + size]:
            last, row = row, [0]
            for i, x in enumerate(part):
                row.append(max(last[i] + (x == y), last[i + 1], row[i]))
        best = max(best, row[-1])
    return best


def plain_leaks(rows, text):
    """Items that some passage holds: every passage against every item, by the formulas alone."""
    kept = [(i, t) for i, t in rows if dc.words_of(t)]
    longest = dc.totals(Counter(len(dc.words_of(t)) for _, t in kept), {}).longest
    words, out = dc.words_of(text), set()
    for shortest, most in zip([0, *longest], longest):
        for start in range(0, max(1, len(words) - 2 * most), 2 * most):
            passage = words[start : start + 4 * most]
            scores = plain_scores(kept, passage)
            for i, t in kept:
                item, q = dc.words_of(t), dc.question_words(t)
                if shortest < len(item) <= most and scores[i] >= dc.THRESHOLD - 1e-9:
                    found = [best_common(x, passage) for x in (item[:q], item[q:])]
                    each = all(n >= dc.EACH * dc.OVERLAP * len(x) - 1e-9 for n, x in zip(found, (item[:q], item[q:])))
                    if each and sum(found) >= dc.OVERLAP * len(item) - 1e-9:
                        out.add(i)
    return out


def test_leaks_equal_plain_version():
    rows, docs, _ = planted(8)
    rows = rows[:25]
    rng, index, found = random.Random(10), dc.Index(rows), 0
    texts = [t for _, t in docs[:60]] + [" ".join(rng.sample(t.decode().split(), 12) + t.decode().split()[2:]) for _, t in rows]
    for text, got in zip(texts, dc.leaks_of(index, [t.encode() for t in texts])):
        want = plain_leaks(rows, text.encode())
        assert {index.ids[k] for k in got} == want
        found += len(want)
    assert found > 20


def test_texts_in_parts_are_searched_alike(monkeypatch):
    rows, docs, _ = planted(12)
    index, texts = dc.Index(rows), [t.encode() for _, t in docs[:50]] + [None, b""]
    whole = list(dc.leaks_of(index, texts))
    monkeypatch.setattr(dc, "PART_SIZE", 50)
    assert list(dc.leaks_of(index, texts)) == whole and any(whole)


def altered(words, kind, rng):
    q = len(words) * 2 // 3
    if kind == "parted":
        return words[:q] + [f"g{rng.randrange(900)}" for _ in words] + words[q:]
    if kind == "dropped":
        return [w for w in words if rng.random() > 0.1]
    return [f"g{rng.randrange(900)}" if rng.random() < 0.1 else w for w in words]


@pytest.mark.parametrize("kind", ["parted", "dropped", "swapped"])
def test_recall_of_altered_items(kind):
    rng = random.Random(11)
    vocabulary = [f"v{n}" for n in range(5000)]
    rows = []
    for i in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(15, 60))]
        cut = len(words) * 2 // 3
        rows.append((i, (" ".join(words[:cut]) + ". " + " ".join(words[cut:])).encode()))
    index = dc.Index(rows)
    filler = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(20, 300)))
    texts = [f"{filler()} {' '.join(altered([w.decode() for w in dc.words_of(t)], kind, rng))} {filler()}".encode() for _, t in rows]
    found = sum(i in {index.ids[k] for k in got} for (i, _), got in zip(rows, dc.leaks_of(index, texts)))
    assert found >= 0.9 * len(rows)
    clean = [filler().encode() for _ in range(200)]
    assert not any(dc.leaks_of(index, clean))


def test_questions_and_answers():
    assert dc.question_words(b"One two three? Four five.") == 3
    assert dc.question_words(b"one two three four five six seven eight") == 6
    assert dc.question_words(b"one") == 0 and dc.question_words(b"...") == 0


def planted(seed=7):
    rng = random.Random(seed)
    rows = items(60, 5)
    filler = lambda n: " ".join(f"f{rng.randrange(4000)} w{int(rng.paretovariate(0.7)) % 300}" for _ in range(n // 2))
    docs, want = [], set()
    for i in range(200):
        text, n = filler(rng.choice([4, 40, 400])), rng.randrange(60)
        kind = i % 5
        item = rows[n][1].decode()
        if kind == 1:
            text, _ = text + " " + item + " " + filler(60), want.add((i, n))
        elif kind == 2:  # other case and marks, a word changed
            words = item.upper().replace(".", " !!").split()
            words[len(words) // 3] = "CHANGED"
            text, _ = filler(90) + "\n" + " , ".join(words), want.add((i, n)) if len(dc.words_of(rows[n][1])) >= 20 else None
        elif kind == 3:  # the question alone isn't a leak
            text += " " + item.split(". ")[0]
        docs.append((i, text))
    return rows, docs, want


def test_contaminated_finds_planted_items(spark):
    rows, docs, want = planted()
    found = dc.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, t.decode()) for i, t in rows], "item_id long, text string")
    ).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert want <= got
    assert {d for d, _ in got} <= {i for i in range(200) if i % 5 in (1, 2)}


def test_large_item_tables_are_searched_in_groups(spark, monkeypatch):
    rows, docs, _ = planted()
    frames = (
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, t.decode()) for i, t in rows], "item_id long, text string")
    )
    exact = [(d, i) for i, t in rows for d, x in docs if f" {t.decode()} " in f" {x} "]
    monkeypatch.setattr(dc, "INDEX_BYTES", 4000)
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(*frames).collect()}
    assert set(exact) <= got


def test_groups_give_what_one_index_gives(spark, monkeypatch):
    rows, docs, _ = planted()
    frames = (
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, t.decode()) for i, t in rows], "item_id long, text string")
    )
    found = lambda: sorted((r.doc_id, r.item_id, round(r.bm25_share, 9)) for r in dc.contaminated(*frames).collect())
    whole = found()
    monkeypatch.setattr(dc, "INDEX_BYTES", 8000)
    assert found() == whole


def test_edges(spark, edge_docs, no_docs):
    schema = "item_id long, text string, doc_id int, score double"
    bench = spark.createDataFrame(
        [(1, "same words here now", 1, 2.0), (2, None, 1, 2.0), (None, "one", 1, 2.0), (3, "", 1, 2.0), (4, "...", 1, 2.0), (5, "same words here now", 1, 2.0)], schema
    )
    got = sorted(((r.doc_id, r.item_id) for r in dc.contaminated(edge_docs, bench).collect()), key=str)
    assert got == sorted([(4, None)] + [(d, i) for d in (5, 6, 6, None) for i in (1, 5)], key=str)
    kept = dc.decontaminated(edge_docs, bench)
    assert kept.columns == edge_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 7, 8, 9, 10]
    none = spark.createDataFrame([], schema)
    assert dc.contaminated(edge_docs, none).count() == 0 and dc.decontaminated(edge_docs, none).count() == edge_docs.count()
    assert dc.contaminated(no_docs, bench).count() == 0 and dc.decontaminated(no_docs, bench).count() == 0
