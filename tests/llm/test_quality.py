import re

from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import quality


def plain_repeats(words, window=8):
    seen = {}
    for i in range(len(words) - window + 1):
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(window)}
    return len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_words_equal_plain_version(words):
    assert quality.repeated_words(words) == plain_repeats(words)


def test_long_text_with_a_repeated_passage():
    words = [str(i).encode() for i in range(30_000)]
    assert quality.repeated_words(words) == 0
    assert quality.repeated_words(words + words[:50]) == 100


def test_base_statistics():
    text = "a #b\n\nx y\nx y\n \nx y z $$ é"
    t = quality.Text(text)
    words = re.findall("[^\x20\x09-\x0d]+", text)
    assert [w.decode() for w in t.words] == words and t.word_chars == sum(map(len, words))
    assert (t.n_symbols, t.n_dup_lines, len(t.lines)) == (3, 1, 4)


def test_order_of_rules_changes_no_verdict():
    texts = ["good words " * 3, " ".join(f"word{i}" for i in range(40)), "# $ " * 30, "\n".join(["same line of text"] * 9), "1 2 3 " * 20, None]
    for text in texts:
        verdicts = {quality.judge(text, order) for order in (list(quality.RULES), list(quality.RULES)[::-1])}
        assert len(verdicts) == 1


def test_a_rejected_text_costs_no_more_statistics():
    t = quality.Text("# $ " * 30)
    assert not quality.passes(t, ["symbols", "repeats", "few_letters", "odd_lines"])
    assert {"n_symbols", "words"} <= set(t.__dict__) and not {"n_repeat_words", "lines"} & set(t.__dict__)


def test_words_with_letters_are_those_of_the_contract():
    for word, has in (("½0", False), ("Ⅷ", False), ("²", False), ("é", True), ("9x", True), ("--", False), ("1\u00a0a", True), ("ǅ", True), ("ª", True)):
        assert quality.has_letter(word.encode()) == has
    order = list(quality.RULES)
    assert not quality.judge(" ".join(f"½{n}" for n in range(300)), order)[-1]
    half = " ".join(f"{n}\u00a0word" if n % 2 else f"{n}{n}" for n in range(400))
    assert not quality.judge(half, order)[-1]


def test_rows_equal_the_sql(spark):
    import duckdb
    import pandas as pd

    from gleaner.llm import queries

    texts = [
        None, "", "few words", " ".join(f"½{n}" for n in range(300)), " ".join(f"{n}\u00a0word" if n % 2 else f"{n}{n}" for n in range(400)),
        " ".join(f"word{n}" for n in range(50)), "# $ " * 30, "\n".join(["same line of text"] * 9 + [f"w{n}" for n in range(40)]), "a b c d e f g h " * 5,
        "\n".join(f"- point {n} is this" for n in range(20)), "\n".join(f"unfinished line number {n}…" for n in range(20)), "aa aa " + "bb " * 20 + " ".join(f"x{n}" for n in range(20)),
    ]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    rel = con.sql(queries.oracle_sql()["op8_quality"])
    got = quality.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert rel.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
    kept = {r.doc_id for r in got.collect() if r.kept}
    assert kept and {r.doc_id for r in quality.filtered(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()} == kept


def test_plan_puts_the_best_rejection_per_cost_first():
    texts = [" ".join(f"word{i}" for i in range(k, k + 40)) for k in range(20)] + [" ".join(f"#${i}" for i in range(40))] * 20
    order = quality.plan(texts)
    assert {name for name, _, _ in order} == set(quality.RULES)
    # What rejects nothing that is left comes last: one rule finds all the bad texts.
    assert order[0][0] in ("symbols", "few_letters") and order[0][2] == 0.5
    assert all(share == 0 for _, _, share in order[1:])
    assert quality.plan([]) and {name for name, _, _ in quality.plan(["one"])} == set(quality.RULES)


def test_edges(edge_docs, no_docs):
    rows = quality.judged(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].base_failed and not by[1].kept and by[1].n_words == 0
    assert by[7].n_words == 60_000 and by[7].n_repeat_words == 60_000 and by[7].base_failed and not by[7].kept
    assert by[10].n_words == 60 and by[10].base_failed
    assert quality.judged(no_docs).count() == 0
