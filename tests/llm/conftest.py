import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, shard int, slot long, copy int, rank int, h string, rate double"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), 1.0, 2, 3, 4, 5, 6, "x", 7.0)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty, blank, very long and repeated texts, ids that repeat, columns whose names operators use themselves."""
    rows = [
        row(1, None), row(2, ""), row(3, " \t\n"), row(4, "one"), row(5, "same words here now"), row(6, "same words here now"),
        row(6, "same words here now"), row(None, "same words here now"), row(None, None), row(7, "word " * 60_000), row(8, "été à l'école, naïve", None, None),
        row(9, "12345 67890 !!!"), row(10, " ".join(WORDS * 3), "en", "b"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
