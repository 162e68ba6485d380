import pytest

EDGE = "doc_id long, text string, lang string, source string, n_chars long, fp long, body string, key string, score double, items array<long>"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and extra columns with names the operators use."""
    long = "alpha beta gamma delta " * 20_000
    passage = " ".join(f"w{i}x" for i in range(80))
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "The same text here, twice over."), (6, "The same text here, twice over."), (6, "The same text here, twice over."),
        (None, "no id for this one"), (None, None), (7, long), (8, "x" * 30_000), (9, passage + " tail of nine"), (10, "head of ten " + passage), (11, "Ünïcödé ☃ 日本 text ñ"), (12, "the THE The"),
    ]
    return spark.createDataFrame([(i, t, None, None, None, None, "b", None, None, None) for i, t in rows], EDGE)


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)
