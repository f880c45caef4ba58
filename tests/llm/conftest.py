import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, shard string, score string, _id long, rank string"


def doc(i, text, lang="en", source="src1"):
    return (i, text, lang, source, None if text is None else len(text), "h", "s", "x", 5, "r")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a long text, repeated rows, ties, clashing column names."""
    words = " ".join(f"word{i % 977} tail{i % 31}" for i in range(60_000))
    rows = [
        doc(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), doc(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
        doc(2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), doc(3, None), doc(4, ""), doc(5, " \t\n "), doc(6, words), doc(None, "one two three"),
        doc(None, None, None, None), doc(7, "one two three", None, None), doc(8, "é ü ñ 漢字 🙂", "fr", "odd"), doc(9, "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
