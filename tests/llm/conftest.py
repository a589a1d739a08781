import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, set_id string, score string, sig int, cell int, rank int, component_id string, label string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    long = " ".join(f"word{i % 977} the and of" for i in range(20_000))
    texts = [None, "", "   \n\t", "one", "one two", "one two three", "ONE two three", "one two three", long, long + " end", "é à ü ß 日本語", "the cat sat on the mat and looked at the moon " * 4, None, "12345 !!! ---"]
    rows = [(i, t, ["en", None, "de"][i % 3], ["b", None, "a"][i % 3], None if i % 4 == 0 else len(t or ""), 1, "k", "s", "x", 1, 1, 1, "c", None) for i, t in enumerate(texts)]
    rows += [rows[11], rows[11], (None, "one two three", None, None, None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
