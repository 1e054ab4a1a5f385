import pytest

LONG = "the quick brown fox jumps over a lazy dog near the old river bank while seven grey geese fly south " * 12


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties and repeated rows, and columns whose names the operators use themselves."""
    rows = [
        (1, LONG, "en", "a", 5),
        (1, LONG, "en", "a", 5),
        (2, LONG + "end", None, "a", None),
        (3, None, "en", None, 0),
        (4, "", "fr", "b", 0),
        (None, "nobody owns this line of words and nothing else at all", "en", "b", 1),
        (5, " \n\t ", None, None, 1),
        (6, "x" * 300_000, "en", "a", 300_000),
        (7, "one two", "en", "a", 7),
        (8, "½ é 😀 <|end|> </s> & mail me at a.b@c.de or +1 (988) 555-0546 " + LONG, "en", "a", 7),
    ]
    extra = [(*r, 1, "t", 2.0, 3, "h", 4, "k") for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, n_words int, line string, n double, hits int, kept string, component_id int, place string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
