import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, n int, token string, digest string, size string, label int, _rank int, _goes int, _probability double, _row int, _digest string, row string, locator string, draw string, tokens int, _h int"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, blank and very long texts, ties, repeated rows, extra columns."""
    extra = ("x", 1, "t", "d", "s", 3, 4, 5, 0.5, 6, "d", "r", "l", "w", 7, 8)
    rows = [
        (1, "The cat sat on the mat and then it ran away", "en", "a", 3),
        (2, " The cat\tsat on the mat and\nthen it ran away", "en", "a", 3),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \t\n", "de", "b", 3),
        (6, LONG, "en", "b", len(LONG)),
        (7, LONG + " tail", "en", "b", 1),
        (8, "ÜBER straße naïve <|endoftext|> 日本語 \x1c \u00a0 end", "de", None, 1),
        (8, "ÜBER straße naïve <|endoftext|> 日本語 \x1c \u00a0 end", "de", None, 1),
        (None, "no id here at all", "fr", "c", 1),
        (None, "no id here at all", "fr", "c", 1),
        (9, "  double  spaces \n and\r\nlines  ", "fr", "c", 1),
        (10, "The cat sat on the mat and then it ran off", "en", "a", 3),
    ]
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd_labels(spark):
    """Extra columns, repeated and conflicting labels, nulls."""
    rows = [(1, 1, 0, "a"), (1, 1, 0, "b"), (6, 0, 1, "a"), (7, 0, 1, "a"), (7, 1, 0, "a"), (None, 1, 1, "a"), (10, None, None, "a"), (99, 1, 0, "a")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
