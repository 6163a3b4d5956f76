import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, node string, band long, words string, mix_size long, slot string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def rows():
    """Nulls in every column, empty and long texts, blanks only, repeated rows, equal texts, characters of all kinds."""
    extra = ("size", "score", "node", 1, "words", 2, "slot")
    texts = [
        (1, "The quick brown fox jumps over the lazy dog\nsame line here again\n\nend", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog\nSAME LINE here again  \nother", "en", "a"),
        (3, None, "en", "a"),
        (4, "", None, "b"),
        (5, " \t\n ", "fr", None),
        (6, "12345 !!", "fr", "b"),
        (7, "Ünïcode ☃ text with spaces <|endoftext|> it's 12 \U0001f600\r\nÀÉ", "fr", "b"),
        (8, LONG, "en", "c"),
        (9, "one", "en", "c"),
        (9, "one", "en", "c"),
        (None, "no id at all in this row", "en", "c"),
        (10, "All rights reserved. All Rights, reserved", "en", None),
    ]
    return [(i, t, lang, s, None if t is None else len(t), *extra) for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def nulls(spark):
    return spark.createDataFrame([tuple([None] * 12)] * 2, SCHEMA)
