import pytest

ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t ", None, None),
    (4, "word", "en", "a"),
]


@pytest.fixture
def make(spark):
    """Documents (doc_id, text, lang, source) with columns whose names clash with results."""

    def build(rows):
        schema = "doc_id long, text string, lang string, source string, score string, n string, size string, kept string"
        return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema)

    return build


@pytest.fixture
def odd():
    return list(ODD)
