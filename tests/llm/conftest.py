import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "Lorem ipsum dolor sit amet, consectetur adipiscing elit. " * 30_000


@pytest.fixture()
def awkward(spark):
    """Nulls in every column, empty and blank texts, ties and repeated rows, a long text, and further columns whose names clash."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35),
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35),
        (2, None, "en", "a", None),
        (3, "", "en", None, 0),
        (None, "alpha beta gamma delta epsilon zeta", None, "b", 35),
        (4, " \n\t ", None, None, 4),
        (5, LONG, "de", "b", len(LONG)),
        (6, "é ñ ß 漢字 🙂", "fr", "c", 9),
        (None, None, None, None, None),
        (7, "alpha beta gamma delta epsilon zeta", "en", "a", 35),
    ]
    clash = [(*r, 0, "x", "y", 1.5) for r in rows]
    return spark.createDataFrame(clash, DOCS + ", slot int, shard string, block string, keep double")


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], DOCS)
