import pytest

# Nulls, empty and very long texts, ties and repeated rows, an extra column whose name some operator also uses.
LONG = "Zeta " + "alpha beta gamma delta epsilon. " * 6000 + "x" * 70_000
ODD = [
    (1, "One plain line of text, nothing else.", "a"),
    (1, "One plain line of text, nothing else.", "a"),
    (2, "", "b"),
    (3, None, None),
    (None, "A row without an id but with a text of some words.", "c"),
    (None, None, None),
    (4, LONG, "d"),
    (5, "  two  spaces\n\nand\tbreaks ", "e"),
    (6, "Ünïcode ﬁne ΑΣ ß ▁ <s> <|endoftext|> 12.5% it's  ok", "f"),
]
SCHEMA = "doc_id long, text string, score string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
