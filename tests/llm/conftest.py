import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with names the operators use."""
    long_text = " ".join(f"word{i}" for i in range(5000))
    rows = [
        (1, "Alpha beta gamma delta", "en", "a", "x", 1),
        (1, "Alpha beta gamma delta", "en", "a", "x", 1),
        (2, "alpha BETA gamma delta", "en", "a", None, None),
        (3, "", None, None, None, None),
        (4, None, "de", "b", None, None),
        (5, " \n\t ", "de", "b", None, None),
        (6, long_text, "de", "b", None, None),
        (7, long_text + " end", "de", "b", None, None),
        (None, "no id", "fr", "a", None, None),
        (8, "Ünïcode ▁ \U0001f600 <|endoftext|> é x", "fr", "c", None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, keep string, pid int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
