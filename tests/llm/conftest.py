import pytest


#: Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, extra columns with clashing names.
WORDY = " ".join(f"word{i % 97}x{i % 89}" for i in range(400))
EDGE_ROWS = [
    (1, WORDY, "en", "a", 5, 0.5, 7),
    (2, WORDY.replace("word3x", "other "), "en", "a", 5, None, 1),
    (3, WORDY, None, None, None, 0.1, 2),
    (4, None, "en", "b", 0, 0.1, None),
    (5, "", "de", "b", 0, 0.1, 2),
    (6, " \t\n\r\x0b\x0c ", "de", "", 6, 0.1, 2),
    (7, "one two", "de", "b", 7, 0.1, 2),
    (8, "one  two", "de", "b", 8, 0.1, 2),
    (8, "one  two", "de", "b", 8, 0.1, 2),
    (None, "one two", "de", "b", 8, 0.1, 2),
    (None, WORDY, None, None, None, None, None),
    (9, "é\u00a0ü\u2003x " * 3, "fr", "c", 8, 0.1, 2),
    (10, ("lorem ipsum dolor " * 40 + "\n") * 300, "la", "c", 1, 0.1, 2),
    (11, "<|endoftext|> 😀 token = \"0123456789abcdef0123456789abcdef01234567\"", "la", "c", 1, 0.1, 2),
    (1, WORDY, "en", "a", 5, 0.5, 7),
]
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copies int"


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
