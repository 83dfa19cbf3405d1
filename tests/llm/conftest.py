import pytest

#: Columns whose names the operators use inside.
CLASHES = ("size", "row_key", "key", "label", "f", "i", "line", "words", "target", "score", "h", "token", "n", "flags", "group")
LONG = ("lorem ipsum dolor sit amet " * 40 + "\n") * 60


@pytest.fixture(scope="session")
def edge_rows():
    return [
        (None, None, None), (1, None, "b"), (2, "", "b"), (3, " \n\t ", None), (4, "one", "a"), (5, "two words", "a"), (5, "two words", "a"),
        (6, LONG, "a"), (7, LONG, "c"), (None, "null id text", "c"), (8, "x" * 50_000, "a"), (9, "é😀 " * 100, "c"), (10, "A b C d E f", "a"), (11, "a B c D e F", "b"),
    ]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    rows = [(i, t, "en", s, len(t or ""), *["clash"] * len(CLASHES)) for i, t, s in edge_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
