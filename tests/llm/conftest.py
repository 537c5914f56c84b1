import pytest

LONG = "alpha beta gamma " * 4000
DOCS = [
    (0, "The quick brown fox jumps over the lazy dog. " * 9, "en", "src0", 1),
    (1, "The quick brown fox jumps over the lazy dog. " * 9, "en", "src0", 1),
    (2, None, None, None, None),
    (3, "", "en", "src1", 0),
    (4, "   \n\t ", "de", "src12", 6),
    (5, LONG, "en", "src0", len(LONG)),
    (6, LONG + "delta epsilon", "en", "src0", len(LONG) + 13),
    (7, "one two", "fr", "src3", 7),
    (7, "one two", "fr", "src3", 7),
    (8, "ONE Two", "fr", "src3", 7),
    (None, "a text without an id", "es", "src4", 20),
    (None, "a text without an id", "es", "src4", 20),
    (9, "Ünïcödé  wörds\n\nand 漢字 <|endoftext|> \x1c \\ </s>", "de", "src5", 40),
    (10, "x" * 5000, "en", "src0", 5000),
    (-11, "### *** $$$ &&& " * 40, "en", "src19", 640),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
