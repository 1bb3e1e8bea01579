import pytest

LONG = "word " * 30_000
ROWS = [
    (None, "The quick brown fox jumps over the lazy dog again and again today", "x"),
    (1, None, "x"),
    (2, "", None),
    (3, " \t\n ", "x"),
    (4, "one two", "x"),
    (5, "The quick brown fox jumps over the lazy dog again and again today", "x"),
    (5, "The quick brown fox jumps over the lazy dog again and again today", "x"),
    (6, LONG, "x"),
    (7, "Ünïcode   text, naïve café ISN'T 12345 \U0001f600", "x"),
    (-8, "a", "x"),
]
COLUMNS = ("doc_id long, text string, score string, word string, n_words string, node string, "
           "row string, hits string, code string, block long, fingerprint string")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, columns that clash with inner names."""
    return spark.createDataFrame([(*r, *["x"] * 6, 1, "x") for r in ROWS], COLUMNS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def all_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def save_tables(tmp_path, **tables):
    """Write tables as a data folder that queries can read."""
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
