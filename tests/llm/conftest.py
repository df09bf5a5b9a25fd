import pytest

from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def stored(spark, tmp_path):
    """Writes rows as a table in several files and reads it back."""
    made = []

    def put(rows, schema=SCHEMA, parts=3):
        path = f"{tmp_path}/t{len(made)}"
        made.append(path)
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return put


@pytest.fixture
def docs(stored):
    """(doc_id, text) pairs as documents whose further columns clash with names the operators might use."""

    def put(pairs, parts=3):
        rows = [(i, t, "en", "s", 0, i, "x", 1.0, 7) for i, t in pairs]
        names = "row long, digest string, score double, found long"
        return stored(rows, f"{SCHEMA}, {names}", parts)

    return put


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")


#: Null, empty and blank texts, ties, repeated rows, a row without id and a very long text.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one two three four"),
    (5, "one  two\tthree\nfour"),
    (5, "one  two\tthree\nfour"),
    (None, "one two three four"),
    (6, "word " * 400_000),
    (7, "x" * 2_000_000),
    (8, "Ünï \u3000 çödé \U0001f600 <|endoftext|>"),
]
