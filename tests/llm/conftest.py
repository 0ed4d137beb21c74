import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.sql import types as T  # noqa: E402

LONG_DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    T.StructField("id", T.StringType()), T.StructField("bucket", T.StringType()), T.StructField("payload", T.StringType()),
    T.StructField("kept", T.StringType()), T.StructField("score", T.StringType()),
])


@pytest.fixture(scope="session")
def table_of(spark):
    """Documents ``(doc_id, text)`` as a table in several partitions, with nulls and clashing names in other columns."""

    def make(rows):
        full = [(i, t, None if k % 3 else "en", None, None, "x", None, "y", "z", "q") for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, LONG_DOCS).repartition(3)

    return make


def words(seed, n, vocabulary=300):
    import random

    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white texts, ties, repeated rows, one id with two texts, near copies and one long text."""
    base = " ".join(words(1, 120)) + "."
    other = " ".join(words(2, 90)) + ". " + " ".join(words(3, 40)) + "!"
    near = base.replace("w7", "w8", 1)
    long = "\n".join(" ".join(words(k, 60)) + "." for k in range(200)) + base
    return [
        (1, base), (2, base), (3, near), (4, other), (5, None), (6, ""), (7, " \t\n "), (8, "x"), (9, "ein Wort äöü"),
        (10, long), (11, "y " + other), (12, "a b c"), (13, "A B C"), (4, other), (14, base + " " + other), (15, "a" * 500),
        (16, "日本語のテキスト。" * 30), (None, base), (17, "b" + "a" * 300), (8, "another text under the id of a second one"),
    ]
