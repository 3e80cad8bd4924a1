import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


def prose(rng, words=120, size=400):
    """Words of an invented language; a few are common."""
    bank = ["".join(rng.choice(["ka", "lo", "mi", "tre", "su", "éa", "ñu", "pf"]) for _ in range(rng.randint(1, 4))) for _ in range(size)]
    return " ".join(bank[int(len(bank) * rng.random() ** 2)] for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, copies, near copies, ties and repeated rows."""
    rng = random.Random(3)
    base = [prose(rng, 150) for _ in range(6)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(base)]
    rows += [(10 + i, base[0], "en", "a", 5) for i in range(8)]
    rows += [(20 + i, base[1] + f" tail{i}", "de", "b", 5) for i in range(4)]
    rows += [(30, None, None, None, None), (31, "", "en", "b", 0), (32, " \n\t ", "en", None, 3), (None, base[2], "en", "a", 1), (None, None, "en", "a", 1)]
    rows += [(33, "one", "en", "c", 3), (34, "one two", "en", "c", 7), (34, "one two", "en", "c", 7), (35, "ONE TWO\n\none two", "en", "c", 9)]
    rows += [(40, " ".join(prose(rng, 100) for _ in range(60)), "fr", "c", 1), (41, "x" * 20_000, "fr", "c", 1), (42, "word " * 300, "fr", "d", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
