import random

import pytest
from pyspark.sql import functions as F

TESTDATA = "/root/testdata"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns whose names the operators use inside."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "einen", "größe", "été", "token", "日本語", "x"]
    long = " ".join(rng.choice(words) for _ in range(40_000)) + "z" * 70_000
    texts = [None, "", " \t\r", "one", "one two three four five\none two three four SIX\n\none two three four five", "one two three four five", long, "secret = 12345678 🎉", "a\x0bb\x0cc", "!!! $$$ |||"]
    rows = [(i, t, ["en", None, "de"][i % 3], ["s1", "s2", None, ""][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, "no id at all", "en", "s1", 12), (None, None, None, None, None), (5, texts[5], "de", "s2", 23), (5, texts[5], "de", "s2", 23), (77, long, "en", "s1", 9)]
    names = ["row", "size", "words", "label", "score", "_k1", "_gone", "at", "rank", "fp", "image"]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(n) for n in names})
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return lambda name, sf="sf0.001": spark.read.parquet(f"{TESTDATA}/{sf}/{name}.parquet")


@pytest.fixture(scope="session")
def marks(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
