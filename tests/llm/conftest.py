import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties and repeated rows, and columns whose names operators might use."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    words = [rng.choice(["lo", "mi", "der", "que", "Ñan", "the", "ÉT", "x9", "日本"]) + rng.choice(["", "en", "or", "ta", ".", ",", "!"]) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long_ = prose(9000)
    rows = [(1, prose(120), "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (None, prose(50), "en", "b", 1), (5, long_, "en", "b", 1), (6, long_, "de", None, 1), (7, " \t\n\x0b ", "en", "a", 5)]
    rows += [(8, prose(60), "en", "c", 1)] * 2 + [(9, "same", "en", "c", 4), (10, "same", "en", "c", 4), (11, "a" * 70000, "en", "c", 1), (12, "Mail bob@x.org or call +1 (243) 555-7962 now", "en", "", 1)]
    rows += [(20 + i, prose(rng.randint(1, 40)), rng.choice(["en", "fr"]), rng.choice(["a", "b", "c", None]), 1) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("f", "t", "k", "d", "th", "h", "size", "taken", "score", "spans", "base", "ids", "part", "toxicity", "copy", "rk", "words", "row", "id", "digest", "node", "n", "word", "g", "run", "doc"):
        df = df.withColumn(name, F.lit(7))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 60)] + [(20, 1, 0), (None, 1, 1), (30, None, None), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
