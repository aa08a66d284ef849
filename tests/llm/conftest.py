import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) pairs; the other columns are filled in."""

    def documents(pairs, partitions=3):
        rows = [(i, t, "en" if i is None or i % 2 else None, "s", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA).repartition(partitions)

    return documents


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty texts, separators only, ties and repeated rows, one long text."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "Éta", "ñu", "iota9", "kap-pa"]
    text = " ".join(rng.choice(words) for _ in range(60))
    long = " ".join(f"{rng.choice(words)}{rng.randrange(200)}" for _ in range(30_000))
    return [
        (1, text), (2, text), (3, text.upper()), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "one"), (None, text), (None, None), (9, text + " tail"), (9, text + " tail"), (10, long),
        (11, long + " end"), (12, "lo " * 400), (13, "\x00     😀 ab" * 5), (14, "four words are here"), (15, "four words are here"), (16, "x" * 5000), (-3, "minus"), (9, "another text with id nine"),
    ]


@pytest.fixture(scope="session")
def clash(spark):
    """Adds columns whose names the operators use themselves."""

    def wider(df):
        from pyspark.sql import functions as F

        for name in ("n", "node", "score", "_text", "_id", "start", "n_words", "c0", "key", "a.b", "n_entities", "_stats", "predicted"):
            df = df.withColumn(name, F.lit(name))
        return df

    return wider
