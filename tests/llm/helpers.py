"""Small inputs that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


def odd_rows(rng: random.Random) -> list[tuple]:
    long = words(rng, 30_000, 5000)
    plain = words(rng, 120)
    return [
        (1, plain, "en", "a", None),
        (2, plain, "en", "a", 3),
        (2, plain, "en", "a", 3),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \t\n", None, "b", 3),
        (6, long, "de", "b", len(long)),
        (None, words(rng, 80), "de", None, None),
        (None, None, "fr", "c", None),
        (7, "Äpfel ünd öl 漢字 🙂", "de", "c", 20),
        (8, "one", "xx", "c", 3),
        (-9, "12 34 !!", "xx", "é", 8),
        (10, plain.upper(), "en", "z", None),
    ]


def documents(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The same rows with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    for name in "key k k2 size sid start block seeds seed fp slice docs score positive at n g ch spans mended given vector rank".split():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(1))
    return df


def rows_of(df, *names: str) -> list[tuple]:
    got = df.select(*names) if names else df
    return sorted((tuple(r) for r in got.collect()), key=repr)
