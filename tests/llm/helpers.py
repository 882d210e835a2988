"""Small document tables for the corpus tests."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: The edge cases every operator must take: nulls in any column, empty and blank texts, repeated rows, no letters.
EDGES = [
    (None, None, None, None, None),
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, None, 4),
    (4, "12 34", "en", None, 5),
    (5, "some words here", "en", "a", 15),
    (5, "some words here", "en", "a", 15),
    (None, "some words here", None, "b", 15),
]


def sentence(rng: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def table(spark, rows, extra: bool = True):
    """A documents table; `extra` adds columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("key", "size", "spans", "score", "start", "node", "rules", "taken", "label", "weights"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def by_id(rows) -> dict:
    return {r["doc_id"]: r for r in rows}
