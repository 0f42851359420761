"""Small tables for the operators' tests."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, many: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(many)]


def doc(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text))


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def write(spark, folder, **tables):
    """Write tables where a query finds them; returns the folder."""
    for name, df in tables.items():
        df.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def odd_docs():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(words(random.Random(5), 30_000, 5_000))
    return [
        (None, None, None, None, None),
        (None, "the cat sat on the mat with a dog", None, "b", 5),
        (1, "", "en", "a", 0),
        (2, "", "en", None, 0),
        (3, "!!! ??? ...", None, "a", 11),
        (4, "the cat sat on the mat with a dog", "en", "a", 33),
        (5, "The Cat sat on THE mat with a dog", "en", "a", 33),
        (5, "The Cat sat on THE mat with a dog", "en", "a", 33),
        (6, long_text, "en", "b", len(long_text)),
        (7, long_text, "de", "b", len(long_text)),
        (8, "ÀÉ ünï ☃ 你好 \U0001f389 é", "fr", "a", None),
        (9, None, "fr", "c", None),
        (-3, " \t\n ", "fr", "c", 4),
    ]
