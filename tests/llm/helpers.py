"""Small tables and brute-force versions for the tests of the text operators."""

from __future__ import annotations

import random

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "fp string, size int, copy string, shard string, id string, host string")
WORDS = ["alpha", "beta", "gamma", "Delta", "the", "of", "and", "to", "River", "stone", "cloud", "über", "ñandú"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed"]) for _ in range(n))


def table(spark, rows):
    """Documents from (doc_id, text, lang, source), with extra columns whose
    names the operators use themselves."""
    full = [(i, t, l, s, None if t is None else len(t), "x", 1, "c", "s", "i", "h") for i, t, l, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def edge_rows():
    rng = random.Random(3)
    base = prose(rng, 60)
    return [(1, base, "en", "a.example.org"), (1, base, "en", "a.example.org"),      # repeated row
            (2, base, "en", None), (None, prose(rng, 30), "en", "b"), (4, None, "en", "b"),
            (5, "", None, "b"), (6, " \t\n ", "xx", "c"), (7, "one", "EN-us", "c"),
            (8, prose(rng, 25_000), "en", "c"), (9, "word " * 3_000, "de", "c"),    # long, one word
            (2, prose(rng, 40), "en", "a.example.org"),                             # same id, other text
            (10, "x" * 300_000, "en", "d"), (None, None, None, None)]


def words(text):
    return (text or "").encode().split()


def rows(df):
    return [r.asDict() for r in df.collect()]
