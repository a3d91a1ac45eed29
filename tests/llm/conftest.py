"""Documents with every awkward case."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, alphabet: str = "abcdefghijk") -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(5)
    base = words(rng, 120)
    out = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, "one two", "fr", "b", 7), (5, "one two", "fr", "b", 7), (5, "one two", "fr", "b", 7),
        (6, base, "en", "a", 1), (7, base.upper(), "en", None, 1), (8, base + " tail words here", "en", "c", 1), (9, words(rng, 5000), "de", "a", 1),
        (10, words(rng, 60) + "\n" + base, "de", "b", 1), (None, "a row without an id but with some words in it", "en", "a", 1),
        (12, "été naïve ÉCOLE œuvre 中文 don't <|endoftext|> x\x00y", "fr", "c", 1), (13, "!!! ??? ...", "es", "c", 1), (14, "word " * 300, "es", "a", 1),
    ]
    for k in range(20, 60):  # a loose group of near copies, and unrelated documents
        own = base.split()
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = words(rng, 1, "lmnop")
        out.append((k, " ".join(own), "en", "a", 1))
        out.append((100 + k, words(rng, rng.randint(1, 90)), rng.choice(["en", "fr", None]), rng.choice("abc"), 1))
    return out


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same with extra columns named as operators name theirs."""
    from pyspark.sql import functions as F

    extra = ["size", "node", "token", "length", "label", "_id", "_size", "component_id", "line", "score", "sim", "key"]
    return awkward.withColumns({c: F.lit("x") for c in extra})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
