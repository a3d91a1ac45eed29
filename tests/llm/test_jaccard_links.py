"""Links that a bound on shared prefix tokens must not lose."""

from __future__ import annotations

import random

from winnower.llm import jaccard_join

from .conftest import SCHEMA
from .test_jaccard import brute


def fresh(rng: random.Random, n: int) -> list[str]:
    return [f"w{rng.getrandbits(40):x}" for _ in range(n)]


def same_as_brute(spark, texts, sketch_bits):
    rows = [(k, " ".join(t), "en", "a", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, sketch_bits=sketch_bits).collect())
    want = brute(df.collect())
    assert [(g, w) for g, w in zip(got, want) if g != w] == [] and len(got) == len(want)


def test_subsets_and_supersets(spark):
    rng, texts = random.Random(11), []
    for k in range(40):  # one text, the same without its first words and without its last
        base = fresh(rng, 160)
        cut = 20 + k % 20
        texts += [base, base[cut:], base[:-cut]]
    same_as_brute(spark, texts, 16)


def test_short_documents_of_a_frequent_passage(spark):
    rng = random.Random(12)
    passage = fresh(rng, 120)
    texts = [fresh(rng, 150) + passage + fresh(rng, 150) for _ in range(300)]
    head = fresh(rng, 4)
    texts += [head + passage, head + passage + fresh(rng, 36)]
    same_as_brute(spark, texts, 18)
