"""Links that the shards lose must not pass the audit."""

from __future__ import annotations

import numpy as np
import pytest

from winnower.llm import vector_dedup


@pytest.mark.parametrize("pairs", [1, 60])
def test_lost_links_are_compared_exactly(spark, monkeypatch, pairs):
    v = np.random.default_rng(6).normal(size=(500, 16))
    v[1 : 2 * pairs : 2] = v[0 : 2 * pairs : 2] * 2 + 0.001
    df = spark.createDataFrame([(k + 1, "a", x) for k, x in enumerate(v.tolist())], "vec_id long, label string, embedding array<double>")
    original = vector_dedup.links
    monkeypatch.setattr(vector_dedup, "links", lambda *a: original(*a).limit(0))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T >= vector_dedup.THRESHOLD) & ~np.eye(len(v), dtype=bool)
    out, _ = vector_dedup.near_duplicates(df, max_shard=128)
    assert {r["vec_id"]: r["n_links"] for r in out.collect()} == {k + 1: int(n) for k, n in enumerate(near.sum(1))}


def test_null_and_repeated_ids(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(5, "x", a), (5, "x", b), (6, "x", [1.0, 0.05, 0.0, 0.0]), (7, "x", [0.05, 1.0, 0.0, 0.0]), (None, "x", [1.0, 0.02, 0.0, 0.0]), (None, "y", a), (8, None, a)]
    out, _ = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>"))
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in out.collect())
    assert got == sorted([("5", 2, "5", True), ("5", 1, "5", True), ("6", 2, "5", False), ("7", 1, "5", False), ("None", 2, "5", False), ("None", 0, "None", True), ("8", 0, "8", True)])


def test_search_in_large_shards_against_all_pairs():
    rng = np.random.default_rng(12)
    base = rng.normal(size=(150, 24))
    v = vector_dedup.unit(base[rng.integers(0, 150, 2500)] + rng.normal(size=(2500, 24)) * rng.choice([0.02, 0.1, 0.25], (2500, 1)))
    near = (v @ v.T >= vector_dedup.THRESHOLD) & ~np.eye(len(v), dtype=bool)
    found = np.zeros_like(near)
    for q, c in vector_dedup.range_search(v, vector_dedup.robust_prune(v), vector_dedup.THRESHOLD):
        found[q, c] = True
    found |= found.T
    assert not (found & ~near).any() and (found & near).sum() >= 0.97 * near.sum()
