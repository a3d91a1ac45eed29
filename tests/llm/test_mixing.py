from __future__ import annotations

import re
from collections import Counter

import numpy as np

from winnower.llm import mixing
from winnower.llm.queries import QUERIES


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def expected_targets(rows):
    amounts = Counter()
    for r in rows:
        amounts[r["source"]] += size(r["text"])
    names = mixing.code_point_order(list(amounts))
    weight = {n: (1, 2, 3)[i % 3] for i, n in enumerate(names)}
    total, capped, goal = sum(amounts.values()), set(), {}
    while True:
        left = total - sum(3 * amounts[n] for n in capped)
        w = sum(weight[n] for n in names if n not in capped)
        goal = {n: 3 * amounts[n] if n in capped else left * weight[n] / w for n in names}
        over = {n for n in names if n not in capped and goal[n] > 3 * amounts[n]}
        if not over:
            return amounts, goal
        capped |= over


def check(rows, docs, tolerance):
    amounts, goal = expected_targets(docs)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d["doc_id"], size(d["text"])) for d in docs)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    by = Counter()
    for r in rows:
        by[round(r["target"], 6), r["source_size"]] += r["taken"]
    sums = Counter()
    for n, t in goal.items():
        sums[round(t, 6), amounts[n]] += t
    assert set(by) == set(sums)
    for k in sums:
        assert abs(by[k] - sums[k]) <= tolerance


def test_awkward(awkward, clashing, nothing):
    rows = sorted(mixing.taken(awkward).collect(), key=str)
    check(rows, awkward.collect(), 2 * mixing.BLOCK)
    assert rows == sorted(mixing.taken(awkward).collect(), key=str)
    assert len(rows) == mixing.taken(clashing.drop("size", "source_size")).count()
    assert mixing.taken(nothing).count() == 0


def test_texts_hold_the_words_taken(awkward):
    want, got = Counter(), Counter()
    for r in mixing.taken(awkward).collect():
        want[r["doc_id"]] += r["taken"]
    for r in mixing.mixed_texts(awkward).collect():
        got[r["doc_id"]] += size(r["text"])
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_targets_share_excess():
    goal = mixing.targets([10, 100, 1], [3, 1, 3])
    assert goal[2] == 3 and goal[0] == 30 and abs(sum(goal) - 111) < 1e-9


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 1000):
        at = np.arange(n)
        assert sorted(mixing.permute(at, np.full(n, n), np.full(n, 9, np.uint64)).tolist()) == at.tolist()


def test_draws_meet_totals_and_vary():
    counts = mixing.draw_counts(np.array([1000, 10, 500]), 16, 1)
    assert counts.sum(0).tolist() == [1000, 10, 500] and len(set(counts[:, 0].tolist())) > 3


def test_query(spark, sf):
    check(QUERIES["op3_mixing"](spark, sf).collect(), spark.read.parquet(f"{sf}/documents.parquet").collect(), 2 * mixing.BLOCK)


def test_null_and_repeated_ids_are_taken_too(spark):
    rows = [(None, "a b c " * 40, "s"), (None, "d e " * 50, "s"), (7, "x y z " * 30, "t"), (7, "x y z " * 30, "t"), (7, "other words " * 20, "t"), (None, "a b c " * 40, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(mixing.taken(docs).collect(), docs.collect(), 2 * mixing.BLOCK)
    want = sum(r["taken"] for r in mixing.taken(docs).collect())
    assert sum(size(r["text"]) for r in mixing.mixed_texts(docs).collect()) == want
