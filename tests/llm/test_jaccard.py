from __future__ import annotations

import re
from itertools import combinations

import numpy as np

from winnower.llm import common, components, jaccard_join
from winnower.llm.queries import ORACLE, QUERIES

from ..oracle import answer, assert_same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    ids = [r["doc_id"] for r in rows]
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((str(i), len(sets[k]), least.get(find(k))) for k, i in enumerate(ids))


def run(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, sketch_bits=12).collect())


def test_awkward_documents(awkward, clashing, nothing):
    want = brute([r for r in awkward.collect()])
    assert run(awkward) == want
    assert run(clashing) == want
    assert run(nothing) == []


def test_small_chunks_lose_nothing(awkward, monkeypatch):
    original = jaccard_join.cross_pairs
    monkeypatch.setattr(jaccard_join, "cross_pairs", lambda t, s, c: original(t, s, c, chunk=3))
    assert run(awkward) == brute([r for r in awkward.collect()])


def test_query(spark, sf):
    assert_same(QUERIES["op4_jaccard_join"](spark, sf).toPandas(), answer(ORACLE["op4_jaccard_join"], sf))


def test_components_over_many_tasks(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    nodes, roots = components.local_stars(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    want = dict(zip(nodes.tolist(), roots.tolist()))
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long"), per_task=20).collect()}
    assert {k: v for k, v in got.items() if k != v} == want


def test_prefixes_are_posted_in_turns_and_go_before_pairs_are_made(awkward, monkeypatch):
    """Each turn has tokens of its own; when pairs are made, no table of all prefixes is stored any more."""
    before, tokens, seen = set(common.stored()), [], []
    spool, original = common.spool, jaccard_join.cross_pairs

    def counted(df, name, *args):
        out = spool(df, name, *args)
        if name == "postings":
            tokens.append({r["token"] for r in out.select("token").distinct().collect()})
        return out

    def cross(heads, shared, comps):
        seen.extend(p for p in common.stored() if p not in before)
        return original(heads, shared, comps)

    monkeypatch.setattr(common, "spool", counted)
    monkeypatch.setattr(jaccard_join, "cross_pairs", cross)
    assert run(awkward) == brute([r for r in awkward.collect()])
    assert seen and not [p for p in seen if "winnower-prefixes-" in p]
    *turns, last = tokens
    assert len(turns) == jaccard_join.TURNS and sum(map(len, turns)) == len(set().union(*turns)) >= len(last) > 0
