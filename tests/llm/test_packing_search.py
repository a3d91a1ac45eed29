"""The search depends on the lengths alone and claims no more than it has shown."""

from __future__ import annotations

import itertools
import time
from collections import Counter

import numpy as np

from winnower.llm import packing


def test_proven_means_the_bound():
    rng = np.random.default_rng(9)
    above = 0
    for _ in range(300):
        found = packing.bin_completion(Counter(rng.integers(20, 60, 9).tolist()), 100)
        above += found.sequences > found.bound
        assert found.proven == (found.sequences == found.bound)
    assert above


def test_a_slow_clock_changes_nothing(monkeypatch):
    rng = np.random.default_rng(10)
    cases = [Counter(rng.integers(20, 60, 30).tolist()) for _ in range(40)]
    want = [packing.bin_completion(c, 100) for c in cases]
    ticks = itertools.count(0, 1000)
    monkeypatch.setattr(time, "monotonic", lambda: float(next(ticks)))
    got = [packing.bin_completion(c, 100) for c in cases]
    assert max(f.nodes for f in want) > 1
    assert [(f.patterns, f.nodes) for f in got] == [(f.patterns, f.nodes) for f in want]


def test_a_wider_search_finds_what_a_narrow_one_misses():
    lengths = [10, 12, 14, 15, 18, 19, 21, 22, 22, 23, 23, 24, 24, 26]
    counts = {n: lengths.count(n) for n in lengths}
    found = packing.bin_completion(counts, 56)
    assert found.sequences == 5 and found.proven
    assert sum(len(p) * n for p, n in found.patterns) == len(lengths)
