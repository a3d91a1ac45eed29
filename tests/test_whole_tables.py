"""Queries that take every row of their tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from winnower.functions import columns
from winnower.operators import matching, objectives, selection
from winnower.plans import catalogue

QUERIES = catalogue.queries()


def test_objective_queries_take_every_customer(spark, tmp_path):
    keys = spark.range(1, 1701).select(F.col("id").alias("c_custkey"), (F.col("id") * 37 % 1009).cast("double").alias("c_acctbal"), (F.col("id") % 25).cast("int").alias("c_nationkey"))
    keys.write.parquet(str(tmp_path / "customer.parquet"))
    for name in ("desirabilities", "pareto_counts", "pareto_rank", "crowding", "ideal_distance", "weighted_priority"):
        assert QUERIES[name](spark, str(tmp_path)).select("c_custkey").distinct().count() == 1700, name


def test_fronts_by_blocks_equal_the_kernel(spark):
    values = np.random.default_rng(4).integers(0, 12, (400, 3)).astype(float)
    scores = spark.createDataFrame([(i, *v) for i, v in enumerate(values.tolist())], "record_id long, d0 double, d1 double, d2 double")
    got = {r["record_id"]: r["pareto_rank"] for r in objectives.ranked_fronts(scores, 3, exact_rows=60).collect()}
    assert [got[i] for i in range(400)] == objectives.pareto_ranks(values).tolist()


def test_connected_groups_of_all_orders(spark, sf):
    pairs = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_suppkey").distinct().collect()
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for o, s in pairs:
        a, b = sorted((find(("o", o)), find(("s", s))))  # orders before suppliers, the least order leads
        parent[b] = a
    got = {r["l_orderkey"]: r["component"] for r in QUERIES["connected_groups"](spark, sf).collect()}
    assert got == {o: find(("o", o))[1] for o, _ in pairs}


def test_evidence_of_all_events(spark, sf):
    users = spark.read.parquet(f"{sf}/customer.parquet")
    events = spark.read.parquet(f"{sf}/events.parquet").join(users, F.col("user_id") == F.col("c_custkey"), "left_semi")
    got = QUERIES["evidence_lookup"](spark, sf)
    assert got.count() == users.count() and got.agg(F.sum("n")).first()[0] == events.count() > 0


def test_ranks_hold_when_no_shuffle_is_shared(spark):
    rows = spark.range(20000).select("id", F.pmod(F.xxhash64("id"), F.lit(1000003)).cast("double").alias("v"))
    off = {"spark.sql.exchange.reuse": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for name, value in off.items():
            spark.conf.set(name, value)
        got = columns.with_rank(rows, "v", "r", descending=False).toPandas()
    finally:
        for name in off:
            spark.conf.unset(name)
    assert (got.r == got.v.rank(method="min")).all()


def _scores(spark, values):
    k = values.shape[1]
    rows = [(i, *v) for i, v in enumerate(values.tolist())]
    return spark.createDataFrame(rows, "record_id long, " + ", ".join(f"d{j} double" for j in range(k)))


def test_dominance_counts_equal_all_pairs(spark):
    for k, block_rows in ((1, 50), (2, 40), (3, 30), (4, 30), (3, 1000)):
        values = np.random.default_rng(k).integers(0, 7, (400, k)).astype(float)
        over = (values[None] >= values[:, None]).all(2) & (values[None] > values[:, None]).any(2)
        rows = objectives.dominance_counts(_scores(spark, values), k, block_rows=block_rows).collect()
        assert {r[0]: (r[1], r[2]) for r in rows} == {i: (over[i].sum(), over[:, i].sum()) for i in range(400)}
        front = {r[0] for r in objectives.first_front(_scores(spark, values), k).collect()}
        assert front == set(np.flatnonzero(over.sum(1) == 0).tolist())


def test_dominance_counts_make_no_pairs_of_rows():
    n = 100_000  # five thousand million pairs: the kernel takes n log(n) steps
    places = np.stack([np.arange(n), np.random.default_rng(1).permutation(n)], 1)
    above, below = objectives.above_and_below(places, np.ones(n, np.int64))
    assert above.sum() == below.sum() and above[places[:, 1].argmax()] == 0
    some = np.arange(0, n, 9973)
    assert [above[i] for i in some] == [(places > places[i]).all(1).sum() for i in some]


def test_fronts_in_one_pass_equal_the_kernel(spark):
    for k in (1, 2, 3):
        values = np.random.default_rng(k).integers(0, 15, (500, k)).astype(float)
        got = {r["record_id"]: r["pareto_rank"] for r in objectives.ranked_fronts(_scores(spark, values), k).collect()}
        assert [got[i] for i in range(500)] == objectives.pareto_ranks(values).tolist()


def test_outlines_place_many_rows():
    rng = np.random.default_rng(2)
    stairs = objectives.Stairs()
    ranks = [stairs.place(x, y) for x, y in zip(rng.integers(0, 25, 100_000).tolist(), rng.random(100_000).tolist())]
    assert max(ranks) == len(stairs.fronts) and sum(len(xs) for xs, _ in stairs.fronts) <= 25 * len(stairs.fronts)


def _prints(spark, n):
    words = np.random.default_rng(5).integers(0, 1 << 32, (n, 2)) & np.random.default_rng(6).integers(0, 1 << 32, (n, 2))
    return words, spark.createDataFrame(pd.DataFrame({"record_id": range(n), "words": words.tolist()}), "record_id long, words array<long>")


def test_butina_takes_pools_of_any_size(spark):
    words, rows = _prints(spark, 10_001)
    assert selection.butina(rows, 0.6).count() == 10_001
    words, rows = words[:400], rows.where("record_id < 400")
    bits = ((words[:, :, None] >> np.arange(32)) & 1).reshape(400, -1).astype(float)
    shared = bits @ bits.T
    near = [np.flatnonzero(x) for x in 1 - shared / (bits.sum(1)[:, None] + bits.sum(1) - shared) <= 0.6]
    want, label = np.zeros(400, int), 0
    for i in sorted(range(400), key=lambda i: (-len(near[i]), i)):
        if not want[i]:
            label += 1
            want[near[i][want[near[i]] == 0]] = label
    got = selection.butina(rows, 0.6).toPandas().sort_values("record_id")
    assert got.cluster_id.tolist() == want.tolist()


def test_maxmin_takes_pools_of_any_size(spark):
    words, rows = _prints(spark, 50_001)
    assert selection.maxmin(rows, 3).count() == 3
    for seeds in (None, words[:20].tolist()):
        got = selection.maxmin(rows.where("record_id >= 20 and record_id < 320"), 12, seeds=seeds).toPandas()
        own = words[20:320]
        distance = lambda a, b: 1 - np.bitwise_count(a & b).sum() / np.bitwise_count(a | b).sum()
        nearest = [min((distance(np.array(s), w) for s in seeds), default=2.0) if seeds else 2.0 for w in own]
        for place, (i, d) in enumerate(zip(got.record_id, got.distance)):
            best = int(np.argmax(nearest))
            assert (i, d) == (best + 20, min(1.0, nearest[best])), place
            nearest = [-1.0 if j == best or n < 0 else min(n, distance(own[best], w)) for j, (n, w) in enumerate(zip(nearest, own))]


def test_context_sends_no_pairs_between_tasks(spark):
    words = np.random.default_rng(7).integers(0, 8, (120, 2))
    words[:5] = 0
    group = [None if i % 11 == 0 else i % 4 for i in range(120)]
    label = [None if i % 7 == 0 else i % 2 for i in range(120)]
    df = spark.createDataFrame([(i, words[i].tolist(), group[i], label[i]) for i in range(120)], "id long, words array<long>, g int, y int")
    for block_rows in (200_000, 30):
        found = matching.context(df.where("id % 3 = 0"), df.where("id % 3 <> 0"), "id", "g", "y", k=3, block_rows=block_rows)
        plan = found._jdf.queryExecution().toString()
        assert "NestedLoopJoin" not in plan
        got = {r["a_id"]: r for r in found.collect()}
        want = {}
        for a in range(0, 120, 3):
            seen = []
            for b in range(120):
                if b % 3 and group[a] is not None and group[b] is not None and group[a] != group[b]:
                    either = np.bitwise_count(words[a] | words[b]).sum()
                    seen.append((-float(np.bitwise_count(words[a] & words[b]).sum() / either) if either else 0.0, b, label[b]))
            if seen:
                seen.sort(key=lambda t: t[:2])
                top = lambda y: [-s for s, _, of in seen if y is None or of == y]  # noqa: E731, B023
                want[a] = (top(1)[0], top(0)[0], np.mean(top(1)[:3]), np.mean(top(0)[:3]), 1 - top(None)[0], np.mean(top(None)[:3]))
        assert set(got) == set(want)
        assert all(np.allclose(tuple(got[a])[1:], want[a]) for a in want)
