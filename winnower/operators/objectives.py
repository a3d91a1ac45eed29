"""Objectives, dominance, fronts, crowding and weighted priorities."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnower.functions.columns import settled, spread_ranked, with_percentile


@dataclass(frozen=True)
class Objective:
    """A column to maximise, minimise, or bring to a value or into a range."""

    column: str
    direction: str = "maximize"
    target: tuple[float, ...] = ()
    weight: float = 1.0

    def desirability(self) -> Column:
        """Larger is better, whatever the direction; NULL stays NULL."""
        v = F.col(self.column).cast("double")
        match self.direction:
            case "maximize":
                return v
            case "minimize":
                return -v
            case "target_value":
                return -F.abs(v - self.target[0])
            case "target_range":
                return -F.greatest(F.lit(float(self.target[0])) - v, v - F.lit(float(self.target[1])), F.when(v.isNotNull(), F.lit(0.0)))
        raise ValueError(f"unknown direction {self.direction!r}")


def desirabilities(df: DataFrame, objectives: list[Objective], record_id: str = "record_id") -> DataFrame:
    """``record_id, d0, d1, ...``; a missing value is worse than any: the least minus 1."""
    raw = df.select(record_id, *(o.desirability().alias(f"d{k}") for k, o in enumerate(objectives)))
    least = raw.agg(*(F.coalesce(F.min(f"d{k}") - 1, F.lit(0.0)).alias(f"m{k}") for k in range(len(objectives))))
    return raw.crossJoin(F.broadcast(least)).select(record_id, *(F.coalesce(f"d{k}", f"m{k}").alias(f"d{k}") for k in range(len(objectives))))


def above_and_below(places: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the weight of the rows greater, and of those less, in every column of ``places``; no column repeats a value.

    One column after the other is split at each bit of the rank: rows that agree above the bit are one group, the lower half
    of it meets the upper.  The last column is a running sum.  Time n log(n) for each column but the first.
    """
    n = len(places)
    rank = np.empty(places.shape, np.int64)
    for j in range(places.shape[1]):
        rank[np.argsort(places[:, j], kind="stable"), j] = np.arange(n)
    above, below = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def meet(rows: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, j: int) -> None:
        if j == rank.shape[1] - 1:
            order = np.argsort(group * n + rank[rows, j])
            rows, group, low, high = rows[order], group[order], low[order], high[order]
            first, last = np.searchsorted(group, group), np.searchsorted(group, group, "right")
            upto = np.concatenate([[0], np.cumsum(np.where(high, weight[rows], 0))])
            at = np.flatnonzero(low)
            above[rows[at]] += upto[last[at]] - upto[at + 1]
            upto = np.concatenate([[0], np.cumsum(np.where(low, weight[rows], 0))])
            at = np.flatnonzero(high)
            below[rows[at]] += upto[at] - upto[first[at]]
            return
        for bit in range(max(1, (n - 1).bit_length())):
            up = (rank[rows, j] >> bit & 1).astype(bool)
            lo, hi = low & ~up, high & up
            on = lo | hi
            if on.any():
                _, part = np.unique(group[on] * (n + 1) + (rank[rows[on], j] >> bit + 1), return_inverse=True)
                meet(rows[on], part, lo[on], hi[on], j + 1)

    if n:
        meet(np.arange(n), np.zeros(n, np.int64), np.ones(n, bool), np.ones(n, bool), 0)
    return above, below


def _beyond(cells: np.ndarray) -> np.ndarray:
    """Per cell of the grid the sum of the cells greater in every direction."""
    out = cells
    for axis in range(cells.ndim):
        out = np.flip(np.cumsum(np.flip(out, axis), axis), axis)
        out = np.concatenate([np.delete(out, 0, axis), np.zeros_like(np.take(out, [0], axis))], axis)
    return out


def dominance_counts(scores: DataFrame, k: int, record_id: str = "record_id", block_rows: int = 1000) -> DataFrame:
    """``domination_count`` (rows that dominate me) and ``dominated_count`` (rows I dominate).

    Equal score vectors are one row with a weight.  In the order of score i, ties by the scores that follow it in turn, whatever
    dominates a row comes after it; a row dominates another if it comes after it in all k orders.  Each order is cut into blocks of
    equal size.  Pairs that share no block are counted on the grid of blocks (at most 2^18 cells, on the driver); the others in
    the first order whose block they share, where each block is a task's.  Time grows as n log(n)^(k-1).
    """
    cols, places = [f"d{i}" for i in range(k)], [f"_p{i}" for i in range(k)]
    distinct = scores.groupBy(*cols).agg(F.count("*").alias("_w"))
    for i, place in enumerate(places):
        distinct = spread_ranked(distinct, [F.asc(c) for c in cols[i:] + cols[:i]], place)
    n = distinct.count()
    blocks = max(1, min(-(-n // block_rows), int(2 ** (18 / k))))
    side = max(1, -(-n // blocks))
    cell = [F.floor((F.col(p) - 1) / side).cast("int") for p in places]
    grid = np.zeros((blocks,) * k, np.int64)
    for r in distinct.groupBy(*(c.alias(f"_c{i}") for i, c in enumerate(cell))).agg(F.sum("_w").alias("_w")).collect():
        grid[tuple(r[:k])] = r[k]
    tables = scores.sparkSession.sparkContext.broadcast((_beyond(grid), np.flip(_beyond(np.flip(grid)))))

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, at = int(key[0]), rows[places].to_numpy(np.int64) - 1
        block, own = at // side, at.copy()
        for j in range(i):  # in the orders before, only blocks beyond: within a block the order of this one is turned round
            own[:, j] = block[:, j] * n + (n - 1 - at[:, i])
        above, below = above_and_below(own, rows["_w"].to_numpy(np.int64))
        if i == 0:
            above, below = (own + table[tuple(block.T)] for own, table in zip((above, below), tables.value))
        return rows[cols].assign(domination_count=above, dominated_count=below)

    orders = range(k if blocks > 1 else 1)
    dealt = distinct.withColumn("_to", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), cell[i].alias("block")) for i in orders))))
    counted = dealt.groupBy("_to.i", "_to.block").applyInPandas(count, ", ".join(f"{c} double" for c in cols) + ", domination_count long, dominated_count long")
    sums = counted.groupBy(*cols).agg(*(F.sum(c).alias(c) for c in ("domination_count", "dominated_count")))
    return scores.join(sums, cols).select(record_id, "domination_count", "dominated_count")


def pareto_ranks(values: np.ndarray) -> np.ndarray:
    """Fronts by peeling, 1 for the best; equal rows share a front."""
    distinct, which = np.unique(values, axis=0, return_inverse=True)
    order = np.argsort(-distinct[:, 0], kind="stable")
    rank, left, front = np.zeros(len(distinct), np.int64), list(order), 0
    while left:
        front += 1
        kept: list[int] = []
        rest = []
        for i in left:  # whatever dominates i has a first score at least as large, so comes before or ties
            block = distinct[kept] if kept else np.zeros((0, distinct.shape[1]))
            if len(block) and (((block >= distinct[i]).all(1)) & ((block > distinct[i]).any(1))).any():
                rest.append(i)
            else:
                kept = [j for j in kept if not ((distinct[i] >= distinct[j]).all() and (distinct[i] > distinct[j]).any())] + [i]
        settled = set(kept)
        rest = [i for i in left if i not in settled]
        rank[kept] = front
        left = rest
    return rank[which.ravel()]


def _fronts_by_blocks(scores: DataFrame, cols: list[str], block_rows: int) -> DataFrame:
    """``*cols, pareto_rank`` of the distinct rows: 1 more than the highest rank among a row's dominators.

    In descending order whatever dominates a row comes before it, so blocks are settled in that order.  The driver holds
    one block; earlier blocks are compared with it where they lie.
    """
    spark = scores.sparkSession
    rows = spread_ranked(scores.select(*cols).distinct(), [F.desc(c) for c in cols], "_place").withColumn("_block", F.floor((F.col("_place") - 1) / block_rows)).persist()
    settled: DataFrame | None = None
    for b in range(rows.agg(F.max("_block")).first()[0] + 1):
        values = rows.where(F.col("_block") == b).orderBy("_place").select(*cols).toPandas().to_numpy(float)
        rank = np.ones(len(values), np.int64)
        if settled is not None:

            def above(frames: Iterator[pd.DataFrame], values=values) -> Iterator[pd.DataFrame]:
                for f in frames:
                    earlier, ranks = f[cols].to_numpy(float), f["pareto_rank"].to_numpy()
                    best = [ranks[(earlier >= v).all(1)].max(initial=0) for v in values]
                    yield pd.DataFrame({"i": np.arange(len(values)), "best": np.array(best, np.int64)})

            for r in settled.mapInPandas(above, "i long, best long").groupBy("i").agg(F.max("best").alias("best")).collect():
                rank[r["i"]] = r["best"] + 1
        for i in range(1, len(values)):
            rank[i] = max(rank[i], 1 + rank[:i][(values[:i] >= values[i]).all(1)].max(initial=0))
        done = spark.createDataFrame(pd.DataFrame(values, columns=cols).assign(pareto_rank=rank))
        settled = done if settled is None else settled.unionAll(done)
    rows.unpersist()
    return settled


class Stairs:
    """The fronts of rows that come in descending order of their first score: of each the outline in the second and third.

    A row goes to the first front whose outline doesn't cover it; fronts before that all cover it, so it is found by halving.
    """

    def __init__(self) -> None:
        self.fronts: list[tuple[list[float], list[float]]] = []

    def place(self, x: float, y: float) -> int:
        low, high = 0, len(self.fronts)
        while low < high:
            mid = (low + high) // 2
            xs, ys = self.fronts[mid]
            at = bisect_left(xs, x)
            if at < len(xs) and ys[at] >= y:
                low = mid + 1
            else:
                high = mid
        if low == len(self.fronts):
            self.fronts.append(([], []))
        xs, ys = self.fronts[low]
        end = first = bisect_right(xs, x)
        while first and ys[first - 1] <= y:
            first -= 1
        xs[first:end], ys[first:end] = [x], [y]
        return low + 1


def _fronts_in_order(scores: DataFrame, cols: list[str]) -> DataFrame:
    """``*cols, pareto_rank`` of the distinct rows of up to three scores: one pass in descending order that holds outlines only.

    The ranks of a chain depend on one another, so the pass is one task's; it streams sorted rows, n log(fronts) steps in all.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stairs = Stairs()
        for f in frames:
            x, y = (np.nan_to_num(f[c].to_numpy(float), nan=np.inf, posinf=np.inf, neginf=-np.inf).tolist() if c in cols else [0.0] * len(f) for c in ("d1", "d2"))
            yield f.assign(pareto_rank=[stairs.place(a, b) for a, b in zip(x, y)])

    rows = scores.select(*cols).distinct().repartition(1).sortWithinPartitions(*(F.desc(c) for c in cols))
    return rows.mapInPandas(run, ", ".join(f"{c} double" for c in cols) + ", pareto_rank long")


def ranked_fronts(scores: DataFrame, k: int, exact_rows: int = 5000, record_id: str = "record_id") -> DataFrame:
    """``pareto_rank`` of each row, exactly.

    Up to three scores take one streaming pass over the distinct rows.  More take one bounded kernel up to ``exact_rows`` rows, and
    beyond it blocks of as many distinct rows, in time that grows with the square of the rows.
    """
    cols = [f"d{i}" for i in range(k)]
    if k <= 3:
        return scores.join(_fronts_in_order(scores, cols), cols).select(record_id, "pareto_rank")
    n = scores.limit(exact_rows + 1).count()
    if n > exact_rows:
        return scores.join(_fronts_by_blocks(scores, cols, exact_rows), cols).select(record_id, "pareto_rank")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = pd.concat(list(frames), ignore_index=True)
        if len(pool):
            yield pd.DataFrame({record_id: pool[record_id], "pareto_rank": pareto_ranks(pool[cols].to_numpy(float))})

    return scores.select(record_id, *cols).coalesce(1).mapInPandas(run, f"{record_id} long, pareto_rank long")


def first_front(scores: DataFrame, k: int, record_id: str = "record_id") -> DataFrame:
    """Rows that nothing dominates.

    Of each batch the rows that one of its rows with the greatest sums of ranks dominates go first; whatever dominates
    one of the rest is dominated by, or is, one of the rest.
    """
    cols = [f"d{i}" for i in range(k)]

    def pruned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            values = f[cols].to_numpy(float)
            best = np.argsort(-f[cols].rank().sum(axis=1).to_numpy(), kind="stable")[:64]
            left = np.ones(len(f), bool)
            for v in values[best]:
                left &= ~((values <= v).all(1) & (values < v).any(1))
            yield f[left]

    rest = settled(scores.select(record_id, *cols).mapInPandas(pruned, scores.select(record_id, *cols).schema))
    return dominance_counts(rest, k, record_id).where("domination_count = 0").select(record_id)


def normalised(scores: DataFrame, k: int, record_id: str = "record_id") -> DataFrame:
    """Scores scaled to [0, 1] (1 for a constant) and the distance to the ideal."""
    ends = scores.agg(*(f(f"d{i}").alias(f"{n}{i}") for i in range(k) for f, n in ((F.min, "lo"), (F.max, "hi"))))
    unit = [F.when(F.col(f"hi{i}") > F.col(f"lo{i}"), (F.col(f"d{i}") - F.col(f"lo{i}")) / (F.col(f"hi{i}") - F.col(f"lo{i}"))).otherwise(1.0) for i in range(k)]
    out = scores.crossJoin(F.broadcast(ends)).select(record_id, *(u.alias(f"n{i}") for i, u in enumerate(unit)))
    return out.withColumn("ideal_distance", F.sqrt(sum((F.pow(1 - F.col(f"n{i}"), 2) for i in range(k)), F.lit(0.0))))


def crowding(fronts: DataFrame, k: int, record_id: str = "record_id") -> DataFrame:
    """Crowding distance within each ``pareto_rank``; ends are infinite, as are fronts of one or two."""
    total = F.lit(0.0)
    inf = F.lit(float("inf"))
    for i in range(k):
        own = Window.partitionBy("pareto_rank")
        order = own.orderBy(f"d{i}", record_id)
        before, after = F.lag(f"d{i}").over(order), F.lead(f"d{i}").over(order)
        spread = F.max(f"d{i}").over(own) - F.min(f"d{i}").over(own)
        gap = F.when(spread > 0, (after - before) / spread).otherwise(0.0)
        total = total + F.when(before.isNull() | after.isNull(), inf).otherwise(gap)
    return fronts.withColumn("crowding", total).select(record_id, "pareto_rank", "crowding")


def weighted_priority(df: DataFrame, objectives: list[Objective], record_id: str = "record_id") -> DataFrame:
    """Weighted mean of the percentile ranks of the desirabilities: ``priority``."""
    scores = desirabilities(df, objectives, record_id)
    weight = sum(o.weight for o in objectives)
    for k in range(len(objectives)):
        scores = with_percentile(scores, f"d{k}", f"_p{k}")
    total = sum((F.col(f"_p{k}") * o.weight for k, o in enumerate(objectives)), F.lit(0.0))
    return scores.select(record_id, (total / weight).alias("priority"))


def diagnostics(df: DataFrame, objectives: list[Objective]) -> DataFrame:
    """``objective, spread, constant``: objectives that hardly vary tell nothing apart."""
    sums = [F.struct(F.lit(o.column).alias("objective"), F.coalesce(F.stddev_pop(o.desirability()), F.lit(0.0)).alias("spread")) for o in objectives]
    rows = df.agg(F.array(*sums).alias("a")).select(F.explode("a").alias("a")).select("a.*")
    return rows.withColumn("constant", F.col("spread") < 1e-9)


def correlations(df: DataFrame, objectives: list[Objective]) -> DataFrame:
    """``a, b, correlation`` of each pair of objectives."""
    cells = [F.struct(F.lit(a.column).alias("a"), F.lit(b.column).alias("b"), F.corr(a.desirability(), b.desirability()).alias("correlation"))
             for i, a in enumerate(objectives) for b in objectives[i + 1 :]]
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")
