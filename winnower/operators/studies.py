"""Study designs and reports: samples, reserves, sweeps, bootstraps, supports, groupings."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnower.functions.columns import closed


def hash_order(ident: Column, seed: str) -> Column:
    """A pseudorandom order that is the same everywhere."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), ident.cast("string")), 256)


def hash_sample(df: DataFrame, ident: str, n: int, seed: str) -> DataFrame:
    """The first n in hash order."""
    return df.orderBy(hash_order(F.col(ident), seed), ident).limit(n)


def background_sample(df: DataFrame, positives: DataFrame, ident: str, n: int, seed: str) -> DataFrame:
    """The first n in hash order of those never positive."""
    return hash_sample(df.join(positives.select(ident).distinct(), ident, "left_anti"), ident, n, seed)


def round_robin(df: DataFrame, family: str, ident: str, n: int, seed: str, least: int = 1) -> DataFrame:
    """n picks, one of each family in turn; families with fewer than ``least`` members are left out: ``turn``."""
    order = Window.partitionBy(family).orderBy(hash_order(F.col(ident), seed), ident)
    rows = df.withColumns({"turn": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy(family))})
    return rows.where(F.col("_n") >= least).orderBy("turn", family).limit(n).drop("_n")


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails, NULL if none does."""
    return F.coalesce(*(F.when(~closed(ok), F.lit(name)) for name, ok in checks))


def temporal_reserve(df: DataFrame, key: str, year: Column, cut: int) -> DataFrame:
    """``role``: development before the cut, external after it if the key is new, overlap otherwise."""
    rows = df.withColumn("_y", year)
    first = rows.groupBy(key).agg(F.min("_y").alias("_first"))
    out = rows.join(first, key)
    return out.withColumn("role", F.when(F.col("_y") < cut, "development").when(F.col("_first") >= cut, "external").otherwise("overlap")).drop("_y", "_first")


def label_matrix(df: DataFrame, ident: str, task: str, tasks: list[str], label: str) -> DataFrame:
    """Records x tasks, unknown labels NULL."""
    return df.groupBy(ident).pivot(task, tasks).agg(F.max(label))


def feature_support(df: DataFrame, features: dict[str, Column], ident: str, label: str, group: str) -> DataFrame:
    """Per feature: records, positives, negatives and groups where it holds, in one pass over the rows."""
    rows = [F.when(closed(c), F.struct(F.lit(n).alias("feature"))) for n, c in features.items()]
    held = df.select(ident, label, group, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("f")).select(ident, label, group, "f.feature")
    return held.groupBy("feature").agg(F.count_distinct(ident).alias("records"), F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"), F.count_distinct(group).alias("groups"))


def threshold_sweep(df: DataFrame, score: str, active: str, base: str, taus: list[float], least_retention: float, most_expansion: float) -> DataFrame:
    """Least expansion (then threshold) that keeps enough actives: one row ``tau, retention, expansion`` or none."""
    kept = lambda t: F.col(base) | closed(F.col(score) <= t)
    cells = [
        F.struct(F.lit(t).alias("tau"), (F.count_if(kept(t) & (F.col(active) == 1)) / F.nullif(F.count_if(F.col(active) == 1), F.lit(0))).alias("retention"),
                 (F.count_if(kept(t)) / F.nullif(F.count_if(base), F.lit(0))).alias("expansion"))
        for t in taus
    ]
    rows = df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("a")).select("a.*")
    return rows.where((F.col("retention") >= least_retention) & (F.col("expansion") <= most_expansion)).orderBy("expansion", "tau").limit(1)


def bootstrap_mean(df: DataFrame, cluster: str, value: str, repeats: int, seed: str) -> DataFrame:
    """``low, mean, high``: 2.5 and 97.5 percentiles of the mean over resampled clusters.

    Each cluster gets in every repeat a Poisson(1) count from a hash, so no rows are drawn: clusters are summed first
    and the repeats are a product with that small table.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    grid = sums.crossJoin(F.broadcast(df.sparkSession.range(repeats).withColumnRenamed("id", "repeat")))
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("repeat").cast("string"), F.col(cluster).cast("string")), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    # cumulative Poisson(1) probabilities
    edges = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563]
    weight = reduce(lambda a, b: a + b, [(u > e).cast("int") for e in edges])
    means = grid.groupBy("repeat").agg((F.sum(F.col("s") * weight) / F.nullif(F.sum(F.col("n") * weight), F.lit(0))).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return ends.crossJoin(sums.agg((F.sum("s") / F.sum("n")).alias("mean"))).select("low", "mean", "high")


def checkpoint_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; unset, a temporary folder in a local session and an error on a cluster, whose
    executors would write where nobody else reads."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="winnower-")
    return named


def connected_groups(df: DataFrame, ident: str, group: str) -> DataFrame:
    """``ident, component``: records that share a group, directly or along a chain, have one component (the least id).

    Labels move to the least of the group and back until nothing changes; every round is a checkpoint.
    """
    member = df.where(F.col(group).isNotNull()).select(ident, group).distinct()
    label = df.select(ident).distinct().withColumn("component", F.col(ident))
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    member = member.checkpoint()
    while True:
        least = member.join(label, ident).groupBy(group).agg(F.min("component").alias("_m"))
        best = member.join(least, group).groupBy(ident).agg(F.min("_m").alias("_m"))
        after = label.join(best, ident, "left").select(ident, F.least("component", F.coalesce("_m", "component")).alias("component"), (F.col("_m") < F.col("component")).alias("_moved")).checkpoint()
        label = after.select(ident, "component")
        if after.where("_moved").isEmpty():
            return label


def linear_histogram(df: DataFrame, value: str, bins: int, selected: Column) -> DataFrame:
    """Equal bins over the range: ``bin, n, chosen``."""
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    rows = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    return rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.count_if(closed(selected)).alias("chosen"))


def zone_statistics(members: DataFrame, record_id: str) -> DataFrame:
    """``zone_id, size, shared``: members and how many of them lie in other zones too."""
    several = members.groupBy(record_id).agg(F.count_distinct("zone_id").alias("_z"))
    return members.join(several, record_id).groupBy("zone_id").agg(F.count("*").alias("size"), F.count_if(F.col("_z") > 1).alias("shared"))


def entropy_grid(weights: list[int], parts: int, spark) -> DataFrame:
    """``weights, entropy``: all ways to give each of ``parts`` one of the weights, not all zero, with Shannon entropy."""
    k = len(weights)
    grid = spark.range(1, k**parts)
    digits = F.array(*(F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.floor(F.col("id") / float(k**i)) % k + 1).cast("int")) for i in range(parts)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    grid = grid.select("id", digits.alias("w")).where(total(F.col("w")) > 0).withColumn("p", F.transform("w", lambda x: x / total(F.col("w"))))
    return grid.select("id", F.col("w").alias("weights"), total(F.transform("p", lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0))).alias("entropy"))


def dominance_warning(df: DataFrame, group: str, share: float = 0.3) -> DataFrame:
    """Groups that hold at least ``share`` of the selection: ``group, n, share``."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("_t"))
    return sizes.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_t")).where(F.col("share") >= share).drop("_t")


def pattern_gate(text: Column, required: list[str], excluded: list[str], preferred: list[str]) -> tuple[Column, Column]:
    """(all required and none excluded, any preferred)"""
    every = reduce(lambda a, b: a & b, [closed(text.rlike(p)) for p in required], F.lit(True))
    none = reduce(lambda a, b: a & ~b, [closed(text.rlike(p)) for p in excluded], F.lit(True))
    liked = reduce(lambda a, b: a | b, [closed(text.rlike(p)) for p in preferred], F.lit(False))
    return every & none, liked
