"""Distances to rule limits, sensitivity to thresholds, counterfactuals, scenarios."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnower.functions.columns import all_of, closed, number
from winnower.operators.rules import Profile, Rule

#: Share of the scale within which a value is near its limit.
NEAR = 0.1


def scales(df: DataFrame, rules: list[Rule], kind: str = "iqr") -> DataFrame:
    """One row, a column ``s_<descriptor>`` each: interquartile range (or range) of the descriptor, NULL if zero."""
    out = []
    for d in sorted({r.descriptor for r in rules}):
        v = number(d)
        spread = F.percentile(v, F.lit(0.75)) - F.percentile(v, F.lit(0.25)) if kind == "iqr" else F.max(v) - F.min(v)
        out.append(F.nullif(spread, F.lit(0.0)).alias(f"s_{d}"))
    return df.agg(*out)


def margins(df: DataFrame, rules: list[Rule], record_id: str = "record_id", kind: str = "iqr") -> DataFrame:
    """A row per record and bounded rule: ``rule_id, value, lower_limit, upper_limit, margin, status``.

    The margin is the distance to the nearer limit over the descriptor's scale (its limit's size if the scale is zero),
    negative outside; a missing value has none and fails robustly.
    """
    bounded = [r for r in rules if r.bounds != (None, None)]
    rows = []
    for r in bounded:
        low, high = r.bounds
        v = number(r.descriptor)
        ends = [v - F.lit(float(low))] if low is not None else []
        ends += [F.lit(float(high)) - v] if high is not None else []
        distance = F.least(*ends) if len(ends) == 2 else ends[0]
        size = max(abs(x) for x in (low, high) if x is not None) or 1.0
        margin = distance / F.coalesce(F.col(f"s_{r.descriptor}"), F.lit(float(size)))
        ok = r.satisfied()
        near = F.abs(margin) <= NEAR
        status = F.when(ok & near, "NEAR_PASS").when(ok, "ROBUST_PASS").when(closed(near), "NEAR_FAIL").otherwise("ROBUST_FAIL")
        rows.append(F.struct(F.lit(r.id).alias("rule_id"), v.alias("value"), F.lit(low).cast("double").alias("lower_limit"),
                             F.lit(high).cast("double").alias("upper_limit"), margin.alias("margin"), status.alias("status")))
    wide = df.crossJoin(F.broadcast(scales(df, bounded, kind)))
    return wide.select(record_id, F.explode(F.array(*rows)).alias("m")).select(record_id, "m.*")


def robustness(found: DataFrame, record_id: str = "record_id") -> DataFrame:
    """Per record: least and mean margin, numbers near and failed, score tanh(3 * least margin), 0 if negative."""
    out = found.groupBy(record_id).agg(
        F.min("margin").alias("min_margin"), F.avg("margin").alias("mean_margin"),
        F.count_if(F.col("status").startswith("NEAR")).alias("borderline"), F.count_if(F.col("status").endswith("FAIL")).alias("failed"),
    )
    return out.withColumn("robustness_score", F.when(F.col("min_margin") < 0, 0.0).otherwise(F.tanh(3 * F.col("min_margin"))))


def closest_rule(found: DataFrame, record_id: str = "record_id") -> DataFrame:
    """The rule of least margin, whole row, equals by rule id."""
    known = found.where("margin is not null")
    best = known.groupBy(record_id).agg(F.min(F.struct("margin", "rule_id", "lower_limit", "upper_limit")).alias("m"))
    return best.select(record_id, "m.rule_id", "m.margin", "m.lower_limit", "m.upper_limit")


def rules_at_risk(found: DataFrame, n: int = 10) -> DataFrame:
    """Rules with most records near their limit."""
    return found.where(F.col("status").startswith("NEAR")).groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id").limit(n)


def margin_matrix(found: DataFrame, rules: list[Rule], record_id: str = "record_id") -> DataFrame:
    """Records x rules."""
    return found.groupBy(record_id).pivot("rule_id", [r.id for r in rules if r.bounds != (None, None)]).agg(F.first("margin"))


_HOLDS = {"<": lambda v, t: v < t, "<=": lambda v, t: v <= t, ">": lambda v, t: v > t, ">=": lambda v, t: v >= t}


def retained(df: DataFrame, value: str, operator: str, thresholds: DataFrame, threshold: str = "threshold") -> DataFrame:
    """``threshold, retained, share`` for each threshold of a bounded list; missing values are never retained.

    Values are first counted by the interval between thresholds that they fall into, so the data are read once and only
    one row per interval is joined with the thresholds.
    """
    edges = thresholds.agg(F.array_sort(F.collect_set(threshold)).alias("_edges"))
    v = number(value)
    rows = df.select(v.alias("v")).crossJoin(F.broadcast(edges))
    below = F.size(F.filter("_edges", lambda t: t < F.col("v")))
    upto = F.size(F.filter("_edges", lambda t: t <= F.col("v")))
    cells = rows.groupBy(F.when(F.col("v").isNotNull(), below).alias("below"), F.when(F.col("v").isNotNull(), upto).alias("upto")).agg(F.count("*").alias("n"))
    at = thresholds.select(F.col(threshold).alias("threshold")).distinct().crossJoin(F.broadcast(edges)).withColumn("k", F.array_position("_edges", F.col("threshold")))
    # the k-th edge (from 1) is above v iff upto < k, and not below v iff below < k
    holds = {"<": F.col("upto") < F.col("k"), "<=": F.col("below") < F.col("k"), ">": F.col("below") >= F.col("k"), ">=": F.col("upto") >= F.col("k")}[operator]
    out = at.crossJoin(F.broadcast(cells)).groupBy("threshold").agg(F.coalesce(F.sum(F.when(holds, F.col("n"))), F.lit(0)).alias("retained"), F.sum("n").alias("total"))
    return out.select("threshold", "retained", (F.col("retained") / F.col("total")).alias("share"))


def even_thresholds(df: DataFrame, value: str, n: int = 60) -> DataFrame:
    """``threshold``: n evenly spaced values from least to greatest."""
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / (n - 1)
    return ends.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col("lo") + k * step)).alias("threshold"))


def change_points(curve: DataFrame, top: int = 3) -> DataFrame:
    """The thresholds at which the retained share changes most from the one before: ``threshold, change``."""
    jump = F.abs(F.col("share") - F.lag("share").over(Window.orderBy("threshold")))
    return curve.select("threshold", jump.alias("change")).where("change is not null").orderBy(F.desc("change"), "threshold").limit(top)


def most_restrictive(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rule_id, retained, rejected`` of every rule, in one pass."""
    sums = [F.struct(F.lit(r.id).alias("rule_id"), F.count_if(r.satisfied()).alias("retained"), F.count_if(~r.satisfied()).alias("rejected")) for r in rules]
    return df.agg(F.array(*sums).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def transitions(df: DataFrame, before: Profile, after: Profile, record_id: str = "record_id") -> DataFrame:
    """Where each record stands under two versions of a profile."""
    a, b = before.columns()[f"{before.id}__passed"], after.columns()[f"{after.id}__passed"]
    change = F.when(a & b, "stayed_in").when(b, "entered").when(a, "left").otherwise("stayed_out")
    return df.select(record_id, change.alias("transition"))


def admitting_thresholds(found: DataFrame, most_broken: int = 3, record_id: str = "record_id") -> DataFrame:
    """For records with at most ``most_broken`` failures: the limit each broken rule would need.

    ``rule_id, observed_value, needed_lower, needed_upper``; rules without numbers can't be moved.
    """
    few = found.groupBy(record_id).agg(F.count("*").alias("k")).where(F.col("k") <= most_broken)
    rows = found.where("observed_value is not null").join(few, record_id)
    lower = F.when(F.col("observed_value") < F.col("lower_limit"), F.col("observed_value"))
    upper = F.when(F.col("observed_value") > F.col("upper_limit"), F.col("observed_value"))
    return rows.select(record_id, "profile_id", "rule_id", "observed_value", lower.alias("needed_lower"), upper.alias("needed_upper"), F.col("k").alias("broken_rules"))


def tightest_flip(found: DataFrame, record_id: str = "record_id") -> DataFrame:
    """For records that pass every bounded rule: the rule whose tightening would exclude them first."""
    passing = found.groupBy(record_id).agg(F.count_if(F.col("status").endswith("FAIL")).alias("f")).where("f = 0").select(record_id)
    return closest_rule(found.join(passing, record_id, "left_semi"), record_id)


def near_misses(found: DataFrame, record_id: str = "record_id") -> DataFrame:
    """Records near a limit, on either side: ``status``, distinct."""
    return found.where(F.col("status").startswith("NEAR")).select(record_id, "status").distinct()


def scenario(df: DataFrame, name: str, profiles: list[Profile], overrides: dict[str, dict[str, Any]] | None = None, keep: Column | None = None, record_id: str = "record_id") -> DataFrame:
    """Eligibility under overridden thresholds, on the same descriptors: ``scenario, record_id, eligible``."""
    changed = [p.with_thresholds((overrides or {}).get(p.id, {})) for p in profiles]
    ok = all_of([p.columns()[f"{p.id}__passed"] for p in changed])
    return df.select(F.lit(name).alias("scenario"), record_id, (ok & (closed(keep) if keep is not None else F.lit(True))).alias("eligible"))


def compare(a: DataFrame, b: DataFrame, record_id: str = "record_id") -> DataFrame:
    """Set comparison of two eligible sets: ``common, only_a, only_b, jaccard`` (1 if both are empty)."""
    x = a.where("eligible").select(record_id).withColumn("in_a", F.lit(True))
    y = b.where("eligible").select(record_id).withColumn("in_b", F.lit(True))
    both = x.join(y, record_id, "full_outer")
    out = both.agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("common"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"))
    every = F.col("common") + F.col("only_a") + F.col("only_b")
    return out.withColumn("jaccard", F.when(every > 0, F.col("common") / every).otherwise(F.lit(1.0)))


def stability(runs: DataFrame, record_id: str = "record_id") -> DataFrame:
    """Over scenarios: how often each record is eligible, ``times, frequency, always``."""
    out = runs.groupBy(record_id).agg(F.count_if("eligible").alias("times"), F.count("*").alias("k"))
    return out.select(record_id, "times", (F.col("times") / F.col("k")).alias("frequency"), (F.col("times") == F.col("k")).alias("always"))
