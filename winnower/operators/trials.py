"""Study tables: normalised records, roles by hash, collapsed pairs, masks, retention and recovery, equal capacity, grids of arms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.functions.columns import closed

#: Upper ends of the shares of fit, tune and calibration; the rest is test.
ROLES = (("fit", 0.60), ("tune", 0.75), ("policy_cal", 0.85), ("test", 1.0))


def constituents(text: Column) -> Column:
    """The finite numbers of a list split by ``;``."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x).try_cast("double"))
    return F.filter(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def record_status(values: Column, label: Column, threshold: float) -> Column:
    """conflicting_constituents (values on both sides of the threshold), unknown, positive or below_threshold."""
    conflict = closed((F.array_min(values) < threshold) & (F.array_max(values) >= threshold))
    return F.when(conflict, "conflicting_constituents").when(label.isNull(), "unknown").when(label == 1, "positive").otherwise("below_threshold")


def hash_fraction(key: Column, seed: int) -> Column:
    """A fraction in [0, 1) from the first 13 hex digits (52 bits) of the SHA-256 of ``seed:key``."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def assign_roles(df: DataFrame, group: str, identity: str, exposed: str, seed: int = 20) -> DataFrame:
    """Adds ``split_group`` and ``role``: whole groups (the identity where the group is blank) by hash share.

    A group with an exposed row is for development only: the shares of fit, tune and calibration are stretched to the whole.
    """
    key = F.when(F.col(group) != "", F.concat(F.lit("group:"), F.col(group))).otherwise(F.concat(F.lit("identity:"), F.col(identity).cast("string")))
    rows = df.withColumn("split_group", key)
    seen = rows.groupBy("split_group").agg(F.max(closed(F.col(exposed))).alias("_exposed"))
    at = hash_fraction(F.col("split_group"), seed)
    own, stretched = None, None
    last = ROLES[-2][1]
    for name, upto in ROLES[:-1]:
        own = F.when(at < upto, name) if own is None else own.when(at < upto, name)
        stretched = F.when(at < upto / last, name) if stretched is None else stretched.when(at < upto / last, name)
    seen = seen.withColumn("role", F.when(F.col("_exposed"), stretched.otherwise(ROLES[-2][0])).otherwise(own.otherwise(ROLES[-1][0]))).drop("_exposed")
    return rows.join(seen, "split_group")


def collapse_pairs(df: DataFrame, pair: list[str], status: str, value: str, ident: str, documents: str) -> tuple[DataFrame, DataFrame]:
    """(one row per compatible pair with positives: median value, sorted row ids and documents; rows of pairs in conflict).

    A pair is in conflict with a conflicting row, or with both positive and below-threshold rows.
    """
    flags = df.groupBy(*pair).agg(F.max((F.col(status) == "conflicting_constituents").cast("int")).alias("_c"), F.max((F.col(status) == "positive").cast("int")).alias("_p"),
                                  F.max((F.col(status) == "below_threshold").cast("int")).alias("_b"))
    bad = flags.where("_c = 1 or (_p = 1 and _b = 1)").select(*pair)
    positive = df.where(F.col(status) == "positive").join(bad, pair, "left_anti")
    kept = positive.groupBy(*pair).agg(
        F.percentile(F.col(value).cast("double"), F.lit(0.5)).alias(value), F.array_join(F.array_sort(F.collect_list(ident)).cast("array<string>"), ";").alias("source_rows"),
        F.array_join(F.array_sort(F.collect_set(F.col(documents).cast("string"))), ";").alias("documents"),
    )
    return kept, df.join(bad, pair, "left_semi")


def masked_labels(labels: DataFrame, observations: DataFrame, pair: list[str], label: str, status: str, split: str) -> DataFrame:
    """``labels`` with training labels of contradictory pairs set to NULL; other splits stay as they are."""
    bad = observations.where(F.col(status) == "conflicting_constituents").select(*pair).distinct().withColumn("_bad", F.lit(True))
    out = labels.join(bad, pair, "left")
    return out.withColumn(label, F.when(closed(F.col("_bad")) & (F.col(split) == "train"), F.lit(None)).otherwise(F.col(label))).drop("_bad")


def filter_metrics(df: DataFrame, baseline: str, accepted: str, active: str, group: str, trained: DataFrame | None = None) -> DataFrame:
    """One row of counts and shares; only known positives enter denominators, groups of ``trained`` are not novel."""
    if not df.where(F.col(baseline) & ~closed(F.col(accepted))).isEmpty():
        raise ValueError("baseline eligibility can't be taken away")
    b, a, y = F.col(baseline), closed(F.col(accepted)), F.col(active)
    positive = closed(y == 1)
    rows = df if trained is None else df.join(trained.select(group).distinct().withColumn("_old", F.lit(True)), group, "left")
    old = closed(F.col("_old")) if trained is not None else F.lit(False)
    named = closed(F.col(group) != "")
    share = lambda n, d: n / F.nullif(d, F.lit(0))
    groups = lambda c: F.count_distinct(F.when(c & named, F.col(group)))
    out = rows.agg(
        F.count("*").alias("records"), F.count_if(b).alias("baseline"), F.count_if(a).alias("eligible"), F.count_if(a & ~b).alias("rescued"), F.count_if(positive).alias("actives"),
        F.count_if(positive & ~b).alias("actives_outside"), F.count_if(positive & a).alias("actives_retained"), F.count_if(positive & a & ~b).alias("actives_rescued"),
        F.count_if(y.isNull()).alias("unknown"), F.count_if(y.isNull() & a & ~b).alias("unknown_rescued"), groups(positive).alias("active_groups"),
        groups(positive & a).alias("active_groups_retained"), groups(positive & ~old).alias("novel_groups"), groups(positive & a & ~old).alias("novel_groups_retained"),
    )
    return out.withColumns({
        "retention": share(F.col("actives_retained"), F.col("actives")), "rescue_retention": share(F.col("actives_rescued"), F.col("actives_outside")),
        "group_retention": share(F.col("active_groups_retained"), F.col("active_groups")), "reduction": 1 - share(F.col("eligible"), F.col("records")),
    })


def activity_metrics(pool: DataFrame, selected: str, label: str) -> DataFrame:
    """``active_pool, active_selected, inactive_selected, unknown_selected, recovery``: unknown is not inactive."""
    s, y = closed(F.col(selected)), F.col(label)
    out = pool.agg(F.count_if(y == 1).alias("active_pool"), F.count_if(s & (y == 1)).alias("active_selected"), F.count_if(s & (y == 0)).alias("inactive_selected"), F.count_if(s & y.isNull()).alias("unknown_selected"))
    return out.withColumn("recovery", F.col("active_selected") / F.nullif("active_pool", F.lit(0)))


def ranked_rescue(df: DataFrame, baseline: str, score: str, supported: str, ident: str, budget: int) -> DataFrame:
    """The baseline and the best ``budget`` supported rows outside it, by score and hash: ``ident, accepted``.  Only those are sorted."""
    key = [F.col(score), F.sha2(F.col(ident).cast("string"), 256), F.col(ident)]
    best = df.where(~F.col(baseline) & closed(F.col(supported)) & F.col(score).isNotNull()).orderBy(*key).limit(budget).select(ident).withColumn("_in", F.lit(True))
    return df.join(best, ident, "left").select(ident, (F.col(baseline) | closed(F.col("_in"))).alias("accepted"))


def equal_capacity(df: DataFrame, baseline: str, left: tuple[str, str], right: tuple[str, str], active: str, ident: str, fraction: float) -> DataFrame:
    """``arm, rescued, actives_rescued``: both arms (score, supported) cut to the number of rescues that both can fill; no rows if that is 0."""
    n = df.agg(F.count_if(~F.col(baseline)).alias("r"), *(F.count_if(~F.col(baseline) & closed(F.col(s)) & F.col(c).isNotNull()).alias(f"n{k}") for k, (c, s) in enumerate((left, right)))).first()
    budget = int(fraction * n["r"])
    common = min(budget, n["n0"], n["n1"])
    out = None
    for name, (score, supported) in (("left", left), ("right", right)):
        chosen = ranked_rescue(df, baseline, score, supported, ident, common).where("accepted")
        row = df.where(~F.col(baseline)).join(chosen.select(ident), ident, "left_semi").agg(F.count("*").alias("rescued"), F.count_if(F.col(active) == 1).alias("actives_rescued"))
        row = row.select(F.lit(name).alias("arm"), "*")
        out = row if out is None else out.unionByName(row)
    return out.where(F.lit(common > 0))


def evaluate_arms(df: DataFrame, arms: dict[str, Column], policies: dict[str, Column], budgets: list[int], quotas: list[int | None], group: str, label: str, ident: str) -> DataFrame:
    """``arm, policy, budget, quota, taken, hits``: every ranking under every policy, budget and quota on groups.

    The pool is read once: a row for each (arm, policy) that admits it, ranked within its group by slices, and all budgets and quotas
    cut the same ranking.
    """
    from winnower.operators.selection import per_group

    cells = []
    for arm, score in arms.items():
        for policy, keep in policies.items():
            rows = df.where(closed(keep)).select(F.col(ident), F.col(group), F.col(label), score.alias("_s"))
            for quota in quotas:
                pool = rows if quota is None else per_group(rows, group, quota, [F.desc_nulls_last("_s")], ident)
                best = pool.orderBy(F.desc_nulls_last("_s"), ident).limit(max(budgets))
                cells.append(best.select(F.lit(arm).alias("arm"), F.lit(policy).alias("policy"), F.lit(quota).cast("long").alias("quota"), "_s", ident, label))
    every = cells[0]
    for c in cells[1:]:
        every = every.unionByName(c)
    from pyspark.sql.window import Window

    ranked = every.withColumn("_r", F.row_number().over(Window.partitionBy("arm", "policy", "quota").orderBy(F.desc_nulls_last("_s"), ident)))
    counts = [F.struct(F.lit(b).cast("long").alias("budget"), F.count_if(F.col("_r") <= b).alias("taken"), F.count_if((F.col("_r") <= b) & (F.col(label) == 1)).alias("hits")) for b in budgets]
    return ranked.groupBy("arm", "policy", "quota").agg(F.array(*counts).alias("c")).select("arm", "policy", "quota", F.explode("c").alias("c")).select("arm", "policy", "quota", "c.*")


def paired_comparison(results: DataFrame, baseline: str) -> DataFrame:
    """``arm, policy, budget, quota, difference``: hits of each arm less those of the baseline arm in the same cell of the grid."""
    base = results.where(F.col("arm") == baseline).select(F.col("policy").alias("p"), F.col("budget").alias("b"), F.col("quota").alias("q"), F.col("hits").alias("base"))
    same = (F.col("policy") == F.col("p")) & (F.col("budget") == F.col("b")) & F.col("quota").eqNullSafe(F.col("q"))
    return results.where(F.col("arm") != baseline).join(F.broadcast(base), same).select("arm", "policy", "budget", "quota", (F.col("hits") - F.col("base")).alias("difference"))


def overlap_with(runs: DataFrame, baseline: str, run: str, ident: str) -> DataFrame:
    """``run, common, either, jaccard`` of each run's selection with the baseline's."""
    base = runs.where(F.col(run) == baseline).select(ident).distinct().withColumn("_in", F.lit(True))
    size = base.agg(F.count("*").alias("_n"))
    out = runs.select(run, ident).distinct().join(base, ident, "left").groupBy(run).agg(F.count_if(closed(F.col("_in"))).alias("common"), F.count("*").alias("own"))
    out = out.crossJoin(F.broadcast(size)).withColumn("either", F.col("own") + F.col("_n") - F.col("common"))
    return out.select(run, "common", "either", (F.col("common") / F.nullif("either", F.lit(0))).alias("jaccard"))


def run_benchmark(df: DataFrame, strategies: dict[str, Callable[[DataFrame], DataFrame]], ident: str, baseline: str) -> DataFrame:
    """Every strategy's selection from the same pool against the baseline's: what ``overlap_with`` returns."""
    runs = None
    for name, select in strategies.items():
        own = select(df).select(F.lit(name).alias("run"), ident)
        runs = own if runs is None else runs.unionByName(own)
    return overlap_with(runs, baseline, "run", ident)


def assign_splits(df: DataFrame, group: str, seed: int = 42, shares: tuple[tuple[str, float], ...] = (("train", 0.7), ("validation", 0.8), ("calibration", 0.9), ("test", 1.0)), date: str | None = None) -> DataFrame:
    """Adds ``split``: whole groups in hash order, or by the latest ``date`` of the group, cut at the shares of groups.

    Groups of one date are never divided: they go where the first of them goes.  Positions come from range partitions.
    """
    from winnower.functions.columns import spread_ranked

    if date is None:
        groups = df.select(group).distinct().withColumn("_k", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 256))
    else:
        if not df.where(F.col(date).isNull()).isEmpty():
            raise ValueError("a split by time needs a date in every row")
        groups = df.groupBy(group).agg(F.max(date).alias("_k"))
    cells = spread_ranked(groups.groupBy("_k").agg(F.count("*").alias("_c")), [F.asc("_k")], "_p", {"_c": "_run"})
    total = cells.agg(F.sum("_c").alias("_n"))
    at = (F.col("_run") - F.col("_c")) / F.col("_n")
    split = None
    for name, upto in shares:
        split = F.when(at < upto, name) if split is None else split.when(at < upto, name)
    cells = cells.crossJoin(F.broadcast(total)).select("_k", split.alias("split"))
    return df.join(groups.join(cells, "_k").select(group, "split"), group)
