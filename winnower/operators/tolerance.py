"""Tolerance of rule violations, learned from reference records that break rules and still are active.

Weighted distributions, support gates, calibration and the contextual priority.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnower.functions.columns import clip, closed, sigmoid, spread_ranked

#: Least distinct identities, scaffolds and documents behind a relaxation; shrinkage of small supports.
SUPPORT = {"identities": 20, "scaffolds": 5, "documents": 3}
SHRINKAGE = 64.0


def balanced_weights(df: DataFrame, task: str, scaffold: str, identity: str) -> DataFrame:
    """``task, scaffold, identity, weight``: equal mass per task, then per scaffold of the task, then per identity of that."""
    rows = df.select(task, scaffold, identity).distinct()
    per_pair = rows.groupBy(task, scaffold).agg(F.count("*").alias("_i"))
    per_task = per_pair.groupBy(task).agg(F.count("*").alias("_s"))
    tasks = per_task.agg(F.count("*").alias("_t"))
    out = rows.join(per_pair, [task, scaffold]).join(per_task, task).crossJoin(F.broadcast(tasks))
    return out.select(task, scaffold, identity, (1 / (F.col("_t") * F.col("_s") * F.col("_i"))).alias("weight"))


def effective_n(df: DataFrame, weight: str, by: list[str] | None = None) -> DataFrame:
    """Kish's effective sample size: ``effective_n``."""
    return df.groupBy(*(by or [])).agg((F.pow(F.sum(weight), 2) / F.sum(F.pow(weight, 2))).alias("effective_n"))


def weighted_ecdf(df: DataFrame, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """Distinct values with their cumulative share of weight: ``x, cdf`` per group.  Windows run over distinct values."""
    by = by or []
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("x")).agg(F.sum(weight).alias("w"))
    part = Window.partitionBy(*by)
    upto = F.sum("w").over(part.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("cdf", upto / F.sum("w").over(part)).drop("w")


def ecdf_lookup(df: DataFrame, curve: DataFrame, value: str, ident: str, by: list[str] | None = None) -> DataFrame:
    """``ident, cdf``: the share at the greatest x not above the value, 0 below all.

    The curve's points and the values are sorted together and the last point seen is carried on: no pairs are compared.
    """
    by = by or []
    points = curve.select(*by, F.col("x"), F.col("cdf"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("i"))
    asked = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("x"), F.lit(None).cast("double").alias("cdf"), F.lit(1).alias("side"), F.col(ident).cast("long").alias("i"))
    order = Window.partitionBy(*by).orderBy("x", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = points.unionByName(asked).withColumn("seen", F.last("cdf", ignorenulls=True).over(order))
    return both.where("side = 1").select(*by, F.col("i").alias(ident), F.coalesce("seen", F.lit(0.0)).alias("cdf"))


def support(df: DataFrame, by: list[str], identity: str, scaffold: str, document: str) -> DataFrame:
    """Distinct identities, scaffolds and documents behind each pattern and whether they are enough."""
    blank = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c))
    out = df.groupBy(*by).agg(F.count_distinct(identity).alias("identities"), F.count_distinct(blank(scaffold)).alias("scaffolds"), F.count_distinct(blank(document)).alias("documents"))
    enough = (F.col("identities") >= SUPPORT["identities"]) & (F.col("scaffolds") >= SUPPORT["scaffolds"]) & (F.col("documents") >= SUPPORT["documents"])
    return out.withColumn("supported", enough)


def shrunk(percentile: Column, n: Column) -> Column:
    """A percentile drawn towards 1 (least tolerant) where few references stand behind it."""
    share = n / (n + F.lit(SHRINKAGE))
    return share * percentile + (1 - share)


def nonconformity(components: DataFrame, ident: str, percentile: str = "cdf", n: str = "n") -> DataFrame:
    """The worst component of each record: ``score``, and how many components there are."""
    return components.groupBy(ident).agg(F.max(shrunk(F.col(percentile), F.col(n))).alias("score"), F.count("*").alias("components"))


def state(base_eligible: Column, supported: Column, score: Column, threshold: float) -> Column:
    """base_eligible, supported_relaxation, review (unsupported), or excluded."""
    return (
        F.when(closed(base_eligible), "base_eligible").when(~closed(supported), "review").when(closed(score <= threshold), "supported_relaxation").otherwise("excluded")
    )


def calibrate(df: DataFrame, score: str, active: str, base: str, retention: float, background_cap: float) -> DataFrame:
    """Least threshold that keeps the wanted share of known actives: ``threshold, needed, background_share, accepted``.

    The base keeps its actives; the rest come in by ascending score.  The threshold is the score at which enough have come, and is
    accepted if it lets in no more than ``background_cap`` of the non-actives outside the base.
    """
    total = df.agg(F.count_if(F.col(active) == 1).alias("a"), F.count_if((F.col(active) == 1) & F.col(base)).alias("kept"))
    need = F.greatest(F.ceil(F.lit(retention) * F.col("a")) - F.col("kept"), F.lit(0))
    rest = df.where(~F.col(base) & F.col(score).isNotNull())
    order = Window.orderBy(score)
    scores = rest.where(F.col(active) == 1).groupBy(score).agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(order))
    at = scores.crossJoin(F.broadcast(total)).where(F.col("upto") >= need).agg(F.min(score).alias("t"), F.first(need).alias("needed"))
    at = at.crossJoin(F.broadcast(total)).select(F.when(F.coalesce("needed", F.lit(0)) > 0, F.col("t")).alias("threshold"), F.coalesce("needed", F.lit(0)).cast("long").alias("needed"))
    others = rest.where(F.col(active) == 0).crossJoin(F.broadcast(at)).groupBy("threshold", "needed").agg(F.avg(closed(F.col(score) <= F.col("threshold")).cast("double")).alias("background_share"))
    out = at.crossJoin(F.broadcast(others.agg(F.max("background_share").alias("background_share"))))
    share = F.coalesce("background_share", F.lit(0.0))
    return out.select("threshold", "needed", share.alias("background_share"), (share <= background_cap).alias("accepted"))


def conformal_cutoff(df: DataFrame, error: str, label: str, alpha: float = 0.1) -> DataFrame:
    """Per class the order statistic of rank ceil((n + 1)(1 - alpha)) of the errors, 1 if there is none: ``label, q``."""
    known = df.where(F.col(label).isNotNull() & F.col(error).isNotNull())
    cells = known.groupBy(label, error).agg(F.count("*").alias("_c"))
    cells = spread_ranked(cells, [F.asc(label), F.asc(error)], "_p", {"_c": "_run"})
    classes = cells.groupBy(label).agg(F.min(F.col("_run") - F.col("_c")).alias("_first"), F.sum("_c").alias("_n"))
    rank = F.ceil((F.col("_n") + 1) * F.lit(1 - alpha))
    cells = cells.join(F.broadcast(classes), label).where(F.col("_run") - F.col("_first") >= rank)
    least = cells.groupBy(label).agg(F.min(error).alias("q"))
    return classes.select(label).join(least, label, "left").select(label, F.coalesce("q", F.lit(1.0)).alias("q"))


def prediction_set(probability: Column, q0: Column, q1: Column) -> Column:
    """Classes whose error does not exceed their cut-off, ascending."""
    both = F.array(F.when(closed(probability <= q0), F.lit(0)), F.when(closed(1 - probability <= q1), F.lit(1)))
    return F.filter(both, lambda c: c.isNotNull())


def logistic(features: dict[str, tuple[float, float, float]], intercept: float = 0.0, slope: float = 1.0, shift: float = 0.0) -> dict[str, Column]:
    """``logit``, ``probability`` and a contribution per feature, from {column: (weight, mean, scale)}; missing is the mean."""
    parts = {c: F.coalesce((F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s) or 1.0), F.lit(0.0)) * F.lit(float(w)) for c, (w, m, s) in features.items()}
    z = sum(parts.values(), F.lit(float(intercept)))
    return {"logit": z, "probability": sigmoid(F.lit(float(slope)) * z + F.lit(float(shift))), **{f"part_{c}": p for c, p in parts.items()}}


def contextual_priority(activity: Column, bonus: Column, penalty: Column) -> Column:
    """Activity plus bonus minus penalty in [0, 1]; unknown activity is 0."""
    return F.when(activity.isNull(), 0.0).otherwise(clip(activity + F.coalesce(bonus, F.lit(0.0)) - F.coalesce(penalty, F.lit(0.0)), 0, 1))


def information_queue(df: DataFrame, priority: str, wanted: Column, budget: int, ident: str) -> DataFrame:
    """A review queue of its own: the first ``budget`` of the wanted rows, ``information_rank``."""
    top = df.where(closed(wanted)).orderBy(F.desc_nulls_last(priority), ident).limit(budget)
    return top.withColumn("information_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(priority), ident)))


def rescue(df: DataFrame, base: str, score: str, supported: str, fraction: float, ident: str) -> DataFrame:
    """The best floor(fraction * baseline) supported rows outside the baseline, by score and SHA-256 of the id: ``rescue_rank``."""
    budget = df.agg(F.floor(F.lit(fraction) * F.count_if(base)).alias("_b"))
    rows = df.where(~F.col(base) & closed(F.col(supported)) & F.col(score).isNotNull())
    ranked = spread_ranked(rows, [F.asc(score), F.sha2(F.col(ident).cast("string"), 256).asc(), F.asc(ident)], "rescue_rank").crossJoin(F.broadcast(budget))
    return ranked.where(F.col("rescue_rank") <= F.col("_b")).drop("_b")


# ---- a tolerance profile: fitted on references that break rules, applied to candidates


def exact_positives(measurements: DataFrame, identity: str, task: str, value: str, relation: str, threshold: float = 6.5) -> DataFrame:
    """Identities with an exact value at or above the threshold in a task whose exact values all agree: ``identity, task``."""
    known = measurements.where((F.trim(relation) == "=") & F.col(value).isNotNull())
    ends = known.groupBy(identity, task).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return ends.where((F.col("_lo") >= threshold) & (F.col("_hi") >= threshold)).select(identity, task)


def fit_profile(failed: DataFrame, identity: str, scaffold: str, document: str, weight: str) -> tuple[DataFrame, DataFrame]:
    """(``criterion, x, cdf``, support per criterion) of the references' failed criteria: rows ``criterion, magnitude`` with who stands
    behind them."""
    curves = weighted_ecdf(failed, "magnitude", weight, ["criterion"])
    return curves, support(failed, ["criterion"], identity, scaffold, document)


def predict_profile(annotated: DataFrame, curves: DataFrame, supports: DataFrame, threshold: float, record_id: str = "record_id") -> DataFrame:
    """``record_id, score, supported, state`` of candidates from their criteria (``criterion, violation, magnitude``).

    Nothing failed and nothing unknown is base_eligible; an unknown criterion, or a failed one without support, is for review; else
    the worst shrunk percentile against the threshold decides.  Criteria that no reference fails have percentile 0 and no support.
    """
    failed = annotated.where(closed(F.col("violation"))).select(record_id, "criterion", "magnitude")
    keyed = failed.withColumn("_i", F.xxhash64(record_id, "criterion"))
    placed = ecdf_lookup(keyed, curves, "magnitude", "_i", ["criterion"]).select("_i", "cdf")
    rows = keyed.join(placed, "_i", "left").join(F.broadcast(supports.select("criterion", "identities", "supported")), "criterion", "left")
    n = F.coalesce("identities", F.lit(0)).cast("double")
    rows = rows.select(record_id, shrunk(F.coalesce("cdf", F.lit(0.0)), n).alias("_s"), closed(F.col("supported")).alias("_ok"))
    worst = rows.groupBy(record_id).agg(F.max("_s").alias("score"), F.min("_ok").alias("supported"))
    every = annotated.groupBy(record_id).agg(F.max(F.col("violation").isNull()).alias("_unknown"))
    out = every.join(worst, record_id, "left")
    base = F.col("score").isNull() & ~F.col("_unknown")
    return out.select(record_id, "score", F.coalesce("supported", F.lit(False)).alias("supported"),
                      state(base, closed(F.col("supported")) & ~F.col("_unknown"), F.col("score"), threshold).alias("state"))


def calibration_fits(fitted: dict, asked: dict) -> bool:
    """Whether a calibrated threshold may be used: the same criteria and the same contexts, whatever their order."""
    return set(fitted["criteria"]) == set(asked["criteria"]) and sorted(map(str, fitted["contexts"])) == sorted(map(str, asked["contexts"]))


# ---- desirability functions


def double_sigmoid(x: Column, a: float, b: float, c: float, d: float, e: float, f: float, most: float) -> Column:
    """Asymmetric double sigmoid over its greatest value, as in the published drug-likeness estimate, in (0, 1]."""
    rise = 1 / (1 + F.exp(-(x - F.lit(c) + F.lit(d / 2)) / F.lit(e)))
    fall = 1 - 1 / (1 + F.exp(-(x - F.lit(c) - F.lit(d / 2)) / F.lit(f)))
    return clip((F.lit(a) + F.lit(b) * rise * fall) / F.lit(most), 1e-9, 1.0)


def likeness(parameters: dict[str, tuple[float, ...]]) -> Column:
    """Geometric mean of the columns' desirabilities; NULL where a column is missing."""
    logs = [F.ln(double_sigmoid(F.col(c).cast("double"), *p)) for c, p in parameters.items()]
    return F.exp(sum(logs[1:], logs[0]) / len(logs))
