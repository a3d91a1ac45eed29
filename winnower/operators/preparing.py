"""Features for models: imputing and scaling, robust scales, distances, histograms, calibration, trees, folds."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnower.functions.columns import sigmoid


@dataclass(frozen=True)
class Scaling:
    """Median, mean and scale of each feature, from training rows alone; ``unit`` features keep their own scale."""

    features: tuple[str, ...]
    median: dict[str, float]
    mean: dict[str, float]
    scale: dict[str, float]
    logged: tuple[str, ...] = field(default=())

    def value(self, c: str) -> Column:
        v = F.col(c).cast("double")
        return F.log1p(v) if c in self.logged else v

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``z_<feature>`` and ``missing_<feature>``: one projection."""
        columns = {}
        for c in self.features:
            v = self.value(c)
            columns[f"z_{c}"] = (F.coalesce(v, F.lit(self.median[c])) - F.lit(self.mean[c])) / F.lit(self.scale[c])
            columns[f"missing_{c}"] = v.isNull().cast("int")
        return df.withColumns(columns)


def fit_scaling(train: DataFrame, features: list[str], unit: tuple[str, ...] = (), logged: tuple[str, ...] = ()) -> Scaling:
    """Medians in one pass, then means and deviations (of the population) of the imputed values in another; a constant has scale 1."""
    shape = Scaling(tuple(features), {}, {}, {}, tuple(logged))
    medians = train.agg(*(F.percentile(shape.value(c), F.lit(0.5)).alias(c) for c in features)).first()
    absent = [c for c in features if medians[c] is None]
    if absent:
        raise ValueError(f"features without a value: {absent}")
    filled = {c: F.coalesce(shape.value(c), F.lit(float(medians[c]))) for c in features}
    moments = train.agg(*(F.avg(filled[c]).alias(f"m_{c}") for c in features), *(F.stddev_pop(filled[c]).alias(f"s_{c}") for c in features)).first()
    mean = {c: 0.0 if c in unit else float(moments[f"m_{c}"]) for c in features}
    scale = {c: 1.0 if c in unit else float(moments[f"s_{c}"]) or 1.0 for c in features}
    return Scaling(tuple(features), {c: float(medians[c]) for c in features}, mean, scale, tuple(logged))


def robust_scale(df: DataFrame, features: list[str]) -> DataFrame:
    """``feature, center, spread``: median and interquartile range, 1 where that is 0."""
    cells = [F.struct(F.lit(c).alias("feature"), F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias("center"),
                      (F.percentile(F.col(c).cast("double"), F.lit(0.75)) - F.percentile(F.col(c).cast("double"), F.lit(0.25))).alias("spread")) for c in features]
    rows = df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("a")).select("a.*")
    return rows.withColumn("spread", F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0))


def block_distance(numeric: list[tuple[str, float]], categories: list[str], a: str = "a_", b: str = "b_", weights: tuple[float, float] = (0.5, 0.5)) -> Column:
    """Weighted sum of a block of numbers (root mean square of differences over their spreads) and a block of categories (mean
    mismatch); pairs where a value is missing count as the greatest difference, 1."""
    squares = [F.coalesce(F.pow((F.col(f"{a}{c}") - F.col(f"{b}{c}")) / F.lit(float(s) or 1.0), 2), F.lit(1.0)) for c, s in numeric]
    apart = [F.coalesce((F.col(f"{a}{c}") != F.col(f"{b}{c}")).cast("double"), F.lit(1.0)) for c in categories]
    first = F.sqrt(reduce(lambda x, y: x + y, squares) / len(squares)) if squares else F.lit(0.0)
    second = reduce(lambda x, y: x + y, apart) / len(apart) if apart else F.lit(0.0)
    return F.lit(weights[0]) * first + F.lit(weights[1]) * second


def nearest_other(sample: DataFrame, ident: str, identity: str, numeric: list[tuple[str, float]], categories: list[str], most: int = 512) -> DataFrame:
    """``ident, distance``: to the nearest row of another identity within a stated sample of at most ``most`` rows."""
    if sample.limit(most + 1).count() > most:
        raise ValueError(f"the sample holds more than {most} rows")
    names = [c for c, _ in numeric] + categories
    a = sample.select(ident, F.col(identity).alias("_ia"), *(F.col(c).alias(f"a_{c}") for c in names))
    b = sample.select(F.col(identity).alias("_ib"), *(F.col(c).alias(f"b_{c}") for c in names))
    near = a.join(F.broadcast(b), F.col("_ia") != F.col("_ib"))
    return near.groupBy(ident).agg(F.min(block_distance(numeric, categories)).alias("distance"))


def domain_threshold(distances: DataFrame, share: float = 0.99) -> DataFrame:
    """``threshold``: the quantile of the nearest distances beyond which a record is out of the domain."""
    return distances.agg(F.percentile("distance", F.lit(share)).alias("threshold"))


def density_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``bin, height``: equal bins between the extremes, heights over the greatest; a constant has one bin."""
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    rows = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    counts = rows.groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select("bin", (F.col("n") / F.col("most")).alias("height"))


def platt(df: DataFrame, logit: str, label: str, steps: int = 50, least: int = 10) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through the calibration rows, by Newton steps, each one aggregate over the rows.

    With fewer than ``least`` rows of a class the identity (1, 0) stays.
    """
    z, y = F.col(logit).cast("double"), F.col(label).cast("double")
    known = df.where(z.isNotNull() & y.isNotNull()).select(z.alias("z"), y.alias("y"))
    n = known.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q")).first()
    if min(n["p"], n["q"]) < least:
        return 1.0, 0.0
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(F.lit(a) * F.col("z") + F.lit(b))
        g, w = F.col("y") - p, p * (1 - p)
        r = known.agg(F.sum(g * F.col("z")).alias("ga"), F.sum(g).alias("gb"), F.sum(w * F.col("z") ** 2).alias("haa"), F.sum(w * F.col("z")).alias("hab"), F.sum(w).alias("hbb")).first()
        haa, hab, hbb = r["haa"] + 1e-6, r["hab"], r["hbb"] + 1e-6
        det = haa * hbb - hab * hab
        da, db = (r["ga"] * hbb - r["gb"] * hab) / det, (r["gb"] * haa - r["ga"] * hab) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    return a, b


def tree_scores(trees: list[dict], intercept: float = 0.0, rate: float = 1.0) -> Column:
    """The sum of array-encoded trees as one expression: {feature, threshold, left, right, value}, left -1 at a leaf; values go left
    up to the threshold, compared in single precision."""

    def node(tree: dict, k: int) -> Column:
        if tree["left"][k] < 0:
            return F.lit(float(tree["value"][k]))
        goes = F.col(tree["feature"][k]).cast("float") <= F.lit(float(tree["threshold"][k])).cast("float")
        return F.when(goes, node(tree, tree["left"][k])).otherwise(node(tree, tree["right"][k]))

    return reduce(lambda s, t: s + F.lit(float(rate)) * node(t, 0), trees, F.lit(float(intercept)))


def cross_fitted_rates(df: DataFrame, fold: str, group: str, label: str, prior: float = 10.0) -> DataFrame:
    """``df`` with ``out_of_fold``: the group's share of positives in all other folds, drawn to the overall share there.

    Totals less the own fold's counts: no model is fitted twice and no rows are paired.
    """
    cells = df.groupBy(group, fold).agg(F.count(label).alias("n"), F.sum(label).alias("p"))
    part = Window.partitionBy(group)
    folds = cells.groupBy(fold).agg(F.sum("n").alias("fn"), F.sum("p").alias("fp"))
    total = folds.agg(F.sum("fn").alias("tn"), F.sum("fp").alias("tp"))
    base = folds.crossJoin(F.broadcast(total)).select(fold, ((F.col("tp") - F.col("fp")) / F.nullif(F.col("tn") - F.col("fn"), F.lit(0))).alias("base"))
    others = cells.select(group, fold, (F.sum("n").over(part) - F.col("n")).alias("on"), (F.coalesce(F.sum("p").over(part), F.lit(0)) - F.coalesce("p", F.lit(0))).alias("op"))
    rates = others.join(F.broadcast(base), fold).select(group, fold, ((F.col("op") + F.lit(prior) * F.col("base")) / (F.col("on") + F.lit(prior))).alias("out_of_fold"))
    return df.join(rates, [group, fold], "left")
