"""Measurements with censored values, labels, leakage-safe splits and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnower.functions.columns import spread_ranked
from winnower.operators.matching import hash_fold


def censored_label(value: Column, relation: Column, threshold: float) -> Column:
    """1 active, 0 inactive, NULL if the relation leaves it open."""
    rel = F.trim(F.coalesce(relation, F.lit("")))
    above = value >= threshold
    return (
        F.when(value.isNull(), None)
        .when(rel.isin("=", ""), F.when(rel == "=", above.cast("int")))
        .when(rel.isin(">", ">="), F.when(above, 1))
        .when(rel.isin("<", "<="), F.when((value < threshold) | ((value == threshold) & (rel == "<")), 0))
    )


def p_activity(value: Column, unit: Column) -> Column:
    """-log10 of a concentration given in M, mM, uM, nM or pM; NULL for other units and non-positive values."""
    # Powers of ten of the units.
    scale = F.when(unit == "M", 0).when(unit == "mM", 3).when(unit == "uM", 6).when(unit == "nM", 9).when(unit == "pM", 12)
    return F.when((value > 0) & scale.isNotNull(), scale - F.log10(value))


def flipped(relation: Column) -> Column:
    """The relation on a scale that runs the other way."""
    return F.translate(relation, "<>", "><")


def evidence(df: DataFrame, key: str, value: str, quality: str, source: str) -> DataFrame:
    """Per key: ``n, least, greatest, qualities, sources`` (distinct, sorted, joined by ``;``)."""
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), text(quality).alias("qualities"), text(source).alias("sources"))


def lookup(candidates: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Candidates with their evidence; 0 and NULLs where there is none."""
    out = candidates.join(index, key, "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def quarantine(df: DataFrame, group: list[str], label: str) -> DataFrame:
    """Rows of groups whose known labels agree; groups with both labels go."""
    ends = df.groupBy(*group).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi")).where("_lo < _hi")
    return df.join(ends.select(*group), group, "left_anti")


def audit(df: DataFrame, group: list[str], value: str, relation: str) -> DataFrame:
    """Counts overall (NULL group) and per group, in one scan."""
    counts = [F.count("*").alias("rows"), F.count(value).alias("measured"), F.count_if(F.col(relation) != "=").alias("censored"), F.count_distinct(value).alias("distinct_values")]
    return df.groupingSets([[F.col(g) for g in group], []], *(F.col(g) for g in group)).agg(*counts)


def split_of(group: Column, seed: str = "20", shares: tuple[tuple[str, int], ...] = (("train", 70), ("validation", 10), ("calibration", 10), ("test", 10))) -> Column:
    """The split of a whole group by hash percentile."""
    at = hash_fold(F.concat(F.lit(f"{seed}:"), group.cast("string")), 100)
    out, upto = None, 0
    for name, share in shares:
        upto += share
        out = F.when(at < upto, name) if out is None else out.when(at < upto, name)
    return out


def temporal_split(df: DataFrame, group: str, date: str, cut: str) -> DataFrame:
    """``split``: a group is late if any of its rows is; groups are never divided."""
    last = df.groupBy(group).agg(F.max(date).alias("available"))
    out = df.join(last, group)
    return out.withColumn("split", F.when(F.col("available") >= F.lit(cut).cast("timestamp"), "external").otherwise("development"))


def leakage(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that lie in more than one split."""
    return df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(key).agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a < b")


def earlier_context(queries: DataFrame, references: DataFrame, key: str, date: str, value: str, ident: str) -> DataFrame:
    """Per query the number, mean and latest value of references of its key dated strictly before it.

    Both sides are united and a running window over (key, date) does the rest: an as-of join without comparing pairs.
    """
    q = queries.select(F.col(ident).alias("q_id"), F.col(key).alias("k"), F.col(date).alias("t"), F.lit(None).cast("double").alias("v"), F.lit(0).alias("side"))
    r = references.select(F.lit(None).cast("long").alias("q_id"), F.col(key).alias("k"), F.col(date).alias("t"), F.col(value).cast("double").alias("v"), F.lit(1).alias("side"))
    both = q.unionByName(r)
    # peers of one date don't see each other: the frame ends before the current date
    before = Window.partitionBy("k").orderBy(F.unix_micros(F.col("t").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    out = both.withColumns({"earlier": F.count("v").over(before), "mean_earlier": F.avg("v").over(before), "latest": F.max(F.when(F.col("v").isNotNull(), F.struct("t", "v"))).over(before)})
    return out.where("side = 0").select(F.col("q_id").alias(ident), "earlier", "mean_earlier", F.col("latest.v").alias("latest"))


# ---- metrics


def _ranked(df: DataFrame, score: str, label: str, ident: str) -> DataFrame:
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.col(ident).alias("i"), F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"))
    return spread_ranked(known, [F.desc("s"), F.asc("i")], "r", {"y": "hits"})


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """``auc`` by the rank sum with ties averaged; NULL with one class.

    Rows are first counted per distinct score, so the window runs over distinct scores only.
    """
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    cells = known.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    cells = spread_ranked(cells, [F.asc("s")], "_p", {"n": "upto"})
    part = cells.withColumn("wins", F.col("p") * (F.col("upto") - F.col("n") / 2))
    return part.agg((F.sum("wins") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


def metrics_at(df: DataFrame, score: str, label: str, ident: str, at: list[int]) -> DataFrame:
    """``at, hits, precision, recall, enrichment`` for the first n of the ranking; only those rows are sorted."""
    total = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    top = known.select(F.col(score).cast("double").alias("s"), F.col(ident).alias("i"), F.col(label).alias("y")).orderBy(F.desc("s"), "i").limit(max(at))
    top = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("s"), "i")))
    sums = [F.struct(F.lit(k).alias("at"), F.count_if((F.col("r") <= k) & (F.col("y") == 1)).alias("hits"), F.count_if(F.col("r") <= k).alias("taken")) for k in at]
    rows = top.agg(F.array(*sums).alias("a")).select(F.explode("a").alias("a")).select("a.*").crossJoin(total)
    precision, base = F.col("hits") / F.col("taken"), F.col("p") / F.col("n")
    return rows.select("at", "hits", precision.alias("precision"), (F.col("hits") / F.nullif("p", F.lit(0))).alias("recall"), (precision / F.nullif(base, F.lit(0))).alias("enrichment"))


def average_precision(df: DataFrame, score: str, label: str, ident: str) -> DataFrame:
    """``average_precision``: mean precision at the positives, in rank order."""
    r = _ranked(df, score, label, ident)
    return r.agg((F.sum(F.when(F.col("y") == 1, F.col("hits") / F.col("r"))) / F.nullif(F.sum("y"), F.lit(0))).alias("average_precision"))


def bedroc(df: DataFrame, score: str, label: str, ident: str, alpha: float = 20.0) -> DataFrame:
    """``bedroc``: early recognition of the positives with exponential weight ``alpha`` (Truchon and Bayly)."""
    r = _ranked(df, score, label, ident)
    n = r.agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    total = r.crossJoin(F.broadcast(n)).groupBy("n", "p").agg(F.sum(F.when(F.col("y") == 1, F.exp(-alpha * F.col("r") / F.col("n")))).alias("e"))
    ra = F.col("p") / F.col("n")
    # robust initial enhancement, scaled to [0, 1] by its least and greatest values
    rie = F.col("e") / (ra * (1 - F.exp(F.lit(-alpha))) / (F.exp(F.lit(alpha) / F.col("n")) - 1))
    best = (1 - F.exp(-alpha * ra)) / (ra * (1 - F.exp(F.lit(-alpha))))
    worst = (1 - F.exp(alpha * ra)) / (ra * (1 - F.exp(F.lit(float(alpha)))))
    return total.select(F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), (rie - worst) / (best - worst)).alias("bedroc"))


def brier_and_ece(df: DataFrame, probability: str, label: str, bins: int = 10) -> DataFrame:
    """``brier, ece`` over equal bins of the probability."""
    p, y = F.col(probability), F.col(label).cast("double")
    known = df.where(p.isNotNull() & y.isNotNull())
    cells = known.groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"), F.sum((p - y) ** 2).alias("q"), F.abs(F.avg(p) - F.avg(y)).alias("gap"))
    return cells.agg((F.sum("q") / F.sum("n")).alias("brier"), (F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"))


def per_task(df: DataFrame, task: str, score: str, label: str) -> DataFrame:
    """AUC of each task and, as task NULL, their mean over the tasks where it is defined."""
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    cells = known.groupBy(task, F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    below = F.sum("n").over(Window.partitionBy(task).orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    part = cells.withColumn("wins", F.col("p") * (F.coalesce(below, F.lit(0)) + F.col("n") / 2))
    each = part.groupBy(task).agg((F.sum("wins") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))
    return each.unionByName(each.agg(F.avg("auc").alias("auc")).withColumn(task, F.lit(None).cast(df.schema[task].dataType)))
