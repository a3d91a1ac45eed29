"""Maps: principal components, density tiles, viewports and lassos."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.functions.columns import closed


def pca_map(df: DataFrame, columns: list[str], record_id: str = "record_id") -> tuple[DataFrame, list[float]]:
    """``record_id, x, y, imputed`` and the share of variance of both axes.

    Rows without any value go; missing values become the mean; columns are scaled by their population deviation.  Means and
    the cross products come from one aggregate each, only the small eigenproblem is solved on the driver.
    """
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
    rows = df.where(some).select(record_id, *(F.col(c).cast("double").alias(c) for c in columns))
    stats = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in columns)).first()
    mean = [float(stats[f"m_{c}"] or 0.0) for c in columns]
    filled = rows.select(record_id, *(F.coalesce(F.col(c), F.lit(m)).alias(c) for c, m in zip(columns, mean)), reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]).alias("imputed"))
    dev = filled.agg(*(F.stddev_pop(c).alias(c) for c in columns)).first()
    scale = [float(dev[c] or 0.0) or 1.0 for c in columns]
    z = [(F.col(c) - m) / s for c, m, s in zip(columns, mean, scale)]
    d = len(columns)
    cells = filled.agg(*(F.avg(z[i] * z[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d))).first()
    cov = np.array([[float(cells[f"c{min(i, j)}_{max(i, j)}"] or 0.0) for j in range(d)] for i in range(d)])
    value, vector = np.linalg.eigh(cov)
    axes = vector[:, np.argsort(-value, kind="stable")[:2]]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), range(axes.shape[1])] < 0, -1, 1)
    points = [sum((c * float(w) for c, w in zip(z, axes[:, k])), F.lit(0.0)).cast("float") for k in range(axes.shape[1])]
    points += [F.lit(0.0).cast("float")] * (2 - len(points))
    share = sorted((float(v / max(value.sum(), 1e-300)) for v in value), reverse=True)[:2]
    return filled.select(record_id, points[0].alias("x"), points[1].alias("y"), "imputed"), share


def tiles(df: DataFrame, x: str, y: str, n: int = 60, selected: str | None = None) -> DataFrame:
    """An n x n grid over the points' extent: ``tx, ty, points, chosen, share``; the far edges belong to the last tiles."""
    ends = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))

    def place(v: str, lo: str, hi: str) -> Column:
        width = (F.col(hi) - F.col(lo)) / n
        return F.when(width > 0, F.least(F.floor((F.col(v) - F.col(lo)) / width), F.lit(n - 1))).otherwise(0).cast("int")

    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).crossJoin(F.broadcast(ends))
    chosen = F.count_if(closed(F.col(selected))) if selected else F.lit(0).cast("long")
    out = rows.groupBy(place(x, "x0", "x1").alias("tx"), place(y, "y0", "y1").alias("ty")).agg(F.count("*").alias("points"), chosen.alias("chosen"))
    return out.withColumn("share", F.col("chosen") / F.col("points"))


def in_viewport(x: str, y: str, x0: float, x1: float, y0: float, y1: float) -> Column:
    """Inside or on the rectangle."""
    return closed(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def in_lasso(x: str, y: str, polygon: list[tuple[float, float]]) -> Column:
    """Inside the polygon by the even-odd rule, one expression over its edges; fewer than three corners hold nothing."""
    if len(polygon) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(polygon, polygon[1:] + polygon[:1]):
        if y0 == y1:
            continue
        spans = (F.col(y) < F.lit(float(max(y0, y1)))) & (F.col(y) >= F.lit(float(min(y0, y1))))
        at = F.lit(float(x0)) + (F.col(y) - F.lit(float(y0))) * F.lit((x1 - x0) / (y1 - y0))
        crossings = crossings + (spans & (F.col(x) < at)).cast("int")
    return closed(crossings % 2 == 1)
