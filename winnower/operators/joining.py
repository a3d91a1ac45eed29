"""Joins that check their keys, context pools, pattern containment, deltas between linked records."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.functions.columns import closed


def require_unique(df: DataFrame, key: str, what: str = "table") -> None:
    """An error if a key is missing or occurs twice; one aggregate with early combine, one row to the driver."""
    found = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col(key).isNull() | (F.col("_n") > 1)).limit(1).collect()
    if found:
        raise ValueError(f"{what}: {key} {found[0][key]!r} is missing or not unique")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join of two tables whose keys are unique on both sides; anything else is an error."""
    require_unique(left, key, "left")
    require_unique(right, key, "right")
    return left.join(right, key, "left")


def score_join(candidates: DataFrame, predictions: DataFrame, context: DataFrame, key: str) -> DataFrame:
    """Candidates with their predictions and their context, each at most one row; columns of both must not clash."""
    clash = (set(candidates.columns) & set(predictions.columns) | set(candidates.columns) & set(context.columns) | set(predictions.columns) & set(context.columns)) - {key}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    return one_to_one(one_to_one(candidates, predictions, key), context, key)


def annotate(df: DataFrame, tables: dict[str, DataFrame], key: str) -> DataFrame:
    """``df`` with the columns of every analysis (fronts, robustness, context); absent tables add nothing, rows are never multiplied."""
    for name, table in tables.items():
        require_unique(table, key, name)
        df = df.join(table, key, "left")
    return df


def library_mapping(ids: list[str]) -> dict[str, int]:
    """Library -> place; an id given twice is an error."""
    twice = {i for i in ids if ids.count(i) > 1}
    if twice:
        raise ValueError(f"libraries given twice: {sorted(twice)}")
    return {i: k for k, i in enumerate(ids)}


def context_mask(df: DataFrame, context: dict[str, object]) -> Column:
    """True where every given key has the given value; a key without a column makes it false everywhere."""
    missing = [k for k in context if k not in df.columns]
    if missing:
        return F.lit(False)
    return reduce(lambda a, b: a & b, [closed(F.col(k) == F.lit(v)) for k, v in context.items()], F.lit(True))


def compatible_pool(queries: DataFrame, references: DataFrame, keys: list[str], ident: str, identity: str, value: str) -> DataFrame:
    """Per query, ``n`` and ``mean`` of ``value`` over the references that agree on every key the query gives (NULL gives none), without
    the query's own ``identity``.

    Queries are split by which keys they give, at most 2**keys kinds; each kind meets references aggregated on just those keys, so
    no query is paired with single references.  The own identity's share is taken off by a second join.
    """
    out = None
    for k in range(len(keys) + 1):
        for given in combinations(keys, k):
            kind = reduce(lambda a, b: a & b, [F.col(c).isNotNull() if c in given else F.col(c).isNull() for c in keys], F.lit(True))
            q = queries.where(kind).select(ident, identity, *given)
            sums = [F.count(value).alias("n"), F.sum(value).alias("s")]
            every = references.groupBy(*given).agg(*sums)
            own = references.groupBy(identity, *given).agg(F.count(value).alias("own_n"), F.sum(value).alias("own_s"))
            part = q.join(every, list(given), "left") if given else q.crossJoin(F.broadcast(every))
            part = part.join(own, [identity, *given], "left")
            n = F.coalesce("n", F.lit(0)) - F.coalesce("own_n", F.lit(0))
            total = F.coalesce("s", F.lit(0.0)) - F.coalesce("own_s", F.lit(0.0))
            part = part.select(ident, n.cast("long").alias("n"), F.when(n > 0, total / n).alias("mean"))
            out = part if out is None else out.unionByName(part)
    return out


def joint_pattern(candidates: DataFrame, references: DataFrame, mask: str, ident: str, most_patterns: int = 4096) -> DataFrame:
    """Per candidate, the number of references that fail all that it fails: ``ident, n``; masks are bits of failed rules.

    Only distinct masks are compared; more than ``most_patterns`` on either side (over 12 rules) is an error, so the broadcast is bounded.
    """
    own = references.groupBy(F.col(mask).alias("_r")).agg(F.count("*").alias("_n"))
    asked = candidates.select(F.col(mask).alias("_q")).distinct()
    for side in (own, asked):
        if side.limit(most_patterns + 1).count() > most_patterns:
            raise ValueError(f"more than {most_patterns} patterns of failed rules")
    met = asked.join(F.broadcast(own), (F.col("_q").bitwiseAND(F.col("_r"))) == F.col("_q"), "left")
    counts = met.groupBy("_q").agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n"))
    return candidates.join(F.broadcast(counts), F.col(mask) == F.col("_q"), "left").select(ident, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def property_deltas(pairs: DataFrame, properties: DataFrame, record_id: str, columns: list[str]) -> DataFrame:
    """``excluded_id, analog_id, property, delta``: analogue minus excluded, where both are known."""
    left = properties.select(F.col(record_id).alias("excluded_id"), *(F.col(c).cast("double").alias(f"e_{c}") for c in columns))
    right = properties.select(F.col(record_id).alias("analog_id"), *(F.col(c).cast("double").alias(f"a_{c}") for c in columns))
    both = pairs.select("excluded_id", "analog_id").join(left, "excluded_id").join(right, "analog_id")
    rows = F.array(*(F.struct(F.lit(c).alias("property"), (F.col(f"a_{c}") - F.col(f"e_{c}")).alias("delta")) for c in columns))
    return both.select("excluded_id", "analog_id", F.explode(rows).alias("d")).select("excluded_id", "analog_id", "d.*").where("delta is not null")
