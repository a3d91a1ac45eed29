"""Scores, gates, alerts and the staged decision with its reasons.

Rules, scores, alerts and policy stay apart: each is a table or column of its own keyed by the record, and only the
decision brings them together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.functions.columns import all_of, clip, closed, count_true, spread_ranked
from winnower.operators.expressions import compile_expression
from winnower.operators.rules import Profile

#: Weights of pass fraction, quality and alerts, and the number of alerts that costs everything.
WEIGHTS = (0.5, 0.35, 0.15)
ALERT_CAP = 3


def pass_fraction(profiles: list[Profile]) -> Column:
    """Share of profiles passed; NULL without profiles."""
    if not profiles:
        return F.lit(None).cast("double")
    return count_true([F.col(f"{p.id}__passed") for p in profiles]) / F.lit(float(len(profiles)))


def hard_violations(profiles: list[Profile]) -> Column:
    return sum((F.col(f"{p.id}__violations") for p in profiles), F.lit(0).cast("long"))


def consensus_score(fraction: Column, quality: Column | None = None, alerts: Column | None = None) -> Column:
    """Weighted mean of the components at hand, in [0, 1]; weights of absent ones are shared out."""
    parts = [(WEIGHTS[0], fraction)]
    if quality is not None:
        parts.append((WEIGHTS[1], quality))
    if alerts is not None:
        parts.append((WEIGHTS[2], 1 - F.least(alerts.cast("double"), F.lit(float(ALERT_CAP))) / ALERT_CAP))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for w, c in parts), F.lit(0.0))
    total = sum((F.coalesce(c * w, F.lit(0.0)) for w, c in parts), F.lit(0.0))
    return F.when(weight > 0, clip(total / weight, 0, 1))


def top_percentile(df: DataFrame, value: str, percent: float, keep: str = "gate") -> DataFrame:
    """Flag the rows at or above the quantile 1 - percent/100, ties kept, missing values out."""
    cut = df.agg(F.expr(f"percentile(`{value}`, {1 - percent / 100})").alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn(keep, closed(F.col(value) >= F.col("_cut"))).drop("_cut")


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Right-closed equal bins of [0, 1], the lowest value included, empty bins too: ``bin, n``."""
    place = F.greatest(F.ceil(F.col(value) * bins).cast("int") - 1, F.lit(0))
    counts = df.where(F.col(value).between(0, 1)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# ---- alerts


@dataclass(frozen=True)
class Alert:
    """A pattern of a catalogue; ``action`` is inform, warn, penalize or exclude."""

    catalog_id: str
    name: str
    pattern: str
    action: str = "warn"
    description: str = ""

    def __post_init__(self) -> None:
        if self.action not in ("inform", "warn", "penalize", "exclude"):
            raise ValueError(f"{self.name}: unknown action {self.action!r}")


def alert_hits(df: DataFrame, alerts: list[Alert], text: str, record_id: str) -> DataFrame:
    """A row per record and alert found: ``catalog_id, alert_name, action, occurrence_count``.

    One scan of the text for all patterns; nothing is joined.
    """
    rows = [
        F.struct(F.lit(a.catalog_id).alias("catalog_id"), F.lit(a.name).alias("alert_name"), F.lit(a.action).alias("action"),
                 F.regexp_count(F.col(text), F.lit(a.pattern)).cast("long").alias("occurrence_count"))
        for a in alerts
    ]
    found = F.filter(F.array(*rows), lambda x: x["occurrence_count"] > 0)
    return df.select(record_id, F.explode(found).alias("h")).select(record_id, "h.*")


def alert_counts(df: DataFrame, hits: DataFrame, record_id: str, actions: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` with ``alert_count`` and ``alert_excluded``; ``actions`` restricts what is counted."""
    counted = hits if actions is None else hits.where(F.col("action").isin(list(actions)))
    per = counted.groupBy(record_id).agg(F.sum("occurrence_count").alias("alert_count"))
    out = hits.where("action = 'exclude'").select(record_id).distinct().withColumn("alert_excluded", F.lit(True))
    df = df.join(per, record_id, "left").join(out, record_id, "left")
    return df.withColumns({"alert_count": F.coalesce("alert_count", F.lit(0)).cast("long"), "alert_excluded": closed(F.col("alert_excluded"))})


# ---- the decision


@dataclass(frozen=True)
class Policy:
    """Stages in order: mandatory profiles, N of M, quality gate, alerts, expression.

    Roles ``exclusion``, ``warning`` and ``ranking`` decide nothing unless ``strict_roles`` makes exclusion mandatory.
    """

    roles: dict[str, str] = field(default_factory=dict)
    consensus_least: int | None = None
    gate: str | None = None
    alerts: bool = False
    expression: str = ""
    strict_roles: bool = False

    def mandatory(self) -> list[str]:
        wanted = {"mandatory", "exclusion"} if self.strict_roles else {"mandatory"}
        return sorted(p for p, r in self.roles.items() if r in wanted)

    def voting(self) -> list[str]:
        return sorted(p for p, r in self.roles.items() if r == "consensus")


def decide(df: DataFrame, policy: Policy) -> DataFrame:
    """Add ``selected`` and ``exclusion_reasons`` (in stage order, joined by ``; ``)."""
    stages: list[tuple[Column, str]] = [(closed(F.col(f"{p}__passed")), f"failed profile {p}") for p in policy.mandatory()]
    if policy.consensus_least is not None:
        votes = count_true([F.col(f"{p}__passed") for p in policy.voting()])
        stages.append((votes >= policy.consensus_least, f"fewer than {policy.consensus_least} of {len(policy.voting())} profiles"))
    if policy.gate:
        stages.append((closed(F.col(policy.gate)), "quality gate"))
    if policy.alerts:
        stages.append((~closed(F.col("alert_excluded")), "excluding alert"))
    if policy.expression:
        stages.append((compile_expression(df, policy.expression), "expression"))
    reasons = F.filter(F.array(*(F.when(~ok, F.lit(why)) for ok, why in stages)).cast("array<string>"), lambda r: r.isNotNull())
    return df.withColumns({"selected": all_of([ok for ok, _ in stages]), "exclusion_reasons": F.array_join(reasons, "; ")})


def drop_with_reason(df: DataFrame, keep: Column, reason: str) -> DataFrame:
    """Deselect selected rows that ``keep`` rejects, appending the reason."""
    gone = F.col("selected") & ~closed(keep)
    text = F.concat_ws("; ", F.when(F.col("exclusion_reasons") != "", F.col("exclusion_reasons")), F.lit(reason))
    return df.withColumns({"selected": F.col("selected") & ~gone, "exclusion_reasons": F.when(gone, text).otherwise(F.col("exclusion_reasons"))})


# ---- reports on rules


def approval(df: DataFrame, profiles: list[Profile]) -> DataFrame:
    """Per profile: ``profile_id, approved, rejected, approved_share, one_violation``, in one pass."""
    sums = [F.struct(F.lit(p.id).alias("profile_id"), F.sum(F.col(f"{p.id}__passed").cast("long")).alias("approved"), F.count("*").alias("n"),
                     F.count_if(F.col(f"{p.id}__violations") == 1).alias("one_violation")) for p in profiles]
    rows = df.agg(F.array(*sums).alias("a")).select(F.explode("a").alias("a")).select("a.*")
    return rows.select("profile_id", "approved", (F.col("n") - F.col("approved")).alias("rejected"), (F.col("approved") / F.col("n")).alias("approved_share"), "one_violation")


def funnel(df: DataFrame, profiles: list[Profile]) -> DataFrame:
    """Running AND over the profiles in order: ``step, profile_id, remaining``."""
    steps = [F.struct(F.lit(k).alias("step"), F.lit(p.id).alias("profile_id"),
                      F.count_if(all_of([F.col(f"{q.id}__passed") for q in profiles[: k + 1]])).alias("remaining")) for k, p in enumerate(profiles)]
    return df.agg(F.array(*steps).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def sole_failures(found: DataFrame, record_id: str = "record_id") -> DataFrame:
    """Rules that alone keep records out: ``profile_id, rule_id, failure_code, n``."""
    alone = found.groupBy(record_id).agg(F.count("*").alias("k"), *(F.first(c).alias(c) for c in ("profile_id", "rule_id", "failure_code"))).where("k = 1")
    return alone.groupBy("profile_id", "rule_id", "failure_code").agg(F.count("*").alias("n"))


def intersections(df: DataFrame, profiles: list[Profile]) -> DataFrame:
    """``given, other, share``: of the records that pass ``given``, the share that pass ``other``; NULL if none do."""
    cells = [
        F.struct(F.lit(a.id).alias("given"), F.lit(b.id).alias("other"),
                 (F.count_if(F.col(f"{a.id}__passed") & F.col(f"{b.id}__passed")) / F.nullif(F.count_if(F.col(f"{a.id}__passed")), F.lit(0))).alias("share"))
        for a in profiles for b in profiles
    ]
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def group_table(df: DataFrame, group: str, empty: str = "(none)") -> DataFrame:
    """``group, n, group_id``: sizes, ids by descending size; the empty group has a name of its own."""
    label = F.when(F.col(group) == "", F.lit(empty)).otherwise(F.col(group))
    sizes = df.where(F.col(group).isNotNull()).groupBy(label.alias("group")).agg(F.count("*").alias("n"))
    return spread_ranked(sizes, [F.desc("n"), F.asc("group")], "group_id").withColumn("group_id", F.col("group_id").cast("int"))


def diversity(df: DataFrame, group: str) -> DataFrame:
    """``total, groups, groups_per_record, largest_share, singletons``."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.sum("n").alias("total"), F.count("*").alias("groups"), (F.count("*") / F.sum("n")).alias("groups_per_record"),
        (F.max("n") / F.sum("n")).alias("largest_share"), F.count_if(F.col("n") == 1).alias("singletons"),
    )
