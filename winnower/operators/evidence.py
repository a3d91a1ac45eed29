"""Contextual evidence: how far rules are broken, what follows from it, and how much support stands behind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.functions.columns import clip, closed, number
from winnower.operators.rules import Profile, Rule

#: Least molecules, members of the rarer class, scaffolds and documents behind a learned action.
LEAST = {"molecules": 20, "rarer_class": 5, "scaffolds": 5, "documents": 3}


@dataclass(frozen=True)
class Action:
    """What a broken rule or profile leads to: inform, warn, penalize or exclude.  Learned actions need support."""

    feature_id: str
    action: str = "warn"
    penalty: float = 0.0
    learned: bool = False
    molecules: int = 0
    positives: int = 0
    negatives: int = 0
    scaffolds: int = 0
    documents: int = 0
    source: str = ""
    endpoint: str = "risk"

    def __post_init__(self) -> None:
        if self.action not in ("inform", "warn", "penalize", "exclude"):
            raise ValueError(f"{self.feature_id}: unknown action {self.action!r}")

    @property
    def supported(self) -> bool:
        rarer = min(self.positives, self.negatives)
        enough = self.molecules >= LEAST["molecules"] and rarer >= LEAST["rarer_class"] and self.scaffolds >= LEAST["scaffolds"]
        return enough and self.documents >= LEAST["documents"] and bool(self.source.strip())

    def effective(self, calibrated: bool, in_domain: Column) -> Column:
        """A learned action is only a warning unless supported, calibrated and in the domain; activity never excludes."""
        if not self.learned:
            return F.lit(self.action)
        if not self.supported or not calibrated or (self.action == "exclude" and self.endpoint == "activity"):
            return F.lit("warn")
        return F.when(closed(in_domain), self.action).otherwise("warn")


def excess(rule: Rule) -> Column:
    """Distance beyond the nearer limit over the limit's size; NULL for a missing value, 0 within."""
    low, high = rule.bounds
    v = number(rule.descriptor)
    sides = [F.lit(0.0)]
    if low is not None:
        sides.append((F.lit(low) - v) / F.lit(abs(low) or 1.0))
    if high is not None:
        sides.append((v - F.lit(high)) / F.lit(abs(high) or 1.0))
    worst = F.greatest(*sides) if len(sides) > 1 else sides[0]
    return F.when(v.isNotNull(), worst)


def _entry(profile: Profile, rule: Rule, action: Action | None, calibrated: bool, domain: Column) -> Column:
    v = number(rule.descriptor)
    effective = action.effective(calibrated, domain) if action else F.lit("inform")
    return F.struct(
        F.lit(profile.id).alias("profile_id"), F.lit(rule.id).alias("rule_id"), v.alias("observed"), F.when(v.isNotNull(), ~rule.satisfied()).alias("violated"),
        excess(rule).alias("normalized_excess"), effective.alias("effective_action"), F.lit(action.supported if action and action.learned else None).cast("boolean").alias("supported"),
    )


def rule_evidence(df: DataFrame, profiles: list[Profile], actions: list[Action] = [], record_id: str = "record_id", calibrated: bool = False, in_domain: str | None = None) -> DataFrame:
    """A row per record and rule: ``profile_id, rule_id, observed, violated (NULL if unknown), normalized_excess, effective_action, supported``."""
    by = {a.feature_id: a for a in actions}
    domain = F.col(in_domain) if in_domain else F.lit(None).cast("boolean")
    rows = F.array(*(_entry(p, r, by.get(r.id), calibrated, domain) for p in profiles for r in p.rules))
    return df.select(record_id, F.explode(rows).alias("e")).select(record_id, "e.*")


def profile_state(profile: Profile) -> tuple[Column, Column, Column]:
    """(violations, unknown rules, passed): more violations than allowed fail whatever is unknown; else unknown rules leave it open."""
    known = [number(r.descriptor).isNotNull() for r in profile.rules]
    broken = sum(((k & ~r.satisfied()).cast("long") for k, r in zip(known, profile.rules)), F.lit(0).cast("long"))
    unknown = sum(((~k).cast("long") for k in known), F.lit(0).cast("long"))
    passed = F.when(broken > (profile.max_violations or 0), False).when(unknown > 0, F.lit(None).cast("boolean")).otherwise(True)
    return broken, unknown, passed


def contextual_policy(df: DataFrame, profiles: list[Profile], actions: list[Action], activity: str, record_id: str = "record_id", calibrated: bool = False, in_domain: str | None = None) -> DataFrame:
    """``record_id, eligible, penalty, priority, warnings``: the actions of broken rules and failed profiles, in order.

    ``exclude`` takes eligibility, ``penalize`` adds its penalty, ``warn`` asks for review; an unknown descriptor is a warning, and
    excludes where a user's own action demands the rule.  Priority is activity minus penalty in [0, 1], 0 for unknown activity.
    """
    by = {a.feature_id: a for a in actions}
    domain = F.col(in_domain) if in_domain else F.lit(None).cast("boolean")
    excluded, penalty, warnings = F.lit(False), F.lit(0.0), [F.when(F.col(activity).isNull(), F.lit("activity_unknown"))]
    for p in profiles:
        for r in p.rules:
            known = number(r.descriptor).isNotNull()
            warnings.append(F.when(~known, F.lit(f"descriptor_missing:{r.descriptor}")))
            a = by.get(r.id)
            if not a:
                continue
            effective, broken = a.effective(calibrated, domain), known & ~r.satisfied()
            excluded = excluded | (broken & (effective == "exclude"))
            if not a.learned and a.action == "exclude":
                excluded = excluded | ~known
            penalty = penalty + F.when(broken & (effective == "penalize"), F.lit(float(a.penalty))).otherwise(0.0)
            warnings.append(F.when(broken & (effective == "warn"), F.lit(f"review:{r.id}")))
    for p in profiles:
        a = by.get(p.id)
        if not a:
            continue
        _, _, passed = profile_state(p)
        failed = closed(~passed)
        if a.action == "exclude":
            excluded = excluded | failed | passed.isNull()
        if a.action == "penalize":
            penalty = penalty + F.when(failed, F.lit(float(a.penalty))).otherwise(0.0)
        if a.action == "warn":
            warnings.append(F.when(failed, F.lit(f"review:{p.id}")))
    score = F.when(F.col(activity).isNull(), 0.0).otherwise(clip(F.col(activity) - penalty, 0, 1))
    text = F.array_join(F.array_distinct(F.filter(F.array(*warnings), lambda w: w.isNotNull())), ";")
    return df.select(record_id, (~excluded).alias("eligible"), penalty.alias("penalty"), score.alias("priority"), text.alias("warnings"))


def magnitudes(df: DataFrame, profiles: list[Profile], record_id: str = "record_id") -> DataFrame:
    """A row per record and rule: ``criterion, violation (NULL if unknown), lower_excess, upper_excess, magnitude``.

    Excesses are distances beyond the limits, 0 on an absent side; the magnitude is the larger one over the size of its limit.
    """
    rows = []
    for p in profiles:
        for r in p.rules:
            low, high = r.bounds
            v = number(r.descriptor)
            below = F.greatest(F.lit(low) - v, F.lit(0.0)) if low is not None else F.lit(0.0)
            above = F.greatest(v - F.lit(high), F.lit(0.0)) if high is not None else F.lit(0.0)
            worst = F.greatest(below / F.lit(abs(low or 0.0) or 1.0), above / F.lit(abs(high or 0.0) or 1.0))
            known = v.isNotNull()
            rows.append(F.struct(F.lit(f"rule:{p.id}:{r.id}").alias("criterion"), F.when(known, ~r.satisfied()).alias("violation"), F.when(known, below).alias("lower_excess"),
                                 F.when(known, above).alias("upper_excess"), F.when(known, worst).alias("magnitude")))
    return df.select(record_id, F.explode(F.array(*rows)).alias("m")).select(record_id, "m.*")


def criteria(found: DataFrame, record_id: str = "record_id") -> DataFrame:
    """``record_id, failed, unknown``: criteria that fail and that can't be told, sorted, joined by ``;``."""
    pick = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("criterion")))), ";")
    return found.groupBy(record_id).agg(pick(closed(F.col("violation"))).alias("failed"), pick(F.col("violation").isNull()).alias("unknown"))


def alert_ids(hits: DataFrame, record_id: str) -> DataFrame:
    """``record_id, alert_ids``: names of catalogue and alert by their hash, sorted."""
    name = F.substring(F.sha2(F.concat_ws(":", "catalog_id", "alert_name"), 256), 1, 16)
    return hits.groupBy(record_id).agg(F.array_join(F.array_sort(F.collect_set(name)), ";").alias("alert_ids"))


def support_gate(df: DataFrame, molecules: str = "molecules", positives: str = "positives", negatives: str = "negatives", scaffolds: str = "scaffolds", documents: str = "documents") -> Column:
    """Whether enough stands behind a learned action, the rarer class included."""
    rarer = F.least(F.col(positives), F.col(negatives))
    return closed((F.col(molecules) >= LEAST["molecules"]) & (rarer >= LEAST["rarer_class"]) & (F.col(scaffolds) >= LEAST["scaffolds"]) & (F.col(documents) >= LEAST["documents"]))
