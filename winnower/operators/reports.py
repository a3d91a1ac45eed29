"""Reports as tables: summary, selected, excluded, matrices, failures, explanations, hand-off manifests, panels, display layers."""

from __future__ import annotations

import hashlib
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.functions.columns import closed
from winnower.operators.rules import Profile
from winnower.sources.sinks import canonical_json

#: Panel orders, (column, ascending).
PANEL_ORDERS = {"closest": ("margin", True), "most_fragile": ("robustness_score", True), "best_score": ("score", False), "most_borderline": ("borderline_rule_count", False), "front": ("pareto_rank", True)}


def _row(section: str, item: Column | str, value: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), (F.lit(item) if isinstance(item, str) else item).cast("string").alias("item"), value.cast("double").alias("value"))


def summary(decisions: DataFrame, profiles: list[Profile], failures: DataFrame, alerts: DataFrame | None = None, score: str | None = None, policy: dict[str, str] | None = None) -> DataFrame:
    """``section, item, value`` (and ``text`` for the policy): totals, approval, violations by rule, alerts, scores.

    One aggregate over the decisions gives totals, approvals and scores; each long table adds one aggregate of its own.
    """
    cells = [_row("totals", "records", F.count("*")), _row("totals", "selected", F.count_if("selected")), _row("totals", "excluded", F.count_if(F.col("exclusion_reasons") != ""))]
    cells += [_row("approval_percent", p.id, 100 * F.count_if(F.col(f"{p.id}__passed")) / F.nullif(F.count("*"), F.lit(0))) for p in profiles]
    if score:
        for k in range(10):
            low, high = F.lit(k / 10), F.lit((k + 1) / 10)
            inside = (F.col(score) > low) & (F.col(score) <= high) if k else (F.col(score) >= low) & (F.col(score) <= high)
            cells.append(_row("score_histogram", f"{k}", F.count_if(inside)))
    out = decisions.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("a")).select("a.*")
    by_rule = failures.groupBy("profile_id", "rule_id").agg(F.count("*").alias("n"))
    out = out.unionByName(by_rule.select(F.lit("violations").alias("section"), F.concat_ws(".", "profile_id", "rule_id").alias("item"), F.col("n").cast("double").alias("value")))
    if alerts is not None:
        by_alert = alerts.groupBy("catalog_id").agg(F.sum("occurrence_count").alias("n"))
        out = out.unionByName(by_alert.select(F.lit("alerts").alias("section"), F.col("catalog_id").alias("item"), F.col("n").cast("double").alias("value")))
    out = out.withColumn("text", F.lit(None).cast("string"))
    if policy:
        rows = decisions.sparkSession.createDataFrame([("policy", k, None, v) for k, v in sorted(policy.items())], out.schema)
        out = out.unionByName(rows)
    return out


def excluded(decisions: DataFrame, failures: DataFrame, record_id: str = "record_id") -> DataFrame:
    """Records not selected: reasons, failed profiles, failed rules, and the values observed, in order of profile and rule."""
    entry = F.struct("profile_id", "rule_id", F.concat_ws("=", "rule_id", F.call_function("format_number", "observed_value", F.lit("0.###"))).alias("seen"))
    per = failures.groupBy(record_id).agg(F.array_sort(F.collect_list(entry)).alias("_f"))
    out = decisions.where(~F.col("selected")).select(record_id, "exclusion_reasons").join(per, record_id, "left")
    names = lambda f: F.array_join(F.transform("_f", lambda x: x[f]), ", ")
    return out.select(record_id, "exclusion_reasons", F.array_join(F.array_distinct(F.transform("_f", lambda x: x["profile_id"])), ", ").alias("failed_profiles"),
                      names("rule_id").alias("failed_rules"), names("seen").alias("observed"))


def selected_and_reserve(decisions: DataFrame, status: str = "selection_status") -> tuple[DataFrame, DataFrame]:
    """(final records, reserves)."""
    return decisions.where(F.col(status) == "final"), decisions.where(F.col(status) == "reserve")


def profile_matrix(decisions: DataFrame, profiles: list[Profile], record_id: str = "record_id") -> DataFrame:
    """PASS, FAIL or N/A of each record and profile."""
    cell = lambda p: F.when(F.col(f"{p.id}__passed").isNull(), "N/A").when(F.col(f"{p.id}__passed"), "PASS").otherwise("FAIL")
    return decisions.select(record_id, *(cell(p).alias(p.id) for p in profiles))


def failed_profile(decisions: DataFrame, failures: DataFrame, profile: Profile, record_id: str = "record_id") -> DataFrame:
    """Records that fail one profile with their codes, sorted."""
    codes = failures.where(F.col("profile_id") == profile.id).groupBy(record_id).agg(F.array_join(F.array_sort(F.collect_set("failure_code")), ", ").alias("codes"))
    return decisions.where(~F.col(f"{profile.id}__passed")).select(record_id).join(codes, record_id, "left")


def config_rows(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """A nested configuration as ``key, value``: paths joined by dots, leaves as JSON."""

    def leaves(prefix: str, value: Any) -> list[tuple[str, str]]:
        if isinstance(value, dict) and value:
            return [x for k in sorted(value) for x in leaves(f"{prefix}.{k}" if prefix else str(k), value[k])]
        return [(prefix, canonical_json(value))]

    return spark.createDataFrame(leaves("", config), "key string, value string")


def explanations(outcome: DataFrame, record_id: str = "record_id") -> DataFrame:
    """``record_id, verdict, why``: what a selection did with each candidate, in words, from its recorded status and reason."""
    verdict = F.when(F.col("selected"), "selected").otherwise("not selected")
    why = F.when(F.col("selected"), F.concat(F.lit("taken at place "), F.col("position").cast("string"), F.lit(": "), F.col("reason"))).otherwise(F.concat(F.lit("left out: "), F.col("reason")))
    return outcome.select(record_id, verdict.alias("verdict"), why.alias("why"))


def consequences(before: DataFrame, after: DataFrame, record_id: str = "record_id", selected: str = "selected") -> DataFrame:
    """``change, n, text``: records gained, lost and kept by a change, and a sentence on each."""
    a = before.select(record_id, closed(F.col(selected)).alias("_a"))
    b = after.select(record_id, closed(F.col(selected)).alias("_b"))
    both = a.join(b, record_id, "full_outer").select(closed(F.col("_a")).alias("a"), closed(F.col("_b")).alias("b"))
    change = F.when(F.col("a") & F.col("b"), "kept").when(F.col("a"), "lost").when(F.col("b"), "gained")
    out = both.withColumn("change", change).where("change is not null").groupBy("change").agg(F.count("*").alias("n"))
    return out.withColumn("text", F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " record ").otherwise(" records "), F.col("change"), F.lit(" by the change")))


def session_export(outcome: DataFrame, properties: DataFrame, record_id: str = "record_id") -> DataFrame:
    """Decision columns beside the records' properties, in order of position."""
    clash = (set(outcome.columns) & set(properties.columns)) - {record_id}
    return outcome.join(properties.drop(*clash), record_id, "left")


def manifest(outcome: DataFrame, wanted: int, recipe: dict[str, Any], record_id: str = "record_id") -> dict[str, Any]:
    """What a hand-off holds: number, digest of the ids in order, shortfall and recipe.  The ids stay in the table."""
    ids = outcome.where("selected").select(F.col(record_id).cast("string").alias("i"), "position")
    own = ids.select(F.sha2(F.concat_ws(":", "position", "i"), 256).alias("h"))
    parts = own.agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.substring("h", 1, 15), 16, 10).cast("long")).alias("x"), F.sum(F.conv(F.substring("h", 16, 8), 16, 10).cast("long")).alias("s")).first()
    digest = hashlib.sha256(canonical_json([parts["n"], parts["x"], parts["s"]]).encode()).hexdigest()
    return {"count": parts["n"], "digest": digest, "shortfall": max(0, wanted - parts["n"]), "recipe": recipe}


def sort_panel(panel: DataFrame, order: str, record_id: str = "record_id") -> DataFrame:
    """One of the named orders; an order whose column is not there leaves the panel as it is."""
    column, ascending = PANEL_ORDERS[order]
    if column not in panel.columns:
        return panel
    return panel.orderBy(F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column), record_id)


def front_order(fronts: DataFrame, weights: dict[str, float], record_id: str = "record_id") -> list[Column]:
    """Order of selection: front, crowding (widest first), distance to the ideal, weighted sum of the objectives, id."""
    weighted = reduce(lambda a, b: a + b, [F.col(c) * F.lit(float(w)) for c, w in weights.items()], F.lit(0.0))
    return [F.asc_nulls_last("pareto_rank"), F.desc_nulls_last("crowding"), F.asc_nulls_last("ideal_distance"), weighted.desc_nulls_last(), F.asc(record_id)]


def display_layer(points: DataFrame, final: Column, record_id: str, most: int = 20_000, seed: str = "view") -> DataFrame:
    """All final records and as many others, in hash order, as the budget leaves: ``layer`` is final or context."""
    chosen = points.where(closed(final)).withColumn("layer", F.lit("final"))
    left = max(0, most - chosen.count())
    rest = points.where(~closed(final)).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(record_id).cast("string")), 256), record_id).limit(left)
    return chosen.unionByName(rest.withColumn("layer", F.lit("context")))
