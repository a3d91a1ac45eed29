"""Queries on checked joins, contextual evidence, features, trials, reports and constrained selection, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.functions.columns import sign_words
from winnower.operators import decisions, evidence, joining, preparing, reports, rules, selection, tolerance, trials
from winnower.operators.decisions import Alert, Policy
from winnower.operators.evidence import Action
from winnower.plans.screening import FIT, MID, PREMIUM, PROFILES, REC, STATUS, records
from winnower.sources import hexcodec


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet")


# ---- joins


def validated_join(spark: SparkSession, sf: str) -> DataFrame:
    per = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return joining.one_to_one(_customers(spark, sf).select("c_custkey", "c_mktsegment"), per, "c_custkey")


def score_join(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("prediction"))
    events = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("user_id").cast("long").alias("c_custkey")).agg(F.count("*").alias("events"))
    return joining.score_join(_customers(spark, sf).select("c_custkey"), orders, events, "c_custkey")


def analysis_join(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    fronts = r.select("record_id", F.dense_rank().over(_by_kind()).cast("long").alias("pareto_rank")).where("record_id % 3 = 0")
    robust = r.where("size is not null").select("record_id", (F.col("size") / 50).alias("robustness_score"))
    return joining.annotate(r.select("record_id", "brand"), {"fronts": fronts, "robustness": robust}, "record_id")


def _by_kind():
    from pyspark.sql.window import Window

    return Window.partitionBy("kind").orderBy(F.desc("price"))


def context_mask(spark: SparkSession, sf: str) -> DataFrame:
    c = _customers(spark, sf)
    given = joining.context_mask(c, {"c_mktsegment": "BUILDING", "c_nationkey": 7})
    return c.select("c_custkey", given.alias("matches"), joining.context_mask(c, {"species": "human"}).alias("unknown_key"))


def compatible_pool(spark: SparkSession, sf: str) -> DataFrame:
    c = _customers(spark, sf).withColumn("identity", F.col("c_custkey") % 50)
    q = c.select("c_custkey", "identity", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("c_nationkey"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return joining.compatible_pool(q, c, ["c_nationkey", "c_mktsegment"], "c_custkey", "identity", "c_acctbal")


_MASKS = "fit__mask + 8 * premium__mask + 32 * mid__mask"


def joint_pattern(spark: SparkSession, sf: str) -> DataFrame:
    r = rules.evaluate(records(spark, sf), PROFILES).select("record_id", (F.col("fit__mask") + 8 * F.col("premium__mask") + 32 * F.col("mid__mask")).alias("mask"))
    return joining.joint_pattern(r.where("record_id % 2 = 0"), r.where("record_id % 2 = 1"), "mask", "record_id")


def property_deltas(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    pairs = r.where("record_id % 4 = 1").select(F.col("record_id").alias("excluded_id"), (F.col("record_id") + 2).alias("analog_id"))
    return joining.property_deltas(pairs, r, "record_id", ["size", "price"])


# ---- contextual evidence

ACTIONS = [
    Action("priced", "penalize", 0.2), Action("dear", "exclude", learned=True, molecules=40, positives=20, negatives=20, scaffolds=9, documents=4, source="study"),
    Action("small", "exclude", learned=True, molecules=10, positives=5, negatives=5, scaffolds=5, documents=3, source="study"), Action("mid_size", "exclude"), Action("fit", "warn"),
]


def rule_evidence(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf).withColumn("known", F.when(F.col("record_id") % 5 != 0, F.col("record_id") % 2 == 0))
    return evidence.rule_evidence(r, [FIT, PREMIUM, MID], ACTIONS, calibrated=True, in_domain="known")


def profile_states(spark: SparkSession, sf: str) -> DataFrame:
    broken, unknown, passed = evidence.profile_state(FIT)
    return records(spark, sf).select("record_id", broken.alias("violations"), unknown.alias("missing_rules"), passed.alias("passed"))


def contextual_policy(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf).withColumns({"known": F.when(F.col("record_id") % 5 != 0, F.col("record_id") % 2 == 0), "activity": F.when(F.col("record_id") % 7 != 0, (F.col("record_id") % 10) / 10)})
    return evidence.contextual_policy(r, [FIT, PREMIUM, MID], ACTIONS, "activity", calibrated=True, in_domain="known")


def rule_magnitudes(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.magnitudes(records(spark, sf), [FIT, MID])


def failed_criteria(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.criteria(rule_magnitudes(spark, sf))


_ALERTS = [Alert("words", "the", "the"), Alert("words", "ing", "ing "), Alert("marks", "hash", "#")]


def alert_id_sets(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return evidence.alert_ids(decisions.alert_hits(docs, _ALERTS, "text", "doc_id"), "doc_id")


def support_gate(spark: SparkSession, sf: str) -> DataFrame:
    c = _customers(spark, sf).groupBy("c_nationkey").agg(
        F.count("*").alias("molecules"), F.count_if(F.col("c_acctbal") > 5000).alias("positives"), F.count_if(F.col("c_acctbal") <= 5000).alias("negatives"),
        F.count_distinct("c_mktsegment").alias("scaffolds"), F.count_distinct(F.col("c_custkey") % 4).alias("documents"))
    return c.select("c_nationkey", evidence.support_gate(c).alias("supported"))


# ---- features

FEATURES = ["size", "price"]


def scaled_features(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    fitted = preparing.fit_scaling(r.where("record_id % 3 <> 0"), FEATURES, logged=("size",))
    return fitted.transform(r).select("record_id", "z_size", "missing_size", "z_price", "missing_price")


def robust_scales(spark: SparkSession, sf: str) -> DataFrame:
    return preparing.robust_scale(records(spark, sf), FEATURES)


_TREES = [
    {"feature": ["size", "price", None, None, None], "threshold": [20, 940.5, 0, 0, 0], "left": [1, 3, -1, -1, -1], "right": [2, 4, -1, -1, -1], "value": [0, 0, 0.5, -1, 2]},
    {"feature": ["price", None, None], "threshold": [925, 0, 0], "left": [1, -1, -1], "right": [2, -1, -1], "value": [0, 0.25, -0.75]},
]


def tree_scores(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf).withColumn("size", F.coalesce("size", F.lit(0)))
    return r.select("record_id", preparing.tree_scores(_TREES, 0.1, 0.5).alias("score"))


def cross_fitted_rates(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf).select("record_id", "brand", (F.col("record_id") % 5).alias("fold"), (F.col("price") > 950).cast("int").alias("y"))
    return preparing.cross_fitted_rates(r, "fold", "brand", "y").select("record_id", "out_of_fold")


def density_bins(spark: SparkSession, sf: str) -> DataFrame:
    return preparing.density_bins(records(spark, sf), "price", 12)


def nearest_other(spark: SparkSession, sf: str) -> DataFrame:
    sample = records(spark, sf).orderBy(F.sha2(F.concat(F.lit("n:"), F.col("record_id").cast("string")), 256)).limit(300)
    return preparing.nearest_other(sample, "record_id", "brand", [("size", 25.0), ("price", 60.0)], ["kind"])


def domain_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return preparing.domain_threshold(nearest_other(spark, sf))


def hex_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", sign_words().alias("words"))
    coded = v.select("vec_id", hexcodec.encode(F.col("words"), 2).alias("hex"))
    return coded.select("vec_id", "hex", hexcodec.decode(F.col("hex"), 2).alias("words")).select("vec_id", "hex", F.col("words")[0].alias("w0"), F.col("words")[1].alias("w1"))


# ---- trials


def record_status(spark: SparkSession, sf: str) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_quantity")).cast("array<string>"), ";").alias("values"))
    values = trials.constituents(F.col("values"))
    label = F.when(F.col("l_orderkey") % 4 != 0, (F.col("l_orderkey") % 2).cast("int"))
    return li.select("l_orderkey", trials.record_status(values, label, 25.0).alias("status"))


def hash_roles(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf).select("record_id", F.when(F.col("record_id") % 6 != 0, F.col("kind")).alias("scaffold"), (F.col("record_id") % 97 == 0).alias("exposed"))
    r = r.withColumn("scaffold", F.coalesce("scaffold", F.lit("")))
    return trials.assign_roles(r, "scaffold", "record_id", "exposed").select("record_id", "role")


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    status = F.when(F.col("l_quantity") >= 25, "positive").when(F.col("l_quantity") < 3, "below_threshold").when(F.col("l_quantity") == 10, "conflicting_constituents").otherwise("unknown")
    return li.select(F.col("l_partkey").alias("identity"), F.col("l_suppkey").alias("task"), status.alias("status"), F.col("l_extendedprice").alias("value"), F.col("l_orderkey").alias("ident"), F.col("l_returnflag").alias("document"))


def collapsed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return trials.collapse_pairs(_observed(spark, sf), ["identity", "task"], "status", "value", "ident", "document")[0].select("identity", "task", "value", "documents")


def conflicting_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return trials.collapse_pairs(_observed(spark, sf), ["identity", "task"], "status", "value", "ident", "document")[1].select("identity", "task", "status", "ident")


def masked_labels(spark: SparkSession, sf: str) -> DataFrame:
    o = _observed(spark, sf)
    labels = o.select("identity", "task").distinct().withColumns({"label": (F.col("identity") % 2).cast("int"), "split": F.when(F.col("identity") % 3 == 0, "test").otherwise("train")})
    return trials.masked_labels(labels, o, ["identity", "task"], "label", "status", "split").select("identity", "task", "label")


def _trial(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    return r.select(
        "record_id", "brand", F.coalesce("kind", F.lit("")).alias("kind"), (F.col("price") > 950).alias("base"), ((F.col("price") > 950) | (F.col("record_id") % 7 == 0)).alias("accepted"),
        F.when(F.col("record_id") % 11 != 0, (F.col("record_id") % 3 == 0).cast("int")).alias("y"), F.col("price").alias("s1"), (F.col("record_id") % 101).alias("s2"),
        (F.col("record_id") % 2 == 0).alias("ok1"), (F.col("record_id") % 5 != 0).alias("ok2"),
    )


def retention_metrics(spark: SparkSession, sf: str) -> DataFrame:
    t = _trial(spark, sf)
    return trials.filter_metrics(t, "base", "accepted", "y", "kind", t.where("record_id % 20 = 0"))


def activity_recovery(spark: SparkSession, sf: str) -> DataFrame:
    return trials.activity_metrics(_trial(spark, sf), "accepted", "y")


def equal_capacity(spark: SparkSession, sf: str) -> DataFrame:
    return trials.equal_capacity(_trial(spark, sf), "base", ("s1", "ok1"), ("s2", "ok2"), "y", "record_id", 0.2)


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    t = _trial(spark, sf)
    return trials.evaluate_arms(t, {"price": F.col("s1"), "mod": F.col("s2").cast("double")}, {"all": F.lit(True), "ok": F.col("ok1")}, [20, 60], [None, 2], "brand", "y", "record_id")


def arm_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, sf)


def paired_arms(spark: SparkSession, sf: str) -> DataFrame:
    return trials.paired_comparison(_grid(spark, sf), "price")


def strategy_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    by_price = lambda d: d.orderBy(F.desc("price"), "record_id").limit(80)
    spread = lambda d: selection.per_group(d, "brand", 4, [F.desc("price")]).orderBy(F.desc("price"), "record_id").limit(80)
    chance = lambda d: d.orderBy(F.sha2(F.concat(F.lit("r:"), F.col("record_id").cast("string")), 256)).limit(80)
    return trials.run_benchmark(records(spark, sf), {"price": by_price, "spread": spread, "chance": chance}, "record_id", "price")


def tolerance_predict(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    m = evidence.magnitudes(r, [FIT, MID]).join(r.select("record_id", "kind", "brand", "price"), "record_id")
    refs = m.where("record_id % 2 = 1 and price > 910 and violation").withColumn("w", F.lit(1.0))
    curves, supports = tolerance.fit_profile(refs, "record_id", "kind", "brand", "w")
    return tolerance.predict_profile(m.where("record_id % 2 = 0"), curves, supports, 0.85)


def exact_positives(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("relation", F.when(F.col("event_id") % 5 != 0, "=").otherwise(">"))
    return tolerance.exact_positives(e, "user_id", "event_type", "value", "relation", 20.0)


_SIGMOIDS = {"size": (0.1, 2.0, 25.0, 10.0, 3.0, 5.0, 1.9), "price": (0.05, 1.5, 950.0, 40.0, 12.0, 9.0, 1.4)}


def likeness(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("record_id", tolerance.likeness(_SIGMOIDS).alias("likeness"))


def group_splits(spark: SparkSession, sf: str) -> DataFrame:
    return trials.assign_splits(_customers(spark, sf).select("c_custkey", "c_nationkey"), "c_nationkey").select("c_custkey", "split")


def dated_splits(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    return trials.assign_splits(o, "o_custkey", date="day").select("o_orderkey", "split")


# ---- reports


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.decide(rules.evaluate(records(spark, sf), PROFILES), Policy(roles={"fit": "mandatory", "mid": "mandatory"}))


def report_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.summary(_decided(spark, sf), PROFILES, rules.failures(records(spark, sf), PROFILES), policy={"mode": "mandatory"})


def report_excluded(spark: SparkSession, sf: str) -> DataFrame:
    return reports.excluded(_decided(spark, sf), rules.failures(records(spark, sf), PROFILES)).select("record_id", "exclusion_reasons", "failed_profiles", "failed_rules")


def report_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return reports.profile_matrix(_decided(spark, sf), PROFILES)


def report_failed_profile(spark: SparkSession, sf: str) -> DataFrame:
    return reports.failed_profile(_decided(spark, sf), rules.failures(records(spark, sf), PROFILES), FIT)


def report_config(spark: SparkSession, sf: str) -> DataFrame:
    return reports.config_rows(spark, {"rules": {"size": 40, "tags": ["a", "b"]}, "mode": "strict"})


def report_consequences(spark: SparkSession, sf: str) -> DataFrame:
    before = _decided(spark, sf)
    return reports.consequences(before, before.withColumn("selected", F.col("fit__passed") & (F.col("price") > 930)))


def display_layer(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    return reports.display_layer(r, F.col("price") > 985, "record_id", 150).select("record_id", "layer")


# ---- selection


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    return r.select("record_id", (F.col("record_id") % 4).alias("pareto_rank"), F.col("price").alias("crowding_distance"), F.col("size").alias("robustness_score"),
                    F.when(F.col("record_id") % 9 != 0, F.col("brand")).alias("murcko_scaffold"))


def constrained_selection(spark: SparkSession, sf: str) -> DataFrame:
    c = _candidates(spark, sf)
    pins, out = c.where("record_id in (5, 17, 30, 55)"), c.where("record_id in (3, 8, 55)")
    got = selection.constrained_selection(c, 40, "balanced", most=2, least_groups=18, pinned=pins, excluded=out)
    return got.select("record_id", "selected", "position", "reason")


def coverage_selection(spark: SparkSession, sf: str) -> DataFrame:
    return selection.constrained_selection(_candidates(spark, sf), 35, "scaffold_coverage", most=3).where("selected").select("record_id", "position", "reason")


def priority_selection(spark: SparkSession, sf: str) -> DataFrame:
    c = _candidates(spark, sf).withColumns({"eligible": F.col("record_id") % 3 != 0, "valid": F.lit(True), "priority_score": F.col("crowding_distance"), "identity": F.col("record_id")})
    return selection.select_priority(c, 30, most=1).where("selected").select("record_id", "position")


_SEL = f"""{REC}, c AS (SELECT record_id, record_id % 4 AS pareto_rank, price AS crowding_distance, size AS robustness_score, CASE WHEN record_id % 9 <> 0 THEN brand END AS g FROM rec)"""
_BAL = "pareto_rank, crowding_distance DESC, robustness_score DESC NULLS LAST, record_id"

QUERIES = {
    f.__name__: f
    for f in (
        validated_join, score_join, analysis_join, context_mask, compatible_pool, joint_pattern, property_deltas, rule_evidence, profile_states, contextual_policy, rule_magnitudes,
        failed_criteria, alert_id_sets, support_gate, scaled_features, robust_scales, tree_scores, cross_fitted_rates, density_bins, nearest_other, domain_threshold, hex_fingerprints,
        record_status, hash_roles, collapsed_pairs, conflicting_pairs, masked_labels, retention_metrics, activity_recovery, equal_capacity, arm_grid, paired_arms, strategy_benchmark,
        tolerance_predict, exact_positives, likeness, group_splits, dated_splits,
        report_summary, report_excluded, report_matrix, report_failed_profile, report_config, report_consequences, display_layer, constrained_selection, coverage_selection,
        priority_selection,
    )
}

# rules of the profiles: profile, rule, value, holds, lower and upper limit
_RULES = [
    ("fit", "small", "size", "ok_small", None, 40), ("fit", "priced", "price", "ok_priced", 905, 985), ("fit", "not_tiny", "size", "ok_not_tiny", 3, None),
    ("premium", "dear", "price", "ok_dear", 950, None), ("premium", "soft_size", "size", "ok_soft_size", None, 25), ("mid", "mid_size", "size", "ok_mid_size", 10, 35),
]


def _excess(v: str, low: float | None, high: float | None) -> str:
    sides = ["0"] + ([f"({low} - {v}) / {low}.0"] if low is not None else []) + ([f"({v} - {high}) / {high}.0"] if high is not None else [])
    return f"CASE WHEN {v} IS NOT NULL THEN greatest({', '.join(sides)})::DOUBLE END"


_DOMAIN = "(record_id % 5 <> 0 AND record_id % 2 = 0)"
_EFFECT = {"priced": "'penalize'", "dear": f"CASE WHEN {_DOMAIN} THEN 'exclude' ELSE 'warn' END", "small": "'warn'", "mid_size": "'exclude'"}
_SUPPORT = {"dear": "true", "small": "false"}
_EVIDENCE = " UNION ALL ".join(
    f"SELECT record_id, '{p}' AS profile_id, '{r}' AS rule_id, {v}::DOUBLE AS observed, CASE WHEN {v} IS NOT NULL THEN NOT {ok} END AS violated, {_excess(v, lo, hi)} AS normalized_excess, "
    f"{_EFFECT.get(r, chr(39) + 'inform' + chr(39))} AS effective_action, {_SUPPORT.get(r, 'NULL')}::BOOLEAN AS supported FROM f"
    for p, r, v, ok, lo, hi in _RULES
)


def _side(v: str, lim: float | None, low: bool) -> str:
    return "0.0::DOUBLE" if lim is None else f"greatest({lim} - {v}, 0)::DOUBLE" if low else f"greatest({v} - {lim}, 0)::DOUBLE"


_MAGNITUDES = " UNION ALL ".join(
    f"SELECT record_id, 'rule:{p}:{r}' AS criterion, CASE WHEN {v} IS NOT NULL THEN NOT {ok} END AS violation, CASE WHEN {v} IS NOT NULL THEN {_side(v, lo, True)} END AS lower_excess, "
    f"CASE WHEN {v} IS NOT NULL THEN {_side(v, hi, False)} END AS upper_excess, CASE WHEN {v} IS NOT NULL THEN greatest({_side(v, lo, True)} / {lo or 1}, {_side(v, hi, False)} / {hi or 1}) END AS magnitude FROM f"
    for p, r, v, ok, lo, hi in _RULES
    if p != "premium"
)
_FAILED = "string_agg(criterion, ';' ORDER BY criterion)"
_OBS = """o AS (SELECT l_partkey AS identity, l_suppkey AS task, CASE WHEN l_quantity >= 25 THEN 'positive' WHEN l_quantity < 3 THEN 'below_threshold' WHEN l_quantity = 10 THEN 'conflicting_constituents' ELSE 'unknown' END AS status,
  l_extendedprice AS value, l_orderkey AS ident, l_returnflag AS document FROM lineitem),
bad AS (SELECT identity, task FROM o GROUP BY ALL HAVING bool_or(status = 'conflicting_constituents') OR (bool_or(status = 'positive') AND bool_or(status = 'below_threshold')))"""
_TRIAL = f"""{REC}, t AS (SELECT record_id, brand, coalesce(kind, '') AS kind, price > 950 AS base, price > 950 OR record_id % 7 = 0 AS accepted, CASE WHEN record_id % 11 <> 0 THEN (record_id % 3 = 0)::INT END AS y,
  price AS s1, record_id % 101 AS s2, record_id % 2 = 0 AS ok1, record_id % 5 <> 0 AS ok2 FROM rec)"""
_HASH = "sha256(record_id::VARCHAR)"
_GRID = f"""{_TRIAL}, cells AS (SELECT 'price' AS arm, 'all' AS policy, s1 AS s, * FROM t UNION ALL SELECT 'price', 'ok', s1, * FROM t WHERE ok1 UNION ALL SELECT 'mod', 'all', s2::DOUBLE, * FROM t UNION ALL SELECT 'mod', 'ok', s2::DOUBLE, * FROM t WHERE ok1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY arm, policy, brand ORDER BY s DESC, record_id) AS g FROM cells),
widened AS (SELECT NULL::BIGINT AS quota, * FROM ranked UNION ALL SELECT 2, * FROM ranked WHERE g <= 2),
cut AS (SELECT *, row_number() OVER (PARTITION BY arm, policy, quota ORDER BY s DESC, record_id) AS r FROM widened),
grid AS (SELECT arm, policy, quota, b AS budget, count(*) FILTER (r <= b) AS taken, count(*) FILTER (r <= b AND y = 1) AS hits FROM cut, (VALUES (20::BIGINT), (60::BIGINT)) AS v(b) GROUP BY ALL)"""
_DECIDED = f"""{STATUS}, dec AS (SELECT *, fit__passed AND mid__passed AS selected,
  concat_ws('; ', CASE WHEN NOT fit__passed THEN 'failed profile fit' END, CASE WHEN NOT mid__passed THEN 'failed profile mid' END) AS exclusion_reasons FROM v)"""
_FAILROWS = " UNION ALL ".join(f"SELECT record_id, '{p}' AS profile_id, '{r}' AS rule_id, '{'TINY' if r == 'not_tiny' else r.upper()}' AS code FROM f WHERE NOT {ok}" for p, r, v, ok, lo, hi in _RULES)
_NEAR = """smp AS (SELECT * FROM rec ORDER BY sha256('n:' || record_id::VARCHAR) LIMIT 300),
nd AS (SELECT a.record_id, min(0.5 * sqrt((coalesce(power((a.size - b.size) / 25.0, 2), 1) + power((a.price - b.price) / 60.0, 2)) / 2) + 0.5 * coalesce((a.kind <> b.kind)::INT, 1)) AS distance
  FROM smp a JOIN smp b ON a.brand <> b.brand GROUP BY a.record_id)"""
_HEXW = "list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[32 * {w} + i + 1] > 0 THEN (1::BIGINT << i) ELSE 0 END))::BIGINT"
_SELECTED = """n AS (SELECT *, record_id IN (5, 17, 30) AS pin FROM c WHERE record_id NOT IN (3, 8, 55)),
r AS (SELECT *, CASE WHEN g IS NOT NULL THEN row_number() OVER (PARTITION BY g ORDER BY pin DESC, {o}) END AS r FROM n),
cov AS (SELECT record_id FROM r WHERE r = 1 AND NOT pin AND g NOT IN (SELECT g FROM r WHERE pin AND g IS NOT NULL) ORDER BY {o} LIMIT greatest(0, 18 - (SELECT count(DISTINCT g) FROM r WHERE pin))),
k AS (SELECT *, CASE WHEN pin THEN 0 WHEN record_id IN (FROM cov) THEN 1 ELSE 2 END AS tier, pin OR g IS NULL OR r <= 2 AS fits FROM r),
p AS (SELECT record_id, row_number() OVER (ORDER BY tier, CASE WHEN pin THEN record_id END, {o}) AS position FROM k WHERE fits)"""

_CUT = "CASE WHEN x < 0.7 THEN 'train' WHEN x < 0.8 THEN 'validation' WHEN x < 0.9 THEN 'calibration' ELSE 'test' END"
_ADS = "({0} + {1} * (1 / (1 + exp(-({v} - {2} + {3} / 2) / {4}))) * (1 - 1 / (1 + exp(-({v} - {2} - {3} / 2) / {5})))) / {6}"
_LIKE = f"k AS (SELECT record_id, {_ADS.format(*_SIGMOIDS['size'], v='size')} AS s, {_ADS.format(*_SIGMOIDS['price'], v='price')} AS p FROM rec)"

ORACLE = {
    "validated_join": "SELECT c_custkey, c_mktsegment, orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "score_join": """SELECT c_custkey, prediction, events FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS prediction FROM orders GROUP BY 1) ON o_custkey = c_custkey
      LEFT JOIN (SELECT user_id, count(*) AS events FROM events GROUP BY 1) ON user_id = c_custkey""",
    "analysis_join": f"""WITH {REC}, x AS (SELECT record_id, dense_rank() OVER (PARTITION BY kind ORDER BY price DESC) AS pr FROM rec)
      SELECT record_id, brand, CASE WHEN record_id % 3 = 0 THEN pr END::BIGINT AS pareto_rank, size / 50 AS robustness_score FROM rec JOIN x USING (record_id)""",
    "context_mask": "SELECT c_custkey, c_mktsegment = 'BUILDING' AND c_nationkey = 7 AS matches, false AS unknown_key FROM customer",
    "compatible_pool": """WITH q AS (SELECT c_custkey, c_custkey % 50 AS i, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS n, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS m FROM customer)
      SELECT q.c_custkey, count(r.c_acctbal) AS n, avg(r.c_acctbal) AS mean FROM q LEFT JOIN customer r ON (q.n IS NULL OR q.n = r.c_nationkey) AND (q.m IS NULL OR q.m = r.c_mktsegment) AND r.c_custkey % 50 <> q.i GROUP BY q.c_custkey""",
    "joint_pattern": f"""WITH {STATUS}, m AS (SELECT record_id, (NOT ok_small)::BIGINT + 2 * (NOT ok_priced)::BIGINT + 4 * (NOT ok_not_tiny)::BIGINT + 8 * (NOT ok_dear)::BIGINT + 16 * (NOT ok_soft_size)::BIGINT + 32 * (NOT ok_mid_size)::BIGINT AS k FROM v)
      SELECT a.record_id, count(b.record_id) AS n FROM m a LEFT JOIN m b ON b.record_id % 2 = 1 AND (a.k & b.k) = a.k WHERE a.record_id % 2 = 0 GROUP BY a.record_id""",
    "property_deltas": f"""WITH {REC}, d AS (SELECT a.record_id AS excluded_id, b.record_id AS analog_id, b.size - a.size AS s, b.price - a.price AS p FROM rec a JOIN rec b ON b.record_id = a.record_id + 2 WHERE a.record_id % 4 = 1)
      SELECT excluded_id, analog_id, 'size' AS property, s::DOUBLE AS delta FROM d WHERE s IS NOT NULL UNION ALL SELECT excluded_id, analog_id, 'price', p FROM d WHERE p IS NOT NULL""",
    "rule_evidence": f"WITH {STATUS} {_EVIDENCE}",
    "profile_states": f"""WITH {STATUS}, k AS (SELECT record_id, (size > 40)::BIGINT AS a, (NOT ok_priced)::BIGINT AS b, (size <= 3)::BIGINT AS c, CASE WHEN size IS NULL THEN 2 ELSE 0 END::BIGINT AS u FROM v)
      SELECT record_id, coalesce(a, 0) + b + coalesce(c, 0) AS violations, u AS missing_rules, CASE WHEN coalesce(a, 0) + b + coalesce(c, 0) > 1 THEN false WHEN u > 0 THEN NULL ELSE true END AS passed FROM k""",
    "contextual_policy": f"""WITH {STATUS}, x AS (SELECT *, CASE WHEN record_id % 7 <> 0 THEN (record_id % 10) / 10.0 END AS act, {_DOMAIN} AS dom, size IS NOT NULL AS known,
      CASE WHEN coalesce((size > 40)::INT, 0) + (NOT ok_priced)::INT + coalesce((size <= 3)::INT, 0) > 1 THEN true ELSE false END AS fitfail FROM v)
      SELECT record_id, NOT ((NOT ok_dear AND dom) OR (known AND NOT ok_mid_size) OR NOT known) AS eligible, CASE WHEN NOT ok_priced THEN 0.2 ELSE 0.0 END::DOUBLE AS penalty,
      CASE WHEN act IS NULL THEN 0.0 ELSE greatest(0, least(1, act - CASE WHEN NOT ok_priced THEN 0.2 ELSE 0 END)) END::DOUBLE AS priority,
      concat_ws(';', CASE WHEN act IS NULL THEN 'activity_unknown' END, CASE WHEN NOT known THEN 'descriptor_missing:size' END, CASE WHEN known AND NOT ok_small THEN 'review:small' END,
        CASE WHEN NOT ok_dear AND NOT dom THEN 'review:dear' END, CASE WHEN fitfail THEN 'review:fit' END) AS warnings FROM x""",
    "rule_magnitudes": f"WITH {STATUS} {_MAGNITUDES}",
    "failed_criteria": f"WITH {STATUS}, m AS ({_MAGNITUDES}) SELECT record_id, coalesce({_FAILED} FILTER (violation), '') AS failed, coalesce({_FAILED} FILTER (violation IS NULL), '') AS unknown FROM m GROUP BY record_id",
    "alert_id_sets": """WITH h AS (SELECT doc_id, unnest(list_filter([CASE WHEN contains(text, 'the') THEN 'words:the' END, CASE WHEN contains(text, 'ing ') THEN 'words:ing' END, CASE WHEN contains(text, '#') THEN 'marks:hash' END], lambda x: x IS NOT NULL)) AS a FROM documents)
      SELECT doc_id, string_agg(sha256(a)[1:16], ';' ORDER BY sha256(a)[1:16]) AS alert_ids FROM h GROUP BY doc_id""",
    "support_gate": """SELECT c_nationkey, count(*) >= 20 AND least(count(*) FILTER (c_acctbal > 5000), count(*) FILTER (c_acctbal <= 5000)) >= 5 AND count(DISTINCT c_mktsegment) >= 5 AND count(DISTINCT c_custkey % 4) >= 3 AS supported
      FROM customer GROUP BY c_nationkey""",
    "scaled_features": f"""WITH {REC}, w AS (SELECT record_id, ln(1 + size::DOUBLE) AS s, price AS p FROM rec), md AS (SELECT quantile_cont(s, 0.5) AS ms, quantile_cont(p, 0.5) AS mp FROM w WHERE record_id % 3 <> 0),
      f AS (SELECT avg(coalesce(s, ms)) AS a, stddev_pop(coalesce(s, ms)) AS b, avg(coalesce(p, mp)) AS c, stddev_pop(coalesce(p, mp)) AS d, any_value(ms) AS ms, any_value(mp) AS mp FROM w, md WHERE record_id % 3 <> 0)
      SELECT record_id, (coalesce(s, ms) - a) / b AS z_size, (s IS NULL)::INT AS missing_size, (coalesce(p, mp) - c) / d AS z_price, (p IS NULL)::INT AS missing_price FROM w, f""",
    "robust_scales": f"""WITH {REC}, x AS (SELECT 'size' AS feature, size::DOUBLE AS v FROM rec UNION ALL SELECT 'price', price FROM rec)
      SELECT feature, quantile_cont(v, 0.5) AS center, CASE WHEN quantile_cont(v, 0.75) > quantile_cont(v, 0.25) THEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25) ELSE 1 END AS spread FROM x GROUP BY feature""",
    "tree_scores": f"""WITH {REC} SELECT record_id, 0.1 + 0.5 * CASE WHEN coalesce(size, 0) <= 20 THEN CASE WHEN price::FLOAT <= 940.5::FLOAT THEN -1 ELSE 2 END ELSE 0.5 END + 0.5 * CASE WHEN price::FLOAT <= 925::FLOAT THEN 0.25 ELSE -0.75 END AS score FROM rec""",
    "cross_fitted_rates": f"""WITH {REC}, r AS (SELECT record_id, brand, record_id % 5 AS fold, (price > 950)::INT AS y FROM rec), b AS (SELECT f.fold, avg(r.y) AS base FROM (SELECT DISTINCT fold FROM r) f JOIN r ON r.fold <> f.fold GROUP BY 1),
      g AS (SELECT k.brand, k.fold, count(r.y) AS n, coalesce(sum(r.y), 0) AS p FROM (SELECT DISTINCT brand, fold FROM r) k LEFT JOIN r ON r.brand = k.brand AND r.fold <> k.fold GROUP BY 1, 2)
      SELECT record_id, (p + 10 * base) / (n + 10) AS out_of_fold FROM r JOIN g USING (brand, fold) JOIN b USING (fold)""",
    "density_bins": f"""WITH {REC}, e AS (SELECT min(price) AS lo, max(price) AS hi FROM rec), c AS (SELECT least(floor((price - lo) / (hi - lo) * 12), 11)::BIGINT AS bin, count(*) AS n FROM rec, e GROUP BY 1)
      SELECT bin, n / (SELECT max(n) FROM c) AS height FROM c""",
    "nearest_other": f"WITH {REC}, {_NEAR} SELECT * FROM nd",
    "domain_threshold": f"WITH {REC}, {_NEAR} SELECT quantile_cont(distance, 0.99) AS threshold FROM nd",
    "hex_fingerprints": f"""WITH w AS (SELECT vec_id, {_HEXW.format(w=0)} AS w0, {_HEXW.format(w=1)} AS w1 FROM embeddings)
      SELECT vec_id, lower(lpad(to_hex(w0), 8, '0') || lpad(to_hex(w1), 8, '0')) AS hex, w0, w1 FROM w""",
    "record_status": """SELECT l_orderkey, CASE WHEN min(l_quantity) < 25 AND max(l_quantity) >= 25 THEN 'conflicting_constituents' WHEN l_orderkey % 4 = 0 THEN 'unknown' WHEN l_orderkey % 2 = 1 THEN 'positive' ELSE 'below_threshold' END AS status
      FROM lineitem GROUP BY l_orderkey""",
    "hash_roles": f"""WITH {REC}, g AS (SELECT record_id, CASE WHEN record_id % 6 <> 0 AND kind IS NOT NULL AND kind <> '' THEN 'group:' || kind ELSE 'identity:' || record_id::VARCHAR END AS k, record_id % 97 = 0 AS e FROM rec),
      h AS (SELECT k, bool_or(e) AS e, ('0x' || sha256('20:' || k)[1:13])::BIGINT / 4503599627370496.0 AS x FROM g GROUP BY k)
      SELECT record_id, CASE WHEN h.e THEN CASE WHEN x < 0.6 / 0.85 THEN 'fit' WHEN x < 0.75 / 0.85 THEN 'tune' ELSE 'policy_cal' END WHEN x < 0.6 THEN 'fit' WHEN x < 0.75 THEN 'tune' WHEN x < 0.85 THEN 'policy_cal' ELSE 'test' END AS role
      FROM g JOIN h USING (k)""",
    "collapsed_pairs": f"""WITH {_OBS} SELECT identity, task, quantile_cont(value, 0.5) AS value, string_agg(DISTINCT document, ';' ORDER BY document) AS documents FROM o ANTI JOIN bad USING (identity, task) WHERE status = 'positive' GROUP BY ALL""",
    "conflicting_pairs": f"WITH {_OBS} SELECT identity, task, status, ident FROM o SEMI JOIN bad USING (identity, task)",
    "masked_labels": f"""WITH {_OBS}, x AS (SELECT identity, task, bool_or(status = 'conflicting_constituents') AS c FROM o GROUP BY ALL)
      SELECT identity, task, CASE WHEN c AND identity % 3 <> 0 THEN NULL ELSE (identity % 2)::INT END AS label FROM x""",
    "retention_metrics": f"""WITH {_TRIAL}, m AS (SELECT *, coalesce(y = 1, false) AS pos, kind IN (SELECT kind FROM t WHERE record_id % 20 = 0) AS old FROM t),
      s AS (SELECT count(*) AS records, count(*) FILTER (base) AS baseline, count(*) FILTER (accepted) AS eligible, count(*) FILTER (accepted AND NOT base) AS rescued, count(*) FILTER (pos) AS actives, count(*) FILTER (pos AND NOT base) AS actives_outside,
      count(*) FILTER (pos AND accepted) AS actives_retained, count(*) FILTER (pos AND accepted AND NOT base) AS actives_rescued, count(*) FILTER (y IS NULL) AS unknown, count(*) FILTER (y IS NULL AND accepted AND NOT base) AS unknown_rescued,
      count(DISTINCT kind) FILTER (pos AND kind <> '') AS active_groups, count(DISTINCT kind) FILTER (pos AND accepted AND kind <> '') AS active_groups_retained, count(DISTINCT kind) FILTER (pos AND NOT old AND kind <> '') AS novel_groups,
      count(DISTINCT kind) FILTER (pos AND accepted AND NOT old AND kind <> '') AS novel_groups_retained FROM m)
      SELECT *, actives_retained / nullif(actives, 0) AS retention, actives_rescued / nullif(actives_outside, 0) AS rescue_retention, active_groups_retained / nullif(active_groups, 0) AS group_retention, 1 - eligible / nullif(records, 0) AS reduction FROM s""",
    "activity_recovery": f"""WITH {_TRIAL}, s AS (SELECT count(*) FILTER (y = 1) AS active_pool, count(*) FILTER (accepted AND y = 1) AS active_selected, count(*) FILTER (accepted AND y = 0) AS inactive_selected, count(*) FILTER (accepted AND y IS NULL) AS unknown_selected FROM t)
      SELECT *, active_selected / nullif(active_pool, 0) AS recovery FROM s""",
    "equal_capacity": f"""WITH {_TRIAL}, o AS (SELECT * FROM t WHERE NOT base), b AS (SELECT least(floor(0.2 * count(*)), count(*) FILTER (ok1), count(*) FILTER (ok2)) AS b FROM o),
      r AS (SELECT 'left' AS arm, row_number() OVER (ORDER BY s1, {_HASH}, record_id) AS r, y FROM o WHERE ok1 UNION ALL SELECT 'right', row_number() OVER (ORDER BY s2, {_HASH}, record_id), y FROM o WHERE ok2)
      SELECT arm, count(*) AS rescued, count(*) FILTER (y = 1) AS actives_rescued FROM r, b WHERE r <= b GROUP BY arm""",
    "arm_grid": f"WITH {_GRID} SELECT * FROM grid",
    "paired_arms": f"WITH {_GRID} SELECT a.arm, a.policy, a.budget, a.quota, a.hits - b.hits AS difference FROM grid a JOIN grid b ON a.policy = b.policy AND a.budget = b.budget AND a.quota IS NOT DISTINCT FROM b.quota WHERE a.arm = 'mod' AND b.arm = 'price'",
    "strategy_benchmark": f"""WITH {REC}, a AS (SELECT record_id FROM rec ORDER BY price DESC, record_id LIMIT 80), g AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY price DESC, record_id) AS r FROM rec),
      b AS (SELECT record_id FROM g WHERE r <= 4 ORDER BY price DESC, record_id LIMIT 80), c AS (SELECT record_id FROM rec ORDER BY sha256('r:' || record_id::VARCHAR) LIMIT 80),
      x AS (SELECT 'price' AS run, * FROM a UNION ALL SELECT 'spread', * FROM b UNION ALL SELECT 'chance', * FROM c),
      s AS (SELECT run, count(*) FILTER (record_id IN (FROM a)) AS common, count(*) + (SELECT count(*) FROM a) - count(*) FILTER (record_id IN (FROM a)) AS either FROM x GROUP BY run) SELECT run, common, either, common / nullif(either, 0) AS jaccard FROM s""",
    "report_summary": f"""WITH {_DECIDED}, fr AS ({_FAILROWS}) SELECT 'totals' AS section, 'records' AS item, count(*)::DOUBLE AS value, NULL::VARCHAR AS text FROM dec UNION ALL SELECT 'totals', 'selected', count(*) FILTER (selected), NULL FROM dec
      UNION ALL SELECT 'totals', 'excluded', count(*) FILTER (exclusion_reasons <> ''), NULL FROM dec UNION ALL SELECT 'approval_percent', 'fit', 100 * count(*) FILTER (fit__passed) / count(*), NULL FROM dec
      UNION ALL SELECT 'approval_percent', 'premium', 100 * count(*) FILTER (premium__passed) / count(*), NULL FROM dec UNION ALL SELECT 'approval_percent', 'mid', 100 * count(*) FILTER (mid__passed) / count(*), NULL FROM dec
      UNION ALL SELECT 'violations', profile_id || '.' || rule_id, count(*), NULL FROM fr GROUP BY profile_id, rule_id UNION ALL SELECT 'policy', 'mode', NULL, 'mandatory'""",
    "report_excluded": f"""WITH {_DECIDED}, fr AS ({_FAILROWS}), p AS (SELECT record_id, string_agg(rule_id, ', ' ORDER BY profile_id, rule_id) AS failed_rules, string_agg(DISTINCT profile_id, ', ' ORDER BY profile_id) AS failed_profiles FROM fr GROUP BY record_id)
      SELECT record_id, exclusion_reasons, failed_profiles, failed_rules FROM dec LEFT JOIN p USING (record_id) WHERE NOT selected""",
    "report_matrix": f"WITH {STATUS} SELECT record_id, CASE WHEN fit__passed THEN 'PASS' ELSE 'FAIL' END AS fit, CASE WHEN premium__passed THEN 'PASS' ELSE 'FAIL' END AS premium, CASE WHEN mid__passed THEN 'PASS' ELSE 'FAIL' END AS mid FROM v",
    "report_failed_profile": f"""WITH {STATUS}, fr AS ({_FAILROWS}) SELECT record_id, string_agg(code, ', ' ORDER BY code) AS codes FROM v JOIN fr USING (record_id) WHERE NOT fit__passed AND profile_id = 'fit' GROUP BY record_id""",
    "report_config": """SELECT * FROM (VALUES ('mode', '"strict"'), ('rules.size', '40'), ('rules.tags', '["a","b"]')) AS t(key, value)""",
    "report_consequences": f"""WITH {_DECIDED}, x AS (SELECT CASE WHEN selected AND fit__passed AND price > 930 THEN 'kept' WHEN selected THEN 'lost' WHEN fit__passed AND price > 930 THEN 'gained' END AS change FROM dec)
      SELECT change, count(*) AS n, count(*) || CASE WHEN count(*) = 1 THEN ' record ' ELSE ' records ' END || change || ' by the change' AS text FROM x WHERE change IS NOT NULL GROUP BY change""",
    "display_layer": f"""WITH {REC}, f AS (SELECT record_id FROM rec WHERE price > 985), r AS (SELECT record_id, row_number() OVER (ORDER BY sha256('view:' || record_id::VARCHAR), record_id) AS k FROM rec WHERE price <= 985)
      SELECT record_id, 'final' AS layer FROM f UNION ALL SELECT record_id, 'context' FROM r WHERE k <= greatest(0, 150 - (SELECT count(*) FROM f))""",
    "constrained_selection": f"""WITH {_SEL}, {_SELECTED.format(o=_BAL)}
      SELECT record_id, coalesce(position <= 40, false) AS selected, CASE WHEN position <= 40 THEN position END AS position,
      CASE WHEN position <= 40 THEN CASE tier WHEN 0 THEN 'pinned' WHEN 1 THEN 'covers a group' ELSE 'strategy order' END WHEN NOT fits THEN 'group quota' ELSE 'number reached' END AS reason FROM k LEFT JOIN p USING (record_id)""",
    "coverage_selection": f"""WITH {_SEL}, z AS (SELECT *, CASE WHEN g IS NOT NULL THEN count(*) OVER (PARTITION BY g) END AS sz FROM c), r AS (SELECT *, CASE WHEN g IS NOT NULL THEN row_number() OVER (PARTITION BY g ORDER BY sz, pareto_rank, robustness_score DESC NULLS LAST, record_id) END AS r FROM z),
      k AS (SELECT *, CASE WHEN r = 1 THEN 1 ELSE 2 END AS tier FROM r WHERE g IS NULL OR r <= 3), p AS (SELECT record_id, tier, row_number() OVER (ORDER BY tier, sz NULLS LAST, pareto_rank, robustness_score DESC NULLS LAST, record_id) AS position FROM k)
      SELECT record_id, position, CASE tier WHEN 1 THEN 'covers a group' ELSE 'strategy order' END AS reason FROM p WHERE position <= 35""",
    "priority_selection": f"""WITH {_SEL}, e AS (SELECT * FROM c WHERE record_id % 3 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY crowding_distance DESC, record_id) AS r FROM e),
      p AS (SELECT record_id, row_number() OVER (ORDER BY crowding_distance DESC, record_id) AS position FROM r WHERE g IS NULL OR r = 1) SELECT * FROM p WHERE position <= 30""",
    "tolerance_predict": f"""WITH {STATUS}, m AS ({_MAGNITUDES}), x AS (SELECT m.*, kind, brand, price FROM m JOIN rec USING (record_id)), ref AS (SELECT * FROM x WHERE record_id % 2 = 1 AND price > 910 AND violation),
      s AS (SELECT criterion, count(DISTINCT record_id) AS n, count(*) AS t, count(DISTINCT record_id) >= 20 AND count(DISTINCT CASE WHEN trim(kind) <> '' THEN kind END) >= 5 AND count(DISTINCT brand) >= 3 AS ok FROM ref GROUP BY criterion),
      c AS (SELECT x.record_id, coalesce(s.n, 0) AS n, coalesce(s.ok, false) AS ok, coalesce((SELECT count(*) FROM ref WHERE ref.criterion = x.criterion AND ref.magnitude <= x.magnitude) / s.t, 0) AS cdf FROM x LEFT JOIN s USING (criterion) WHERE x.record_id % 2 = 0 AND violation),
      w AS (SELECT record_id, max(n / (n + 64.0) * cdf + (1 - n / (n + 64.0))) AS score, bool_and(ok) AS supported FROM c GROUP BY record_id),
      a AS (SELECT record_id, bool_or(violation IS NULL) AS unknown FROM x WHERE record_id % 2 = 0 GROUP BY record_id)
      SELECT record_id, score, coalesce(supported, false) AS supported, CASE WHEN score IS NULL AND NOT unknown THEN 'base_eligible' WHEN NOT (coalesce(supported, false) AND NOT unknown) THEN 'review' WHEN score <= 0.85 THEN 'supported_relaxation' ELSE 'excluded' END AS state
      FROM a LEFT JOIN w USING (record_id)""",
    "exact_positives": "SELECT user_id, event_type FROM events WHERE event_id % 5 <> 0 AND value IS NOT NULL GROUP BY ALL HAVING min(value) >= 20",
    "likeness": f"WITH {REC}, {_LIKE} SELECT record_id, CASE WHEN s IS NOT NULL THEN exp((ln(greatest(1e-9, least(1, s))) + ln(greatest(1e-9, least(1, p)))) / 2) END AS likeness FROM k",
    "group_splits": f"""WITH g AS (SELECT n, (row_number() OVER (ORDER BY sha256('42:' || n::VARCHAR)) - 1) / count(*) OVER () AS x FROM (SELECT DISTINCT c_nationkey AS n FROM customer))
      SELECT c_custkey, {_CUT} AS split FROM customer JOIN g ON n = c_nationkey""",
    "dated_splits": f"""WITH g AS (SELECT o_custkey AS c, max(o_orderdate::DATE) AS d FROM orders GROUP BY 1), h AS (SELECT c, (rank() OVER (ORDER BY d) - 1) / count(*) OVER () AS x FROM g) SELECT o_orderkey, {_CUT} AS split FROM orders JOIN h ON c = o_custkey""",
}
