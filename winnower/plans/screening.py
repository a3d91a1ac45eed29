"""Queries on rules, scores, alerts and decisions over ``part`` and ``documents``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.functions.columns import shortest_rank, with_percentile, with_rank, without_nan
from winnower.operators import decisions, rules, selection
from winnower.operators.decisions import Alert, Policy
from winnower.operators.expressions import compile_expression
from winnower.operators.rules import Profile, Rule

#: Every 17th size and every 23rd type is missing, in Spark and in SQL alike.
REC = """rec AS (SELECT p_partkey AS record_id, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size END AS size, p_retailprice AS price,
  p_brand AS brand, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_type END AS kind FROM part)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    """``part`` as records: size and price as descriptors, brand as group, type as cluster."""
    part = without_nan(spark.read.parquet(f"{sf}/part.parquet"))
    return part.select(
        F.col("p_partkey").alias("record_id"), F.when(F.col("p_partkey") % 17 != 0, F.col("p_size")).alias("size"), F.col("p_retailprice").alias("price"),
        F.col("p_brand").alias("brand"), F.when(F.col("p_partkey") % 23 != 0, F.col("p_type")).alias("kind"),
    )


FIT = Profile("fit", (Rule("small", "size", "<=", 40), Rule("priced", "price", "between_inclusive", (905, 985)), Rule("not_tiny", "size", ">", 3, failure_code="TINY")), 1)
PREMIUM = Profile("premium", (Rule("dear", "price", ">=", 950), Rule("soft_size", "size", "<", 25, "soft")))
MID = Profile("mid", (Rule("mid_size", "size", "between_exclusive", (10, 35)),))
PROFILES = [FIT, PREMIUM, MID]

_FIT = {
    "small": "coalesce(size <= 40, false)", "priced": "coalesce(price BETWEEN 905 AND 985, false)", "not_tiny": "coalesce(size > 3, false)",
    "dear": "coalesce(price >= 950, false)", "soft_size": "coalesce(size < 25, false)", "mid_size": "coalesce(size > 10 AND size < 35, false)",
}
STATUS = f"""{REC}, f AS (SELECT *, {", ".join(f"{v} AS ok_{k}" for k, v in _FIT.items())} FROM rec),
st AS (SELECT *, (NOT ok_small)::BIGINT + (NOT ok_priced)::BIGINT + (NOT ok_not_tiny)::BIGINT AS fit__violations, (NOT ok_dear)::BIGINT AS premium__violations,
  (NOT ok_mid_size)::BIGINT AS mid__violations FROM f),
v AS (SELECT *, fit__violations <= 1 AS fit__passed, premium__violations <= 0 AS premium__passed, mid__violations <= 0 AS mid__passed FROM st)"""


def rules_status(spark: SparkSession, sf: str) -> DataFrame:
    out = rules.evaluate(records(spark, sf), PROFILES)
    return out.select("record_id", *(f"{p.id}__{c}" for p in PROFILES for c in ("passed", "violations", "soft_violations", "mask")))


RULES_STATUS = f"""WITH {STATUS} SELECT record_id, fit__passed, fit__violations, 0::BIGINT AS fit__soft_violations,
  (NOT ok_small)::BIGINT + 2 * (NOT ok_priced)::BIGINT + 4 * (NOT ok_not_tiny)::BIGINT AS fit__mask, premium__passed, premium__violations,
  (NOT ok_soft_size)::BIGINT AS premium__soft_violations, (NOT ok_dear)::BIGINT + 2 * (NOT ok_soft_size)::BIGINT AS premium__mask,
  mid__passed, mid__violations, 0::BIGINT AS mid__soft_violations, (NOT ok_mid_size)::BIGINT AS mid__mask FROM v"""


def rules_failures(spark: SparkSession, sf: str) -> DataFrame:
    return rules.failures(records(spark, sf), PROFILES)


_FAILS = [
    ("fit", "small", "SMALL", "size", "NULL", "40"), ("fit", "priced", "PRICED", "price", "905", "985"), ("fit", "not_tiny", "TINY", "size", "3", "NULL"),
    ("premium", "dear", "DEAR", "price", "950", "NULL"), ("premium", "soft_size", "SOFT_SIZE", "size", "NULL", "25"), ("mid", "mid_size", "MID_SIZE", "size", "10", "35"),
]
FAILURES = STATUS + ", fl AS (" + " UNION ALL ".join(
    f"SELECT record_id, '{p}' AS profile_id, '{r}' AS rule_id, '{c}' AS failure_code, {d}::DOUBLE AS observed_value, {lo}::DOUBLE AS lower_limit, {hi}::DOUBLE AS upper_limit FROM v WHERE NOT ok_{r}"
    for p, r, c, d, lo, hi in _FAILS
) + ")"


def rules_long_status(spark: SparkSession, sf: str) -> DataFrame:
    return rules.long_status(records(spark, sf), PROFILES).drop("mask", "soft_violations")


def rules_failure_texts(spark: SparkSession, sf: str) -> DataFrame:
    return rules.failure_texts(rules_failures(spark, sf))


def _operator(rule: Rule):
    return lambda spark, sf: records(spark, sf).select("record_id", rule.satisfied().alias("ok"))


_OPERATORS = {
    "op_lt": (Rule("r", "size", "<", 20), "coalesce(size < 20, false)"),
    "op_le": (Rule("r", "size", "<=", 20), "coalesce(size <= 20, false)"),
    "op_gt": (Rule("r", "size", ">", 20), "coalesce(size > 20, false)"),
    "op_ge": (Rule("r", "size", ">=", 20), "coalesce(size >= 20, false)"),
    "op_eq": (Rule("r", "size", "==", 20), "coalesce(size = 20, false)"),
    "op_ne": (Rule("r", "size", "!=", 20), "coalesce(size <> 20, false)"),
    "op_between_inclusive": (Rule("r", "size", "between_inclusive", (10, 20)), "coalesce(size BETWEEN 10 AND 20, false)"),
    "op_between_exclusive": (Rule("r", "size", "between_exclusive", (10, 20)), "coalesce(size > 10 AND size < 20, false)"),
    "op_in": (Rule("r", "kind", "in", ("STANDARD", "PROMO", "SMALL")), "coalesce(kind IN ('STANDARD', 'PROMO', 'SMALL'), false)"),
    "op_not_in": (Rule("r", "kind", "not_in", ("STANDARD", "PROMO", "SMALL")), "coalesce(kind NOT IN ('STANDARD', 'PROMO', 'SMALL'), false)"),
}


def _pattern(rule: Rule):
    return lambda spark, sf: records(spark, sf).withColumn("flag", F.col("kind").contains("A")).select("record_id", rule.satisfied().alias("ok"))


def expression_policy(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet").withColumn("c_acctbal", F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal")))
    ok = compile_expression(c, "(0 < C_ACCTBAL <= 5000 and c_mktsegment == 'BUILDING') or not c_nationkey >= 5 and c_nationkey")
    return c.select("c_custkey", ok.alias("ok"))


EXPRESSION = """WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)
SELECT c_custkey, (coalesce(0 < bal, false) AND coalesce(bal <= 5000, false) AND c_mktsegment = 'BUILDING') OR (NOT coalesce(c_nationkey >= 5, false) AND c_nationkey <> 0) AS ok FROM c"""

# ---- scores


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    out = rules.evaluate(records(spark, sf), PROFILES)
    quality = (F.col("price") - 900) / 100
    out = out.withColumns({"quality": quality, "pass_fraction": decisions.pass_fraction(PROFILES), "hard_violations": decisions.hard_violations(PROFILES)})
    out = out.withColumn("alert_count", F.when(F.col("brand").endswith("5"), 2).otherwise(0).cast("long"))
    return out.withColumn("consensus_score", decisions.consensus_score(F.col("pass_fraction"), F.col("quality"), F.col("alert_count")))


def score_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("record_id", "pass_fraction", "hard_violations", "consensus_score")


SCORED = STATUS + """, sc AS (SELECT *, (price - 900) / 100 AS quality, (fit__passed::INT + premium__passed::INT + mid__passed::INT) / 3.0::DOUBLE AS pass_fraction,
  fit__violations + premium__violations + mid__violations AS hard_violations, CASE WHEN brand LIKE '%5' THEN 2 ELSE 0 END AS alert_count FROM v),
s AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE * pass_fraction + 0.35::DOUBLE * quality + 0.15::DOUBLE * (1 - least(alert_count, 3) / 3.0::DOUBLE))) AS consensus_score FROM sc)"""


def score_rank(spark: SparkSession, sf: str) -> DataFrame:
    return with_rank(records(spark, sf), "size", "rank").select("record_id", "rank", shortest_rank("size", ["brand"], False).alias("brand_rank"))


def score_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return with_percentile(records(spark, sf), "size", "pct").select("record_id", "pct")


def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.histogram(records(spark, sf).withColumn("q", (F.col("price") - 900) / 100), "q")


def gate_top_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.top_percentile(records(spark, sf), "size", 20).select("record_id", "gate")


POLICY = Policy({"fit": "mandatory", "premium": "consensus", "mid": "consensus"}, consensus_least=1, gate="gate", expression="quality > 0.2 and not brand == 'Brand#11'")


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.decide(decisions.top_percentile(_scored(spark, sf), "consensus_score", 60), POLICY)


def decision_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf).select("record_id", "selected", "exclusion_reasons")


DECIDED = SCORED + """, cut AS (SELECT quantile_cont(consensus_score, 0.4) AS c FROM s),
k AS (SELECT s.*, consensus_score >= c AS gate, premium__passed::INT + mid__passed::INT >= 1 AS votes, quality > 0.2 AND NOT brand = 'Brand#11' AS expr FROM s, cut),
d AS (SELECT *, fit__passed AND votes AND gate AND expr AS selected, concat_ws('; ', CASE WHEN NOT fit__passed THEN 'failed profile fit' END,
  CASE WHEN NOT votes THEN 'fewer than 1 of 2 profiles' END, CASE WHEN NOT gate THEN 'quality gate' END, CASE WHEN NOT expr THEN 'expression' END) AS exclusion_reasons FROM k)"""


def drop_duplicates_with_reason(spark: SparkSession, sf: str) -> DataFrame:
    out = decisions.drop_with_reason(_decided(spark, sf), F.col("record_id") % 5 != 0, "reference duplicate")
    return out.select("record_id", "selected", "exclusion_reasons")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Decision, then at most two of each brand and the best 25."""
    chosen = _decided(spark, sf).where("fit__passed")
    best = selection.select_single_quota(chosen, 25, [F.desc("consensus_score")], "brand", 2)
    return best.select("record_id", "brand", "fit__violations", "fit__mask", "consensus_score", "exclusion_reasons", "position")


FLAGSHIP = f"""WITH {DECIDED}, r AS (SELECT *, (NOT ok_small)::BIGINT + 2 * (NOT ok_priced)::BIGINT + 4 * (NOT ok_not_tiny)::BIGINT AS fit__mask,
  row_number() OVER (PARTITION BY brand ORDER BY consensus_score DESC, record_id) AS g FROM d WHERE fit__passed),
b AS (SELECT *, row_number() OVER (ORDER BY consensus_score DESC, record_id) AS position FROM r WHERE g <= 2)
SELECT record_id, brand, fit__violations, fit__mask, consensus_score, exclusion_reasons, position FROM b WHERE position <= 25"""

# ---- alerts

CATALOG = [
    Alert("licence", "apache", "Apache License", "inform"), Alert("licence", "gpl", "GNU General Public", "exclude"),
    Alert("noise", "symbols", "[#$%&*]{3}", "warn"), Alert("noise", "shout", "[A-Z]{3,}!!", "exclude"), Alert("layout", "table", " [|] ", "penalize"),
]


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def alert_hits(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.alert_hits(_documents(spark, sf), CATALOG, "text", "doc_id")


HITS = "h AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{a.catalog_id}' AS catalog_id, '{a.name}' AS alert_name, '{a.action}' AS action, len(regexp_extract_all(text, '{a.pattern}'))::BIGINT AS occurrence_count FROM documents"
    for a in CATALOG
) + "), hits AS (SELECT * FROM h WHERE occurrence_count > 0)"


def alert_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).select("doc_id", "text")
    return decisions.alert_counts(docs.select("doc_id"), decisions.alert_hits(docs, CATALOG, "text", "doc_id"), "doc_id")


# ---- reports


def impact_approval(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.approval(rules.evaluate(records(spark, sf), PROFILES), PROFILES)


def impact_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.funnel(rules.evaluate(records(spark, sf), PROFILES), PROFILES)


def sole_failures(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.sole_failures(rules_failures(spark, sf))


def profile_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.intersections(rules.evaluate(records(spark, sf), PROFILES), PROFILES)


def group_table(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.group_table(records(spark, sf), "brand")


def group_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.diversity(records(spark, sf), "brand")


QUERIES = {
    "flagship": flagship, "rules_status": rules_status, "rules_failures": rules_failures, "rules_long_status": rules_long_status, "rules_failure_texts": rules_failure_texts,
    **{name: _operator(rule) for name, (rule, _) in _OPERATORS.items()},
    "op_contains_pattern": _pattern(Rule("r", "flag", "contains_substructure")), "op_lacks_pattern": _pattern(Rule("r", "flag", "does_not_contain_substructure")),
    "expression_policy": expression_policy, "score_consensus": score_consensus, "score_rank": score_rank, "score_percentile": score_percentile,
    "score_histogram": score_histogram, "gate_top_percentile": gate_top_percentile, "decision_reasons": decision_reasons,
    "drop_duplicates_with_reason": drop_duplicates_with_reason, "alert_hits": alert_hits, "alert_counts": alert_counts, "impact_approval": impact_approval,
    "impact_funnel": impact_funnel, "sole_failures": sole_failures, "profile_intersection": profile_intersection, "group_table": group_table, "group_diversity": group_diversity,
}

_P = ("fit", "premium", "mid")
ORACLE = {
    "flagship": FLAGSHIP, "rules_status": RULES_STATUS, "rules_failures": f"WITH {FAILURES} SELECT * FROM fl",
    "rules_long_status": f"WITH {STATUS} " + " UNION ALL ".join(f"SELECT record_id, '{p}' AS profile_id, {p}__passed AS passed, {p}__violations AS violations FROM v" for p in _P),
    "rules_failure_texts": f"WITH {FAILURES} SELECT record_id, string_agg(DISTINCT profile_id, ', ' ORDER BY profile_id) AS failed_profiles, string_agg(DISTINCT failure_code, ', ' ORDER BY failure_code) AS failure_codes FROM fl GROUP BY record_id",
    **{name: f"WITH {REC} SELECT record_id, {sql} AS ok FROM rec" for name, (_, sql) in _OPERATORS.items()},
    "op_contains_pattern": f"WITH {REC} SELECT record_id, coalesce(kind LIKE '%A%', false) AS ok FROM rec",
    "op_lacks_pattern": f"WITH {REC} SELECT record_id, NOT coalesce(kind LIKE '%A%', false) AS ok FROM rec",
    "expression_policy": EXPRESSION, "score_consensus": f"WITH {SCORED} SELECT record_id, pass_fraction, hard_violations, consensus_score FROM s",
    "score_rank": f"""WITH {REC} SELECT record_id, CASE WHEN size IS NOT NULL THEN rank() OVER (ORDER BY size DESC NULLS LAST) END AS rank,
      CASE WHEN size IS NOT NULL THEN rank() OVER (PARTITION BY brand ORDER BY size ASC NULLS LAST) END AS brand_rank FROM rec""",
    "score_percentile": f"""WITH {REC} SELECT record_id, CASE WHEN size IS NOT NULL THEN (rank() OVER (ORDER BY size ASC NULLS LAST) + (count(size) OVER (PARTITION BY size) - 1) / 2.0::DOUBLE) / count(size) OVER () END AS pct FROM rec""",
    "score_histogram": f"""WITH {REC}, q AS (SELECT (price - 900) / 100 AS q FROM rec), b AS (SELECT greatest(ceil(q * 10)::INT - 1, 0) AS bin FROM q WHERE q BETWEEN 0 AND 1)
      SELECT r.range::INT AS bin, count(b.bin) AS n FROM range(10) r LEFT JOIN b ON b.bin = r.range GROUP BY 1""",
    "gate_top_percentile": f"WITH {REC} SELECT record_id, coalesce(size >= (SELECT quantile_cont(size::DOUBLE, 0.8) FROM rec), false) AS gate FROM rec",
    "decision_reasons": f"WITH {DECIDED} SELECT record_id, selected, exclusion_reasons FROM d",
    "drop_duplicates_with_reason": f"""WITH {DECIDED} SELECT record_id, selected AND record_id % 5 <> 0 AS selected,
      CASE WHEN selected AND record_id % 5 = 0 THEN 'reference duplicate' ELSE exclusion_reasons END AS exclusion_reasons FROM d""",
    "alert_hits": f"WITH {HITS} SELECT * FROM hits",
    "alert_counts": f"""WITH {HITS} SELECT d.doc_id, coalesce(sum(occurrence_count), 0)::BIGINT AS alert_count, coalesce(bool_or(action = 'exclude'), false) AS alert_excluded
      FROM documents d LEFT JOIN hits USING (doc_id) GROUP BY d.doc_id""",
    "impact_approval": f"WITH {STATUS} " + " UNION ALL ".join(
        f"SELECT '{p}' AS profile_id, sum({p}__passed::INT)::BIGINT AS approved, (count(*) - sum({p}__passed::INT))::BIGINT AS rejected, sum({p}__passed::INT) / count(*)::DOUBLE AS approved_share, count(*) FILTER ({p}__violations = 1) AS one_violation FROM v" for p in _P),
    "impact_funnel": f"WITH {STATUS} " + " UNION ALL ".join(f"SELECT {k} AS step, '{p}' AS profile_id, count(*) FILTER ({' AND '.join(q + '__passed' for q in _P[:k + 1])}) AS remaining FROM v" for k, p in enumerate(_P)),
    "sole_failures": f"""WITH {FAILURES}, a AS (SELECT record_id FROM fl GROUP BY record_id HAVING count(*) = 1)
      SELECT profile_id, rule_id, failure_code, count(*) AS n FROM fl JOIN a USING (record_id) GROUP BY ALL""",
    "profile_intersection": f"WITH {STATUS} " + " UNION ALL ".join(
        f"SELECT '{a}' AS given, '{b}' AS other, count(*) FILTER ({a}__passed AND {b}__passed) / nullif(count(*) FILTER ({a}__passed), 0)::DOUBLE AS share FROM v" for a in _P for b in _P),
    "group_table": f"""WITH {REC}, g AS (SELECT CASE WHEN brand = '' THEN '(none)' ELSE brand END AS "group", count(*) AS n FROM rec WHERE brand IS NOT NULL GROUP BY 1)
      SELECT *, row_number() OVER (ORDER BY n DESC, "group") AS group_id FROM g""",
    "group_diversity": f"""WITH {REC}, g AS (SELECT brand, count(*) AS n FROM rec WHERE brand IS NOT NULL GROUP BY 1)
      SELECT sum(n)::BIGINT AS total, count(*) AS groups, count(*) / sum(n)::DOUBLE AS groups_per_record, max(n) / sum(n)::DOUBLE AS largest_share, count(*) FILTER (n = 1) AS singletons FROM g""",
}
