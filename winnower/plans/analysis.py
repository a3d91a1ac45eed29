"""Queries on duplicates, fingerprints, margins, thresholds, scenarios and objectives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.functions.columns import sign_words
from winnower.operators import margins as M
from winnower.operators import matching, objectives, rules
from winnower.operators.objectives import Objective
from winnower.plans.screening import FIT, MID, PREMIUM, REC, STATUS, records

# ---- duplicates and overlap

KEY = r"lower(regexp_replace(trim(text), '\s+', ' ', 'g'))"


def _keyed(spark: SparkSession, sf: str, table: str, ident: str) -> DataFrame:
    t = spark.read.parquet(f"{sf}/{table}.parquet").select(ident, "text")
    return t.withColumn("canonical", F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))).withColumn("letters", F.regexp_replace(F.lower("text"), "[^a-z]+", ""))


def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return matching.first_occurrence(_keyed(spark, sf, "documents", "doc_id"), "canonical", "doc_id").select("doc_id", "duplicate_of")


def dedup_groups(spark: SparkSession, sf: str) -> DataFrame:
    return matching.duplicate_groups(_keyed(spark, sf, "documents", "doc_id"), "canonical", "doc_id").select("n", "first_record")


def overlap_multi_key(spark: SparkSession, sf: str) -> DataFrame:
    docs = _keyed(spark, sf, "documents", "doc_id")
    return matching.exact_overlap(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "ref_id"), ["canonical", "letters"], "doc_id", "ref_id")


def overlap_flags(spark: SparkSession, sf: str) -> DataFrame:
    docs = _keyed(spark, sf, "documents", "doc_id")
    return matching.overlap_flags(docs.where("doc_id % 5 <> 0").select("doc_id"), overlap_multi_key(spark, sf), "doc_id", "ref_id")


_OVERLAP = f"""k AS (SELECT doc_id, {KEY} AS canonical, regexp_replace(lower(text), '[^a-z]+', '', 'g') AS letters FROM documents),
o AS (SELECT a.doc_id, b.doc_id AS ref_id, 'canonical' AS key_type FROM k a JOIN k b USING (canonical) WHERE a.doc_id % 5 <> 0 AND b.doc_id % 5 = 0 AND trim(canonical) <> ''
  UNION ALL SELECT a.doc_id, b.doc_id, 'letters' FROM k a JOIN k b USING (letters) WHERE a.doc_id % 5 <> 0 AND b.doc_id % 5 = 0 AND trim(letters) <> '')"""

# ---- fingerprints: signs of the embedding


def _prints(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", sign_words().alias("words"), "label")


def _pairs(spark: SparkSession, sf: str, least: float = 0.0) -> DataFrame:
    p = _prints(spark, sf)
    return matching.similarities(p.where("vec_id % 5 <> 0"), p.where("vec_id % 5 = 0"), "vec_id", "vec_id", least=least)


_WORD = "list_sum(list_transform(embedding[{0}:{1}], lambda x, i: CASE WHEN x > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END))"
PRINTS = f"fp AS (SELECT vec_id, label, {_WORD.format(1, 32)} AS w0, {_WORD.format(33, 64)} AS w1 FROM embeddings)"
_SIM = "(bit_count(({0}.w0::BIGINT & {1}.w0::BIGINT)) + bit_count(({0}.w1::BIGINT & {1}.w1::BIGINT))) / (bit_count(({0}.w0::BIGINT | {1}.w0::BIGINT)) + bit_count(({0}.w1::BIGINT | {1}.w1::BIGINT)))::DOUBLE"
PAIRS = f"{PRINTS}, s AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, {_SIM.format('a', 'b')} AS similarity FROM fp a, fp b WHERE a.vec_id % 5 <> 0 AND b.vec_id % 5 = 0)"
NEAREST = f"{PAIRS}, n AS (SELECT a_id, b_id, similarity, 1 - similarity AS novelty FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY similarity DESC, b_id) AS r FROM s) WHERE r = 1)"


def nearest_reference(spark: SparkSession, sf: str) -> DataFrame:
    return matching.nearest(_pairs(spark, sf))


def novelty_top(spark: SparkSession, sf: str) -> DataFrame:
    return matching.nearest(_pairs(spark, sf)).orderBy(F.desc("novelty"), "a_id").limit(40)


def similarity_window(spark: SparkSession, sf: str) -> DataFrame:
    return matching.similarity_window(_pairs(spark, sf), 0.4, 0.5)


def analogues(spark: SparkSession, sf: str) -> DataFrame:
    return matching.top_k(_pairs(spark, sf, 0.4), 3)


def similarity_mean_pairwise(spark: SparkSession, sf: str) -> DataFrame:
    return matching.mean_pairwise(_prints(spark, sf), "vec_id")


def similarity_context(spark: SparkSession, sf: str) -> DataFrame:
    p = _prints(spark, sf).withColumn("y", (F.col("label") % 2).cast("int")).withColumn("family", F.col("vec_id") % 7)
    return matching.context(p.where("vec_id % 3 = 0"), p.where("vec_id % 3 <> 0"), "vec_id", "family", "y")


CONTEXT = f"""WITH {PRINTS}, c AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, b.label % 2 AS y, {_SIM.format('a', 'b')} AS s FROM fp a, fp b
  WHERE a.vec_id % 3 = 0 AND b.vec_id % 3 <> 0 AND a.vec_id % 7 <> b.vec_id % 7),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id, y ORDER BY s DESC, b_id) AS rc, row_number() OVER (PARTITION BY a_id ORDER BY s DESC, b_id) AS ra FROM c)
SELECT a_id, max(s) FILTER (y = 1) AS max_positive, max(s) FILTER (y = 0) AS max_negative, avg(s) FILTER (y = 1 AND rc <= 5) AS mean_top_positive,
  avg(s) FILTER (y = 0 AND rc <= 5) AS mean_top_negative, 1 - max(s) AS novelty, avg(s) FILTER (ra <= 5) AS density FROM r GROUP BY a_id"""


def similarity_out_of_fold(spark: SparkSession, sf: str) -> DataFrame:
    p = _prints(spark, sf).withColumn("fold", matching.hash_fold(F.col("label"), 3))
    return matching.out_of_fold(p, p, "fold", "vec_id")


# ---- margins

RULES = [*FIT.rules, *PREMIUM.rules, *MID.rules]
_LIMITS = {"small": ("size", None, 40), "priced": ("price", 905, 985), "not_tiny": ("size", 3, None), "dear": ("price", 950, None), "soft_size": ("size", None, 25), "mid_size": ("size", 10, 35)}


def _margin_sql(rule: str) -> str:
    d, lo, hi = _LIMITS[rule]
    ends = [f"{d} - {lo}" if lo is not None else None, f"{hi} - {d}" if hi is not None else None]
    known = [x for x in ends if x]
    distance = f"CASE WHEN {d} IS NOT NULL THEN least({known[0]}, {known[1]}) END" if len(known) == 2 else known[0]
    size = max(abs(x) for x in (lo, hi) if x is not None)
    margin = f"({distance})::DOUBLE / coalesce(s_{d}, {size})"
    return f"""SELECT record_id, '{rule}' AS rule_id, {d}::DOUBLE AS value, {lo if lo is not None else 'NULL'}::DOUBLE AS lower_limit, {hi if hi is not None else 'NULL'}::DOUBLE AS upper_limit, {margin} AS margin,
  CASE WHEN ok_{rule} AND abs({margin}) <= 0.1 THEN 'NEAR_PASS' WHEN ok_{rule} THEN 'ROBUST_PASS' WHEN coalesce(abs({margin}) <= 0.1, false) THEN 'NEAR_FAIL' ELSE 'ROBUST_FAIL' END AS status FROM v, sc"""


MARGINS = f"""{STATUS}, sc AS (SELECT nullif(quantile_cont(size::DOUBLE, 0.75) - quantile_cont(size::DOUBLE, 0.25), 0) AS s_size, nullif(quantile_cont(price, 0.75) - quantile_cont(price, 0.25), 0) AS s_price FROM rec),
m AS ({" UNION ALL ".join(_margin_sql(r) for r in _LIMITS)})"""
ROBUST = f"""{MARGINS}, ro AS (SELECT record_id, min(margin) AS min_margin, avg(margin) AS mean_margin, count(*) FILTER (status LIKE 'NEAR%') AS borderline, count(*) FILTER (status LIKE '%FAIL') AS failed FROM m GROUP BY record_id)"""
CLOSEST = "SELECT record_id, rule_id, margin, lower_limit, upper_limit FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY margin, rule_id) AS r FROM {0} WHERE margin IS NOT NULL) WHERE r = 1"


def _margins(spark: SparkSession, sf: str) -> DataFrame:
    return M.margins(records(spark, sf), RULES)


def margins_iqr(spark: SparkSession, sf: str) -> DataFrame:
    return _margins(spark, sf)


def robustness(spark: SparkSession, sf: str) -> DataFrame:
    return M.robustness(_margins(spark, sf))


def closest_rule(spark: SparkSession, sf: str) -> DataFrame:
    return M.closest_rule(_margins(spark, sf))


def rules_at_risk(spark: SparkSession, sf: str) -> DataFrame:
    return M.rules_at_risk(_margins(spark, sf), 3)


def near_misses(spark: SparkSession, sf: str) -> DataFrame:
    return M.near_misses(_margins(spark, sf))


def margin_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return M.margin_matrix(_margins(spark, sf), RULES)


def most_fragile(spark: SparkSession, sf: str) -> DataFrame:
    return M.robustness(_margins(spark, sf)).where("failed = 0").orderBy("min_margin", "record_id").limit(20).select("record_id", "min_margin")


def counterfactual_pass(spark: SparkSession, sf: str) -> DataFrame:
    return M.tightest_flip(_margins(spark, sf))


def counterfactual_fail(spark: SparkSession, sf: str) -> DataFrame:
    return M.admitting_thresholds(rules.failures(records(spark, sf), [FIT, MID]), 2)


# ---- thresholds and scenarios


def retention_curve(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    at = spark.range(0, 11).select((F.col("id") * 5).cast("double").alias("threshold"))
    out = None
    for op in ("<", "<=", ">", ">="):
        part = M.retained(r, "size", op, at).withColumn("operator", F.lit(op))
        out = part if out is None else out.unionByName(part)
    return out


def change_points(spark: SparkSession, sf: str) -> DataFrame:
    at = spark.range(0, 11).select((F.col("id") * 5).cast("double").alias("threshold"))
    return M.change_points(M.retained(records(spark, sf), "size", "<=", at))


def most_restrictive(spark: SparkSession, sf: str) -> DataFrame:
    return M.most_restrictive(records(spark, sf), RULES)


def sensitivity_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return M.transitions(records(spark, sf), FIT, FIT.with_thresholds({"small": 25, "priced": (900, 990)}))


def _scenario(spark: SparkSession, sf: str, name: str) -> DataFrame:
    over = {"base": {}, "wide": {"mid": {"mid_size": (5, 45)}}, "strict": {"fit": {"small": 20}}}[name]
    return M.scenario(records(spark, sf), name, [FIT, MID], over)


def scenario_compare(spark: SparkSession, sf: str) -> DataFrame:
    return M.compare(_scenario(spark, sf, "wide"), _scenario(spark, sf, "strict"))


def scenario_stability(spark: SparkSession, sf: str) -> DataFrame:
    runs = _scenario(spark, sf, "base").unionByName(_scenario(spark, sf, "wide")).unionByName(_scenario(spark, sf, "strict"))
    return M.stability(runs)


_FITSQL = "((NOT coalesce(size <= {0}, false))::INT + (NOT coalesce(price BETWEEN 905 AND 985, false))::INT + (NOT coalesce(size > 3, false))::INT <= 1)"
_MIDSQL = "coalesce(size > {0} AND size < {1}, false)"
SCENARIOS = f"""{REC}, sn AS (SELECT record_id, {_FITSQL.format(40)} AND {_MIDSQL.format(10, 35)} AS base, {_FITSQL.format(40)} AND {_MIDSQL.format(5, 45)} AS wide,
  {_FITSQL.format(20)} AND {_MIDSQL.format(10, 35)} AS strict FROM rec)"""

# ---- objectives

OBJECTIVES = [Objective("c_acctbal"), Objective("c_nationkey", "minimize"), Objective("c_custkey", "target_value", (700.0,), 0.5)]


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").withColumn("c_acctbal", F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal")))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return objectives.desirabilities(_pool(spark, sf), OBJECTIVES, "c_custkey")


SCORES = """p AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS bal, c_nationkey FROM customer),
d AS (SELECT c_custkey, coalesce(bal, (SELECT min(bal) - 1 FROM p)) AS d0, -c_nationkey::DOUBLE AS d1, -abs(c_custkey::DOUBLE - 700) AS d2 FROM p),
dom AS (SELECT a.c_custkey AS lo, b.c_custkey AS hi FROM d a JOIN d b ON b.d0 >= a.d0 AND b.d1 >= a.d1 AND b.d2 >= a.d2 AND (b.d0 > a.d0 OR b.d1 > a.d1 OR b.d2 > a.d2))"""


def desirabilities(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf)


def pareto_counts(spark: SparkSession, sf: str) -> DataFrame:
    return objectives.dominance_counts(_scores(spark, sf), 3, "c_custkey")


def pareto_front(spark: SparkSession, sf: str) -> DataFrame:
    return objectives.first_front(_scores(spark, sf), 3, "c_custkey")


def pareto_rank(spark: SparkSession, sf: str) -> DataFrame:
    return objectives.ranked_fronts(_scores(spark, sf), 3, record_id="c_custkey")


def pareto_front_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return pareto_rank(spark, sf).groupBy("pareto_rank").agg(F.count("*").alias("n"))


def crowding(spark: SparkSession, sf: str) -> DataFrame:
    s = _scores(spark, sf).withColumn("pareto_rank", (F.col("c_custkey") % 4).cast("long"))
    return objectives.crowding(s, 3, "c_custkey")


CROWD = " + ".join(
    f"CASE WHEN lag(d{i}) OVER w{i} IS NULL OR lead(d{i}) OVER w{i} IS NULL THEN 'Infinity'::DOUBLE WHEN max(d{i}) OVER f > min(d{i}) OVER f THEN (lead(d{i}) OVER w{i} - lag(d{i}) OVER w{i}) / (max(d{i}) OVER f - min(d{i}) OVER f) ELSE 0 END"
    for i in range(3)
)


def ideal_distance(spark: SparkSession, sf: str) -> DataFrame:
    return objectives.normalised(_scores(spark, sf), 3, "c_custkey")


def weighted_priority(spark: SparkSession, sf: str) -> DataFrame:
    return objectives.weighted_priority(_pool(spark, sf), OBJECTIVES, "c_custkey")


def objective_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return objectives.diagnostics(_pool(spark, sf), OBJECTIVES)


def objective_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return objectives.correlations(_pool(spark, sf), OBJECTIVES)


_PCT = "(rank() OVER (ORDER BY d{0}) + (count(*) OVER (PARTITION BY d{0}) - 1) / 2.0::DOUBLE) / count(*) OVER ()"
QUERIES = {
    f.__name__: f
    for f in (
        dedup_first, dedup_groups, overlap_multi_key, overlap_flags, nearest_reference, novelty_top, similarity_window, analogues, similarity_mean_pairwise,
        similarity_context, similarity_out_of_fold, margins_iqr, robustness, closest_rule, rules_at_risk, near_misses, margin_matrix, most_fragile, counterfactual_pass,
        counterfactual_fail, retention_curve, change_points, most_restrictive, sensitivity_transitions, scenario_compare, scenario_stability, desirabilities,
        pareto_counts, pareto_front, pareto_rank, pareto_front_sizes, crowding, ideal_distance, weighted_priority, objective_diagnostics, objective_correlations,
    )
}

_RET = " UNION ALL ".join(f"SELECT t.range * 5.0::DOUBLE AS threshold, count(*) FILTER (size {op} t.range * 5) AS retained, count(*) FILTER (size {op} t.range * 5) / count(*)::DOUBLE AS share, '{op}' AS operator FROM rec, range(11) t GROUP BY t.range" for op in ("<", "<=", ">", ">="))
ORACLE = {
    "dedup_first": f"WITH k AS (SELECT doc_id, {KEY} AS c FROM documents) SELECT doc_id, CASE WHEN c <> '' AND min(doc_id) OVER (PARTITION BY c) <> doc_id THEN min(doc_id) OVER (PARTITION BY c) END AS duplicate_of FROM k",
    "dedup_groups": f"SELECT count(*) AS n, min(doc_id) AS first_record FROM documents WHERE {KEY} <> '' GROUP BY {KEY} HAVING count(*) > 1",
    "overlap_multi_key": f"WITH {_OVERLAP} SELECT * FROM o",
    "overlap_flags": f"""WITH {_OVERLAP}, i AS (SELECT doc_id, string_agg(ref_id::VARCHAR, ';' ORDER BY ref_id) AS reference_ids FROM (SELECT DISTINCT doc_id, ref_id FROM o) GROUP BY doc_id)
      SELECT d.doc_id, i.reference_ids, i.reference_ids IS NOT NULL AS in_reference FROM documents d LEFT JOIN i USING (doc_id) WHERE d.doc_id % 5 <> 0""",
    "nearest_reference": f"WITH {NEAREST} SELECT * FROM n",
    "novelty_top": f"WITH {NEAREST} SELECT * FROM n ORDER BY novelty DESC, a_id LIMIT 40",
    "similarity_window": f"WITH {NEAREST} SELECT * FROM n WHERE similarity BETWEEN 0.4 AND 0.5",
    "analogues": f"WITH {PAIRS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY similarity DESC, b_id)::INT AS rank FROM s WHERE similarity >= 0.4) WHERE rank <= 3",
    "similarity_mean_pairwise": f"WITH {PRINTS}, f AS (SELECT * FROM fp ORDER BY vec_id LIMIT 2000) SELECT coalesce(avg({_SIM.format('a', 'b')}), 0) AS mean_similarity FROM f a, f b WHERE a.vec_id < b.vec_id",
    "similarity_context": CONTEXT,
    "similarity_out_of_fold": f"""WITH {PRINTS}, g AS (SELECT *, ('0x' || substr(sha256(label::VARCHAR), 1, 8))::BIGINT % 3 AS fold FROM fp)
      SELECT a.vec_id AS a_id, max({_SIM.format('a', 'b')}) AS best_other_fold FROM g a JOIN g b ON a.fold <> b.fold GROUP BY a.vec_id""",
    "margins_iqr": f"WITH {MARGINS} SELECT * FROM m",
    "robustness": f"WITH {ROBUST} SELECT *, CASE WHEN min_margin < 0 THEN 0 ELSE tanh(3 * min_margin) END AS robustness_score FROM ro",
    "closest_rule": f"WITH {MARGINS} " + CLOSEST.format("m"),
    "rules_at_risk": f"WITH {MARGINS} SELECT rule_id, count(*) AS n FROM m WHERE status LIKE 'NEAR%' GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 3",
    "near_misses": f"WITH {MARGINS} SELECT DISTINCT record_id, status FROM m WHERE status LIKE 'NEAR%'",
    "margin_matrix": f"WITH {MARGINS} SELECT record_id, " + ", ".join(f"max(margin) FILTER (rule_id = '{r}') AS {r}" for r in _LIMITS) + " FROM m GROUP BY record_id",
    "most_fragile": f"WITH {ROBUST} SELECT record_id, min_margin FROM ro WHERE failed = 0 ORDER BY min_margin, record_id LIMIT 20",
    "counterfactual_pass": f"WITH {MARGINS}, ps AS (SELECT * FROM m WHERE record_id IN (SELECT record_id FROM m GROUP BY record_id HAVING count(*) FILTER (status LIKE '%FAIL') = 0)) " + CLOSEST.format("ps"),
    "counterfactual_fail": f"""WITH {STATUS}, fl AS ({" UNION ALL ".join(
        f"SELECT record_id, '{p}' AS profile_id, '{r}' AS rule_id, {d}::DOUBLE AS observed_value, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi FROM v WHERE NOT ok_{r}"
        for p, r, d, lo, hi in (("fit", "small", "size", "NULL", 40), ("fit", "priced", "price", 905, 985), ("fit", "not_tiny", "size", 3, "NULL"), ("mid", "mid_size", "size", 10, 35)))}),
      c AS (SELECT *, count(*) OVER (PARTITION BY record_id) AS broken_rules FROM fl)
      SELECT record_id, profile_id, rule_id, observed_value, CASE WHEN observed_value < lo THEN observed_value END AS needed_lower, CASE WHEN observed_value > hi THEN observed_value END AS needed_upper, broken_rules
      FROM c WHERE broken_rules <= 2 AND observed_value IS NOT NULL""",
    "retention_curve": f"WITH {REC} {_RET}",
    "change_points": f"""WITH {REC}, c AS (SELECT t.range * 5.0::DOUBLE AS threshold, count(*) FILTER (size <= t.range * 5) / count(*)::DOUBLE AS share FROM rec, range(11) t GROUP BY t.range),
      j AS (SELECT threshold, abs(share - lag(share) OVER (ORDER BY threshold)) AS change FROM c) SELECT * FROM j WHERE change IS NOT NULL ORDER BY change DESC, threshold LIMIT 3""",
    "most_restrictive": f"WITH {STATUS} " + " UNION ALL ".join(f"SELECT '{r}' AS rule_id, count(*) FILTER (ok_{r}) AS retained, count(*) FILTER (NOT ok_{r}) AS rejected FROM v" for r in _LIMITS),
    "sensitivity_transitions": f"""WITH {REC}, t AS (SELECT record_id, {_FITSQL.format(40)} AS a, (NOT coalesce(size <= 25, false))::INT + (NOT coalesce(price BETWEEN 900 AND 990, false))::INT + (NOT coalesce(size > 3, false))::INT <= 1 AS b FROM rec)
      SELECT record_id, CASE WHEN a AND b THEN 'stayed_in' WHEN b THEN 'entered' WHEN a THEN 'left' ELSE 'stayed_out' END AS transition FROM t""",
    "scenario_compare": f"""WITH {SCENARIOS} SELECT count(*) FILTER (wide AND strict) AS common, count(*) FILTER (wide AND NOT strict) AS only_a, count(*) FILTER (strict AND NOT wide) AS only_b,
      count(*) FILTER (wide AND strict) / count(*) FILTER (wide OR strict)::DOUBLE AS jaccard FROM sn""",
    "scenario_stability": f"WITH {SCENARIOS}, c AS (SELECT record_id, (base::INT + wide::INT + strict::INT)::BIGINT AS times FROM sn) SELECT record_id, times, times / 3.0::DOUBLE AS frequency, times = 3 AS always FROM c",
    "desirabilities": f"WITH {SCORES} SELECT * FROM d",
    "pareto_counts": f"""WITH {SCORES}, u AS (SELECT lo, count(*) AS n FROM dom GROUP BY lo), w AS (SELECT hi, count(*) AS n FROM dom GROUP BY hi)
      SELECT d.c_custkey, coalesce(u.n, 0)::BIGINT AS domination_count, coalesce(w.n, 0)::BIGINT AS dominated_count FROM d LEFT JOIN u ON u.lo = c_custkey LEFT JOIN w ON w.hi = c_custkey""",
    "pareto_front": f"WITH {SCORES} SELECT c_custkey FROM d WHERE c_custkey NOT IN (SELECT lo FROM dom)",
    "crowding": f"""WITH {SCORES}, f0 AS (SELECT *, c_custkey % 4 AS pareto_rank FROM d) SELECT c_custkey, pareto_rank, {CROWD} AS crowding FROM f0
      WINDOW f AS (PARTITION BY pareto_rank), {", ".join(f"w{i} AS (PARTITION BY pareto_rank ORDER BY d{i}, c_custkey)" for i in range(3))}""",
    "ideal_distance": f"""WITH {SCORES}, n AS (SELECT c_custkey, {", ".join(f"(d{i} - min(d{i}) OVER ()) / (max(d{i}) OVER () - min(d{i}) OVER ()) AS n{i}" for i in range(3))} FROM d)
      SELECT *, sqrt((1 - n0) ^ 2 + (1 - n1) ^ 2 + (1 - n2) ^ 2) AS ideal_distance FROM n""",
    "weighted_priority": f"WITH {SCORES} SELECT c_custkey, ({_PCT.format(0)} + {_PCT.format(1)} + 0.5 * {_PCT.format(2)}) / 2.5 AS priority FROM d",
    "objective_diagnostics": f"WITH {SCORES} " + " UNION ALL ".join(f"SELECT '{c}' AS objective, stddev_pop({x}) AS spread, stddev_pop({x}) < 1e-9 AS constant FROM p" for c, x in (("c_acctbal", "bal"), ("c_nationkey", "-c_nationkey::DOUBLE"), ("c_custkey", "-abs(c_custkey::DOUBLE - 700)"))),
    "objective_correlations": f"WITH {SCORES} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({x}, {y}) AS correlation FROM p" for (a, x), (b, y) in (
        (("c_acctbal", "bal"), ("c_nationkey", "-c_nationkey::DOUBLE")), (("c_acctbal", "bal"), ("c_custkey", "-abs(c_custkey::DOUBLE - 700)")), (("c_nationkey", "-c_nationkey::DOUBLE"), ("c_custkey", "-abs(c_custkey::DOUBLE - 700)")))),
}
