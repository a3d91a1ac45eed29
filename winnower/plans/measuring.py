"""Queries on measurements, splits, metrics, tolerance and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.operators import activity as A
from winnower.operators import tolerance as T
from winnower.streaming import events as E

# ---- events as measurements: user = compound, type = assay, relation and source by id


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    relation = F.element_at(F.array(*(F.lit(x) for x in ("=", "=", ">", "<", ">=", ""))), (F.col("event_id") % 6 + 1).cast("int"))
    value = F.when(F.col("event_id") % 19 != 0, F.col("value"))
    return e.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), value.alias("value"), relation.alias("relation"),
                    F.concat(F.lit("src"), F.col("event_id") % 4).alias("source"), F.get_json_object("props", "$.k").cast("int").alias("k"))


MS = """ms AS (SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 19 = 0 THEN NULL ELSE value END AS value, ['=', '=', '>', '<', '>=', ''][event_id % 6 + 1] AS relation,
  'src' || (event_id % 4) AS source, (props->>'$.k')::INT AS k FROM events)"""
_LABEL = """CASE WHEN value IS NULL THEN NULL WHEN trim(relation) = '=' THEN (value >= 50)::INT WHEN trim(relation) IN ('>', '>=') THEN CASE WHEN value >= 50 THEN 1 END
  WHEN trim(relation) IN ('<', '<=') THEN CASE WHEN value < 50 OR (value = 50 AND relation = '<') THEN 0 END END"""


def censored_labels(spark: SparkSession, sf: str) -> DataFrame:
    m = _measured(spark, sf)
    return m.select("event_id", A.censored_label(F.col("value"), F.col("relation"), 50.0).alias("y"), A.flipped(F.col("relation")).alias("flipped"))


def p_activity(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.element_at(F.array(*(F.lit(x) for x in ("nM", "uM", "M", "mM", "pM", "mg"))), (F.col("event_id") % 6 + 1).cast("int"))
    return _measured(spark, sf).select("event_id", A.p_activity(F.col("value"), unit).alias("p"))


def measurement_audit(spark: SparkSession, sf: str) -> DataFrame:
    return A.audit(_measured(spark, sf), ["event_type"], "value", "relation")


def evidence_lookup(spark: SparkSession, sf: str) -> DataFrame:
    index = A.evidence(_measured(spark, sf), "user_id", "value", "relation", "source")
    users = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    return A.lookup(users, index, "user_id")


def conflict_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    m = _measured(spark, sf).withColumn("y", A.censored_label(F.col("value"), F.col("relation"), 50.0))
    return A.quarantine(m, ["user_id", "event_type"], "y").select("event_id")


def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return _measured(spark, sf).select("user_id", A.split_of(F.col("user_id")).alias("split")).distinct()


def temporal_split(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return A.temporal_split(o, "o_custkey", "o_orderdate", "1997-06-01").select("o_orderkey", "split")


def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("split", A.split_of(F.col("o_orderkey")))
    return A.leakage(o, "o_custkey")


def temporal_context(spark: SparkSession, sf: str) -> DataFrame:
    m = _measured(spark, sf)
    return A.earlier_context(m.where("event_id % 5 = 0"), m.where("event_id % 5 <> 0"), "user_id", "ts", "value", "event_id")


# ---- metrics: a score from the text's length against the quality label


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars", "lang", "source")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    score = (F.col("n_chars") % 1000) / 1000
    return d.join(labels, "doc_id", "left").withColumn("score", score)


JD = "jd AS (SELECT d.doc_id, n_chars, lang, source, quality, toxic, (n_chars % 1000) / 1000::DOUBLE AS score FROM documents d LEFT JOIN labels USING (doc_id))"


def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return A.roc_auc(_judged(spark, sf), "score", "quality")


def metrics_at_n(spark: SparkSession, sf: str) -> DataFrame:
    return A.metrics_at(_judged(spark, sf), "score", "quality", "doc_id", [10, 50, 100])


def avg_precision(spark: SparkSession, sf: str) -> DataFrame:
    return A.average_precision(_judged(spark, sf), "score", "quality", "doc_id")


def bedroc(spark: SparkSession, sf: str) -> DataFrame:
    return A.bedroc(_judged(spark, sf), "score", "toxic", "doc_id")


def brier_ece(spark: SparkSession, sf: str) -> DataFrame:
    return A.brier_and_ece(_judged(spark, sf), "score", "quality")


def macro_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return A.per_task(_judged(spark, sf), "lang", "score", "quality")


# ---- tolerance


def balanced_weights(spark: SparkSession, sf: str) -> DataFrame:
    return T.balanced_weights(_measured(spark, sf), "event_type", "source", "user_id")


def effective_n(spark: SparkSession, sf: str) -> DataFrame:
    return T.effective_n(balanced_weights(spark, sf), "weight", ["event_type"])


def weighted_ecdf(spark: SparkSession, sf: str) -> DataFrame:
    m = _measured(spark, sf).withColumn("w", (F.col("event_id") % 3 + 1).cast("double"))
    return T.weighted_ecdf(m, "k", "w", ["event_type"])


def ecdf_lookup(spark: SparkSession, sf: str) -> DataFrame:
    asked = _measured(spark, sf).where("event_id % 2 = 0").withColumn("k2", F.col("k") + 0.5 - F.col("event_id") % 2)
    return T.ecdf_lookup(asked, weighted_ecdf(spark, sf), "k2", "event_id", ["event_type"])


_ECDF = f"""{MS}, x AS (SELECT event_type, k::DOUBLE AS x, sum(event_id % 3 + 1)::DOUBLE AS w FROM ms WHERE k IS NOT NULL GROUP BY 1, 2),
ec AS (SELECT event_type, x, sum(w) OVER (PARTITION BY event_type ORDER BY x) / sum(w) OVER (PARTITION BY event_type) AS cdf FROM x)"""


def pattern_support(spark: SparkSession, sf: str) -> DataFrame:
    return T.support(_measured(spark, sf).withColumn("doc", F.when(F.col("k") > 2, F.col("k").cast("string")).otherwise(" ")), ["event_type", "relation"], "user_id", "source", "doc")


def tolerance_calibration(spark: SparkSession, sf: str) -> DataFrame:
    j = _judged(spark, sf).withColumn("base", F.col("doc_id") % 4 == 0)
    return T.calibrate(j, "score", "quality", "base", 0.7, 0.6)


def conformal_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    j = _judged(spark, sf).withColumn("error", F.when(F.col("quality") == 1, 1 - F.col("score")).otherwise(F.col("score")))
    return T.conformal_cutoff(j, "error", "quality", 0.2)


def prediction_sets(spark: SparkSession, sf: str) -> DataFrame:
    j = _judged(spark, sf)
    return j.select("doc_id", F.array_join(T.prediction_set(F.col("score"), F.lit(0.4), F.lit(0.7)), ",").alias("classes"))


def logistic_score(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))
    out = T.logistic({"c_acctbal": (0.8, 4500.0, 3000.0), "c_nationkey": (-0.3, 12.0, 7.0)}, 0.1, 1.5, -0.2)
    return c.select("c_custkey", *(x.alias(n) for n, x in out.items()))


def contextual_priority(spark: SparkSession, sf: str) -> DataFrame:
    j = _judged(spark, sf)
    bonus, penalty = F.when(F.col("lang") == "en", 0.1), (F.col("toxic") * 0.4)
    return j.select("doc_id", T.contextual_priority(F.when(F.col("doc_id") % 9 != 0, F.col("score")), bonus, penalty).alias("priority"))


def information_queue(spark: SparkSession, sf: str) -> DataFrame:
    j = _judged(spark, sf)
    return T.information_queue(j, "score", F.col("quality").isNull(), 25, "doc_id").select("doc_id", "information_rank")


def rescue_selection(spark: SparkSession, sf: str) -> DataFrame:
    j = _judged(spark, sf).withColumn("base", F.col("doc_id") % 4 == 0).withColumn("ok", F.col("lang") != "es")
    return T.rescue(j, "base", "score", "ok", 0.1, "doc_id").select("doc_id", "rescue_rank")


# ---- event windows (extension: not in the reference)


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = E.windowed(e, "1 day")
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", "total")


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.sessions(e, "6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def returns_cube(spark: SparkSession, sf: str) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.count_distinct("l_suppkey").alias("suppliers"))


QUERIES = {
    f.__name__: f
    for f in (
        censored_labels, p_activity, measurement_audit, evidence_lookup, conflict_quarantine, hash_split, temporal_split, split_leakage, temporal_context, roc_auc, metrics_at_n,
        avg_precision, bedroc, brier_ece, macro_metrics, balanced_weights, effective_n, weighted_ecdf, ecdf_lookup, pattern_support, tolerance_calibration, conformal_cutoffs,
        prediction_sets, logistic_score, contextual_priority, information_queue, rescue_selection, event_windows, event_sessions, returns_cube,
    )
}

_SPLIT = "CASE WHEN h < 70 THEN 'train' WHEN h < 80 THEN 'validation' WHEN h < 90 THEN 'calibration' ELSE 'test' END"
_HASH = "('0x' || substr(sha256('20:' || {0}::VARCHAR), 1, 8))::BIGINT % 100"
_RANKED = f"{JD}, rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM jd WHERE {{0}} IS NOT NULL)"
_WEIGHTS = f"""{MS}, u AS (SELECT DISTINCT event_type, source, user_id FROM ms), bw AS (SELECT event_type, source, user_id, 1.0::DOUBLE / ((SELECT count(DISTINCT event_type) FROM u)
  * (SELECT count(DISTINCT source) FROM u v WHERE v.event_type = u.event_type) * count(*) OVER (PARTITION BY event_type, source)) AS weight FROM u)"""
_AUCSQL = "sum(p * (coalesce(below, 0) + n / 2.0::DOUBLE)) / nullif(sum(p) * sum(n), 0)"
ORACLE = {
    "censored_labels": f"WITH {MS} SELECT event_id, {_LABEL} AS y, translate(relation, '<>', '><') AS flipped FROM ms",
    "p_activity": f"WITH {MS}, u AS (SELECT event_id, value, [9, 6, 0, 3, 12, NULL][event_id % 6 + 1] AS s FROM ms) SELECT event_id, CASE WHEN value > 0 AND s IS NOT NULL THEN s - log10(value) END AS p FROM u",
    "measurement_audit": f'WITH {MS} SELECT event_type, count(*) AS "rows", count(value) AS measured, count(*) FILTER (relation <> \'=\') AS censored, count(DISTINCT value) AS distinct_values FROM ms GROUP BY GROUPING SETS ((event_type), ())',
    "evidence_lookup": f"""WITH {MS}, i AS (SELECT user_id, count(*) AS n, min(value) AS least, max(value) AS greatest, string_agg(DISTINCT relation, ';' ORDER BY relation) AS qualities, string_agg(DISTINCT source, ';' ORDER BY source) AS sources
      FROM ms GROUP BY user_id) SELECT c_custkey AS user_id, coalesce(n, 0)::BIGINT AS n, least, greatest, qualities, sources FROM customer LEFT JOIN i ON user_id = c_custkey""",
    "conflict_quarantine": f"""WITH {MS}, y AS (SELECT *, {_LABEL} AS y FROM ms) SELECT event_id FROM y WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM y GROUP BY user_id, event_type HAVING min(y) < max(y))""",
    "hash_split": f"WITH h AS (SELECT DISTINCT user_id, {_HASH.format('user_id')} AS h FROM events) SELECT user_id, {_SPLIT} AS split FROM h",
    "temporal_split": "SELECT o_orderkey, CASE WHEN max(o_orderdate) OVER (PARTITION BY o_custkey) >= TIMESTAMP '1997-06-01' THEN 'external' ELSE 'development' END AS split FROM orders",
    "split_leakage": f"WITH h AS (SELECT o_custkey, {_HASH.format('o_orderkey')} AS h FROM orders), s AS (SELECT o_custkey, {_SPLIT} AS split FROM h) SELECT o_custkey, min(split) AS a, max(split) AS b FROM s GROUP BY o_custkey HAVING min(split) < max(split)",
    "temporal_context": f"""WITH {MS}, j AS (SELECT q.event_id, r.ts, r.value FROM ms q LEFT JOIN ms r ON r.user_id = q.user_id AND r.event_id % 5 <> 0 AND r.ts < q.ts AND r.value IS NOT NULL WHERE q.event_id % 5 = 0)
      SELECT event_id, count(value) AS earlier, avg(value) AS mean_earlier, arg_max(value, ts) AS latest FROM j GROUP BY event_id""",
    "roc_auc": f"""WITH {JD}, c AS (SELECT score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM jd WHERE quality IS NOT NULL GROUP BY score),
      b AS (SELECT *, sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM c) SELECT {_AUCSQL} AS auc FROM b""",
    "metrics_at_n": f"""WITH {_RANKED.format('quality')}, t AS (SELECT count(*) AS n, count(*) FILTER (quality = 1) AS p FROM rk)
      SELECT a::INT AS at, count(*) FILTER (quality = 1) AS hits, count(*) FILTER (quality = 1) / count(*)::DOUBLE AS precision, count(*) FILTER (quality = 1) / max(p)::DOUBLE AS recall,
      (count(*) FILTER (quality = 1) / count(*)::DOUBLE) / (max(p) / max(n)::DOUBLE) AS enrichment FROM rk, t, (SELECT unnest([10, 50, 100]) AS a) WHERE r <= a GROUP BY a""",
    "avg_precision": f"WITH {_RANKED.format('quality')}, h AS (SELECT *, sum(quality) OVER (ORDER BY r) AS hits FROM rk) SELECT sum(hits / r::DOUBLE) FILTER (quality = 1) / nullif(sum(quality), 0) AS average_precision FROM h",
    "bedroc": f"""WITH {_RANKED.format('toxic')}, t AS (SELECT count(*)::DOUBLE AS n, sum(toxic)::DOUBLE AS p FROM rk), e AS (SELECT sum(exp(-20 * r / n)) FILTER (toxic = 1) AS e, max(n) AS n, max(p) AS p FROM rk, t),
      x AS (SELECT e / ((p / n) * (1 - exp(-20.0::DOUBLE)) / (exp(20.0::DOUBLE / n) - 1)) AS rie, (1 - exp(-20 * p / n)) / ((p / n) * (1 - exp(-20.0::DOUBLE))) AS best, (1 - exp(20 * p / n)) / ((p / n) * (1 - exp(20.0::DOUBLE))) AS worst FROM e)
      SELECT (rie - worst) / (best - worst) AS bedroc FROM x""",
    "brier_ece": f"""WITH {JD}, c AS (SELECT least(floor(score * 10), 9) AS b, count(*) AS n, sum((score - quality) ^ 2) AS q, abs(avg(score) - avg(quality)) AS gap FROM jd WHERE quality IS NOT NULL GROUP BY 1)
      SELECT sum(q) / sum(n) AS brier, sum(gap * n) / sum(n) AS ece FROM c""",
    "macro_metrics": f"""WITH {JD}, c AS (SELECT lang, score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM jd WHERE quality IS NOT NULL GROUP BY lang, score),
      b AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM c), t AS (SELECT lang, {_AUCSQL} AS auc FROM b GROUP BY lang)
      SELECT * FROM t UNION ALL SELECT NULL, avg(auc) FROM t""",
    "balanced_weights": f"WITH {_WEIGHTS} SELECT * FROM bw",
    "effective_n": f"WITH {_WEIGHTS} SELECT event_type, sum(weight) ^ 2 / sum(weight ^ 2) AS effective_n FROM bw GROUP BY event_type",
    "weighted_ecdf": f"WITH {_ECDF} SELECT * FROM ec",
    "ecdf_lookup": f"""WITH {_ECDF}, q AS (SELECT event_id, event_type, k + 0.5 - event_id % 2 AS v FROM ms WHERE event_id % 2 = 0 AND k IS NOT NULL)
      SELECT q.event_type, q.event_id, coalesce(max(cdf), 0) AS cdf FROM q LEFT JOIN ec ON ec.event_type = q.event_type AND ec.x <= q.v GROUP BY 1, 2""",
    "pattern_support": f"""WITH {MS}, s AS (SELECT event_type, relation, count(DISTINCT user_id) AS identities, count(DISTINCT source) AS scaffolds, count(DISTINCT CASE WHEN k > 2 THEN k END) AS documents FROM ms GROUP BY 1, 2)
      SELECT *, identities >= 20 AND scaffolds >= 5 AND documents >= 3 AS supported FROM s""",
    "tolerance_calibration": f"""WITH {JD}, b AS (SELECT *, doc_id % 4 = 0 AS base FROM jd), n AS (SELECT greatest(ceil(0.7 * count(*) FILTER (quality = 1)) - count(*) FILTER (quality = 1 AND base), 0)::BIGINT AS needed FROM b),
      a AS (SELECT score, row_number() OVER (ORDER BY score) AS r FROM b WHERE quality = 1 AND NOT base), t AS (SELECT (SELECT score FROM a WHERE r = needed) AS threshold, needed FROM n),
      o AS (SELECT threshold, needed, (SELECT avg((score <= threshold)::INT) FROM b WHERE quality = 0 AND NOT base) AS background_share FROM t) SELECT *, background_share <= 0.6 AS accepted FROM o""",
    "conformal_cutoffs": f"""WITH {JD}, e AS (SELECT quality, CASE WHEN quality = 1 THEN 1 - score ELSE score END AS err FROM jd WHERE quality IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY err) AS r, count(*) OVER (PARTITION BY quality) AS n FROM e)
      SELECT quality, coalesce(max(err) FILTER (r = ceil((n + 1) * 0.8::DOUBLE)), 1.0) AS q FROM r GROUP BY quality""",
    "prediction_sets": f"WITH {JD} SELECT doc_id, concat_ws(',', CASE WHEN score <= 0.4 THEN '0' END, CASE WHEN 1 - score <= 0.7::DOUBLE THEN '1' END) AS classes FROM jd",
    "logistic_score": """WITH c AS (SELECT c_custkey, coalesce((CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END - 4500) / 3000 * 0.8::DOUBLE, 0) AS part_c_acctbal, (c_nationkey - 12) / 7.0::DOUBLE * -0.3::DOUBLE AS part_c_nationkey FROM customer),
      z AS (SELECT *, part_c_acctbal + part_c_nationkey + 0.1 AS logit FROM c) SELECT *, 1 / (1 + exp(-(1.5 * logit - 0.2))) AS probability FROM z""",
    "contextual_priority": f"""WITH {JD} SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE greatest(0, least(1, score + CASE WHEN lang = 'en' THEN 0.1::DOUBLE ELSE 0 END - coalesce(toxic * 0.4::DOUBLE, 0))) END AS priority FROM jd""",
    "information_queue": f"WITH {JD}, r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS information_rank FROM jd WHERE quality IS NULL) SELECT * FROM r WHERE information_rank <= 25",
    "rescue_selection": f"""WITH {JD}, r AS (SELECT doc_id, row_number() OVER (ORDER BY score, sha256(doc_id::VARCHAR), doc_id)::INT AS rescue_rank FROM jd WHERE doc_id % 4 <> 0 AND lang <> 'es')
      SELECT * FROM r WHERE rescue_rank <= (SELECT floor(0.1 * count(*)) FROM jd WHERE doc_id % 4 = 0)""",
    "event_windows": "SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      n AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g), c AS (SELECT user_id, i, count(*) AS n FROM n GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
    "returns_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
}
