"""Queries on study designs, reports and structure counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.functions import structures
from winnower.operators import rules, selection
from winnower.operators import studies as S
from winnower.plans.measuring import JD, MS, _judged, _measured
from winnower.plans.screening import FAILURES, REC, records


def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return S.hash_sample(records(spark, sf), "record_id", 50, "s1").select("record_id")


def background_sample(spark: SparkSession, sf: str) -> DataFrame:
    j = _judged(spark, sf)
    return S.background_sample(j, j.where("toxic = 1"), "doc_id", 60, "bg").select("doc_id")


def round_robin_pick(spark: SparkSession, sf: str) -> DataFrame:
    return S.round_robin(records(spark, sf), "brand", "record_id", 60, "rr", 3).select("record_id", "brand", "turn")


def rejection_reasons(spark: SparkSession, sf: str) -> DataFrame:
    m = _measured(spark, sf)
    checks = [("no value", F.col("value").isNotNull()), ("censored", F.col("relation") == "="), ("out of range", F.col("value").between(10, 90)), ("late", F.col("event_id") < 9000)]
    return m.select("event_id", S.first_reason(checks).alias("reason"))


def temporal_reserve(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return S.temporal_reserve(o, "o_custkey", F.year("o_orderdate"), 1996).groupBy("role").agg(F.count("*").alias("n"))


def label_matrix(spark: SparkSession, sf: str) -> DataFrame:
    m = _measured(spark, sf).withColumn("y", (F.col("value") >= 50).cast("int"))
    return S.label_matrix(m, "user_id", "event_type", _TYPES, "y")


_TYPES = ["click", "view", "purchase"]


def feature_support(spark: SparkSession, sf: str) -> DataFrame:
    j = _judged(spark, sf).where("toxic IS NOT NULL")
    return S.feature_support(j, {"long": F.col("n_chars") > 2000, "english": F.col("lang") == "en", "scored": F.col("score") > 0.5}, "doc_id", "toxic", "source")


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    j = _judged(spark, sf).withColumn("base", F.col("doc_id") % 4 == 0)
    return S.threshold_sweep(j, "score", "quality", "base", [0.0, 0.2, 0.4, 0.6, 0.8], 0.5, 3.5)


def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    return S.bootstrap_mean(_judged(spark, sf), "source", "quality", 200, "b")


def connected_groups(spark: SparkSession, sf: str) -> DataFrame:
    return S.connected_groups(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_orderkey", "l_suppkey")


def descriptor_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return S.linear_histogram(records(spark, sf), "price", 25, F.col("size") > 25)


def violation_counts(spark: SparkSession, sf: str) -> DataFrame:
    from winnower.plans.screening import PROFILES

    found = rules.failures(records(spark, sf), PROFILES)
    return found.groupBy("failure_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "failure_code").limit(15)


def zone_statistics(spark: SparkSession, sf: str) -> DataFrame:
    zones = {"cheap": F.col("price") < 930, "large": F.col("size") > 30, "small": F.col("size") <= 20}
    flags = F.filter(F.array(*(F.when(c, F.lit(z)) for z, c in zones.items())), lambda z: z.isNotNull())
    return S.zone_statistics(records(spark, sf).select("record_id", F.explode(flags).alias("zone_id")), "record_id")


def entropy_weights(spark: SparkSession, sf: str) -> DataFrame:
    grid = S.entropy_grid([0, 1, 2, 3, 4], 8, spark)
    return grid.orderBy(F.desc(F.round("entropy", 9)), "id").limit(100).agg(F.avg("entropy").alias("mean_entropy"), F.max("entropy").alias("best"))


def dominance_warning(spark: SparkSession, sf: str) -> DataFrame:
    return S.dominance_warning(records(spark, sf).where("price > 950 and kind is not null"), "kind", 0.16)


def pattern_gate(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    ok, liked = S.pattern_gate(F.col("text"), ["the", "and"], ["[#$%&*]{3}"], ["License", "ing "])
    return d.select("doc_id", ok.alias("ok"), liked.alias("liked"))


def basket_overlap(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    a = selection.select_single_quota(r, 50, [F.desc("price")]).select("record_id")
    b = selection.select_single_quota(r, 50, [F.desc("price")], "brand", 2).select("record_id")
    both = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), "record_id", "full_outer")
    return both.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("common"), F.count("*").alias("either"))


# ---- structures

#: Well-known molecules with heavy atoms, rings, donors, acceptors, rotatable bonds and weight to 0.01.
MOLECULES = (
    ("CC(=O)Oc1ccccc1C(=O)O", 13, 1, 1, 4, 3, 180.16), ("CN1C=NC2=C1C(=O)N(C(=O)N2C)C", 14, 2, 0, 6, 0, 194.19), ("c1ccccc1", 6, 1, 0, 0, 0, 78.11),
    ("CCO", 3, 0, 1, 1, 0, 46.07), ("CC(C)Cc1ccc(cc1)C(C)C(=O)O", 15, 1, 1, 2, 4, 206.28), ("c1ccc2ccccc2c1", 10, 2, 0, 0, 0, 128.17),
    ("[Na+].[Cl-]", 2, 0, 0, 0, 0, 58.44), ("C1CC", None, None, None, None, None, None),
)


def _structures(spark: SparkSession, sf: str) -> DataFrame:
    smiles = F.element_at(F.array(*(F.lit(m[0]) for m in MOLECULES)), (F.col("p_partkey") % len(MOLECULES) + 1).cast("int"))
    return structures.described(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("record_id"), smiles.alias("smiles")), "smiles")


def structure_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = _structures(spark, sf)
    return out.select("record_id", "valid", "heavy_atom_count", "ring_count", "hbd", "hba", "rotatable_bonds", F.round("mol_wt", 1).alias("mol_wt"))


def structure_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Lipinski fails on the partition coefficient that only a toolkit gives, and tolerates one failure."""
    out = rules.evaluate(_structures(spark, sf), [rules.BUILT_IN["lipinski"]])
    return out.select("record_id", "lipinski__passed", "lipinski__violations")


_MOLS = "mol AS (SELECT * FROM (VALUES " + ", ".join("({}, {})".format(k, ", ".join("NULL" if x is None else str(x) for x in m[1:])) for k, m in enumerate(MOLECULES)) + ") t(k, heavy, rings, hbd, hba, rot, wt))"

QUERIES = {
    f.__name__: f
    for f in (
        hash_sample, background_sample, round_robin_pick, rejection_reasons, temporal_reserve, label_matrix, feature_support, threshold_sweep, bootstrap_interval, connected_groups,
        descriptor_histogram, violation_counts, zone_statistics, entropy_weights, dominance_warning, pattern_gate, basket_overlap, structure_counts, structure_profiles,
    )
}

_SWEEP = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS tau, count(*) FILTER ((base OR score <= {t}) AND quality = 1) / count(*) FILTER (quality = 1)::DOUBLE AS retention, count(*) FILTER (base OR score <= {t}) / count(*) FILTER (base)::DOUBLE AS expansion FROM b" for t in (0.0, 0.2, 0.4, 0.6, 0.8))
ORACLE = {
    "hash_sample": "SELECT p_partkey AS record_id FROM part ORDER BY sha256('s1:' || p_partkey), p_partkey LIMIT 50",
    "background_sample": f"WITH {JD} SELECT doc_id FROM jd WHERE doc_id NOT IN (SELECT doc_id FROM jd WHERE toxic = 1) ORDER BY sha256('bg:' || doc_id), doc_id LIMIT 60",
    "round_robin_pick": f"WITH {REC}, r AS (SELECT record_id, brand, row_number() OVER (PARTITION BY brand ORDER BY sha256('rr:' || record_id), record_id)::INT AS turn, count(*) OVER (PARTITION BY brand) AS n FROM rec) SELECT record_id, brand, turn FROM r WHERE n >= 3 ORDER BY turn, brand LIMIT 60",
    "rejection_reasons": f"WITH {MS} SELECT event_id, CASE WHEN value IS NULL THEN 'no value' WHEN relation <> '=' THEN 'censored' WHEN NOT value BETWEEN 10 AND 90 THEN 'out of range' WHEN event_id >= 9000 THEN 'late' END AS reason FROM ms",
    "temporal_reserve": """WITH r AS (SELECT year(o_orderdate) AS y, min(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS f FROM orders)
      SELECT CASE WHEN y < 1996 THEN 'development' WHEN f >= 1996 THEN 'external' ELSE 'overlap' END AS role, count(*) AS n FROM r GROUP BY 1""",
    "label_matrix": f"WITH {MS} SELECT user_id, " + ", ".join(f"max((value >= 50)::INT) FILTER (event_type = '{t}') AS {t}" for t in _TYPES) + " FROM ms GROUP BY user_id",
    "feature_support": f"WITH {JD}, t AS (SELECT * FROM jd WHERE toxic IS NOT NULL) " + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, count(DISTINCT doc_id) AS records, count(*) FILTER (toxic = 1) AS positives, count(*) FILTER (toxic = 0) AS negatives, count(DISTINCT source) AS groups FROM t WHERE {c}"
        for n, c in (("long", "n_chars > 2000"), ("english", "lang = 'en'"), ("scored", "score > 0.5"))),
    "threshold_sweep": f"WITH {JD}, b AS (SELECT *, doc_id % 4 = 0 AS base FROM jd), w AS ({_SWEEP}) SELECT * FROM w WHERE retention >= 0.5 AND expansion <= 3.5 ORDER BY expansion, tau LIMIT 1",
    "bootstrap_interval": f"""WITH {JD}, s AS (SELECT source, sum(quality)::DOUBLE AS s, count(quality) AS n FROM jd WHERE quality IS NOT NULL GROUP BY source),
      u AS (SELECT s, n, r.range AS repeat, ('0x' || substr(sha256('b:' || r.range || ':' || source), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM s, range(200) r),
      w AS (SELECT *, (u > 0.36787944117144233::DOUBLE)::INT + (u > 0.7357588823428847::DOUBLE)::INT + (u > 0.9196986029286058::DOUBLE)::INT + (u > 0.9810118431238462::DOUBLE)::INT + (u > 0.9963401531726563::DOUBLE)::INT AS w FROM u),
      m AS (SELECT sum(s * w) / nullif(sum(n * w), 0) AS m FROM w GROUP BY repeat) SELECT quantile_cont(m, 0.025) AS low, (SELECT sum(s) / sum(n) FROM s) AS mean, quantile_cont(m, 0.975) AS high FROM m""",
    "connected_groups": """WITH RECURSIVE li AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), e AS (SELECT DISTINCT a.s AS x, b.s AS y FROM li a JOIN li b USING (o)),
      r AS (SELECT DISTINCT s AS x, s AS y FROM li UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), c AS (SELECT x, min(y) AS c FROM r GROUP BY x),
      m AS (SELECT c.c, min(o) AS component FROM li JOIN c ON c.x = s GROUP BY c.c) SELECT DISTINCT o AS l_orderkey, component FROM li JOIN c ON c.x = s JOIN m ON m.c = c.c""",
    "descriptor_histogram": f"WITH {REC}, e AS (SELECT min(price) AS lo, max(price) AS hi FROM rec) SELECT least(floor((price - lo) / ((hi - lo) / 25)), 24)::INT AS bin, count(*) AS n, count(*) FILTER (size > 25) AS chosen FROM rec, e GROUP BY 1",
    "zone_statistics": f"""WITH {REC}, z AS (SELECT record_id, 'cheap' AS zone_id FROM rec WHERE price < 930 UNION ALL SELECT record_id, 'large' FROM rec WHERE size > 30 UNION ALL SELECT record_id, 'small' FROM rec WHERE size <= 20),
      c AS (SELECT zone_id, count(*) OVER (PARTITION BY record_id) AS k FROM z) SELECT zone_id, count(*) AS size, count(*) FILTER (k > 1) AS shared FROM c GROUP BY zone_id""",
    "entropy_weights": """WITH g AS (SELECT range AS id, list_transform(range(8), lambda i: ((t.range // (5 ** i)::BIGINT) % 5)::DOUBLE) AS w FROM range(1, 390625) t), p AS (SELECT id, list_transform(w, lambda x: x / list_sum(w)) AS p FROM g),
      h AS (SELECT id, list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN -x * ln(x) ELSE 0 END)) AS entropy FROM p), t AS (SELECT * FROM h ORDER BY round(entropy, 9) DESC, id LIMIT 100) SELECT avg(entropy) AS mean_entropy, max(entropy) AS best FROM t""",
    "dominance_warning": f"WITH {REC}, g AS (SELECT kind, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM rec WHERE price > 950 AND kind IS NOT NULL GROUP BY kind) SELECT * FROM g WHERE share >= 0.16",
    "pattern_gate": "SELECT doc_id, regexp_matches(text, 'the') AND regexp_matches(text, 'and') AND NOT regexp_matches(text, '[#$%&*]{3}') AS ok, regexp_matches(text, 'License') OR regexp_matches(text, 'ing ') AS liked FROM documents",
    "basket_overlap": f"""WITH {REC}, a AS (SELECT record_id FROM rec ORDER BY price DESC, record_id LIMIT 50), g AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY price DESC, record_id) AS r FROM rec),
      b AS (SELECT record_id FROM g WHERE r <= 2 ORDER BY price DESC, record_id LIMIT 50) SELECT count(*) FILTER (a.record_id IS NOT NULL AND b.record_id IS NOT NULL) AS common, count(*) AS either FROM a FULL JOIN b USING (record_id)""",
    "structure_counts": f"""WITH {_MOLS} SELECT p_partkey AS record_id, heavy IS NOT NULL AS valid, heavy::BIGINT AS heavy_atom_count, rings::BIGINT AS ring_count, hbd::BIGINT AS hbd, hba::BIGINT AS hba, rot::BIGINT AS rotatable_bonds,
      round(wt::DOUBLE, 1) AS mol_wt FROM part JOIN mol ON k = p_partkey % {len(MOLECULES)}""",
    "structure_profiles": f"""WITH {_MOLS} SELECT p_partkey AS record_id, heavy IS NOT NULL AS lipinski__passed, CASE WHEN heavy IS NULL THEN 4 ELSE 1 END::BIGINT AS lipinski__violations FROM part JOIN mol ON k = p_partkey % {len(MOLECULES)}""",
}

ORACLE["violation_counts"] = f"WITH {FAILURES} SELECT failure_code, count(*) AS n FROM fl GROUP BY 1 ORDER BY n DESC, failure_code LIMIT 15"
