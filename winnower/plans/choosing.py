"""Queries on quotas, zones, diversity, clusters, maps and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.functions.columns import sign_words, spread_ranked
from winnower.operators import selection, space, state
from winnower.plans.screening import REC, records

def _rank() -> list:
    return [F.desc("price"), F.asc_nulls_last("size")]


_ORDER = "price DESC, size ASC NULLS LAST, record_id"


def pick_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return selection.per_group(records(spark, sf), "kind", 3, _rank())


def select_single_quota(spark: SparkSession, sf: str) -> DataFrame:
    return selection.select_single_quota(records(spark, sf), 40, _rank(), "brand", 2).select("record_id", "brand", "position")


def final_reserve_split(spark: SparkSession, sf: str) -> DataFrame:
    return selection.final_and_reserve(records(spark, sf), 30, 20, _rank()).select("record_id", "selection_status")


def group_coverage_pass(spark: SparkSession, sf: str) -> DataFrame:
    return selection.cover_groups(records(spark, sf), 10, "brand", _rank()).select("record_id", "brand")


def global_position(spark: SparkSession, sf: str) -> DataFrame:
    return spread_ranked(records(spark, sf), [*_rank(), F.asc("record_id")], "position").select("record_id", "position")


def select_crossed_quota(spark: SparkSession, sf: str) -> DataFrame:
    return selection.select_crossed_quotas(records(spark, sf), 60, "brand", "kind", 3, 12, _rank())


_ZONES = [("cheap", 15, 1), ("large", 10, 2), ("small", 10, 2)]


def zone_allocation(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    rules = {"cheap": F.col("price") < 930, "large": F.col("size") > 30, "small": F.col("size") <= 20}
    zones = F.filter(F.array(*(F.when(c, F.lit(z)) for z, c in rules.items())), lambda z: z.isNotNull())
    members = r.select("record_id", "price", F.explode(zones).alias("zone_id"))
    return selection.allocate_zones(members, _ZONES, "price")


ZONES = f"""WITH {REC}, n AS (SELECT count(*) FILTER (size > 30) AS large, count(*) FILTER (size <= 20) AS small FROM rec),
z1 AS (SELECT r.*, row_number() OVER (ORDER BY price DESC, record_id::VARCHAR) AS rank FROM rec r, n WHERE CASE WHEN n.large <= n.small THEN size > 30 ELSE size <= 20 END),
z2 AS (SELECT r.*, row_number() OVER (ORDER BY price DESC, record_id::VARCHAR) AS rank FROM rec r, n WHERE (CASE WHEN n.large <= n.small THEN size <= 20 ELSE size > 30 END)
  AND record_id NOT IN (SELECT record_id FROM z1 WHERE rank <= 10)),
z3 AS (SELECT *, row_number() OVER (ORDER BY price DESC, record_id::VARCHAR) AS rank FROM rec WHERE price < 930 AND record_id NOT IN (SELECT record_id FROM z1 WHERE rank <= 10 UNION SELECT record_id FROM z2 WHERE rank <= 10))
SELECT CASE WHEN n.large <= n.small THEN 'large' ELSE 'small' END AS zone_id, record_id, rank::INT AS rank FROM z1, n WHERE rank <= 10
UNION ALL SELECT CASE WHEN n.large <= n.small THEN 'small' ELSE 'large' END, record_id, rank::INT FROM z2, n WHERE rank <= 10
UNION ALL SELECT 'cheap', record_id, rank::INT FROM z3 WHERE rank <= 15"""


def _prints(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", sign_words().alias("words"))


def maxmin_pick(spark: SparkSession, sf: str) -> DataFrame:
    return selection.maxmin(_prints(spark, sf), 25, "vec_id")


def maxmin_from_reference(spark: SparkSession, sf: str) -> DataFrame:
    p = _prints(spark, sf)
    seeds = [r["words"] for r in p.where("vec_id % 50 = 0").select("words").collect()]
    return selection.maxmin(p.where("vec_id % 50 <> 0"), 25, "vec_id", seeds=seeds)


def butina(spark: SparkSession, sf: str) -> DataFrame:
    return selection.butina(_prints(spark, sf), 0.5, "vec_id")


def unrepresented_groups(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    return selection.unrepresented(r, selection.select_single_quota(r, 25, _rank()), "brand")


def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    return selection.coverage(records(spark, sf).withColumn("selected", F.col("price") > 990), "brand")


# ---- maps


def _points(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), (F.col("label") == 3).alias("chosen"))


PTS = "pt AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label = 3 AS chosen FROM embeddings)"


def density_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return space.tiles(_points(spark, sf), "x", "y", 12, "chosen")


def uncovered_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return space.tiles(_points(spark, sf), "x", "y", 12, "chosen").where("points >= 4 and chosen = 0").select("tx", "ty", "points")


TILES = f"""WITH {PTS}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pt),
t AS (SELECT least(floor((x - x0) / ((x1 - x0) / 12)), 11)::INT AS tx, least(floor((y - y0) / ((y1 - y0) / 12)), 11)::INT AS ty, count(*) AS points, count(*) FILTER (chosen) AS chosen FROM pt, e GROUP BY 1, 2)"""


def viewport(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf).where(space.in_viewport("x", "y", -0.1, 0.05, -0.05, 0.2)).select("vec_id")


_POLYGON = [(-0.2, -0.1), (0.2, -0.15), (0.05, 0.0), (0.25, 0.2), (-0.1, 0.15)]


def lasso(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf).where(space.in_lasso("x", "y", _POLYGON)).select("vec_id")


_CROSS = " + ".join(
    f"(y < {max(a[1], b[1])} AND y >= {min(a[1], b[1])} AND x < {a[0]}::DOUBLE + (y - ({a[1]})::DOUBLE) * ({(b[0] - a[0]) / (b[1] - a[1])!r})::DOUBLE)::INT" for a, b in zip(_POLYGON, _POLYGON[1:] + _POLYGON[:1])
)


def pca_map(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf).withColumn("both", F.col("size") * F.col("price"))
    return space.pca_map(r, ["size", "price", "both"])[0].select("record_id", "x", "y", "imputed")


# ---- state: events as actions on parts


def _actions(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    kinds = F.array(*(F.lit(a) for a in ("select", "exclude", "reserve", "pin", "unpin", "reset", "undo", "redo")))
    action = F.element_at(kinds, (F.col("event_id") * 7 % 8 + 1).cast("int"))
    return e.select("event_id", "user_id", (F.col("event_id") % 97).alias("record_id"), action.alias("action"))


ACTIONS = "ac AS (SELECT event_id, user_id, event_id % 97 AS record_id, ['select', 'exclude', 'reserve', 'pin', 'unpin', 'reset', 'undo', 'redo'][event_id * 7 % 8 + 1] AS action FROM events)"
BASKET = f"""{ACTIONS}, bk AS (SELECT record_id, coalesce(arg_max(CASE action WHEN 'select' THEN 'selected' WHEN 'reserve' THEN 'reserve' WHEN 'exclude' THEN 'excluded' WHEN 'reset' THEN 'undecided' END, event_id) FILTER (action IN ('select', 'reserve', 'exclude', 'reset')), 'undecided') AS status,
  coalesce(arg_max(action = 'pin', event_id) FILTER (action IN ('pin', 'unpin')), false) AS pinned, count(*) AS changes FROM ac GROUP BY record_id)"""


def basket_state(spark: SparkSession, sf: str) -> DataFrame:
    return state.basket(_actions(spark, sf), "record_id", "event_id", "action")


def basket_at_cursor(spark: SparkSession, sf: str) -> DataFrame:
    return state.basket(_actions(spark, sf), "record_id", "event_id", "action", upto=500)


def basket_counters(spark: SparkSession, sf: str) -> DataFrame:
    return state.counters(basket_state(spark, sf))


def basket_replaced(spark: SparkSession, sf: str) -> DataFrame:
    proposal = spark.range(50, 120).select(F.col("id").alias("record_id"))
    return state.replaced(basket_state(spark, sf), proposal, "record_id")


def undo_redo_state(spark: SparkSession, sf: str) -> DataFrame:
    log = state.effective(_actions(spark, sf), "user_id", "event_id", "action")
    return state.basket(log, "record_id", "event_id", "action")


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return state.content_hash(spark.read.parquet(f"{sf}/part.parquet"), ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])


QUERIES = {
    f.__name__: f
    for f in (
        pick_per_group, select_single_quota, final_reserve_split, group_coverage_pass, global_position, select_crossed_quota, zone_allocation, maxmin_pick,
        maxmin_from_reference, butina, unrepresented_groups, coverage_report, density_tiles, uncovered_tiles, viewport, lasso, pca_map, basket_state, basket_at_cursor,
        basket_counters, basket_replaced, undo_redo_state, content_hash,
    )
}

ORACLE = {
    "pick_per_group": f"WITH {REC}, g AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {_ORDER}) AS r FROM rec) SELECT record_id, size, price, brand, kind FROM g WHERE r <= 3 OR kind IS NULL",
    "select_single_quota": f"""WITH {REC}, g AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY {_ORDER}) AS r FROM rec),
      p AS (SELECT record_id, brand, row_number() OVER (ORDER BY {_ORDER})::INT AS position FROM g WHERE r <= 2) SELECT * FROM p WHERE position <= 40""",
    "final_reserve_split": f"""WITH {REC}, p AS (SELECT record_id, row_number() OVER (ORDER BY {_ORDER}) AS r FROM rec)
      SELECT record_id, CASE WHEN r <= 30 THEN 'final' WHEN r <= 50 THEN 'reserve' ELSE 'excluded' END AS selection_status FROM p""",
    "group_coverage_pass": f"WITH {REC}, g AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY {_ORDER}) AS r FROM rec) SELECT record_id, brand FROM g WHERE r = 1 ORDER BY {_ORDER} LIMIT 10",
    "global_position": f"WITH {REC} SELECT record_id, row_number() OVER (ORDER BY {_ORDER}) AS position FROM rec",
    "zone_allocation": ZONES,
    "unrepresented_groups": f"WITH {REC}, t AS (SELECT * FROM rec ORDER BY {_ORDER} LIMIT 25) SELECT brand, count(*) AS n FROM rec WHERE brand NOT IN (SELECT brand FROM t) GROUP BY brand",
    "coverage_report": f"""WITH {REC} SELECT count(*) AS records, count(*) FILTER (price > 990) AS selected, count(DISTINCT brand) AS groups, count(DISTINCT brand) FILTER (price > 990) AS covered,
      count(DISTINCT brand) FILTER (price > 990) / count(DISTINCT brand)::DOUBLE AS coverage FROM rec""",
    "density_tiles": TILES + " SELECT *, chosen / points::DOUBLE AS share FROM t",
    "uncovered_tiles": TILES + " SELECT tx, ty, points FROM t WHERE points >= 4 AND chosen = 0",
    "viewport": f"WITH {PTS} SELECT vec_id FROM pt WHERE x BETWEEN -0.1 AND 0.05 AND y BETWEEN -0.05 AND 0.2",
    "lasso": f"WITH {PTS} SELECT vec_id FROM pt WHERE ({_CROSS}) % 2 = 1",
    "basket_state": f"WITH {BASKET} SELECT * FROM bk",
    "basket_at_cursor": f"WITH {BASKET.replace('FROM ac GROUP', 'FROM ac WHERE event_id <= 500 GROUP')} SELECT * FROM bk",
    "basket_counters": f"WITH {BASKET} SELECT count(*) AS records, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("selected", "reserve", "excluded", "undecided")) + ", count(*) FILTER (pinned) AS pinned FROM bk",
    "basket_replaced": f"""WITH {BASKET}, n AS (SELECT range AS record_id FROM range(50, 120)) SELECT coalesce(bk.record_id, n.record_id) AS record_id,
      CASE WHEN coalesce(pinned, false) THEN status WHEN n.record_id IS NOT NULL THEN 'selected' ELSE 'undecided' END AS status, coalesce(pinned, false) AS pinned FROM bk FULL JOIN n ON n.record_id = bk.record_id""",
    "content_hash": r"SELECT count(*) AS rows, sum(('0x' || substr(m, 1, 8))::BIGINT)::BIGINT AS content, sum(('0x' || substr(m, 9, 8))::BIGINT)::BIGINT AS content2, sum(('0x' || substr(m, 17, 8))::BIGINT)::BIGINT AS content3 FROM (SELECT md5(concat_ws('|', p_partkey::VARCHAR, coalesce(p_name, '\N'), coalesce(p_brand, '\N'), coalesce(p_type, '\N'), coalesce(p_size::VARCHAR, '\N'))) AS m FROM part)",
}
