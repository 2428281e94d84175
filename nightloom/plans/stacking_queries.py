"""Stacking queries bound to lineitem: pixel = l_partkey, frame = l_suppkey, sample = l_extendedprice, weight = 1 + l_quantity / 50.
In the clipped ones every 64th column of pixels is dead: its samples are NaN, so no frame covers it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.operators import robust

KAPPA = 1.5  # tight enough that these samples are rejected at all


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _sample():
    return F.when(F.col("l_partkey") % 64 == 13, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))


def _combined(method: str, weighted: bool, kappa: float = KAPPA):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        weight = 1 + F.col("l_quantity") / 50 if weighted else None
        sample = _sample() if method in ("sigma_clip", "kappa_sigma") else F.col("l_extendedprice")
        out = robust.combine(_lines(spark, sf_dir), ["l_partkey"], sample, weight, method, kappa)
        return out.withColumn("value", F.round(F.nanvl("value", F.lit(None).cast("double")), 6))

    return query


def _clip_sql(seed_centre: str, seed_sigma: str, weighted: bool) -> str:
    """The three passes as common table expressions."""
    w = "1 + l_quantity / 50" if weighted else "1.0"
    order = f"l_extendedprice, {w}" if weighted else "l_extendedprice"
    sql = f"""WITH g0 AS (SELECT l_partkey, coalesce(list({{'x': l_extendedprice, 'w': {w}}} ORDER BY {order}) FILTER (WHERE l_partkey % 64 <> 13), []) AS e FROM lineitem GROUP BY 1),
g AS (SELECT *, list_transform(e, lambda r: r.x) AS xs FROM g0),
m AS (SELECT *, {seed_centre} AS c FROM g),
d AS (SELECT *, list_sort(list_transform(xs, lambda x: abs(x - c))) AS dev FROM m),
p0 AS (SELECT l_partkey, e, len(e) AS n, list_median(xs) AS med, c, {seed_sigma} AS s, false AS done, false AS floor, list_median(dev) AS mad FROM d)"""
    for i in (1, 2, 3):
        p = f"p{i - 1}"
        sql += f""",
k{i} AS (SELECT *, list_filter(e, lambda r: r.x >= c - {KAPPA} * s AND r.x <= c + {KAPPA} * s) AS k FROM {p}),
h0{i} AS (SELECT *, done OR s <= 0 OR len(k) = len(e) AS settled FROM k{i}),
h{i} AS (SELECT *, settled OR len(k) < 3 AS stop, NOT settled AND len(k) < 3 AS low, list_avg(list_transform(k, lambda r: r.x)) AS mu FROM h0{i}),
p{i} AS (SELECT l_partkey, n, med, mad, floor OR low AS floor, CASE WHEN stop THEN e ELSE k END AS e, CASE WHEN stop THEN c ELSE mu END AS c,
  CASE WHEN stop THEN s ELSE sqrt(list_sum(list_transform(k, lambda r: (r.x - mu) * (r.x - mu))) / (len(k) - 1)) END AS s, stop AS done FROM h{i})"""
    return sql


MAD = "CASE WHEN list_median(dev) > 0 THEN 1.4826 * list_median(dev) ELSE 1.2533 * list_avg(dev) END"
SD = "CASE WHEN len(xs) < 2 THEN 0.0 ELSE list_stddev_samp(xs) END"
VALUE = """
SELECT l_partkey, n::BIGINT AS n, round(CASE WHEN n < 5 THEN med ELSE list_sum(list_transform(e, lambda r: r.x * r.w)) / list_sum(list_transform(e, lambda r: r.w)) END, 6) AS value,
  (CASE WHEN n < 5 THEN n ELSE len(e) END)::BIGINT AS survivors FROM p3"""


def rejection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.rejection_stats(_lines(spark, sf_dir), ["l_partkey"], _sample(), KAPPA)


def robust_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust.spread_stats(_lines(spark, sf_dir), ["l_suppkey"], F.col("l_extendedprice"))
    return out.withColumns({c: F.round(c, 6) for c in ("median", "upper_median", "mad_sigma", "mean_dev_sigma", "sd")})


def index_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.index_percentiles(_lines(spark, sf_dir), ["l_partkey"], F.col("l_extendedprice"), {"p25": 0.25, "p50": 0.5, "p999": 0.999})


def coverage_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Frames shipped before 1995 count as finite samples, the others as sentinels.
    sample = F.when(F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz"), F.col("l_extendedprice"))
    return robust.coverage(_lines(spark, sf_dir), ["l_partkey"], sample)


def master_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    red = lines.where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.expr("median(l_quantity)").alias("v"))
    master = lines.select("l_partkey").distinct().join(red, "l_partkey", "left")
    return robust.master_stats(master, "v").withColumn("mean_value", F.round("mean_value", 6))


def master_dark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.combine(_lines(spark, sf_dir), ["l_partkey"], F.col("l_quantity"), method="median").select("l_partkey", "n", "value")


QUERIES = {
    "stack_sigma_clip": _combined("sigma_clip", True),
    "stack_kappa_sigma": _combined("kappa_sigma", False),
    "stack_median": _combined("median", False),
    "stack_weighted_mean": _combined("mean", True),
    "rejection_stats": rejection_stats,
    "robust_stats": robust_stats,
    "index_percentile": index_percentile,
    "coverage_count": coverage_count,
    "master_stats": master_stats,
    "master_dark": master_dark,
}
ORACLES = {
    "stack_sigma_clip": _clip_sql("list_median(xs)", MAD, True) + VALUE,
    "stack_kappa_sigma": _clip_sql("list_avg(xs)", SD, False) + VALUE,
    "stack_median": "SELECT l_partkey, count(*)::BIGINT AS n, round(median(l_extendedprice), 6) AS value, count(*)::BIGINT AS survivors FROM lineitem GROUP BY 1",
    "stack_weighted_mean": "SELECT l_partkey, count(*)::BIGINT AS n, round(sum(l_extendedprice * (1 + l_quantity / 50)) / sum(1 + l_quantity / 50), 6) AS value, count(*)::BIGINT AS survivors FROM lineitem GROUP BY 1",
    "rejection_stats": _clip_sql("list_median(xs)", MAD, False) + " SELECT count(*)::BIGINT AS pixels, sum(n)::BIGINT AS samples, (sum(n - len(e)) FILTER (WHERE n >= 5))::BIGINT AS rejected, (count(*) FILTER (WHERE n = 0))::BIGINT AS uncovered, (count(*) FILTER (WHERE n > 0 AND n < 5))::BIGINT AS below_floor, (count(*) FILTER (WHERE n >= 5 AND floor))::BIGINT AS floor_hit, (count(*) FILTER (WHERE n >= 5 AND mad <= 0))::BIGINT AS degenerate_spread FROM p3",
    "robust_stats": """WITH g AS (SELECT l_suppkey, list(l_extendedprice ORDER BY l_extendedprice) AS xs FROM lineitem GROUP BY 1),
m AS (SELECT *, list_median(xs) AS m FROM g), d AS (SELECT *, list_transform(xs, lambda x: abs(x - m)) AS dev FROM m)
SELECT l_suppkey, len(xs)::BIGINT AS n, round(m, 6) AS median, round(xs[len(xs) // 2 + 1], 6) AS upper_median, round(1.4826 * list_median(dev), 6) AS mad_sigma,
  round(1.2533 * list_avg(dev), 6) AS mean_dev_sigma, round(list_stddev_samp(xs), 6) AS sd FROM d""",
    "index_percentile": """WITH g AS (SELECT l_partkey, list(l_extendedprice ORDER BY l_extendedprice) AS xs FROM lineitem GROUP BY 1)
SELECT l_partkey, xs[CAST(floor((len(xs) - 1) * 0.25) AS INT) + 1] AS p25, xs[CAST(floor((len(xs) - 1) * 0.5) AS INT) + 1] AS p50, xs[CAST(floor((len(xs) - 1) * 0.999) AS INT) + 1] AS p999 FROM g""",
    "coverage_count": "SELECT l_partkey, (count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1995-01-01'))::BIGINT AS n_covering FROM lineitem GROUP BY 1",
    "master_stats": """WITH a AS (SELECT DISTINCT l_partkey FROM lineitem), r AS (SELECT l_partkey, median(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT min(v) AS min_value, round(avg(v), 6) AS mean_value, max(v) AS max_value, (count(*) FILTER (WHERE v IS NULL))::BIGINT AS uncovered FROM a LEFT JOIN r USING (l_partkey)""",
    "master_dark": "SELECT l_partkey, count(*)::BIGINT AS n, median(l_quantity) AS value FROM lineitem GROUP BY 1",
}
