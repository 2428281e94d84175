"""Sky, exposure and planning queries bound to customer, supplier, part, region and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.functions import exposure as E
from nightloom.functions import sky
from nightloom.operators import noise as N

POINTING = [
    "c_custkey",
    "CAST(c_custkey * 37 % 179 - 89 AS DOUBLE) AS alt",
    "CAST(c_custkey * 61 % 360 AS DOUBLE) AS az",
    "CAST(c_nationkey * 6 - 72 AS DOUBLE) AS lat",
    "CAST(c_custkey * 7 % 360 - 180 AS DOUBLE) AS lon",
    "1704067200000 + c_custkey * 3600000 AS ms",
    "c_acctbal",
]
SQL = "WITH p AS (SELECT " + ", ".join(POINTING) + " FROM customer)"


def _pointings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(*POINTING)


def sky_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    alt, az, lat = F.col("alt"), F.col("az"), F.col("lat")
    lst = sky.lst_hours(F.col("ms"), F.col("lon"))
    return _pointings(spark, sf_dir).select(
        "c_custkey", F.round(sky.declination_deg(alt, az, lat), 6).alias("declination"), F.round(sky.hour_angle_deg(alt, az, lat), 6).alias("hour_angle"),
        F.round(lst, 5).alias("lst"), F.round(sky.right_ascension_hours(alt, az, lat, lst), 5).alias("right_ascension"), F.round(sky.field_rotation(alt, az, lat), 6).alias("rotation"),
        sky.near_zenith(alt).alias("near_zenith"), sky.compass_point(az).alias("compass"), sky.format_declination(sky.declination_deg(alt, az, lat)).alias("text"),
    )


def sky_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sky.drift_seed(F.col("alt"), F.col("az"), F.col("lat"), F.col("c_custkey") % 360, F.lit(60.0), F.lit(30.0))
    return _pointings(spark, sf_dir).withColumn("s", s).select("c_custkey", *[F.round(f"s.{c}", 6).alias(c) for c in ("rotation_deg", "dx", "dy")])


def sky_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declination that each pointing's drift implies, and whether one a little off it is the same field."""
    k, p = F.col("c_custkey"), _pointings(spark, sf_dir)
    same = sky.same_field(F.col("alt"), F.col("az"), F.col("alt") + (k % 5 - 2), F.col("az") + 357.2 + k % 6, F.lit(1.5))
    return p.select("c_custkey", F.round(sky.implied_declination(F.col("alt"), F.col("az"), F.col("lat")), 6).alias("implied"), same.alias("same"))


def moon_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round(sky.moon_fraction(ms), 6).alias("fraction"), sky.moon_waxing(ms).alias("waxing"))


def _optics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select("s_suppkey", (0.8 + F.col("s_suppkey") % 20 / 10.0).alias("pitch"), (4.0 + F.col("s_suppkey") % 9).alias("focal"), F.when(F.col("s_suppkey") % 6 != 0, (F.col("s_suppkey") * 13 % 89).cast("double")).alias("dec"))


def trailing_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale, half = E.arcsec_per_pixel(F.col("pitch"), F.col("focal")), E.half_field_deg(F.lit(5.6), F.lit(4.2), F.col("focal"))
    return _optics(spark, sf_dir).select("s_suppkey", F.round(scale, 6).alias("scale"), F.round(half, 6).alias("half_field"), F.round(E.trailing_limit_seconds(scale, half, F.col("dec")), 6).alias("seconds"))


def compensation(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = E.snap_stops((F.col("s_suppkey") % 23 - 11) / 2.3)
    sub = F.col("pitch") * F.pow(F.lit(2.0), stops)
    cost = E.frame_cost_seconds(sub, F.when(F.col("s_suppkey") % 4 != 0, F.lit(3.0)), F.lit(0.25))
    return _optics(spark, sf_dir).select("s_suppkey", F.round(stops, 9).alias("stops"), F.round(sub, 9).alias("sub"), F.round(cost, 9).alias("cost"))


NOISE = [(400, 16000.0, 5.0), (800, 8000.0, 4.0), (1600, 4000.0, 3.4), (3200, 2000.0, 3.0)]


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = spark.createDataFrame(NOISE, "iso int, full_scale double, read_noise double")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    sites = s.select(F.col("s_suppkey").alias("site"), ((F.col("s_acctbal") + 1000) / 50).alias("rate"), F.when(F.col("s_suppkey") % 3 == 0, F.lit(800)).alias("dual_gain_iso"))
    return N.exposure_table(sites, noise, 12.0)


def exposure_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir).select("site", "iso", *[F.round(c, 9).alias(c) for c in ("required_seconds", "exposure_seconds", "sky_to_read", "background", "headroom_stops")], "clipping_limited", "verdict")


def exposure_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.choose_exposure(_table(spark, sf_dir)).withColumn("exposure_seconds", F.round("exposure_seconds", 6))


def _brand_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.groupBy("p_brand", F.col("p_size").alias("iso")).agg(F.min("p_retailprice").alias("read_noise"))


def noise_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = _brand_noise(spark, sf_dir)
    got = N.bracket(noise.select("p_brand", "iso"), noise.where("iso <= 40 AND NOT iso BETWEEN 11 AND 25"), "p_brand")
    return got.withColumn("read_noise", F.round("read_noise", 6))


def dual_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.dual_gain_iso(_brand_noise(spark, sf_dir), "p_brand", 1.05)


def session_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, seconds = F.col("c_custkey"), F.col("c_acctbal") + 1200.0
    sub = (1 + k % 30).cast("double")
    per = sub + 0.5
    lights = F.greatest(F.when(k % 3 == 0, F.ceil(seconds / sub)).when(k % 3 == 1, E.lights_that_fit(seconds, per)).otherwise(k % 400), F.lit(1))
    p = _pointings(spark, sf_dir).withColumns({"lights": lights, "sub": sub, "per": per})
    p = p.withColumn("darks", E.dark_count(F.col("lights")))
    p = p.withColumns({"total": (F.col("lights") + F.col("darks")) * F.col("per"), "bytes": (F.col("lights") + F.col("darks")) * F.lit(E.BYTES_A_FRAME)})
    turn = F.abs(sky.field_rotation(F.col("alt"), F.col("az"), F.col("lat"))) * F.col("total") / 3600.0
    area = E.common_area_fraction(turn, 4096.0, 3072.0)
    return p.select(
        "c_custkey", "lights", "darks", F.round("total", 6).alias("total"), "bytes", F.round(area, 6).alias("common_area"),
        E.severity(F.col("bytes"), k * 1_000_000_000 % 50_000_000_000 - F.lit(E.RESERVE_BYTES)).alias("storage"),
        E.severity(F.col("total") / 3600.0 * E.BATTERY_AN_HOUR, k % 100).alias("battery"), F.when(area < 0.8, F.lit("WARN")).otherwise(F.lit("OK")).alias("rotation"),
    )


def predicted_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """48 bins of the sky's expected distribution, for each region's sky rate and ISO."""
    noise = spark.createDataFrame(NOISE, "iso int, full_scale double, read_noise double")
    r = spark.read.parquet(f"{sf_dir}/region.parquet").crossJoin(F.broadcast(noise))
    electrons = 40.0 * (F.col("r_regionkey") + 1) * 8.0
    r = r.withColumn("peak", F.least(F.lit(1.0), electrons / F.col("full_scale")))
    r = r.withColumn("width", F.greatest(F.sqrt(electrons + F.col("read_noise") * F.col("read_noise")) / F.col("full_scale"), F.lit(1.0 / 48)))
    bins = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda i: F.exp(-0.5 * F.pow(((i + 0.5) / 48.0 - F.col("peak")) / F.col("width"), F.lit(2.0))))
    r = r.withColumn("bins", bins)
    return r.select("r_regionkey", "iso", F.posexplode(F.transform("bins", lambda b: F.round(b / F.array_max("bins"), 6))).alias("bin", "height"))


def focus_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    samples = e.groupBy("user_id", (F.col("event_id") % 9 / 20.0).alias("diopters")).agg((F.max("value") / 20).alias("hfr"), F.count("*").alias("star_count"))
    return N.focus_sweep(samples, "user_id").withColumns({"best_diopters": F.round("best_diopters", 6), "best_hfr": F.round("best_hfr", 6)})


def lunar_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    ns = E.looney_eleven_ns(1.4 + F.col("p_size") / 20.0, 100 * (1 + F.col("p_partkey") % 8))
    probe = E.lunar_probe(F.col("ns"), F.col("p_partkey") % 120 / 100.0 - 0.05, F.when(F.col("p_partkey") % 9 == 0, 1).otherwise(0))
    return part.withColumn("ns", ns).withColumn("probe", probe).select("p_partkey", "ns", "probe.verdict", "probe.next_ns")


QUERIES = {
    "sky_coords": sky_coords, "sky_drift": sky_drift, "sky_field": sky_field, "moon_phase": moon_phase, "trailing_limit": trailing_limit, "compensation": compensation,
    "exposure_candidates": exposure_candidates, "exposure_choice": exposure_choice, "noise_bracket": noise_bracket, "dual_gain": dual_gain, "session_plan": session_plan,
    "predicted_histogram": predicted_histogram, "focus_sweep": focus_sweep, "lunar_exposure": lunar_exposure,
}
SUPPLIER = "o AS (SELECT s_suppkey, 0.8::DOUBLE + s_suppkey % 20 / 10.0::DOUBLE AS pitch, 4.0::DOUBLE + s_suppkey % 9 AS focal, CASE WHEN s_suppkey % 6 <> 0 THEN (s_suppkey * 13 % 89)::DOUBLE END AS dec FROM supplier)"
CANDIDATES = """WITH n(iso, fs, rn) AS (VALUES (400, 16000.0::DOUBLE, 5.0::DOUBLE), (800, 8000.0, 4.0), (1600, 4000.0, 3.4), (3200, 2000.0, 3.0)),
s AS (SELECT s_suppkey AS site, (s_acctbal + 1000) / 50 AS rate, CASE WHEN s_suppkey % 3 = 0 THEN 800 END AS dg FROM supplier),
a AS (SELECT site, iso, fs, rn, dg, rate, greatest(rate, 1e-6) AS r FROM s, n), b AS (SELECT *, 0.33::DOUBLE * fs / r AS clip, least(12.0, 0.33::DOUBLE * fs / r) AS secs FROM a),
c AS (SELECT *, rate * secs AS el FROM b),
t AS (SELECT site, iso, rn, 4.0 * rn * rn / r AS required_seconds, secs AS exposure_seconds, el / (rn * rn) AS sky_to_read, el / fs AS background, log2(fs / el) AS headroom_stops, clip < 12.0 AS clipping_limited,
  CASE WHEN dg IS NOT NULL AND iso < dg THEN 'BELOW_DUAL_GAIN' WHEN el >= 4.0 * (rn * rn) THEN 'SKY_LIMITED' ELSE 'READ_NOISE_LIMITED' END AS verdict FROM c)"""
BRAND = "WITH n AS (SELECT p_brand, p_size AS iso, min(p_retailprice) AS rn FROM part GROUP BY 1, 2)"
ORACLES = {
    "sky_coords": f"""{SQL}, r AS (SELECT *, radians(alt) AS a, radians(az) AS z, radians(lat) AS l, ms / 86400000.0::DOUBLE + 2440587.5::DOUBLE AS jd FROM p),
d AS (SELECT *, degrees(asin(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sin(a) * sin(l) + cos(a) * cos(l) * cos(z))))) AS dec, degrees(atan2(-sin(z) * cos(a) + 0.0, sin(a) * cos(l) - cos(a) * sin(l) * cos(z))) AS ha,
  18.697374558::DOUBLE + 24.06570982441908::DOUBLE * (jd - 2451545.0::DOUBLE) AS g FROM r),
e AS (SELECT *, g - 24.0 * floor(g / 24.0) + lon / 15.0 AS g2 FROM d), f AS (SELECT *, g2 - 24.0 * floor(g2 / 24.0) AS lst FROM e),
h AS (SELECT *, lst - ha / 15.0 AS ra0, floor(abs(dec) * 60.0 + 0.5)::BIGINT AS mins FROM f)
SELECT c_custkey, round(dec, 6) AS declination, round(ha, 6) AS hour_angle, round(lst, 5) AS lst, round(ra0 - 24.0 * floor(ra0 / 24.0), 5) AS right_ascension,
  round(15.041067::DOUBLE * cos(l) * cos(z) / cos(radians(greatest(-88.0, least(88.0, alt)))), 6) AS rotation, abs(alt) > 88 AS near_zenith,
  (['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])[(floor(az / 22.5 + 0.5)::INT % 16) + 1] AS compass,
  printf('%s%02d° %02d′', CASE WHEN dec < 0 THEN '-' ELSE '+' END, mins // 60, mins % 60) AS text FROM h""",
    "sky_field": f"""{SQL}, r AS (SELECT *, radians(alt) AS a, radians(az) AS z, radians(lat) AS l FROM p WHERE true),
d AS (SELECT *, sqrt(pow((sin(l) - cos(l) * cos(z) * tan(a)) * cos(a), 2) + pow(cos(l) * sin(z), 2)) AS share, abs(alt) <= 88 AS ok FROM r)
SELECT c_custkey, CASE WHEN ok THEN round(degrees(acos(least(1.0, share))), 6) END AS implied, abs(c_custkey % 5 - 2) <= 1.5 AND c_custkey % 6 IN (2, 3, 4) AS same FROM d""",
    "sky_drift": f"""{SQL}, r AS (SELECT *, radians(alt) AS a, radians(az) AS z, radians(lat) AS l, radians(c_custkey % 360) AS t FROM p WHERE true),
d AS (SELECT *, 15.041067::DOUBLE * (sin(l) - cos(l) * cos(z) * tan(a)) * cos(a) * 30.0 / 60.0 AS al, 15.041067::DOUBLE * cos(l) * sin(z) * 30.0 / 60.0 AS up, abs(alt) <= 88 AS ok FROM r)
SELECT c_custkey, CASE WHEN ok THEN round(15.041067::DOUBLE * cos(l) * cos(z) / cos(a) * 30.0 / 3600.0, 6) END AS rotation_deg, CASE WHEN ok THEN round(al * cos(t) - up * sin(t), 6) END AS dx, CASE WHEN ok THEN round(-(up * cos(t) + al * sin(t)), 6) END AS dy FROM d""",
    "moon_phase": """WITH d AS (SELECT o_orderkey, 297.8501921::DOUBLE + 12.19074912::DOUBLE * (epoch_ms(o_orderdate) / 86400000.0::DOUBLE + 2440587.5::DOUBLE - 2451545.0::DOUBLE) AS e0 FROM orders),
e AS (SELECT o_orderkey, e0 - 360.0 * floor(e0 / 360.0) AS e FROM d) SELECT o_orderkey, round((1.0 + cos(radians(180.0 - e))) / 2.0, 6) AS fraction, e < 180 AS waxing FROM e""",
    "trailing_limit": f"""WITH {SUPPLIER}, h AS (SELECT *, 206264.806::DOUBLE * pitch / (focal * 1000.0) AS scale, degrees(atan(sqrt(5.6::DOUBLE * 5.6 + 4.2::DOUBLE * 4.2) / 2.0 / focal)) AS half FROM o)
SELECT s_suppkey, round(scale, 6) AS scale, round(half, 6) AS half_field, round(1.5 * scale / (15.041067::DOUBLE * cos(radians(coalesce(CASE WHEN abs(dec) > half THEN abs(dec) - half ELSE 0.0 END, 0.0)))), 6) AS seconds FROM h""",
    "compensation": f"""WITH {SUPPLIER}, s AS (SELECT *, floor(greatest(-4.0, least(4.0, (s_suppkey % 23 - 11) / 2.3::DOUBLE)) / (1.0::DOUBLE / 6.0) + 0.5) * (1.0::DOUBLE / 6.0) AS stops FROM o),
t AS (SELECT *, pitch * pow(2.0::DOUBLE, stops) AS sub FROM s)
SELECT s_suppkey, round(stops, 9) AS stops, round(sub, 9) AS sub, round(CASE WHEN s_suppkey % 4 <> 0 AND sub > 3.0 THEN sub * 2.6::DOUBLE ELSE sub + 0.25::DOUBLE END, 9) AS cost FROM t""",
    "exposure_candidates": f"{CANDIDATES} SELECT site, iso, round(required_seconds, 9) AS required_seconds, round(exposure_seconds, 9) AS exposure_seconds, round(sky_to_read, 9) AS sky_to_read, round(background, 9) AS background, round(headroom_stops, 9) AS headroom_stops, clipping_limited, verdict FROM t",
    "exposure_choice": f"""{CANDIDATES}, u AS (SELECT *, min(rn) OVER (PARTITION BY site) AS quiet, bool_or(verdict = 'SKY_LIMITED') OVER (PARTITION BY site) AS any_good FROM t WHERE verdict <> 'BELOW_DUAL_GAIN')
SELECT site, iso, round(exposure_seconds, 6) AS exposure_seconds, verdict FROM u WHERE CASE WHEN any_good THEN verdict = 'SKY_LIMITED' ELSE rn <= quiet * 1.1 END
QUALIFY row_number() OVER (PARTITION BY site ORDER BY CASE WHEN any_good THEN -round_even(headroom_stops * 10, 0) END, CASE WHEN any_good THEN -exposure_seconds END, iso) = 1""",
    "noise_bracket": f"""{BRAND}, k AS (SELECT * FROM n WHERE iso <= 40 AND NOT iso BETWEEN 11 AND 25),
j AS (SELECT n.p_brand, n.iso, max(k.iso) FILTER (WHERE k.iso < n.iso) AS below, min(k.iso) FILTER (WHERE k.iso > n.iso) AS above, arg_max(k.rn, k.iso) FILTER (WHERE k.iso < n.iso) AS rb, arg_min(k.rn, k.iso) FILTER (WHERE k.iso > n.iso) AS ra,
  max(k.rn) FILTER (WHERE k.iso = n.iso) AS rs, arg_min(k.iso, abs(k.iso - n.iso) * 1000 + k.iso) AS nearest FROM n JOIN k ON n.p_brand = k.p_brand GROUP BY 1, 2)
SELECT p_brand, iso, below, above, round(coalesce(rs, rb + (ra - rb) * (ln(iso) - ln(below)) / (ln(above) - ln(below)), rb, ra), 6) AS read_noise, nearest FROM j""",
    "dual_gain": f"{BRAND}, l AS (SELECT *, lag(rn) OVER (PARTITION BY p_brand ORDER BY iso) AS prev FROM n) SELECT p_brand, min(iso) FILTER (WHERE prev > 0 AND prev / rn >= 1.05::DOUBLE) AS dual_gain_iso FROM l GROUP BY 1",
    "session_plan": f"""{SQL}, a AS (SELECT *, (1 + c_custkey % 30)::DOUBLE AS sub, c_acctbal + 1200.0 AS secs FROM p), b AS (SELECT *, sub + 0.5 AS per, floor(secs / (sub + 0.5))::BIGINT AS most FROM a),
c AS (SELECT *, greatest(CASE c_custkey % 3 WHEN 0 THEN ceil(secs / sub)::BIGINT WHEN 1 THEN coalesce(list_max(list_filter(range(most - 30, most - 9), lambda n: (n + greatest(10, least(30, floor(n * 0.15::DOUBLE + 0.5)))) * per <= secs)), 1) ELSE c_custkey % 400 END, 1) AS lights FROM b),
d AS (SELECT *, greatest(10, least(30, floor(lights * 0.15::DOUBLE + 0.5)))::BIGINT AS darks FROM c), e AS (SELECT *, (lights + darks) * per AS total, (lights + darks) * 25195876 AS bytes FROM d),
f AS (SELECT *, abs(15.041067::DOUBLE * cos(radians(lat)) * cos(radians(az)) / cos(radians(greatest(-88.0, least(88.0, alt))))) * total / 3600.0 AS turn FROM e), g AS (SELECT *, radians(turn) AS t FROM f),
h AS (SELECT *, least(3072.0::DOUBLE / (4096.0::DOUBLE * sin(t) + 3072.0::DOUBLE * cos(t)), 4096.0::DOUBLE / (4096.0::DOUBLE * cos(t) + 3072.0::DOUBLE * sin(t))) AS s FROM g),
i AS (SELECT *, CASE WHEN t <= 0 THEN 1.0 WHEN turn >= 90 THEN 0.0 ELSE greatest(0.0, least(1.0, s * s)) END::DOUBLE AS area, c_custkey * 1000000000 % 50000000000 - 524288000 AS free FROM h)
SELECT c_custkey, lights::BIGINT AS lights, darks, round(total, 6) AS total, bytes::BIGINT AS bytes, round(area, 6) AS common_area, CASE WHEN bytes > free THEN 'BLOCK' WHEN bytes > free * 0.8::DOUBLE THEN 'WARN' ELSE 'OK' END AS storage,
  CASE WHEN total / 3600.0 * 18.0 > c_custkey % 100 THEN 'BLOCK' WHEN total / 3600.0 * 18.0 > (c_custkey % 100) * 0.8::DOUBLE THEN 'WARN' ELSE 'OK' END AS battery, CASE WHEN area < 0.8 THEN 'WARN' ELSE 'OK' END AS rotation FROM i""",
    "predicted_histogram": """WITH n(iso, fs, rn) AS (VALUES (400, 16000.0::DOUBLE, 5.0::DOUBLE), (800, 8000.0, 4.0), (1600, 4000.0, 3.4), (3200, 2000.0, 3.0)),
a AS (SELECT r_regionkey, iso, fs, rn, 40.0::DOUBLE * (r_regionkey + 1) * 8.0 AS el FROM region, n), b AS (SELECT *, least(1.0, el / fs) AS peak, greatest(sqrt(el + rn * rn) / fs, 1.0::DOUBLE / 48) AS width FROM a),
c AS (SELECT r_regionkey, iso, peak, width, unnest(range(0, 48)) AS bin FROM b), d AS (SELECT *, exp(-0.5 * pow(((bin + 0.5::DOUBLE) / 48.0 - peak) / width, 2)) AS h FROM c)
SELECT r_regionkey, iso, bin::INT AS bin, round(h / max(h) OVER (PARTITION BY r_regionkey, iso), 6) AS height FROM d""",
    "focus_sweep": """WITH s AS (SELECT user_id, event_id % 9 / 20.0::DOUBLE AS d, max(value) / 20 AS h, count(*) AS n FROM events GROUP BY 1, 2), v AS (SELECT * FROM s WHERE h > 0 AND n >= 5),
u AS (SELECT DISTINCT user_id FROM s), g AS (SELECT u.user_id, list(d ORDER BY d) FILTER (WHERE d IS NOT NULL) AS ds, list(h ORDER BY d) FILTER (WHERE d IS NOT NULL) AS hs FROM u LEFT JOIN v ON u.user_id = v.user_id GROUP BY 1),
i AS (SELECT *, coalesce(len(hs), 0) AS n, list_position(hs, list_min(hs)) AS i FROM g),
w AS (SELECT *, CASE WHEN n < 3 THEN 'TOO_FEW_STARS' WHEN (list_max(hs) - list_min(hs)) / list_min(hs) < 0.05 THEN 'FLAT' WHEN i = 1 OR i = n THEN 'MINIMUM_AT_EDGE' ELSE 'CLEAR_MINIMUM' END AS verdict FROM i),
x AS (SELECT *, ds[i - 1] AS x0, ds[i] AS x1, ds[i + 1] AS x2, hs[i - 1] AS y0, hs[i] AS y1, hs[i + 1] AS y2 FROM w),
y AS (SELECT *, (x0 - x1) * (x0 - x2) * (x1 - x2) AS den FROM x), z AS (SELECT *, (x2 * (y1 - y0) + x1 * (y0 - y2) + x0 * (y2 - y1)) / den AS a, (x2 * x2 * (y0 - y1) + x1 * x1 * (y2 - y0) + x0 * x0 * (y1 - y2)) / den AS b FROM y)
SELECT user_id, round(CASE WHEN verdict = 'CLEAR_MINIMUM' THEN CASE WHEN abs(a) > 1e-12 THEN -b / (2 * a) ELSE x1 END ELSE coalesce(x1, 0.0) END, 6) AS best_diopters, round(y1, 6) AS best_hfr, verdict FROM z""",
    "lunar_exposure": """WITH a AS (SELECT p_partkey, greatest(floor(pow((1.4::DOUBLE + p_size / 20.0::DOUBLE) / 11.0, 2) / (100 * (1 + p_partkey % 8)) * 1e9 + 0.5), 1)::BIGINT AS ns, greatest(0.0, least(1.0, p_partkey % 120 / 100.0::DOUBLE - 0.05::DOUBLE)) AS f, p_partkey % 9 = 0 AS clip FROM part),
b AS (SELECT *, CASE WHEN clip THEN 1.0::DOUBLE / 16 WHEN f <= 0 THEN 64.0::DOUBLE ELSE greatest(1.0::DOUBLE / 64, least(64.0::DOUBLE, 0.7::DOUBLE / f)) END AS sc, NOT clip AND f >= 0.6::DOUBLE AND f <= 0.8::DOUBLE AS ok FROM a)
SELECT p_partkey, ns, CASE WHEN clip THEN 'CLIPPED' WHEN ok THEN 'SETTLED' WHEN f < 0.6::DOUBLE THEN 'DIM' ELSE 'BRIGHT' END AS verdict, CASE WHEN NOT ok THEN greatest(floor(ns * sc + 0.5), 1)::BIGINT END AS next_ns FROM b""",
}
