"""Star and plane queries. Stars are embeddings (frame = label, x, y = the first two parts times 1000, flux = the third); the plane is
lineitem (x = l_partkey % 64, y = l_suppkey % 48)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.operators import components
from nightloom.operators import geometry as G
from nightloom.operators import planes as P
from nightloom.operators import registration as R


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    part = lambda i: F.col("embedding")[i].cast("double")
    return e.select(F.col("label").cast("long").alias("frame"), F.col("vec_id").alias("star"), (part(0) * 1000).alias("x"), (part(1) * 1000).alias("y"), part(2).alias("flux"), (part(3) * 1000).alias("u"), (part(4) * 1000).alias("v"))


STARS = "WITH s AS (SELECT label::BIGINT AS frame, vec_id AS star, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, embedding[3]::DOUBLE AS flux, embedding[4]::DOUBLE * 1000 AS u, embedding[5]::DOUBLE * 1000 AS v FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY flux DESC, star) AS rank FROM s)"


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = _stars(spark, sf_dir)
    return s.where("frame = 0"), s.where("frame > 0")


def brightest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.brightest(_stars(spark, sf_dir)).select("frame", "star", "rank")


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.triangles(_stars(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("ratio_long", "ratio_short")})


def triangle_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, tgt = _two(spark, sf_dir)
    return G.triangle_votes(G.triangles(ref), G.triangles(tgt))


def asterism_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame 0 against itself turned and moved, and against the other frames."""
    ref, tgt = _two(spark, sf_dir)
    m = G.rigid_apply(F.col("x"), F.col("y"), F.lit(8.25), F.lit(12.0), F.lit(40.0))
    moved = ref.withColumn("m", m).withColumns({"frame": F.lit(-1).cast("long"), "x": F.col("m.x"), "y": F.col("m.y")}).drop("m")
    return G.asterism_matches(G.triangles(ref), G.triangles(tgt.unionByName(moved)))


def vote_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.offset_votes(*_two(spark, sf_dir), bin_px=20.0, least=2)
    return out.withColumns({"dx": F.round("dx", 6), "dy": F.round("dy", 6)})


def seed_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.seed_matches(*_two(spark, sf_dir), 0.5, 3.0, -2.0).withColumn("distance", F.round("distance", 6))


def procrustes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.procrustes(_stars(spark, sf_dir), "frame").withColumns({c: F.round(c, 6) for c in ("rotation_deg", "dx", "dy")})


def rigid_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = G.rigid_apply(F.col("x"), F.col("y"), F.lit(8.25), F.lit(12.0), F.lit(40.0))
    s = _stars(spark, sf_dir).withColumn("m", m)
    back = G.rigid_invert(F.col("m.x"), F.col("m.y"), F.lit(8.25), F.lit(12.0), F.lit(40.0))
    return s.withColumn("b", back).select("star", F.round("m.x", 6).alias("mx"), F.round("m.y", 6).alias("my"), ((F.abs(F.col("b.x") - F.col("x")) < 1e-9) & (F.abs(F.col("b.y") - F.col("y")) < 1e-9)).alias("returns"))


def drift_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.drift_fit(_stars(spark, sf_dir), "frame", "star").withColumns({c: F.round(c, 6) for c in ("vx", "vy", "x0", "y0")})


def rigid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the brightest stars with themselves, turned by the frame's number of degrees and moved, every fourth one wrong."""
    s = G.brightest(_stars(spark, sf_dir))
    m = G.rigid_apply(F.col("x"), F.col("y"), F.col("frame").cast("double"), F.lit(12.0), F.lit(40.0))
    wrong = F.when(F.col("rank") % 4 == 0, F.lit(50.0) + F.col("rank")).otherwise(F.lit(0.0))
    got = R.rigid_fit(s.withColumn("m", m).select("frame", "x", "y", (F.col("m.x") + wrong).alias("u"), F.col("m.y").alias("v")))
    return got.withColumns({c: F.round(c, 6) for c in ("rotation_deg", "dx", "dy")})


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumns({"x": F.col("l_partkey") % 64, "y": F.col("l_suppkey") % 48})


def _plane(spark: SparkSession, sf_dir: str, value: str = "avg(l_quantity)", where: str = "true") -> DataFrame:
    return _lines(spark, sf_dir).where(where).groupBy("x", "y").agg(F.expr(value).alias("v"))


PLANE = "p AS (SELECT l_partkey % 64 AS x, l_suppkey % 48 AS y, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
HOLES = "l_returnflag = 'R' AND l_linenumber = 1 AND l_quantity > 25"


def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    light = _plane(spark, sf_dir, "max(l_extendedprice)")
    dark = _plane(spark, sf_dir, "median(l_quantity)", "l_returnflag = 'A' AND l_quantity > 20").withColumnRenamed("v", "dark")
    flat = P.normalise_flat(_plane(spark, sf_dir, "avg(l_discount)")).select("x", "y", "gain")
    joined = light.join(dark, ["x", "y"], "left").join(flat, ["x", "y"], "left")
    return joined.select("x", "y", F.round(P.calibrate(F.col("v"), F.col("dark"), F.col("gain"), F.lit(64.0)), 4).alias("v"))


def flat_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.normalise_flat(_plane(spark, sf_dir)).select("x", "y", F.round("gain", 9).alias("gain"))


def hot_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.hot_pixels(_plane(spark, sf_dir, "sum(l_quantity)"), 2.5)


def green_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.green_bins(_plane(spark, sf_dir, "sum(l_quantity)"), 4).withColumn("v", F.round("v", 6))


def tile_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tile_medians(_plane(spark, sf_dir), 16).withColumn("median", F.round("median", 6))


def background_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.background_level(_plane(spark, sf_dir), 8).withColumn("level", F.round("level", 6))


def gradient_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tile_percentiles(_plane(spark, sf_dir), 16).withColumn("v", F.round("v", 6))


def coverage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.coverage_rows(_plane(spark, sf_dir, where=HOLES), 64)


def worst_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.worst_rows(coverage_rows(spark, sf_dir), 64)


def preview_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.preview_stretch(_plane(spark, sf_dir), 64)


def mtf_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.autostretch(_plane(spark, sf_dir), 0.0, 64.0).select("x", "y", F.round("stretched", 6).alias("stretched"))


def disc_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    bright = F.when(F.hypot(F.col("x") - 30, F.col("y") - 20) <= 6, F.lit(900.0)).otherwise(F.lit(0.0))
    p = _plane(spark, sf_dir).withColumns({"v": F.col("v") + bright, "frame": F.lit(0)})
    return P.disc(p, ["frame"]).withColumns({c: F.round(c, 6) for c in ("centroid_x", "centroid_y", "peak", "background")})


def sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sharpness(_plane(spark, sf_dir)).withColumn("sharpness", F.round("sharpness", 6))


def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    moon = _plane(spark, sf_dir, "max(l_quantity)")
    return P.composite(_plane(spark, sf_dir), moon, 30.0, 20.0, 9.0, 3.4, -2.6, 1.5).withColumn("v", F.round("v", 6))


def gradient_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane with a slope added, less its fitted gradient; what is left of the slope shows in the tiles' levels."""
    p = _plane(spark, sf_dir).withColumn("v", F.col("v") + F.col("x") * 2.0 + F.col("y") * 0.5)
    tiles = P.tile_percentiles(p, 8).select((F.col("tx") * 8 + 4).alias("x"), (F.col("ty") * 8 + 4).alias("y"), "v")
    fit = P.fit_gradient(tiles, 64.0, 48.0, 2)
    return P.tile_medians(P.subtract_gradient(p, fit, 64.0, 48.0, 2), 16)


def largest_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = _plane(spark, sf_dir)
    holes = _plane(spark, sf_dir, "1.0", "l_quantity > 49 AND l_returnflag = 'R'").select("x", "y", F.lit(1).alias("hole"))
    c = full.join(holes, ["x", "y"], "left").select(F.lit(0).cast("long").alias("frame"), "x", "y", F.when(F.col("hole").isNull(), 1.0).otherwise(0.0).alias("v"))
    return R.largest_covered(c, "frame")


AREA_WIDTH, AREA_HEIGHT = 512.0, 384.0


def area_motions(e: DataFrame) -> DataFrame:
    """A motion for each event; errors have none."""
    turn = F.when(F.col("event_type") != "error", F.col("value") / 100)
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("idx"), turn.alias("rotation_deg"), (F.col("event_id") % 40 - 20.0).alias("dx"), (F.col("event_id") % 30 - 15.0).alias("dy"))


def common_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.common_area(area_motions(spark.read.parquet(f"{sf_dir}/events.parquet")), AREA_WIDTH, AREA_HEIGHT).withColumn("fraction", F.round("fraction", 6))


def phase_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane against itself moved around by the frame's number of pixels."""
    p = _plane(spark, sf_dir)
    frames = p.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(F.col("frame").cast("long").alias("frame"), ((F.col("x") + F.col("frame")) % 64).alias("x"), ((F.col("y") + 2 * F.col("frame")) % 48).alias("y"), "v")
    got = R.phase_correlation(frames.join(p.withColumnRenamed("v", "w"), ["x", "y"]))
    return got.select("frame", F.round("dx").cast("long").alias("dx"), F.round("dy").cast("long").alias("dy"), "accepted")


def detect_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _lines(spark, sf_dir).groupBy(F.col("l_linenumber").cast("long").alias("frame"), "x", "y").agg(F.avg("l_extendedprice").alias("v"))
    return R.detect_stars(p, 1.5)


def tiled_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of bright cells of seven frames, labelled in tiles of 16, with their moments."""
    p = _lines(spark, sf_dir).groupBy(F.col("l_linenumber").cast("long").alias("frame"), "x", "y").agg(F.avg("l_quantity").alias("v"))
    got = components.star_moments(p.where("v > 40").select("frame", "x", "y", (F.col("v") - 25).alias("w")), 16)
    return got.select("frame", "component", "n", *[F.round(c, 5).alias(c) for c in ("flux", "x", "y", "hfr", "eccentricity")])


QUERIES = {
    "tiled_stars": tiled_stars,
    "brightest_k": brightest_k, "triangles": triangles, "triangle_band_join": triangle_band_join, "asterism_match": asterism_match, "vote_offset": vote_offset, "seed_nearest": seed_nearest,
    "procrustes": procrustes, "rigid_apply": rigid_apply, "drift_fit": drift_fit, "rigid_fit": rigid_fit, "calibrate": calibrate, "flat_normalise": flat_normalise, "hot_pixels": hot_pixels,
    "green_bin": green_bin, "tile_background": tile_background, "background_level": background_level, "gradient_tiles": gradient_tiles, "coverage_rows": coverage_rows, "worst_rows": worst_rows,
    "preview_stretch": preview_stretch, "mtf_stretch": mtf_stretch, "disc_centroid": disc_centroid, "sharpness": sharpness, "composite": composite, "gradient_fit": gradient_fit, "largest_rectangle": largest_rectangle,
    "common_area": common_area, "phase_correlation": phase_correlation, "detect_stars": detect_stars,
}
TRIANGLES = STARS + """, t0 AS (SELECT a.frame, list_sort([
  {'d': sqrt(pow(b.x - c.x, 2) + pow(b.y - c.y, 2)), 'n': 0, 'v': {'star': a.star, 'x': a.x, 'y': a.y}}, {'d': sqrt(pow(c.x - a.x, 2) + pow(c.y - a.y, 2)), 'n': 1, 'v': {'star': b.star, 'x': b.x, 'y': b.y}},
  {'d': sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 'n': 2, 'v': {'star': c.star, 'x': c.x, 'y': c.y}}]) AS s FROM k a JOIN k b ON a.frame = b.frame AND a.rank < b.rank JOIN k c ON a.frame = c.frame AND b.rank < c.rank WHERE c.rank <= 30),
t1 AS (SELECT frame, s[1].v AS v0, s[2].v AS v1, s[3].v AS v2, s[1].d AS d0, s[2].d AS d1, s[3].d AS d2 FROM t0),
t2 AS (SELECT *, (v1.x - v0.x) * (v2.y - v0.y) - (v1.y - v0.y) * (v2.x - v0.x) AS cr FROM t1),
t AS (SELECT frame, v0.star AS v0, v1.star AS v1, v2.star AS v2, d2 / d0 AS rl, d1 / d0 AS rs, cr < 0 AS clockwise FROM t2 WHERE d0 >= 5 AND d2 <= 10 * d0 AND abs(cr) >= 25)"""
# Clips by one edge of one frame after the other.
SIDE = "((h.bx - h.ax) * ({p}.y - h.ay) - (h.by_ - h.ay) * ({p}.x - h.ax))"
AREA = f"""WITH RECURSIVE m AS (SELECT user_id AS session, event_id AS idx, event_type <> 'error' AS known, -radians(value / 100) AS t, event_id % 40 - 20.0::DOUBLE AS dx, event_id % 30 - 15.0::DOUBLE AS dy FROM events),
c(e, x0, y0, x1, y1) AS (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, {AREA_WIDTH}::DOUBLE, 0.0::DOUBLE), (1, {AREA_WIDTH}, 0.0, {AREA_WIDTH}, {AREA_HEIGHT}), (2, {AREA_WIDTH}, {AREA_HEIGHT}, 0.0, {AREA_HEIGHT}), (3, 0.0, {AREA_HEIGHT}, 0.0, 0.0)),
h AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY idx, e) AS k, (x0 - dx) * cos(t) - (y0 - dy) * sin(t) AS ax, (x0 - dx) * sin(t) + (y0 - dy) * cos(t) AS ay, (x1 - dx) * cos(t) - (y1 - dy) * sin(t) AS bx, (x1 - dx) * sin(t) + (y1 - dy) * cos(t) AS by_
  FROM m CROSS JOIN c WHERE known),
r AS (SELECT DISTINCT user_id AS session, 0::BIGINT AS k, [{{'x': 0.0::DOUBLE, 'y': 0.0::DOUBLE}}, {{'x': {AREA_WIDTH}::DOUBLE, 'y': 0.0::DOUBLE}}, {{'x': {AREA_WIDTH}::DOUBLE, 'y': {AREA_HEIGHT}::DOUBLE}}, {{'x': 0.0::DOUBLE, 'y': {AREA_HEIGHT}::DOUBLE}}] AS p FROM events
  UNION ALL
  SELECT r.session, h.k, flatten(list_transform(range(1, len(p) + 1), lambda i: list_concat(CASE WHEN {SIDE.format(p="p[i]")} >= 0 THEN [p[i]] ELSE [] END,
    CASE WHEN ({SIDE.format(p="p[i]")} >= 0) <> ({SIDE.format(p="p[i % len(p) + 1]")} >= 0) THEN [{{'x': p[i].x + (p[i % len(p) + 1].x - p[i].x) * {SIDE.format(p="p[i]")} / ({SIDE.format(p="p[i]")} - {SIDE.format(p="p[i % len(p) + 1]")}),
      'y': p[i].y + (p[i % len(p) + 1].y - p[i].y) * {SIDE.format(p="p[i]")} / ({SIDE.format(p="p[i]")} - {SIDE.format(p="p[i % len(p) + 1]")})}}] ELSE [] END))) FROM r JOIN h ON h.session = r.session AND h.k = r.k + 1),
z AS (SELECT session, arg_max(p, k) AS p FROM r GROUP BY 1), n AS (SELECT session, count(*) AS frames FROM m GROUP BY 1)
SELECT session, frames, round(coalesce(abs(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i].x * p[i % len(p) + 1].y - p[i].y * p[i % len(p) + 1].x))) / 2, 0.0) / {AREA_WIDTH * AREA_HEIGHT}, 6)::DOUBLE AS fraction FROM z JOIN n USING (session)"""
MATCHES = f"""{TRIANGLES.replace("FROM embeddings)", "FROM embeddings), s9 AS (SELECT * FROM s UNION ALL SELECT -1, star, x * cos(radians(8.25::DOUBLE)) - y * sin(radians(8.25::DOUBLE)) + 12, x * sin(radians(8.25::DOUBLE)) + y * cos(radians(8.25::DOUBLE)) + 40, flux, u, v FROM s WHERE frame = 0)").replace("AS rank FROM s)", "AS rank FROM s9)")},
m AS (SELECT b.frame, unnest([a.v0, a.v1, a.v2]) AS ref, unnest([b.v0, b.v1, b.v2]) AS tgt FROM t a JOIN t b ON a.frame = 0 AND b.frame <> 0 AND a.clockwise = b.clockwise AND abs(b.rl - a.rl) <= 0.02::DOUBLE AND abs(b.rs - a.rs) <= 0.02::DOUBLE),
w AS (SELECT frame, ref, tgt, count(*)::BIGINT AS votes FROM m GROUP BY 1, 2, 3), q AS (SELECT ref, count(*) AS chances FROM (SELECT unnest([v0, v1, v2]) AS ref FROM t WHERE frame = 0) GROUP BY 1),
f AS (SELECT w.* FROM w JOIN q USING (ref) WHERE votes >= 2 AND votes >= chances * 0.25::DOUBLE QUALIFY row_number() OVER (PARTITION BY frame, ref ORDER BY votes DESC, tgt) = 1)
SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY frame, tgt ORDER BY votes DESC, ref) = 1"""
ORACLES = {
    "tiled_stars": """WITH RECURSIVE c AS (SELECT l_linenumber::BIGINT AS frame, l_partkey % 64 AS x, l_suppkey % 48 AS y, avg(l_quantity) - 25 AS w FROM lineitem GROUP BY 1, 2, 3 HAVING avg(l_quantity) > 40),
r AS (SELECT frame, x, y, x AS cx, y AS cy FROM c UNION SELECT r.frame, r.x, r.y, n.x, n.y FROM r JOIN c n ON n.frame = r.frame AND abs(n.x - r.cx) <= 1 AND abs(n.y - r.cy) <= 1),
k AS (SELECT frame, x, y, min(cy * 4294967296 + cx) AS component FROM r GROUP BY 1, 2, 3), d AS (SELECT * FROM c JOIN k USING (frame, x, y)),
s AS (SELECT frame, component, count(*) AS n, sum(w) AS flux, sum(x * w) / sum(w) AS mx, sum(y * w) / sum(w) AS my FROM d GROUP BY 1, 2 HAVING count(*) BETWEEN 3 AND 2000 AND sum(w) > 0),
m AS (SELECT frame, component, n, flux, mx, my, sum(w * sqrt(pow(x - mx, 2) + pow(y - my, 2))) / flux AS hfr, sum(w * pow(x - mx, 2)) / flux AS a, sum(w * (x - mx) * (y - my)) / flux AS b, sum(w * pow(y - my, 2)) / flux AS e FROM d JOIN s USING (frame, component) GROUP BY 1, 2, 3, 4, 5, 6),
t AS (SELECT *, sqrt(pow((a - e) / 2, 2) + b * b) AS root FROM m)
SELECT frame, component, n, round(flux, 5) AS flux, round(mx, 5) AS x, round(my, 5) AS y, round(hfr, 5) AS hfr, round(CASE WHEN (a + e) / 2 + root > 0 THEN sqrt(1 - greatest(0.0, (a + e) / 2 - root) / ((a + e) / 2 + root)) ELSE 1.0 END, 5) AS eccentricity FROM t""",
    "preview_stretch": f"""WITH {PLANE}, a AS (SELECT list(v ORDER BY v) AS s FROM p WHERE (y * 64 + x) % 16 = 0), m AS (SELECT s, s[len(s) // 2 + 1] AS m FROM a), d AS (SELECT m, list_sort(list_transform(s, lambda v: abs(v - m))) AS d FROM m),
h AS (SELECT max(v) AS hi, min(v) AS lo FROM p), l AS (SELECT m, hi, CASE WHEN 1.4826::DOUBLE * d[len(d) // 2 + 1] > 1e-6 THEN m - 2.0 * 1.4826::DOUBLE * d[len(d) // 2 + 1] ELSE lo END AS low FROM d, h),
n AS (SELECT *, CASE WHEN hi - low > 1e-6 THEN hi - low ELSE 1.0 END AS span FROM l), k AS (SELECT *, greatest(1e-4, least(1 - 1e-4, (m - low) / span)) AS sky FROM n),
t AS (SELECT *, CASE WHEN abs(0.5::DOUBLE * sky - 0.25 - sky) < 1e-9 THEN 0.5 ELSE greatest(1e-4, least(1 - 1e-4, sky * (0.25::DOUBLE - 1.0) / (0.5::DOUBLE * sky - 0.25 - sky))) END AS mid FROM k),
q AS (SELECT x, y, greatest(0.0, least(1.0, (v - low) / span)) AS n, mid FROM p, t)
SELECT x, y, floor(CASE WHEN n <= 0 THEN 0.0 WHEN n >= 1 THEN 1.0 ELSE (mid - 1.0) * n / ((2.0 * mid - 1.0) * n - mid) END * 255.0 + 0.5)::INT AS grey FROM q""",
    "common_area": AREA, "asterism_match": MATCHES,
    # What was planted: every match but each fourth moves as the frame does.
    "rigid_fit": f"{STARS} SELECT frame, frame::DOUBLE AS rotation_deg, 12.0::DOUBLE AS dx, 40.0::DOUBLE AS dy, count(*) FILTER (WHERE rank % 4 <> 0)::BIGINT AS inliers, count(*)::BIGINT AS pairs FROM k WHERE rank <= 30 GROUP BY 1",
    "phase_correlation": "SELECT range AS frame, range AS dx, 2 * range AS dy, true AS accepted FROM range(6)",
    # All spans of rows: columns that are covered in the whole span, and their longest runs. Ties as in the operator: the first bottom, then right edge, the taller.
    "largest_rectangle": f"""WITH {PLANE}, h AS (SELECT DISTINCT l_partkey % 64 AS x, l_suppkey % 48 AS y FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R'),
c AS (SELECT x, y FROM p ANTI JOIN h USING (x, y)), u AS (SELECT x, y, y - row_number() OVER (PARTITION BY x ORDER BY y) AS g FROM c), k AS (SELECT x, y AS bottom, y - min(y) OVER (PARTITION BY x, g) + 1 AS tall FROM u),
s AS (SELECT x, bottom, unnest(range(1, tall + 1)) AS height FROM k), r AS (SELECT *, x - row_number() OVER (PARTITION BY bottom, height ORDER BY x) AS g FROM s),
a AS (SELECT bottom, height, min(x) AS x0, max(x) AS x1 FROM r GROUP BY bottom, height, g)
SELECT 0::BIGINT AS frame, x0::BIGINT AS "left", (bottom - height + 1)::BIGINT AS top, (x1 - x0 + 1)::BIGINT AS width, height::BIGINT AS height FROM a ORDER BY (x1 - x0 + 1) * height DESC, bottom, x1, height DESC LIMIT 1""",
    "brightest_k": f"{STARS} SELECT frame, star, rank FROM k WHERE rank <= 30",
    "triangles": f"{TRIANGLES} SELECT frame, v0, v1, v2, round(rl, 6) AS ratio_long, round(rs, 6) AS ratio_short, clockwise FROM t",
    "triangle_band_join": f"{TRIANGLES}, m AS (SELECT b.frame, unnest([a.v0, a.v1, a.v2]) AS ref, unnest([b.v0, b.v1, b.v2]) AS tgt FROM t a JOIN t b ON a.frame = 0 AND b.frame > 0 AND a.clockwise = b.clockwise AND abs(b.rl - a.rl) <= 0.02::DOUBLE AND abs(b.rs - a.rs) <= 0.02::DOUBLE) SELECT frame, ref, tgt, count(*)::BIGINT AS votes FROM m GROUP BY 1, 2, 3",
    "vote_offset": f"""{STARS}, d AS (SELECT b.frame, b.x - a.x AS dx, b.y - a.y AS dy FROM k a JOIN k b ON a.frame = 0 AND b.frame > 0 AND a.rank <= 25 AND b.rank <= 25),
g AS (SELECT frame, floor(dx / 20 + 0.5) AS bx, floor(dy / 20 + 0.5) AS by_, count(*) AS votes, avg(dx) AS dx, avg(dy) AS dy FROM d GROUP BY 1, 2, 3)
SELECT frame, round(dx, 6) AS dx, round(dy, 6) AS dy, votes::BIGINT AS votes FROM g QUALIFY row_number() OVER (PARTITION BY frame ORDER BY votes DESC, bx, by_) = 1 AND votes >= 2""",
    "seed_nearest": f"""{STARS}, r AS (SELECT star AS ref, rank AS rr, x * cos(radians(0.5)) - y * sin(radians(0.5)) + 3 AS px, x * sin(radians(0.5)) + y * cos(radians(0.5)) - 2 AS py FROM k WHERE frame = 0 AND rank <= 30),
d AS (SELECT k.frame, ref, rr, k.star AS tgt, k.rank, sqrt(pow(k.x - px, 2) + pow(k.y - py, 2)) AS distance FROM k, r WHERE k.frame > 0 AND k.rank <= 30),
e AS (SELECT *, row_number() OVER w AS n, lead(distance) OVER w AS second FROM d WINDOW w AS (PARTITION BY frame, ref ORDER BY distance, rank)),
f AS (SELECT * FROM e WHERE n = 1 AND distance <= 8 AND (second IS NULL OR distance < second * 0.6::DOUBLE))
SELECT frame, ref, tgt, round(distance, 6) AS distance FROM f QUALIFY row_number() OVER (PARTITION BY frame, tgt ORDER BY rr) = 1""",
    "procrustes": f"""{STARS}, m AS (SELECT frame, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM s GROUP BY 1),
c AS (SELECT frame, count(*)::BIGINT AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv, atan2(sum((x - mx) * (v - mv) - (y - my) * (u - mu)), sum((x - mx) * (u - mu) + (y - my) * (v - mv))) AS t FROM s JOIN m USING (frame) GROUP BY 1)
SELECT frame, n, round(degrees(t), 6) AS rotation_deg, round(mu - (mx * cos(t) - my * sin(t)), 6) AS dx, round(mv - (mx * sin(t) + my * cos(t)), 6) AS dy FROM c""",
    "rigid_apply": f"{STARS} SELECT star, round(x * cos(radians(8.25)) - y * sin(radians(8.25)) + 12, 6) AS mx, round(x * sin(radians(8.25)) + y * cos(radians(8.25)) + 40, 6) AS my, true AS returns FROM s",
    "drift_fit": f"{STARS} SELECT frame, count(*)::BIGINT AS n, round(regr_slope(x, star), 6) AS vx, round(regr_slope(y, star), 6) AS vy, round(avg(x), 6) AS x0, round(avg(y), 6) AS y0 FROM s GROUP BY 1",
    "calibrate": """WITH l AS (SELECT l_partkey % 64 AS x, l_suppkey % 48 AS y, max(l_extendedprice) AS v, avg(l_discount) AS f FROM lineitem GROUP BY 1, 2),
d AS (SELECT l_partkey % 64 AS x, l_suppkey % 48 AS y, median(l_quantity) AS dark FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 20 GROUP BY 1, 2), m AS (SELECT avg(f) FILTER (WHERE f > 0) AS mean FROM l)
SELECT l.x, l.y, round(CASE WHEN f / mean > 0.05::DOUBLE THEN (v - coalesce(dark, 64.0)) / (f / mean) END, 4) AS v FROM l CROSS JOIN m LEFT JOIN d ON l.x = d.x AND l.y = d.y""",
    "flat_normalise": f"WITH {PLANE}, m AS (SELECT avg(v) FILTER (WHERE v > 0) AS mean FROM p) SELECT x, y, round(v / mean, 9) AS gain FROM p, m",
    "hot_pixels": """WITH p AS (SELECT l_partkey % 64 AS x, l_suppkey % 48 AS y, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), a AS (SELECT list(v ORDER BY v) AS s FROM p), m AS (SELECT s[len(s) // 2 + 1] AS m, s FROM a),
d AS (SELECT m, list_sort(list_transform(s, lambda v: abs(v - m))) AS d FROM m), t AS (SELECT m + 2.5::DOUBLE * greatest(1.4826::DOUBLE * d[len(d) // 2 + 1], 0.5) AS t FROM d) SELECT x, y, v FROM p, t WHERE v > t""",
    "green_bin": "WITH p AS (SELECT l_partkey % 64 AS x, l_suppkey % 48 AS y, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT x // 4 AS x, y // 4 AS y, round(avg(v), 6) AS v FROM p WHERE x % 2 = y % 2 GROUP BY 1, 2",
    "tile_background": f"WITH {PLANE} SELECT x // 16 AS tx, y // 16 AS ty, round(median(v), 6) AS median FROM p GROUP BY 1, 2",
    "background_level": f"WITH {PLANE}, t AS (SELECT x // 8, y // 8, median(v) AS m FROM p GROUP BY 1, 2), s AS (SELECT list(m ORDER BY m) AS s FROM t) SELECT len(s)::BIGINT AS tiles, round(s[len(s) // 2 + 1], 6) AS level FROM s",
    "gradient_tiles": f"WITH {PLANE}, t AS (SELECT x // 16 AS tx, y // 16 AS ty, list(v ORDER BY v) AS s FROM p GROUP BY 1, 2) SELECT tx, ty, len(s)::BIGINT AS n, round(s[floor((len(s) - 1) * 0.25)::INT + 1], 6) AS v FROM t",
    "coverage_rows": f"""WITH p AS (SELECT DISTINCT l_partkey % 64 AS x, l_suppkey % 48 AS y FROM lineitem WHERE {HOLES}), g AS (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY y ORDER BY x) - 1, 0) AS gap FROM p)
SELECT y, count(*)::BIGINT AS covered, min(x) AS left_inset, 63 - max(x) AS right_inset, sum(gap)::BIGINT AS holes, max(gap) AS longest_hole FROM g GROUP BY 1""",
    "worst_rows": f"WITH p AS (SELECT DISTINCT l_partkey % 64 AS x, l_suppkey % 48 AS y FROM lineitem WHERE {HOLES}) SELECT y, 64 - count(*) AS uncovered FROM p GROUP BY 1 HAVING count(*) < 64 ORDER BY 2 DESC, 1 LIMIT 5",
    "mtf_stretch": f"""WITH {PLANE}, n AS (SELECT x, y, greatest(0.0, least(1.0, v / 64.0)) AS n FROM p), a AS (SELECT list(n ORDER BY n) AS s FROM n), m AS (SELECT s, s[len(s) // 2 + 1] AS m FROM a),
d AS (SELECT m, list_sort(list_transform(s, lambda v: abs(v - m))) AS d FROM m), q AS (SELECT m, greatest(0.0, least(1.0, m - 2.8::DOUBLE * 1.4826::DOUBLE * d[len(d) // 2 + 1])) AS sh FROM d),
z AS (SELECT *, (m - sh) / (1.0 - sh) AS x0 FROM q), w AS (SELECT *, greatest(1e-4, least(1 - 1e-4, (0.25::DOUBLE - 1) * x0 / ((2 * 0.25::DOUBLE - 1) * x0 - 0.25::DOUBLE))) AS mid FROM z),
r AS (SELECT n.x, n.y, n, sh, mid, (n - sh) / (1.0 - sh) AS u FROM n, w)
SELECT x, y, round(CASE WHEN n <= sh THEN 0.0 WHEN u >= 1 THEN 1.0 ELSE (mid - 1) * u / ((2 * mid - 1) * u - mid) END, 6)::DOUBLE AS stretched FROM r""",
    "disc_centroid": f"""WITH {PLANE}, q AS (SELECT x, y, v + CASE WHEN sqrt(pow(x - 30, 2) + pow(y - 20, 2)) <= 6 THEN 900.0 ELSE 0.0 END AS v FROM p), a AS (SELECT list(v ORDER BY v) AS s FROM q),
b AS (SELECT s[floor(0.1::DOUBLE * (len(s) - 1) + 0.5)::INT + 1] AS bg, s[len(s)] AS peak, s[floor(0.5 * (len(s) - 1) + 0.5)::INT + 1] AS med, s FROM a),
c AS (SELECT *, bg + 0.25 * (peak - bg) AS t, list_sort(list_transform(s, lambda v: abs(v - med))) AS d FROM b), e AS (SELECT x, y, v - t AS w, peak, bg, 1.4826::DOUBLE * d[len(d) // 2 + 1] AS sg FROM q, c WHERE v >= t)
SELECT 0 AS frame, count(*) >= 12 AND sum(w) > 0 AND any_value(peak - bg) >= 8 * any_value(sg) AS found, round(sum(x * w) / sum(w), 6) AS centroid_x, round(sum(y * w) / sum(w), 6) AS centroid_y, count(*)::BIGINT AS pixels, round(any_value(peak), 6) AS peak, round(any_value(bg), 6) AS background FROM e""",
    "sharpness": f"WITH {PLANE}, l AS (SELECT v, lag(v) OVER a + lead(v) OVER a + lag(v) OVER b + lead(v) OVER b - 4.0 * v AS lap FROM p WINDOW a AS (PARTITION BY y ORDER BY x), b AS (PARTITION BY x ORDER BY y)) SELECT count(lap)::BIGINT AS n, round(var_pop(lap) / var_pop(v), 6) AS sharpness FROM l",
    "composite": f"""WITH {PLANE}, m AS (SELECT l_partkey % 64 AS sx, l_suppkey % 48 AS sy, max(l_quantity) AS mv FROM lineitem GROUP BY 1, 2),
d AS (SELECT *, sqrt(pow(x - 33.4::DOUBLE, 2) + pow(y - 17.4::DOUBLE, 2)) AS d, trunc(x - 3.4::DOUBLE)::BIGINT AS sx, trunc(y + 2.6::DOUBLE)::BIGINT AS sy FROM p),
a AS (SELECT *, CASE WHEN d > 9.0 + 1.5 THEN 0.0::DOUBLE WHEN d <= 9.0 THEN 1.0 ELSE 1.0 - (d - 9.0) / 1.5 END AS al FROM d)
SELECT x, y, round(CASE WHEN al > 0 AND mv IS NOT NULL THEN v * (1.0 - al) + mv * 1.5 * al ELSE v END, 6) AS v, al > 0 AS touched FROM a LEFT JOIN m ON a.sx = m.sx AND a.sy = m.sy""",
}
