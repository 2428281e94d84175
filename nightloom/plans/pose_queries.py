"""Pose and picture queries: angles and measurements are made of the numbers of events, part and supplier; the plane is the one
of geometry_queries (x = l_partkey % 64, y = l_suppkey % 48)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.operators import bracket, editing, pose, stack
from nightloom.operators import planes as P
from nightloom.plans.geometry_queries import PLANE, _lines, _plane
from nightloom.sources import frames, tiff
from nightloom.sources.store import shared_folder

WIDTH, HEIGHT = 64, 48


def camera_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    alt, az = F.radians(k % 91), F.radians(k * 7 % 360)
    turn = F.array(F.lit(1.0), F.sin(k.cast("double")), F.lit(0.0), F.lit(0.0), F.cos(k * 2.0), F.lit(0.0), F.lit(0.0), F.sin(k * 3.0), F.lit(1.0))
    roll = pose.camera_roll(turn, F.cos(alt) * F.sin(az), F.cos(alt) * F.cos(az), F.sin(alt))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(roll, 6).alias("roll"))


def plane_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.radians(F.col("s_suppkey") % 30 / 10.0)
    m = F.array(F.cos(t), -F.sin(t), F.sin(t), F.cos(t), F.col("s_acctbal"), F.lit(-7.5))
    got = pose.plane_mapping(m, F.lit(1.5), F.lit(2.0), 2 * (1 + F.col("s_nationkey") % 4))
    band = pose.band_matrix(m, F.col("s_suppkey") % 512, F.col("s_suppkey") % 100)
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", got.alias("m"), band.alias("b"), pose.lifted(F.col("s_suppkey"), F.lit(4)).alias("lifted"))
    return s.select("s_suppkey", *[F.round(f"m.{c}", 6).alias(c) for c in ("a", "b", "tx", "c", "d", "ty")], F.round(F.get("b", F.lit(2)), 6).alias("band_tx"), F.round(F.get("b", F.lit(5)), 6).alias("band_ty"), "lifted")


def disc_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disc for each event but errors; the reference of a user is the first event's."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, v = F.col("event_id"), F.col("value")
    disc = F.when(F.col("event_type") != "error", F.struct((500 + v + k % 9 * 60).alias("centroid_x"), (400 - v / 2).alias("centroid_y"), (200 + k % 13 * 40).alias("pixels")))
    e = e.select("event_id", "user_id", disc.alias("d"))
    first = e.groupBy("user_id").agg(F.min_by(F.struct("d"), "event_id").alias("first")).select("user_id", F.col("first.d").alias("ref"))
    got = e.join(first, "user_id").withColumn("m", pose.disc_align(F.col("ref"), F.col("d"), 1600, 1200))
    return got.select("event_id", "m.verdict", F.round("m.dx", 6).alias("dx"), F.round("m.dy", 6).alias("dy"), F.round("m.shift", 6).alias("shift"))


def night_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as nights: the first is the reference; the least line is the sky, the largest the signal."""
    o, li = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    n = li.groupBy("l_orderkey").agg(F.min("l_quantity").alias("sky"), F.max("l_quantity").alias("signal")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    ref = n.groupBy("o_custkey").agg(F.min_by(F.struct("sky", "signal"), "o_orderkey").alias("r"))
    got = n.join(ref, "o_custkey").withColumn("n", pose.normalisation(F.col("r.sky"), F.col("r.signal"), F.col("sky"), F.col("signal")))
    return got.select("o_orderkey", F.round("n.scale", 9).alias("scale"), F.col("n.level").alias("level"), F.round(pose.background_ratio(F.col("r.sky"), F.col("sky")), 9).alias("ratio"))


def sky_from_adu(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = pose.sky_from_adu(F.col("s_acctbal"), F.lit(64.0), F.lit(8000.0), F.lit(0.31), 1.0 + F.col("s_suppkey") % 30)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", k.alias("k")).select("s_suppkey", F.round("k.electrons_per_second", 6).alias("eps"), F.round("k.background_fraction", 9).alias("background"), "k.clipped")


def stream_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cameras: brands' sizes stand for the candidates of a second stream."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", (1000 + F.col("p_size") * 80).alias("width"), (700 + F.col("p_size") * 60).alias("height"))
    pool = p.groupBy("p_brand").agg(F.array_sort(F.collect_set(F.struct((F.col("width") / 2).cast("int").alias("width"), (F.col("height") / 2).cast("int").alias("height")))).alias("pool"))
    got = p.join(pool, "p_brand").withColumn("s", pose.secondary_size(F.struct("width", "height"), F.col("pool")))
    return got.select("p_partkey", pose.bin_factor(F.col("width"), F.col("height")).cast("int").alias("factor"), F.col("s.width").alias("width"), F.col("s.height").alias("height"))


def focus_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = pose.focus_verify(F.when(F.col("event_type") != "error", F.col("value") / 20), (F.col("event_id") % 60).cast("int"), F.lit(2.0))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", verdict.alias("verdict"))


def lunar_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    samples = e.groupBy("user_id", (F.col("event_id") % 9 / 20.0).alias("diopters")).agg(F.max("value").alias("sharpness"), (F.count("*") - 3).alias("disc_pixels"))
    return pose.lunar_focus(samples, "user_id").withColumns({"best_diopters": F.round("best_diopters", 6), "best_sharpness": F.round("best_sharpness", 6)})


def rotate_argb(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plane(spark, sf_dir).withColumn("r", pose.rotated(F.col("x"), F.col("y"), WIDTH, HEIGHT, 90))
    return p.select("r.x", "r.y", pose.argb(F.floor(F.col("v") * 4)).alias("argb"))


def unsharp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plane: pixels without a line are 0."""
    every = spark.range(WIDTH).withColumnRenamed("id", "x").crossJoin(spark.range(HEIGHT).withColumnRenamed("id", "y"))
    p = every.join(_plane(spark, sf_dir), ["x", "y"], "left").select("x", "y", F.least(F.floor(F.coalesce("v", F.lit(0.0)) * 5), F.lit(255)).cast("int").alias("v"))
    return editing.unsharp(p).select("x", "y", "v", "sharp")


def auto_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel = lambda flag: F.round(F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))), 6)
    p = _lines(spark, sf_dir).groupBy("x", "y").agg(channel("A").alias("r"), channel("N").alias("g"), channel("R").alias("b"))
    every = spark.range(WIDTH).withColumnRenamed("id", "x").crossJoin(spark.range(HEIGHT).withColumnRenamed("id", "y"))
    whole = every.join(p, ["x", "y"], "left").select("x", "y", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "rgb"])
    return editing.auto_edit(whole, WIDTH, HEIGHT)


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of three line numbers cover a pixel, by lines that were returned."""
    return _lines(spark, sf_dir).where("l_returnflag <> 'N' AND l_linenumber <= 3").groupBy("x", "y").agg(F.count_distinct("l_linenumber").alias("n"))


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editing.coverage_report(_coverage(spark, sf_dir), WIDTH, HEIGHT, 3)


def worst_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editing.worst_lines(_coverage(spark, sf_dir), "x", WIDTH, HEIGHT, 3)


def _raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw file for each line number: 64 columns by 48 rows, the last pixel always there."""
    corner = spark.range(1, 8).select(F.col("id").alias("frame"), F.lit(WIDTH - 1).cast("long").alias("x"), F.lit(HEIGHT - 1).cast("long").alias("y"), F.lit(0.0).alias("v"))
    p = _lines(spark, sf_dir).select(F.col("l_linenumber").cast("long").alias("frame"), "x", "y", F.col("l_quantity").alias("v")).unionByName(corner)
    p = p.groupBy("frame", "x", "y").agg((64 + F.floor(F.max("v") * 8)).cast("int").alias("v"))
    return tiff.encode_raw(p, "frame")


def _raw_folder(spark: SparkSession, sf_dir: str) -> str:
    """The raw files, written to the shared folder."""
    folder = shared_folder(spark, "raw")
    frames.write_files(_raw_files(spark, sf_dir).withColumnRenamed("path", "name"), folder, ".dng")
    return folder


def raw_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the raw files, beside one that breaks off."""
    folder = _raw_folder(spark, sf_dir)
    broken = spark.range(1).select(F.lit("broken").alias("name"), F.lit(b"II*\x00\x08\x00").alias("content"))
    frames.write_files(broken, folder, ".dng")
    m = spark.read.format("raw_metadata").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.dng$", 1)
    return m.select(name.alias("path"), "width", "height", "iso", F.element_at("black", 1).alias("black"), "exposure_seconds", F.col("error").isNotNull().alias("unreadable"))


def source_to_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw files in bands of rows, through calibration, demosaicking, motions of whole pixels and the clipped combination by
    tiles, to a master in a file, which is read again."""
    bands = spark.read.format("raw_bands").option("band_rows", 10).load(_raw_folder(spark, sf_dir)).where("error IS NULL")
    frame = F.regexp_extract("path", r"([^/]+)\.dng$", 1).cast("long")
    black = F.element_at("black", 1)
    bands = bands.select(F.lit(0).cast("long").alias("session"), frame.alias("frame"), "width", "height", "top", "rows", F.transform("samples", lambda v: v - black).alias("samples"))
    motions = spark.range(1, 8).select(F.lit(0).cast("long").alias("session"), F.col("id").alias("frame"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("rotation_deg"), (F.col("id") % 3 - 1.0).alias("dx"), (F.floor(F.col("id") / 3) - 1.0).alias("dy"))
    master = stack.stack_bands(bands, motions, 16, kappa=1.5)
    folder = shared_folder(spark, "master")
    frames.write_masters(stack.master_bands(master, F.lit("master"), WIDTH, HEIGHT), folder, description="seven frames")
    return frames.master_pixels(frames.read_masters(spark, folder, band_rows="10")).select("x", "y", "channel", F.nanvl("v", F.lit(None).cast("double")).alias("v"))


def user_combiner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two combiners of a user's own, in partial and final stages, over seven planes in tiles of 16 by 64."""
    p = _lines(spark, sf_dir).groupBy(F.col("l_linenumber").alias("frame"), "x", "y").agg(F.max("l_quantity").alias("v"))
    row = p.groupBy("frame", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", "v"))).alias("m"))
    row = row.withColumn("values", F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(float("nan")))))
    t = row.groupBy("frame", F.floor(F.col("y") / 16).alias("t")).agg(F.array_sort(F.collect_list(F.struct("y", "values"))).alias("rows"))
    every = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.coalesce(F.get(F.filter("rows", lambda r: r["y"] == F.col("t") * 16 + i), 0)["values"], F.array_repeat(F.lit(float("nan")), WIDTH)))
    tiles = t.select(
        F.lit(0).cast("long").alias("session"), (F.col("t") * 16).cast("int").alias("top"), F.lit(0).alias("left"), F.col("frame").cast("long").alias("frame"), (F.col("frame") / 2.0).alias("weight"),
        F.lit(16).alias("height"), F.lit(WIDTH).alias("width"), F.flatten(every).cast("array<float>").alias("values"),
    )
    cells = lambda m, name: m.select("top", F.posexplode("values").alias("i", "v")).select((F.col("i") % WIDTH).alias("x"), (F.col("top") + F.floor(F.col("i") / WIDTH)).alias("y"), F.round(F.nanvl(F.col("v").cast("double"), F.lit(None).cast("double")), 4).alias(name))
    mean, trimmed = (stack.combine_with(tiles, c, channels=1) for c in (stack.WeightedMean(), stack.TrimmedMean()))
    every = spark.range(WIDTH).withColumnRenamed("id", "x").crossJoin(spark.range(HEIGHT).withColumnRenamed("id", "y"))  # the plane's fixed grid
    return every.join(cells(mean, "mean"), ["x", "y"], "left").join(cells(trimmed, "trimmed"), ["x", "y"], "left")


def master_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sessions: views are discs of ground frames by their time, the first purchase is the disc of the moon master."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("epoch_ms", F.col("event_id") * 1000)
    cx, cy = 900 + F.col("value") * 3 + F.col("event_id") / 40, 700 - F.col("value") - F.col("event_id") / 90
    discs = e.select(F.col("user_id").alias("session"), "epoch_ms", "event_type", cx.alias("centroid_x"), cy.alias("centroid_y"), (500 + F.col("event_id") % 7 * 900).cast("long").alias("pixels"))
    first = discs.where("event_type = 'purchase'").groupBy("session").agg(F.min_by(F.struct("centroid_x", "centroid_y", "pixels"), "epoch_ms").alias("m"))
    epochs = discs.groupBy("session").agg(F.min("epoch_ms").alias("epoch_ms"))
    moons = first.select("session", "m.centroid_x", "m.centroid_y", F.when(F.col("session") % 9 == 0, 20).otherwise(F.col("m.pixels")).alias("pixels"))
    got = bracket.place_moon(discs.where("event_type = 'view'"), moons, epochs, 4096, 600)
    return got.select("session", "verdict", "fitted", *[F.round(c, 4).alias(c) for c in ("dx", "dy", "at_x", "at_y", "drift_px_s", "radius")])


def bracketed_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane of lineitem as the ground; a disc of the moon in its master and, elsewhere and drifting, in five ground frames."""
    every = spark.range(WIDTH).withColumnRenamed("id", "x").crossJoin(spark.range(HEIGHT).withColumnRenamed("id", "y"))
    channels = F.explode(F.array(*[F.lit(c) for c in range(3)]))
    plane = every.join(_plane(spark, sf_dir), ["x", "y"], "left")
    disc = lambda cx, cy: F.pow(F.col("x") - cx, 2) + F.pow(F.col("y") - cy, 2) <= 36
    ground = plane.withColumn("channel", channels).select(F.lit(1).cast("long").alias("session"), "x", "y", "channel", (F.col("v") + F.col("channel")).alias("v"))
    moon = every.withColumn("channel", channels).select(F.lit(1).cast("long").alias("session"), "x", "y", "channel", F.when(disc(20, 18), 400.0 + F.col("channel")).otherwise(1.0).alias("v"))
    k = F.col("k")
    frames = plane.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(F.lit(1).cast("long").alias("session"), (k * 2000).cast("long").alias("epoch_ms"), "x", "y", F.when(disc(30 + k, 24 - k), 5000.0).otherwise(F.coalesce("v", F.lit(0.0))).alias("v"))
    epochs = spark.range(1).select(F.lit(1).cast("long").alias("session"), F.lit(3000).cast("long").alias("epoch_ms"))
    out, _ = bracket.bracketed_stack(ground, moon, frames, epochs, WIDTH, HEIGHT)
    return out.select("x", "y", "channel", F.round("v", 4).alias("v"), "touched")


QUERIES = {
    "raw_scan": raw_scan, "source_to_master": source_to_master, "user_combiner": user_combiner, "master_align": master_align, "bracketed_stack": bracketed_stack,
    "camera_roll": camera_roll, "plane_mapping": plane_mapping, "disc_align": disc_align, "night_levels": night_levels, "sky_from_adu": sky_from_adu, "stream_choice": stream_choice,
    "focus_verify": focus_verify, "lunar_focus": lunar_focus, "rotate_argb": rotate_argb, "unsharp": unsharp, "auto_edit": auto_edit, "coverage_report": coverage_report, "worst_columns": worst_columns,
}
GRID = f"e AS (SELECT x.range::BIGINT AS x, y.range::BIGINT AS y FROM range({WIDTH}) x, range({HEIGHT}) y)"
COVERAGE = "c AS (SELECT l_partkey % 64 AS x, l_suppkey % 48 AS y, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber <= 3 GROUP BY 1, 2)"
MTF = "CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 WHEN {m} <= 0 THEN 1.0 WHEN {m} >= 1 THEN 0.0 ELSE ({m} - 1.0) * {x} / ((2.0 * {m} - 1.0) * {x} - {m}) END"


def _edit_sql() -> str:
    n, total = -(-WIDTH * HEIGHT // 17), -(-3 * WIDTH * HEIGHT // 17)
    at = lambda p, k: int((k - 1) * p) + 1
    stretch = MTF.format(m="mid", x="((q - sh) / (1.0 - sh))")
    return f"""WITH {GRID}, p AS (SELECT l_partkey % 64 AS x, l_suppkey % 48 AS y, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A'), 6) AS r, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'N'), 6) AS g, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS b FROM lineitem GROUP BY 1, 2),
w AS (SELECT x, y, y * {WIDTH} + x AS pos, coalesce(r, 0.0) AS r, coalesce(g, 0.0) AS g, coalesce(b, 0.0) AS b FROM e LEFT JOIN p USING (x, y)),
a AS (SELECT list(r ORDER BY r) AS r, list(g ORDER BY g) AS g, list(b ORDER BY b) AS b FROM w WHERE pos % 17 = 0),
l AS (SELECT [r[{at(0.30, n)}], g[{at(0.30, n)}], b[{at(0.30, n)}]] AS sky, [r[{at(0.9995, n)}], g[{at(0.9995, n)}], b[{at(0.9995, n)}]] AS hi FROM a),
l2 AS (SELECT sky, list_sum(sky) / 3 AS base, [hi[1] - sky[1], hi[2] - sky[2], hi[3] - sky[3]] AS sp FROM l),
l3 AS (SELECT sky, base, list_transform(sp, lambda s: CASE WHEN list_min(sp) > 0 THEN least(4.0, greatest(0.25, list_sum(sp) / 3 / s)) ELSE 1.0 END) AS k FROM l2),
v AS (SELECT x, y, pos, base + (r + (base - sky[1]) - base) * k[1] AS r, base + (g + (base - sky[2]) - base) * k[2] AS g, base + (b + (base - sky[3]) - base) * k[3] AS b FROM w, l3),
i AS (SELECT unnest([pos * 3, pos * 3 + 1, pos * 3 + 2]) AS pos, unnest([r, g, b]) AS v FROM v), j AS (SELECT list(v ORDER BY v) AS s FROM i WHERE pos % 17 = 0), wh AS (SELECT greatest(s[{at(0.99995, total)}], 1.0) AS white FROM j),
u AS (SELECT greatest(0.0, least(1.0, (r + g + b) / 3 / white)) AS n FROM v, wh), um AS (SELECT list(n ORDER BY n) AS s FROM u), m1 AS (SELECT s, s[len(s) // 2 + 1] AS m FROM um),
m2 AS (SELECT m, list_sort(list_transform(s, lambda q: abs(q - m))) AS d FROM m1), m3 AS (SELECT m, d[len(d) // 2 + 1] AS mad FROM m2),
m4 AS (SELECT m, mad, CASE WHEN mad > 0 THEN greatest(0.0, least(1.0, m - 2.8 * 1.4826 * mad)) ELSE 0.0 END AS sh FROM m3), m5 AS (SELECT *, (m - sh) / (1.0 - sh) AS z, {0.08 + 0.55 * (0.35 - 0.08)!r}::DOUBLE AS tg FROM m4),
m6 AS (SELECT sh, CASE WHEN mad > 0 AND m > sh THEN greatest(1e-4, least(1 - 1e-4, {MTF.format(m="tg", x="z")})) ELSE 0.5 END AS mid FROM m5),
q AS (SELECT x, y, unnest(['r', 'g', 'b']) AS c, unnest([r, g, b]) AS q0 FROM v), q1 AS (SELECT x, y, c, greatest(0.0, least(1.0, q0 / white)) AS q, sh, mid FROM q, wh, m6),
q2 AS (SELECT x, y, c, CASE WHEN q <= sh THEN 0.0 ELSE {stretch} END AS s FROM q1),
t AS (SELECT x, y, max(s) FILTER (WHERE c = 'r') AS r, max(s) FILTER (WHERE c = 'g') AS g, max(s) FILTER (WHERE c = 'b') AS b FROM q2 GROUP BY 1, 2), t2 AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS lu FROM t)
SELECT x, y, {", ".join(f"floor(greatest(0.0, least(1.0, lu + ({c} - lu) * {1.0 + 0.55 * 0.6!r}::DOUBLE)) * 255.0 + 0.5)::INT AS {c}8" for c in "rgb")} FROM t2"""


def _blur_sql(src: str, out: str, axis: str, size: int, value: str) -> str:
    x, y = ("n.o", "a.y") if axis == "x" else ("a.x", "n.o")
    other = f"b.y = a.y AND b.x = greatest(0, least({size - 1}, a.x + n.o))" if axis == "x" else f"b.x = a.x AND b.y = greatest(0, least({size - 1}, a.y + n.o))"
    return f"{out} AS (SELECT a.x, a.y, any_value(a.v) AS v, sum(b.{value}) // 5 AS {out}v FROM {src} a, (SELECT unnest([-2, -1, 0, 1, 2]) AS o) n JOIN {src} b ON {other} GROUP BY 1, 2)"


RAW = "f AS (SELECT l_linenumber AS frame, l_partkey % 64 AS x, l_suppkey % 48 AS y, floor(max(l_quantity) * 8) AS v FROM lineitem GROUP BY 1, 2, 3)"


def _master_sql() -> str:
    """Demosaicking by weighted neighbours, motions of whole pixels, and three clipping passes at 1.5."""
    sql = f"""WITH {GRID}, {RAW}, n AS (SELECT range AS frame FROM range(1, 8)), m AS (SELECT n.frame, e.x, e.y, coalesce(v, 0.0) AS v, CASE WHEN e.y % 2 = 0 THEN CASE WHEN e.x % 2 = 0 THEN 1 ELSE 0 END ELSE CASE WHEN e.x % 2 = 0 THEN 2 ELSE 1 END END AS site
  FROM e CROSS JOIN n LEFT JOIN f ON f.x = e.x AND f.y = e.y AND f.frame = n.frame),
o(i, j, k) AS (SELECT i.range - 1, j.range - 1, (2 - abs(i.range - 1)) * (2 - abs(j.range - 1)) FROM range(3) i, range(3) j),
d AS (SELECT a.frame, a.x, a.y, c.range AS channel, CAST(CASE WHEN any_value(a.site) = any_value(c.range) THEN any_value(a.v) ELSE sum(b.v * k) FILTER (WHERE b.site = c.range) / (sum(k) FILTER (WHERE b.site = c.range)) END AS FLOAT)::DOUBLE AS v
  FROM m a CROSS JOIN o JOIN m b ON b.frame = a.frame AND b.x = a.x + i AND b.y = a.y + j CROSS JOIN range(3) c GROUP BY a.frame, a.x, a.y, c.range),
g AS (SELECT e.x, e.y, c.range AS channel, coalesce(list(v ORDER BY v) FILTER (WHERE v IS NOT NULL), []) AS e FROM e CROSS JOIN range(3) c CROSS JOIN n LEFT JOIN d ON d.frame = n.frame AND d.channel = c.range AND d.x = e.x + n.frame % 3 - 1 AND d.y = e.y + n.frame // 3 - 1 GROUP BY 1, 2, 3),
q AS (SELECT *, list_median(e) AS c FROM g), w AS (SELECT *, list_transform(e, lambda x: abs(x - c)) AS dev FROM q),
p0 AS (SELECT x, y, channel, e, len(e) AS n, c AS med, c, CASE WHEN list_median(dev) > 0 THEN 1.4826 * list_median(dev) ELSE 1.2533 * list_avg(dev) END AS s, false AS done FROM w)"""
    for i in (1, 2, 3):
        sql += f""",
k{i} AS (SELECT *, list_filter(e, lambda r: r >= c - 1.5 * s AND r <= c + 1.5 * s) AS k FROM p{i - 1}), h{i} AS (SELECT *, done OR s <= 0 OR len(k) = len(e) OR len(k) < 3 AS stop, list_avg(k) AS mu FROM k{i}),
p{i} AS (SELECT x, y, channel, n, med, CASE WHEN stop THEN e ELSE k END AS e, CASE WHEN stop THEN c ELSE mu END AS c, CASE WHEN stop THEN s ELSE sqrt(list_sum(list_transform(k, lambda r: (r - mu) * (r - mu))) / (len(k) - 1)) END AS s, stop AS done FROM h{i})"""
    return sql + " SELECT x, y, channel, CAST(CASE WHEN n = 0 THEN NULL WHEN n < 5 THEN med ELSE list_sum(e) / len(e) END AS FLOAT)::DOUBLE AS v FROM p3"


ORACLES = {
    "master_align": """WITH d AS (SELECT user_id AS session, event_id * 1000 AS ms, event_type, 900 + value * 3 + event_id / 40.0::DOUBLE AS cx, 700 - value - event_id / 90.0::DOUBLE AS cy, 500 + event_id % 7 * 900 AS px FROM events),
e AS (SELECT session, min(ms) AS epoch FROM d GROUP BY 1), m AS (SELECT session, arg_min({'x': cx, 'y': cy, 'p': CASE WHEN session % 9 = 0 THEN 20 ELSE px END}, ms) AS m FROM d WHERE event_type = 'purchase' GROUP BY 1),
s AS (SELECT session, count(*) AS n, avg(px) AS area, avg(ms - epoch) AS mt, var_pop(ms - epoch) AS vt, avg(cx) AS mx, avg(cy) AS my, regr_slope(cx, ms - epoch) AS sx, regr_slope(cy, ms - epoch) AS sy FROM d JOIN e USING (session) WHERE event_type = 'view' GROUP BY 1),
j AS (SELECT session, m, n, area, coalesce(n >= 3 AND vt > 0, false) AS fitted, mx, my, mt, sx, sy FROM e LEFT JOIN m USING (session) LEFT JOIN s USING (session)),
k AS (SELECT *, CASE WHEN fitted THEN mx - sx * mt ELSE mx END AS at_x, CASE WHEN fitted THEN my - sy * mt ELSE my END AS at_y FROM j),
v AS (SELECT *, CASE WHEN m IS NULL THEN 'NO_DISC' WHEN n IS NULL THEN 'NO_SAMPLES' WHEN area / m.p > 25 OR area / m.p < 1 / 25.0::DOUBLE THEN 'AREA' WHEN sqrt(pow(at_x - m.x, 2) + pow(at_y - m.y, 2)) > 300 THEN 'SHIFT' ELSE 'MATCHED' END AS verdict FROM k)
SELECT session, verdict, fitted, CASE WHEN verdict = 'MATCHED' THEN round(at_x - m.x, 4) END AS dx, CASE WHEN verdict = 'MATCHED' THEN round(at_y - m.y, 4) END AS dy, round(at_x, 4) AS at_x, round(at_y, 4) AS at_y,
  CASE WHEN fitted THEN round(sqrt(sx * sx + sy * sy) * 1000, 4) END AS drift_px_s, round(sqrt(m.p / pi()), 4) AS radius FROM v""",
    # The discs' centres and sizes are known; the track's middle is at (31.5, 22.5).
    "bracketed_stack": f"""WITH {GRID}, {PLANE}, n AS (SELECT count(*) AS px FROM e WHERE pow(x - 20, 2) + pow(y - 18, 2) <= 36), r AS (SELECT sqrt(px / pi()) AS r FROM n), c AS (SELECT range AS channel FROM range(3)),
g AS (SELECT e.x, e.y, channel, p.v + channel AS v, r, greatest({P.LEAST_FEATHER}::DOUBLE, r * {P.FEATHER}::DOUBLE) AS f, sqrt(pow(e.x - 31.5, 2) + pow(e.y - 22.5, 2)) AS far, trunc(e.x - 11.5::DOUBLE) AS sx, trunc(e.y - 4.5::DOUBLE) AS sy FROM e LEFT JOIN p USING (x, y) CROSS JOIN c CROSS JOIN r),
a AS (SELECT *, CASE WHEN far > r + f THEN 0.0 WHEN far <= r THEN 1.0 ELSE 1.0 - (far - r) / f END AS alpha, sx >= 0 AND sy >= 0 AND sx < {WIDTH} AND sy < {HEIGHT} AS there, CASE WHEN pow(sx - 20, 2) + pow(sy - 18, 2) <= 36 THEN 400.0::DOUBLE + channel ELSE 1.0 END AS mv FROM g)
SELECT x, y, channel::INT AS channel, round(CASE WHEN alpha > 0 AND there THEN coalesce(v, 0.0) * (1.0 - alpha) + mv * alpha ELSE v END, 4) AS v, alpha > 0 AS touched FROM a""",
    "raw_scan": f"SELECT CASE WHEN range < 8 THEN CAST(range AS VARCHAR) ELSE 'broken' END AS path, CASE WHEN range < 8 THEN {WIDTH} END AS width, CASE WHEN range < 8 THEN {HEIGHT} END AS height, CASE WHEN range < 8 THEN 800 END AS iso, CASE WHEN range < 8 THEN 64.0::DOUBLE END AS black, CASE WHEN range < 8 THEN 8.0::DOUBLE END AS exposure_seconds, range = 8 AS unreadable FROM range(1, 9)",
    "source_to_master": _master_sql(),
    "user_combiner": f"""WITH {GRID}, p AS (SELECT l_linenumber AS k, l_partkey % 64 AS x, l_suppkey % 48 AS y, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)
SELECT e.x, e.y, round(CAST(sum(v * k / 2.0::DOUBLE) / sum(k / 2.0::DOUBLE) AS FLOAT)::DOUBLE, 4) AS mean, round(CAST(CASE WHEN count(v) >= 3 THEN (sum(v) - min(v) - max(v)) / (count(v) - 2) ELSE avg(v) END AS FLOAT)::DOUBLE, 4) AS trimmed
FROM e LEFT JOIN p ON p.x = e.x AND p.y = e.y GROUP BY 1, 2""",
    "camera_roll": """WITH a AS (SELECT event_id, radians(event_id % 91) AS alt, radians(event_id * 7 % 360) AS az, sin(event_id::DOUBLE) AS vx, cos(event_id * 2.0::DOUBLE) AS vy, sin(event_id * 3.0::DOUBLE) AS vz FROM events),
d AS (SELECT *, cos(alt) * sin(az) AS dx, cos(alt) * cos(az) AS dy, sin(alt) AS dz FROM a), l AS (SELECT *, sqrt(pow(dx * dz, 2) + pow(dy * dz, 2) + pow(1.0 - dz * dz, 2)) AS len FROM d),
u AS (SELECT *, -dx * dz / len AS ux, -dy * dz / len AS uy, (1.0 - dz * dz) / len AS uz FROM l WHERE len >= 1e-6),
r AS (SELECT event_id, ux * vx + uy * vy + uz * vz AS co, -((uy * vz - uz * vy) * dx + (uz * vx - ux * vz) * dy + (ux * vy - uy * vx) * dz) AS si FROM u)
SELECT e.event_id, CASE WHEN sqrt(si * si + co * co) >= 1e-6 THEN round(degrees(atan2(si, co)), 6) END AS roll FROM events e LEFT JOIN r USING (event_id)""",
    "plane_mapping": """WITH t AS (SELECT *, radians(s_suppkey % 30 / 10.0::DOUBLE) AS t, 2 * (1 + s_nationkey % 4) AS f FROM supplier), m AS (SELECT *, cos(t) AS a, -sin(t) AS b, sin(t) AS c, cos(t) AS d, s_acctbal AS tx, -7.5::DOUBLE AS ty, (f - 1) / 2.0::DOUBLE AS o FROM t)
SELECT s_suppkey, round(a * 1.5, 6) AS a, round(b * 2.0, 6) AS b, round((o * (a + b - 1.0) + tx) / f, 6) AS tx, round(c * 1.5, 6) AS c, round(d * 2.0, 6) AS d, round((o * (c + d - 1.0) + ty) / f, 6) AS ty,
  round(tx + b * (s_suppkey % 512), 6) AS band_tx, round(ty + d * (s_suppkey % 512) - s_suppkey % 100, 6) AS band_ty, s_suppkey * 4 + 1.5::DOUBLE AS lifted FROM m""",
    "disc_align": """WITH d AS (SELECT event_id, user_id, event_type <> 'error' AS found, 500 + value + event_id % 9 * 60 AS cx, 400 - value / 2 AS cy, 200 + event_id % 13 * 40 AS px FROM events),
r AS (SELECT user_id, arg_min({'f': found, 'x': cx, 'y': cy, 'p': px}, event_id) AS r FROM d GROUP BY 1), m AS (SELECT d.*, r, px / r.p::DOUBLE AS ratio, cx - r.x AS dx, cy - r.y AS dy FROM d JOIN r USING (user_id)),
v AS (SELECT *, sqrt(dx * dx + dy * dy) AS s, CASE WHEN NOT r.f THEN 'NO_REFERENCE' WHEN NOT found THEN 'NO_DISC' WHEN ratio > 2 OR ratio < 0.5 THEN 'AREA' WHEN sqrt(dx * dx + dy * dy) > 300 THEN 'SHIFT' ELSE 'MATCHED' END AS verdict FROM m)
SELECT event_id, verdict, CASE WHEN verdict = 'MATCHED' THEN round(dx, 6) END AS dx, CASE WHEN verdict = 'MATCHED' THEN round(dy, 6) END AS dy, CASE WHEN verdict = 'MATCHED' THEN round(s, 6) END AS shift FROM v""",
    "night_levels": """WITH n AS (SELECT l_orderkey AS k, min(l_quantity) AS sky, max(l_quantity) AS sig FROM lineitem GROUP BY 1), o AS (SELECT n.*, o_custkey AS c FROM n JOIN orders ON k = o_orderkey), r AS (SELECT c, arg_min({'a': sky, 'b': sig}, k) AS r FROM o GROUP BY 1)
SELECT k AS o_orderkey, CASE WHEN r.b > r.a AND sig > sky THEN round((r.b - r.a) / (sig - sky), 9) END AS scale, CASE WHEN r.b > r.a AND sig > sky THEN r.a END AS level, CASE WHEN r.a > 0 AND sky > 0 THEN round(greatest(r.a, sky) / least(r.a, sky), 9) END AS ratio FROM o JOIN r USING (c)""",
    "sky_from_adu": "SELECT s_suppkey, round(greatest(s_acctbal - 64, 0) * 0.31::DOUBLE / (1 + s_suppkey % 30), 6) AS eps, round(greatest(s_acctbal - 64, 0) / 7936.0::DOUBLE, 9) AS background, s_acctbal >= 8000 AS clipped FROM supplier",
    "stream_choice": """WITH p AS (SELECT p_partkey, p_brand, 1000 + p_size * 80 AS w, 700 + p_size * 60 AS h FROM part), c AS (SELECT DISTINCT p_brand, w // 2 AS cw, h // 2 AS ch FROM p),
j AS (SELECT p_partkey, w, h, cw, ch, cw <= 1920 AND ch <= 1080 AS inside, cw <= 1920 AND ch <= 1080 AND abs(cw / ch::DOUBLE - w / h::DOUBLE) < 0.02 AS alike FROM p JOIN c USING (p_brand)),
b AS (SELECT p_partkey, any_value(w) AS w, any_value(h) AS h, arg_max({'w': cw, 'h': ch}, cw * ch) FILTER (WHERE alike) AS b1, arg_max({'w': cw, 'h': ch}, cw * ch) FILTER (WHERE inside) AS b2, arg_min({'w': cw, 'h': ch}, cw * ch) AS b3 FROM j GROUP BY 1)
SELECT p_partkey, coalesce(list_filter([2, 4, 6, 8, 10, 12, 14], lambda f: (w::BIGINT * h) // (f * f) <= 1000000)[1], 16)::INT AS factor, coalesce(b1, b2, b3).w::INT AS width, coalesce(b1, b2, b3).h::INT AS height FROM b""",
    "focus_verify": "WITH a AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value / 20 END AS h, event_id % 60 AS n FROM events) SELECT event_id, CASE WHEN h IS NULL OR h <= 0 OR n < 5 THEN 'UNKNOWN' WHEN h > 3.4::DOUBLE THEN 'LOST' WHEN h > 2.7::DOUBLE THEN 'DRIFTING' ELSE 'LOCKED' END AS verdict FROM a",
    "lunar_focus": """WITH s AS (SELECT user_id, event_id % 9 / 20.0::DOUBLE AS d, max(value) AS h, count(*) - 3 AS n FROM events GROUP BY 1, 2), v AS (SELECT * FROM s WHERE h > 0 AND n > 0),
u AS (SELECT DISTINCT user_id FROM s), g AS (SELECT u.user_id, list(d ORDER BY d) FILTER (WHERE d IS NOT NULL) AS ds, list(h ORDER BY d) FILTER (WHERE d IS NOT NULL) AS hs FROM u LEFT JOIN v ON u.user_id = v.user_id GROUP BY 1),
i AS (SELECT *, coalesce(len(hs), 0) AS n, list_position(hs, list_max(hs)) AS i FROM g),
w AS (SELECT *, CASE WHEN n < 3 THEN 'NO_DISC' WHEN (list_max(hs) - list_min(hs)) / list_max(hs) < 0.10 THEN 'FLAT' WHEN i = 1 OR i = n THEN 'PEAK_AT_EDGE' ELSE 'CLEAR_PEAK' END AS verdict FROM i),
x AS (SELECT *, ds[i - 1] AS x0, ds[i] AS x1, ds[i + 1] AS x2, -hs[i - 1] AS y0, -hs[i] AS y1, -hs[i + 1] AS y2 FROM w),
y AS (SELECT *, (x0 - x1) * (x0 - x2) * (x1 - x2) AS den FROM x), z AS (SELECT *, (x2 * (y1 - y0) + x1 * (y0 - y2) + x0 * (y2 - y1)) / den AS a, (x2 * x2 * (y0 - y1) + x1 * x1 * (y2 - y0) + x0 * x0 * (y1 - y2)) / den AS b FROM y)
SELECT user_id, round(coalesce(CASE WHEN verdict = 'CLEAR_PEAK' AND abs(a) > 1e-12 THEN -b / (2 * a) END, x1, 0.0), 6) AS best_diopters, round(-y1, 6) AS best_sharpness, verdict, coalesce(verdict = 'CLEAR_PEAK' AND abs(a) > 1e-12, false) AS interpolated FROM z""",
    "rotate_argb": f"WITH {PLANE}, g AS (SELECT *, greatest(0, least(255, floor(v * 4)))::BIGINT AS g FROM p) SELECT {HEIGHT - 1} - y AS x, x AS y, (-16777216 + g * 65536 + g * 256 + g)::INT AS argb FROM g",
    "unsharp": f"WITH {PLANE}, {GRID}, q AS (SELECT x, y, least(floor(coalesce(v, 0.0) * 5), 255)::INT AS v FROM e LEFT JOIN p USING (x, y)), {_blur_sql('q', 'h', 'x', WIDTH, 'v')}, {_blur_sql('h', 'k', 'y', HEIGHT, 'hv')} SELECT x, y, v, greatest(0, least(255, floor(v + 0.6::DOUBLE * (v - kv) + 0.5)))::INT AS sharp FROM k",
    "auto_edit": _edit_sql(),
    "coverage_report": f"""WITH {GRID}, {COVERAGE}, f AS (SELECT x, y, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (x, y)),
r AS (SELECT y, min(x) FILTER (WHERE n >= 3) AS lo, max(x) FILTER (WHERE n >= 3) AS hi, count(*) FILTER (WHERE n >= 3) AS n_full FROM f GROUP BY 1), k AS (SELECT x, min(y) FILTER (WHERE n >= 3) AS lo, max(y) FILTER (WHERE n >= 3) AS hi FROM f GROUP BY 1),
a AS (SELECT list(coalesce(lo, {WIDTH}) ORDER BY coalesce(lo, {WIDTH})) AS l, list(coalesce({WIDTH - 1} - hi, 0) ORDER BY coalesce({WIDTH - 1} - hi, 0)) AS r, sum(n_full) AS n_full, sum(coalesce(hi - lo + 1 - n_full, 0)) AS inside FROM r),
b AS (SELECT list(coalesce(lo, {HEIGHT}) ORDER BY coalesce(lo, {HEIGHT})) AS t, list(coalesce({HEIGHT - 1} - hi, 0) ORDER BY coalesce({HEIGHT - 1} - hi, 0)) AS o FROM k), z AS (SELECT count(*) FILTER (WHERE n = 0) AS zero, min(n) AS least FROM f),
m AS (SELECT n_full, zero, least, inside, l[len(l) // 2 + 1] AS lm, l[-1] AS lw, r[len(r) // 2 + 1] AS rm, r[-1] AS rw, t[len(t) // 2 + 1] AS tm, t[-1] AS tw, o[len(o) // 2 + 1] AS om, o[-1] AS ow FROM a, b, z)
SELECT n_full::BIGINT AS "full", {WIDTH * HEIGHT} - n_full::BIGINT AS short, zero::BIGINT AS zero, least::BIGINT AS least, inside::BIGINT AS interior, lm::BIGINT AS left_median, lw::BIGINT AS left_worst, rm::BIGINT AS right_median, rw::BIGINT AS right_worst,
  tm::BIGINT AS top_median, tw::BIGINT AS top_worst, om::BIGINT AS bottom_median, ow::BIGINT AS bottom_worst,
  CASE WHEN n_full = {WIDTH * HEIGHT} THEN 'FULL' WHEN greatest(lm, rm, tm, om) = 0 THEN 'INTERIOR' WHEN greatest(lw, rw, tw, ow) / greatest(lm, rm, tm, om)::DOUBLE < 2 THEN 'BAND' ELSE 'SPUR' END AS shape FROM m""",
    "worst_columns": f"WITH {GRID}, {COVERAGE} SELECT e.x AS line, ({HEIGHT} - count(*) FILTER (WHERE n >= 3))::BIGINT AS short FROM e LEFT JOIN c USING (x, y) GROUP BY 1 HAVING short > 0 ORDER BY 2 DESC, 1 LIMIT 5",
}
