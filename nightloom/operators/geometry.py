"""Stars of frames: brightest, triangles, matches by triangle shape, by seed and by offset votes, rigid motions.

A stars table has frame, star, x, y, flux. Joins between stars of two frames are bounded by the brightest k of each, and
triangles meet through buckets of their side ratios, never through a cross join of all.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the matching rules.
MAX_STARS, TOLERANCE, LEAST_SIDE, MAX_ELONGATION, LEAST_CROSS = 30, 0.02, 5.0, 10.0, 25.0
LEAST_VOTES, LEAST_SHARE = 2, 0.25
SEED_RADIUS, SEED_AMBIGUITY = 8.0, 0.6
OFFSET_STARS, OFFSET_BIN, OFFSET_VOTES = 25, 2.0, 4


def brightest(stars: DataFrame, k: int = MAX_STARS) -> DataFrame:
    """The k brightest stars of each frame, ties by star."""
    return stars.withColumn("rank", F.row_number().over(W.partitionBy("frame").orderBy(F.desc("flux"), "star"))).where(F.col("rank") <= k)


def triangles(stars: DataFrame, k: int = MAX_STARS) -> DataFrame:
    """frame, v0, v1, v2, ratio_long, ratio_short, clockwise of the triangles of each frame's brightest stars.

    Vertices stand in the order of the side opposite to them, shortest first."""
    s = brightest(stars, k).select("frame", "rank", F.struct("star", "x", "y").alias("p"))
    a, b, c = (s.select("frame", F.col("rank").alias(f"r{n}"), F.col("p").alias(n)) for n in "abc")
    t = a.join(b, "frame").where("ra < rb").join(c, "frame").where("rb < rc")
    side = lambda p, q: F.hypot(F.col(f"{p}.x") - F.col(f"{q}.x"), F.col(f"{p}.y") - F.col(f"{q}.y"))
    entry = lambda d, n, v: F.struct(d.alias("d"), F.lit(n).alias("n"), F.col(v).alias("v"))
    t = t.select("frame", F.array_sort(F.array(entry(side("b", "c"), 0, "a"), entry(side("c", "a"), 1, "b"), entry(side("a", "b"), 2, "c"))).alias("s"))
    v = [F.col("s")[i]["v"] for i in range(3)]
    d = [F.col("s")[i]["d"] for i in range(3)]
    cross = (v[1]["x"] - v[0]["x"]) * (v[2]["y"] - v[0]["y"]) - (v[1]["y"] - v[0]["y"]) * (v[2]["x"] - v[0]["x"])
    t = t.withColumn("cross", cross).where((d[0] >= LEAST_SIDE) & (d[2] <= MAX_ELONGATION * d[0]) & (F.abs("cross") >= LEAST_CROSS))
    return t.select("frame", *[v[i]["star"].alias(f"v{i}") for i in range(3)], F.try_divide(d[2], d[0]).alias("ratio_long"), F.try_divide(d[1], d[0]).alias("ratio_short"), (F.col("cross") < 0).alias("clockwise"))


def triangle_votes(reference: DataFrame, target: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """frame, ref, tgt, votes: how many pairs of alike triangles put a reference star on a target star.

    A band join: long ratios fall into buckets of the tolerance's width, each reference triangle looks into three."""
    cell = lambda c: F.floor(F.col(c) / tolerance)
    r = reference.select(*[F.col(c).alias(f"r_{c}") for c in ("v0", "v1", "v2", "ratio_long", "ratio_short", "clockwise")])
    r = r.withColumn("cell", F.explode(F.sequence(cell("r_ratio_long") - 1, cell("r_ratio_long") + 1)))
    t = target.withColumn("cell", cell("ratio_long"))
    m = t.join(r, (t.cell == r.cell) & (t.clockwise == r.r_clockwise) & (F.abs(t.ratio_long - r.r_ratio_long) <= tolerance) & (F.abs(t.ratio_short - r.r_ratio_short) <= tolerance))
    pairs = F.explode(F.array(*[F.struct(F.col(f"r_v{i}").alias("ref"), F.col(f"v{i}").alias("tgt")) for i in range(3)]))
    return m.select("frame", pairs.alias("p")).groupBy("frame", "p.ref", "p.tgt").agg(F.count("*").alias("votes"))


def asterism_matches(reference: DataFrame, target: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """frame, ref, tgt, votes: a one-to-one match by votes, most first (ties by reference, then target). A reference star is
    spent by its first candidate even where that target is taken. At most MAX_STARS squared candidates a frame."""
    chances = reference.select(F.explode(F.array("v0", "v1", "v2")).alias("ref")).groupBy("ref").agg(F.count("*").alias("chances"))
    votes = triangle_votes(reference, target, tolerance).where(F.col("votes") >= LEAST_VOTES).join(chances, "ref").where(F.col("votes") >= F.col("chances") * LEAST_SHARE)

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["votes", "ref", "tgt"], ascending=[False, True, True])
        refs, targets, keep = set(), set(), []
        for r, t in zip(rows.ref, rows.tgt, strict=True):
            fresh = r not in refs
            refs.add(r)
            keep.append(fresh and t not in targets)
            if fresh:
                targets.add(t)
        return rows[keep]

    return votes.select("frame", "ref", "tgt", "votes").groupBy("frame").applyInPandas(greedy, "frame long, ref long, tgt long, votes long")


def offset_votes(reference: DataFrame, target: DataFrame, k: int = OFFSET_STARS, bin_px: float = OFFSET_BIN, least: int = OFFSET_VOTES) -> DataFrame:
    """frame, dx, dy, votes: the most frequent offset of the k brightest stars, binned, as the mean within its bin (ties: the
    least bin)."""
    cell = lambda d: F.floor(d / bin_px + 0.5).cast("long")
    r = brightest(reference, k).select(F.col("x").alias("rx"), F.col("y").alias("ry"))
    d = brightest(target, k).crossJoin(F.broadcast(r))  # k stars of one frame
    d = d.select("frame", (F.col("x") - F.col("rx")).alias("dx"), (F.col("y") - F.col("ry")).alias("dy"))
    g = d.groupBy("frame", cell(F.col("dx")).alias("bx"), cell(F.col("dy")).alias("by")).agg(F.count("*").alias("votes"), F.avg("dx").alias("dx"), F.avg("dy").alias("dy"))
    best = g.groupBy("frame").agg(F.max(F.struct("votes", -F.col("bx"), -F.col("by"), "dx", "dy")).alias("m"))
    return best.select("frame", "m.dx", "m.dy", "m.votes").where(F.col("votes") >= least)


def seed_matches(reference: DataFrame, target: DataFrame, rotation_deg: float, dx: float, dy: float, k: int = MAX_STARS, cx: float = 0.0, cy: float = 0.0) -> DataFrame:
    """frame, ref, tgt, distance: nearest target of each moved reference star, if near and clearly nearer than the second; a
    target goes to the first reference star (by brightness) that it is accepted for."""
    t = F.radians(F.lit(rotation_deg))
    ox, oy = F.col("x") - cx, F.col("y") - cy
    r = brightest(reference, k).select(
        F.col("star").alias("ref"), F.col("rank").alias("ref_rank"), (cx + ox * F.cos(t) - oy * F.sin(t) + dx).alias("px"), (cy + ox * F.sin(t) + oy * F.cos(t) + dy).alias("py")
    )
    d = brightest(target, k).select("frame", F.col("star").alias("tgt"), "x", "y", "rank").crossJoin(F.broadcast(r))  # k stars of one frame
    d = d.withColumn("distance", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")))
    near = W.partitionBy("frame", "ref").orderBy("distance", "rank")
    d = d.withColumns({"n": F.row_number().over(near), "second": F.lead("distance").over(near)}).where("n = 1")
    d = d.where((F.col("distance") <= SEED_RADIUS) & (F.col("second").isNull() | (F.col("distance") < F.col("second") * SEED_AMBIGUITY)))
    first = F.row_number().over(W.partitionBy("frame", "tgt").orderBy("ref_rank"))
    return d.withColumn("f", first).where("f = 1").select("frame", "ref", "tgt", "distance")


def procrustes(pairs: DataFrame, by: str) -> DataFrame:
    """by, n, rotation_deg, dx, dy of the rigid motion (x, y) to (u, v) with least squares: sums only."""
    s = pairs.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyuv"], *[F.avg(F.col(p) * F.col(q)).alias(p + q) for p in "xy" for q in "uv"])
    c = lambda p, q: F.col(p + q) - F.col(f"m{p}") * F.col(f"m{q}")
    t = F.atan2(c("x", "v") - c("y", "u"), c("x", "u") + c("y", "v"))
    s = s.withColumn("t", t)
    dx = F.col("mu") - (F.col("mx") * F.cos("t") - F.col("my") * F.sin("t"))
    dy = F.col("mv") - (F.col("mx") * F.sin("t") + F.col("my") * F.cos("t"))
    return s.select(by, "n", F.degrees("t").alias("rotation_deg"), dx.alias("dx"), dy.alias("dy"))


def rigid_apply(x: Column, y: Column, rotation_deg: Column, dx: Column, dy: Column) -> Column:
    t = F.radians(rotation_deg)
    return F.struct((x * F.cos(t) - y * F.sin(t) + dx).alias("x"), (x * F.sin(t) + y * F.cos(t) + dy).alias("y"))


def rigid_invert(x: Column, y: Column, rotation_deg: Column, dx: Column, dy: Column) -> Column:
    t = F.radians(rotation_deg)
    return F.struct(((x - dx) * F.cos(t) + (y - dy) * F.sin(t)).alias("x"), (-(x - dx) * F.sin(t) + (y - dy) * F.cos(t)).alias("y"))


def drift_fit(track: DataFrame, by: str, time: str) -> DataFrame:
    """by, n, and slope and value at the mean time of x and y: straight drifts, with time taken from its mean for precision."""
    mean = track.groupBy(by).agg(F.avg(time).alias("t0"))
    t = track.join(mean, by).withColumn("t", F.col(time) - F.col("t0"))
    return t.groupBy(by).agg(
        F.count("*").alias("n"), F.regr_slope("x", "t").alias("vx"), F.regr_slope("y", "t").alias("vy"), F.avg("x").alias("x0"), F.avg("y").alias("y0")
    )
