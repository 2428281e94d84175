"""Sensor noise tables: bracketing and nearest ISO, the dual-gain point, the exposure table and the choice from it, focus sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.functions import arrays as A
from nightloom.functions import exposure as E

#: Fixed values of the focus sweep.
LEAST_STARS, LEAST_POSITIONS, FLAT_TOLERANCE = 5, 3, 0.05


def ladders(noise: DataFrame, by: str) -> DataFrame:
    """by, ladder: the measured ISOs of a sensor in order, as an array of struct(iso, read_noise). A ladder has tens of steps."""
    return noise.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("iso", "read_noise"))).alias("ladder"))


def bracket(wanted: DataFrame, noise: DataFrame, by: str) -> DataFrame:
    """by, iso, below, above, read_noise: interpolated over log ISO between the neighbours, the nearer end beyond them; and
    nearest, the ISO nearest by difference (the smaller on ties)."""
    w = wanted.join(ladders(noise, by), by)
    iso = F.col("iso")
    w = w.withColumns({
        "b": F.try_element_at(F.filter("ladder", lambda e: e["iso"] < iso), F.lit(-1)),
        "a": F.try_element_at(F.filter("ladder", lambda e: e["iso"] > iso), F.lit(1)),
        "same": F.try_element_at(F.filter("ladder", lambda e: e["iso"] == iso), F.lit(1)),
        "n": F.array_min(F.transform("ladder", lambda e: F.struct(F.abs(e["iso"] - iso).alias("d"), e["iso"].alias("iso")))),
    })
    t = (F.ln(iso) - F.ln("b.iso")) / (F.ln("a.iso") - F.ln("b.iso"))
    read = F.coalesce(F.col("same.read_noise"), F.col("b.read_noise") + (F.col("a.read_noise") - F.col("b.read_noise")) * t, F.col("b.read_noise"), F.col("a.read_noise"))
    return w.select(by, "iso", F.col("b.iso").alias("below"), F.col("a.iso").alias("above"), read.alias("read_noise"), F.col("n.iso").alias("nearest"))


def dual_gain_iso(noise: DataFrame, by: str, drop: float = E.DUAL_GAIN_DROP) -> DataFrame:
    """by, dual_gain_iso: the first ISO at which read noise falls by the factor; null where it never does."""
    steps = ladders(noise, by).withColumn("at", F.sequence(F.lit(1), F.size("ladder") - 1))
    ladder = F.col("ladder")
    hits = F.filter("at", lambda i: (ladder[i - 1]["read_noise"] > 0) & (ladder[i - 1]["read_noise"] / ladder[i]["read_noise"] >= drop))
    found = F.when(F.size("ladder") > 1, F.get("ladder", F.get(hits, F.lit(0)))["iso"])
    return steps.select(by, found.alias("dual_gain_iso"))


def exposure_table(sites: DataFrame, noise: DataFrame, ceiling: float) -> DataFrame:
    """A row for each site (site, rate, dual_gain_iso) and ISO of one sensor's table (iso, full_scale, read_noise: tens of rows)."""
    c = E.candidate(F.col("rate"), F.col("iso"), F.col("full_scale"), F.col("read_noise"), F.lit(ceiling), F.col("dual_gain_iso"))
    return sites.crossJoin(F.broadcast(noise)).withColumn("c", c).select("site", "iso", "read_noise", "c.*")


def choose_exposure(table: DataFrame) -> DataFrame:
    """site, iso, exposure_seconds, verdict: of sky-limited ISOs the one with most headroom (to a tenth of a stop), then the
    longest exposure, then the lower ISO; else the lowest ISO whose read noise is within a tenth of the least."""
    t = table.where("verdict <> 'BELOW_DUAL_GAIN'")
    pick = F.struct("iso", "exposure_seconds", "verdict")
    limited = F.col("verdict") == "SKY_LIMITED"
    order = F.struct(F.rint(F.col("headroom_stops") * 10) / 10, "exposure_seconds", -F.col("iso"))
    g = t.groupBy("site").agg(F.max_by(F.when(limited, pick), F.when(limited, order)).alias("good"), F.array_sort(F.collect_list(F.struct("iso", "read_noise", pick.alias("pick")))).alias("all"))
    quiet = F.array_min(F.transform("all", lambda e: e["read_noise"]))
    other = A.let(quiet, lambda q: F.get(F.filter("all", lambda e: e["read_noise"] <= q * (1 + E.INVARIANCE_TOLERANCE)), F.lit(0))["pick"])
    return g.withColumn("p", F.coalesce("good", other)).select("site", "p.*")


def focus_sweep(samples: DataFrame, by: str) -> DataFrame:
    """by, best_diopters, best_hfr, verdict of a sweep of (diopters, hfr, star_count), tens of positions."""
    valid = samples.where((F.col("hfr") > 0) & (F.col("star_count") >= LEAST_STARS))
    g = samples.select(by).distinct().join(valid.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("diopters", "hfr"))).alias("s")), by, "left")
    g = g.withColumn("s", F.coalesce("s", F.array().cast("array<struct<diopters:double,hfr:double>>")))
    g = g.withColumn("h", F.transform("s", lambda e: e["hfr"])).withColumn("i", (F.array_position("h", F.array_min("h")) - 1).cast("int"))
    s, i, n = F.col("s"), F.col("i"), F.size("s")
    at = lambda k: F.get(s, i + k)
    flat = (F.array_max("h") - F.array_min("h")) / F.array_min("h") < FLAT_TOLERANCE
    verdict = F.when(n < LEAST_POSITIONS, F.lit("TOO_FEW_STARS")).when(flat, F.lit("FLAT")).when((i == 0) | (i == n - 1), F.lit("MINIMUM_AT_EDGE")).otherwise(F.lit("CLEAR_MINIMUM"))
    vertex = E.parabola_vertex(at(-1)["diopters"], at(-1)["hfr"], at(0)["diopters"], at(0)["hfr"], at(1)["diopters"], at(1)["hfr"])
    best = F.when(verdict == "CLEAR_MINIMUM", F.coalesce(vertex, at(0)["diopters"])).otherwise(F.coalesce(at(0)["diopters"], F.lit(0.0)))
    return g.select(by, best.alias("best_diopters"), at(0)["hfr"].alias("best_hfr"), verdict.alias("verdict"))
