"""Operators over frames in capture order: windows where state can be written as one, folds where it cannot.

The state machines (star baseline of the gate, residual baseline) live in small step functions that the batch twin
(applyInPandas, per session) and the streaming twin (applyInPandasWithState) share.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nightloom.functions import arrays as A

#: Focus monitor, frame gate, residual monitor, leak limits, thermal policy, running mean.
FOCUS_WINDOW, FOCUS_LEAST, FOCUS_STARS, LOST, DRIFTING, FOCUS_MARGIN = 5, 3, 5, 1.6, 1.25, 0.2
MAX_TILT_DEG, MAX_ECCENTRICITY, LEAST_HFR, LEAST_STARS, COLLAPSE, STAR_WINDOW, STAR_LEAST = 0.5, 0.6, 1.5, 8, 0.5, 15, 3
RESIDUAL_WINDOW, RESIDUAL_LEAST, SPIKE_FACTOR, SPIKE_FLOOR = 12, 5, 3.0, 0.4
LEAK_LIMIT, LEAK_LEAST = 0.5, 20
HEADROOM_FLOOR, BATTERY_CEILING, MAX_GAP_SECONDS = 0.85, 42.0, 30.0
MEAN_DEPTH = 32


def focus_status(frames: DataFrame, reference_hfr: Column, by: str = "session", order: tuple[str, ...] = ("ts", "idx")) -> DataFrame:
    """frames with median_hfr (of the last five valid) and status; invalid frames keep the status before."""
    valid = F.coalesce((F.col("hfr") > 0) & (F.col("star_count") >= FOCUS_STARS), F.lit(False))
    recent = F.collect_list("hfr").over(W.partitionBy(by, "valid").orderBy(*order).rowsBetween(-(FOCUS_WINDOW - 1), 0))
    f = frames.withColumn("valid", valid).withColumn("recent", F.when(F.col("valid"), F.array_sort(recent)))
    f = f.withColumn("m", F.when(F.size("recent") >= FOCUS_LEAST, A.averaged_median(F.col("recent"))))
    status = (
        F.when(~F.col("valid"), F.lit(None))
        .when(F.col("m").isNull(), F.lit("UNKNOWN"))
        .when(F.col("m") > reference_hfr * LOST + FOCUS_MARGIN, F.lit("LOST"))
        .when(F.col("m") > reference_hfr * DRIFTING + FOCUS_MARGIN, F.lit("DRIFTING"))
        .otherwise(F.lit("LOCKED"))
    )
    so_far = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    f = f.withColumn("own", status)
    f = f.withColumns({"status": F.coalesce(F.last("own", True).over(so_far), F.lit("UNKNOWN")), "median_hfr": F.last("m", True).over(so_far)})
    return f.drop("valid", "recent", "m", "own")


def accumulate_offsets(frames: DataFrame, delta: Column, by: str = "session", order: tuple[str, ...] = ("ts", "idx")) -> DataFrame:
    """frames with used_delta (the last known one where it is missing, 0 before any) and its running sum, offset."""
    so_far = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return frames.withColumn("used_delta", F.coalesce(F.last(delta, True).over(so_far), F.lit(0.0))).withColumn("offset", F.sum("used_delta").over(so_far))


def leak_trend(samples: DataFrame, value: str, by: str = "session", order: tuple[str, ...] = ("ts", "idx")) -> DataFrame:
    """by, settled, rate, median_step, leaking, conclusive: growth of a resource over cycles, the first being dropped."""
    w = W.partitionBy(by).orderBy(*order)
    s = samples.withColumns({"rn": F.row_number().over(w), "n": F.count("*").over(W.partitionBy(by)) - 1, "before": F.lag(value).over(w)}).where("rn > 1")
    tail = F.greatest(F.lit(2), F.floor((F.col("n") + 1) / 2))
    s = s.withColumn("tail", tail)
    in_tail = F.col("rn") - 1 > F.col("n") - F.col("tail")
    g = s.groupBy(by).agg(
        F.first("n").alias("settled"), F.first("tail").alias("tail"),
        F.min(F.when(in_tail, F.struct("rn", F.col(value).alias("v")))).alias("a"), F.max(F.when(in_tail, F.struct("rn", F.col(value).alias("v")))).alias("b"),
        F.median(F.when(F.col("rn") > 2, F.col(value) - F.col("before"))).alias("median_step"),
    )
    enough = F.col("settled") >= LEAK_LEAST
    rate = (F.col("b.v") - F.col("a.v")) / (F.col("tail") - 1)
    return g.select(
        by, "settled", F.when(enough, rate).alias("rate"), F.when(enough, F.col("median_step")).alias("median_step"),
        F.when(enough, (rate >= LEAK_LIMIT) | (F.col("median_step") >= LEAK_LIMIT)).otherwise(F.lit(False)).alias("leaking"), enough.alias("conclusive"),
    )


def running_mean(samples: DataFrame, value: str, by: str, order: tuple[str, ...], depth: int = MEAN_DEPTH) -> DataFrame:
    """by, n, mean: a mean whose weight for new samples never falls below 1/depth; missing samples only count as depth."""
    g = samples.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("v")))).alias("xs"))
    start = F.struct(F.lit(0.0).alias("m"), F.lit(0).alias("n"))
    fold = F.aggregate(
        "xs", start,
        lambda a, x: F.struct(F.when(x["v"].isNull() | F.isnan(x["v"]), a["m"]).otherwise(a["m"] + (x["v"] - a["m"]) / F.least(a["n"] + 1, F.lit(depth))).alias("m"), (a["n"] + 1).alias("n")),
    )
    return g.withColumn("r", fold).select(by, F.col("r.n").cast("long").alias("n"), F.col("r.m").alias("mean"))


def thermal_decision(headroom: Column, battery_temp: Column, pacing: Column) -> Column:
    """struct(gap_seconds, throttling)."""
    hot = F.coalesce(headroom >= HEADROOM_FLOOR, F.lit(False)) | F.coalesce(battery_temp >= BATTERY_CEILING, F.lit(False))
    over = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (headroom - HEADROOM_FLOOR) / (1.0 - HEADROOM_FLOOR)))
    excess = F.when(headroom.isNull(), F.lit(0.5)).otherwise(over)  # greatest and least would skip a null
    return F.struct(F.when(hot & pacing, MAX_GAP_SECONDS * (0.3 + 0.7 * excess)).otherwise(F.lit(0.0)).alias("gap_seconds"), hot.alias("throttling"))


def _upper(recent: list) -> float:
    return sorted(recent)[len(recent) // 2]


def gate_step(recent: list[int], frame) -> str | None:
    """The reject reason of a frame (None: accepted); recent, the remembered star counts, is updated."""
    hfr, ecc, tilt = frame.hfr, frame.eccentricity, frame.tilt_deg
    if frame.saturated:
        return "SATURATED"
    if pd.notna(tilt) and tilt > MAX_TILT_DEG:
        return "BUMPED"
    if (pd.isna(hfr) or hfr >= LEAST_HFR) and pd.notna(ecc) and frame.star_count > 0 and ecc > MAX_ECCENTRICITY:
        return "TRAILED"
    if frame.bumped:
        return "BUMPED"
    if frame.star_count < LEAST_STARS:
        return "CLOUD"
    if len(recent) >= STAR_LEAST and frame.star_count < _upper(recent) * COLLAPSE:
        return "CLOUD"
    recent.append(int(frame.star_count))
    del recent[:-STAR_WINDOW]
    return "REGISTRATION" if frame.failed else None


def residual_step(recent: list[float], residual: float) -> str:
    """STEADY, SPIKE or UNKNOWN; spikes are not remembered."""
    if not (0 <= residual < float("inf")):
        return "UNKNOWN"
    known = len(recent) >= RESIDUAL_LEAST
    if known:
        base = _upper(recent)
        if residual > max(base * SPIKE_FACTOR, base + SPIKE_FLOOR):
            return "SPIKE"
    recent.append(float(residual))
    del recent[:-RESIDUAL_WINDOW]
    return "STEADY" if known else "UNKNOWN"


GATE_SCHEMA = "session long, idx long, accepted boolean, reason string"
RESIDUAL_SCHEMA = "session long, idx long, verdict string"


def _gate_rows(session: int, rows: pd.DataFrame, recent: list[int]) -> pd.DataFrame:
    reasons = [gate_step(recent, r) for r in rows.itertuples()]
    return pd.DataFrame({"session": session, "idx": rows.idx.to_numpy(), "accepted": [r is None for r in reasons], "reason": pd.Series(reasons, dtype=object)})


def gate_frames(frames: DataFrame) -> DataFrame:
    """Verdict of every frame, in capture order by session. frames: session, ts, idx, star_count, eccentricity, hfr,
    tilt_deg, saturated, bumped, failed."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _gate_rows(key[0], rows.sort_values(["ts", "idx"], kind="stable"), [])

    return frames.groupBy("session").applyInPandas(run, GATE_SCHEMA)


def residual_verdicts(frames: DataFrame, residual: str) -> DataFrame:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, recent = rows.sort_values(["ts", "idx"], kind="stable"), []
        return pd.DataFrame({"session": key[0], "idx": rows.idx.to_numpy(), "verdict": [residual_step(recent, x) for x in rows[residual]]})

    return frames.groupBy("session").applyInPandas(run, RESIDUAL_SCHEMA)


def gate_stream(frames: DataFrame) -> DataFrame:
    """The gate over a stream: the remembered star counts of a session are its state. Rows of a micro-batch are taken
    in order of (ts, idx)."""
    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["ts", "idx"], kind="stable")
        out = _gate_rows(key[0], rows, recent)
        state.update((recent,))
        yield out

    return frames.groupBy("session").applyInPandasWithState(step, GATE_SCHEMA, "recent array<int>", "append", "NoTimeout")


def residual_stream(frames: DataFrame, residual: str) -> DataFrame:
    """Verdicts of residuals over a stream: the remembered steady ones of a session are its state."""
    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["ts", "idx"], kind="stable")
        out = pd.DataFrame({"session": key[0], "idx": rows.idx.to_numpy(), "verdict": [residual_step(recent, x) for x in rows[residual]]})
        state.update((recent,))
        yield out

    return frames.groupBy("session").applyInPandasWithState(step, RESIDUAL_SCHEMA, "recent array<double>", "append", "NoTimeout")


def focus_stream(frames: DataFrame, reference_hfr: float) -> DataFrame:
    """focus_status over a stream: the last valid measurements of a session, its median and its status are the state."""
    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent, median, status = (list(state.get[0]), *state.get[1:]) if state.exists else ([], None, "UNKNOWN")
        rows = pd.concat(list(parts)).sort_values(["ts", "idx"], kind="stable")
        out = []
        for r in rows.itertuples():
            if pd.notna(r.hfr) and r.hfr > 0 and r.star_count >= FOCUS_STARS:
                recent = [*recent, float(r.hfr)][-FOCUS_WINDOW:]
                if len(recent) < FOCUS_LEAST:
                    status = "UNKNOWN"
                else:
                    s = sorted(recent)
                    median = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
                    lost, drifting = (reference_hfr * k + FOCUS_MARGIN for k in (LOST, DRIFTING))
                    status = "LOST" if median > lost else "DRIFTING" if median > drifting else "LOCKED"
            out.append((median, status))
        state.update((recent, median, status))
        yield pd.DataFrame({"session": key[0], "idx": rows.idx.to_numpy(), "median_hfr": pd.Series([m for m, _ in out], dtype=float), "status": [x for _, x in out]})

    return frames.groupBy("session").applyInPandasWithState(step, "session long, idx long, median_hfr double, status string", "recent array<double>, median double, status string", "append", "NoTimeout")


def running_mean_stream(samples: DataFrame, depth: int = MEAN_DEPTH) -> DataFrame:
    """session, n, mean after every micro-batch. samples: session, ts, idx, value."""
    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, m = state.get if state.exists else (0, 0.0)
        for x in pd.concat(list(parts)).sort_values(["ts", "idx"], kind="stable")["value"]:
            n += 1
            if pd.notna(x):
                m += (x - m) / min(n, depth)
        state.update((n, m))
        yield pd.DataFrame({"session": [key[0]], "n": [n], "mean": [m]})

    return samples.groupBy("session").applyInPandasWithState(step, "session long, n long, mean double", "n long, mean double", "update", "NoTimeout")


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, name: str) -> DataFrame:
    """left with `name`: right's value of the last row with the same keys at or before left's time. One shuffle, no range join:
    both sides are put in one order and the value is carried forward."""
    cols = left.columns
    a = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(*by, F.col(at), F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    w = W.partitionBy(*by).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(name, F.last("_v", True).over(w))
    return both.where("_side = 1").select(*cols, name)


def interval_join(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, bucket_seconds: int) -> DataFrame:
    """spans with the points of the same keys with start < at <= end. Points fall into time buckets and a span is copied to
    each bucket it touches, so it is an equi-join with an exact check, and a busy key spreads over its buckets."""
    second = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    slot = lambda c: F.floor(second(c) / bucket_seconds)
    p = points.withColumn("_slot", slot(at))
    s = spans.withColumn("_slot", F.explode(F.sequence(slot(start), slot(end))))
    return s.join(p, [*by, "_slot"]).where((F.col(at) > F.col(start)) & (F.col(at) <= F.col(end))).drop("_slot")


def interval_join_stream(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, longest: str, late: str) -> DataFrame:
    """interval_join of two streams (times are timestamps). Each side has a watermark `late` behind its newest row, and rows behind
    it are dropped; no span may be longer than `longest`, so a point is kept until the spans' watermark is that far beyond it,
    and a span until the points' watermark has passed its end."""
    too_long = F.raise_error(F.lit(f"a span is longer than {longest}"))
    s = spans.withColumn(end, F.when(F.col(end) > F.col(start) + F.expr(f"INTERVAL {longest}"), too_long.cast("timestamp")).otherwise(F.col(end))).withWatermark(end, late).alias("s")
    p = points.withWatermark(at, late).alias("p")
    same = [F.col(f"s.{c}") == F.col(f"p.{c}") for c in by]
    inside = (F.col(f"p.{at}") > F.col(f"s.{start}")) & (F.col(f"p.{at}") <= F.col(f"s.{end}")) & (F.col(f"p.{at}") >= F.col(f"s.{end}") - F.expr(f"INTERVAL {longest}"))
    on = inside
    for c in same:
        on = on & c
    return s.join(p, on).select(*[F.col(f"s.{c}") for c in spans.columns], *[F.col(f"p.{c}") for c in points.columns if c not in by])
