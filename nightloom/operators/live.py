"""Live registration: each frame of a session against the first one that has stars enough to be its reference.

A frame is matched by its stars (by a predicted motion, if one is given and convinces; else by triangles), the match is fitted,
and where that fails the whole planes are correlated. As a batch, the reference is joined to the session's frames and frames
are registered apart, in any number of tasks; only residuals, a few numbers a frame, are judged in order by session. As a
stream, the reference, its plane and the remembered residuals are a session's state. Both use the same kernels and agree.

A frames table has session, ts, idx, stars (array of struct(x, y, flux), sensor coordinates), plane (array of float, row by row, of
a binned frame; null if there is none), plane_width, bin (sensor pixels a plane pixel), width, height (of the sensor), and
optionally seed (struct(rotation_deg, dx, dy): the motion predicted since the reference). A motion turns about the sensor's centre.

Defined results: null stars are none; frames before a reference are STARVED; a plane of another shape than the reference's, or
none, cannot be correlated; repeated idx are frames of their own, in order of (ts, idx).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from nightloom.operators import geometry as G
from nightloom.operators import monitors as M
from nightloom.operators import registration as R

#: Stars a reference needs, and pairs that make a predicted motion convincing.
REFERENCE_STARS, SEED_PAIRS = 8, 3
OUTCOME = "session long, idx long, outcome string, rotation_deg double, dx double, dy double, residual_px double, inliers int, verdict string, reason string, confidence double"
_NAMES = [c.split()[0] for c in OUTCOME.split(", ")]
NO_MATCH, NO_FIT = "no usable star match", "the star fit did not converge"


def brightest(stars, k: int = G.MAX_STARS) -> np.ndarray:
    """x, y, flux of the k brightest, ties in order."""
    v = np.array([[s["x"], s["y"], s["flux"]] for s in stars] if stars is not None else [], float).reshape(-1, 3)
    return v[np.argsort(-v[:, 2], kind="stable")[:k]]


def triangle_shapes(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vertices (by the side opposite, shortest first), long and short side ratio, and sense of a frame's usable triangles."""
    abc = np.array(list(combinations(range(len(xy)), 3)), int).reshape(-1, 3)
    p = xy[abc]
    side = np.hypot(*np.moveaxis(p[:, [1, 2, 0]] - p[:, [2, 0, 1]], 2, 0))  # the side opposite to each vertex
    order = np.argsort(side, axis=1, kind="stable")
    v, d = np.take_along_axis(abc, order, 1), np.take_along_axis(side, order, 1)
    a, b, c = (xy[v[:, i]] for i in range(3))
    cross = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    ok = (d[:, 0] >= G.LEAST_SIDE) & (d[:, 2] <= G.MAX_ELONGATION * d[:, 0]) & (np.abs(cross) >= G.LEAST_CROSS)
    v, d, cross = v[ok], d[ok], cross[ok]
    return v, d[:, 2] / d[:, 0], d[:, 1] / d[:, 0], cross < 0


def asterism_pairs(ref: np.ndarray, tgt: np.ndarray, tolerance: float = G.TOLERANCE) -> np.ndarray:
    """(reference, target, votes) by triangles of one shape; the rules of geometry.asterism_matches."""
    rv, rl, rs, rc = triangle_shapes(ref[:, :2])
    tv, tl, ts, tc = triangle_shapes(tgt[:, :2])
    by = np.argsort(tl)
    first, last = np.searchsorted(tl[by], rl - tolerance, "left"), np.searchsorted(tl[by], rl + tolerance, "right")
    # Each reference triangle looks at the targets in its band of the longer ratio.
    n = last - first
    r = np.repeat(np.arange(len(rl)), n)
    t = by[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)] if len(by) else np.zeros(0, int)
    alike = (rc[r] == tc[t]) & (np.abs(tl[t] - rl[r]) <= tolerance) & (np.abs(ts[t] - rs[r]) <= tolerance)
    votes = np.zeros((len(ref), len(tgt)), int)
    np.add.at(votes, (rv[r[alike]].ravel(), tv[t[alike]].ravel()), 1)
    chances = np.bincount(rv.ravel(), minlength=len(ref))
    i, j = np.nonzero((votes >= G.LEAST_VOTES) & (votes >= chances[:, None] * G.LEAST_SHARE))
    pairs, refs, targets = [], set(), set()
    for a, b in sorted(zip(i.tolist(), j.tolist(), strict=True), key=lambda p: (-votes[p], p)):
        if a not in refs:
            refs.add(a)
            if b not in targets:
                pairs.append((a, b, votes[a, b]))
            targets.add(b)
    return np.array(pairs, int).reshape(-1, 3)


def seed_pairs(ref: np.ndarray, tgt: np.ndarray, seed, centre: np.ndarray) -> np.ndarray:
    """(reference, target, 1) of stars that lie alone near their predicted places."""
    t = np.radians(seed["rotation_deg"])
    o = ref[:, :2] - centre
    at = centre + np.column_stack([o[:, 0] * np.cos(t) - o[:, 1] * np.sin(t), o[:, 0] * np.sin(t) + o[:, 1] * np.cos(t)]) + [seed["dx"], seed["dy"]]
    far = np.hypot(*np.moveaxis(tgt[None, :, :2] - at[:, None], 2, 0))
    pairs, taken = [], set()
    for a, row in enumerate(far):
        order = np.argsort(row, kind="stable")
        second = row[order[1]] if len(row) > 1 else np.inf
        if row[order[0]] <= G.SEED_RADIUS and row[order[0]] < second * G.SEED_AMBIGUITY and order[0] not in taken:
            taken.add(order[0])
            pairs.append((a, int(order[0]), 1))
    return np.array(pairs, int).reshape(-1, 3)


def place(frame, ref: np.ndarray, ref_plane, ref_width: int) -> dict:
    """How a frame lies to the reference; residual_px is null where no stars were fitted."""
    centre = np.array([(frame["width"] - 1) / 2, (frame["height"] - 1) / 2])
    tgt = brightest(frame["stars"])
    pairs, method = np.zeros((0, 3), int), None
    if len(ref) >= 3 and len(tgt) >= 3:
        seed = frame.get("seed")
        if seed is not None:
            pairs, method = seed_pairs(ref, tgt, seed, centre), "SEEDED"
        if len(pairs) < SEED_PAIRS:
            pairs, method = asterism_pairs(ref, tgt), "ASTERISM"
    fit = R.consensus_rigid(ref[pairs[:, 0], :2] - centre, tgt[pairs[:, 1], :2] - centre) if len(pairs) else None
    if fit is not None:
        t, dx, dy, good = fit
        p, q = ref[pairs[good, 0], :2] - centre, tgt[pairs[good, 1], :2] - centre
        off = np.column_stack([p[:, 0] * np.cos(t) - p[:, 1] * np.sin(t) + dx, p[:, 0] * np.sin(t) + p[:, 1] * np.cos(t) + dy]) - q
        return {"outcome": method, "rotation_deg": float(np.degrees(t)), "dx": dx, "dy": dy, "residual_px": float(np.sqrt((off**2).sum(axis=1).mean())), "inliers": int(good.sum())}
    why = NO_FIT if len(pairs) else NO_MATCH
    plane, w = frame["plane"], frame["plane_width"]
    if plane is None or ref_plane is None or len(plane) != len(ref_plane) or w != ref_width:
        return {"outcome": "FAILED", "inliers": 0, "reason": why}
    dx, dy, ratio = R.phase_shift(*(np.asarray(v, float).reshape(-1, int(w)) for v in (ref_plane, plane)))
    if ratio < R.LEAST_PEAK_RATIO:
        return {"outcome": "FAILED", "inliers": 0, "reason": why}
    return {"outcome": "CORRELATED", "rotation_deg": 0.0, "dx": dx * frame["bin"], "dy": dy * frame["bin"], "inliers": 0, "reason": why, "confidence": ratio}


def _records(part: pd.DataFrame) -> Iterator[dict]:
    for r in part.to_dict("records"):
        yield {k: None if v is None or (isinstance(v, float) and np.isnan(v)) else v for k, v in r.items()}


def _table(rows: list[dict], names: list[str]) -> pd.DataFrame:
    """Rows with what they lack as null; texts as plain objects."""
    out = pd.DataFrame(rows, columns=names)
    for c in {"outcome", "verdict", "reason"} & set(names):
        out[c] = pd.Series([r.get(c) for r in rows], dtype=object)
    return out


def _columns(frames: DataFrame) -> list[str]:
    return ["session", "ts", "idx", "stars", "plane", "plane_width", "bin", "width", "height", *(["seed"] if "seed" in frames.columns else [])]


def register(frames: DataFrame) -> DataFrame:
    """The outcome of every frame, as a batch (columns of OUTCOME)."""
    frames = frames.select(*_columns(frames))
    able = frames.where(F.size("stars") >= REFERENCE_STARS)
    order = F.struct("ts", "idx")
    ref = able.groupBy("session").agg(F.min_by(F.struct(order.alias("at"), "stars", "plane", "plane_width"), order).alias("ref"))
    joined = frames.join(ref, "session", "left")
    early = F.col("ref").isNull() | (F.struct("ts", "idx") < F.col("ref.at"))
    state = F.when(early, "STARVED").when(F.struct("ts", "idx") == F.col("ref.at"), "REFERENCE")
    joined = joined.withColumn("outcome", state)
    apart = joined.where("outcome IS NULL").select(*frames.columns, F.col("ref.stars").alias("ref_stars"), F.col("ref.plane").alias("ref_plane"), F.col("ref.plane_width").alias("ref_width"))
    schema = "session long, ts timestamp, idx long, outcome string, rotation_deg double, dx double, dy double, residual_px double, inliers int, reason string, confidence double"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [{"session": r["session"], "ts": r["ts"], "idx": r["idx"], **place(r, brightest(r["ref_stars"]), r["ref_plane"], r["ref_width"])} for r in _records(part)]
            yield _table(out, names)

    placed = apart.withColumn("ts", F.col("ts").cast("timestamp")).mapInPandas(run, schema)
    judged = M.residual_verdicts(placed.where("residual_px IS NOT NULL").select("session", "ts", "idx", "residual_px"), "residual_px")
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in OUTCOME.split(", ")[3:7])]
    rest = joined.where("outcome IS NOT NULL").select("session", "idx", "outcome", *none, F.lit(0).alias("inliers"), F.lit("UNKNOWN").alias("verdict"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("double").alias("confidence"))
    return placed.join(judged, ["session", "idx"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("UNKNOWN"))).select(*_NAMES).unionByName(rest.select(*_NAMES), allowMissingColumns=True)


class Registrar(StatefulProcessor):
    """A session's reference stars and plane, set once, and the residuals that are remembered."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reference = handle.getValueState("reference", "stars array<struct<x: double, y: double, flux: double>>")
        self.plane = handle.getValueState("plane", "plane array<float>, plane_width int")
        self.residuals = handle.getValueState("residuals", "recent array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (session,) = key
        part = pd.concat(list(rows)).sort_values(["ts", "idx"], kind="stable")
        ref = brightest(_structs(self.reference.get()[0])) if self.reference.exists() else None
        plane, width = self.plane.get() if self.plane.exists() else (None, None)
        recent = list(self.residuals.get()[0]) if self.residuals.exists() else []
        out = []
        for r in _records(part):
            row = {"session": session, "idx": r["idx"], "inliers": 0, "verdict": "UNKNOWN"}
            stars = r["stars"] if r["stars"] is not None else []
            if ref is None and len(stars) < REFERENCE_STARS:
                row["outcome"] = "STARVED"
            elif ref is None:
                row["outcome"], ref, plane, width = "REFERENCE", brightest(stars), r["plane"], r["plane_width"]
                self.reference.update(([(float(a), float(b), float(c)) for a, b, c in ref],))
                if plane is not None:
                    self.plane.update(([float(v) for v in plane], int(width)))
            else:
                row |= place(r, ref, plane, width)
                if row.get("residual_px") is not None:
                    row["verdict"] = M.residual_step(recent, row["residual_px"])
            out.append(row)
        self.residuals.update((recent,))
        yield _table(out, _NAMES)

    def close(self) -> None:
        pass


def _structs(stars) -> list[dict]:
    return [dict(zip(("x", "y", "flux"), s, strict=True)) for s in stars]


def register_stream(frames: DataFrame) -> DataFrame:
    """The outcome of every frame, as a stream. Frames of a micro-batch are taken in order of (ts, idx)."""
    return frames.select(*_columns(frames)).groupBy("session").transformWithStateInPandas(Registrar(), OUTCOME, "append", "None")
