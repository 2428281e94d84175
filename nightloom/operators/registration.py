"""2-D kernels that columns cannot express, as small NumPy functions that Spark runs by frame: components and star moments,
phase correlation, rigid consensus, the largest covered rectangle, the common area of turned frames."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.functions.arrays import MAD_TO_SIGMA
from nightloom.operators.flats import LEAST_SIGMA, NOISE_STRIDE

#: Fixed values of detection, correlation and consensus.
LEAST_PIXELS, MOST_PIXELS = 3, 2000
LEAST_PEAK_RATIO, EXCLUSION, MOST_RATIO = 50.0, 4, 10_000.0
TOLERANCE_PX, LEAST_BASELINE, LEAST_PAIRS = 2.0, 20.0, 3


def grid_of(rows: pd.DataFrame, fill: float = np.nan) -> np.ndarray:
    out = np.full((int(rows.y.max()) + 1, int(rows.x.max()) + 1), fill)
    out[rows.y.to_numpy(int), rows.x.to_numpy(int)] = rows.v
    return out


def label(mask: np.ndarray) -> np.ndarray:
    """Numbers of 8-connected components (0 outside; a component has the number of its first cell, counted by rows from 1): runs
    of each row are joined with those they touch in the next, and roots are halved until nothing changes."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    if not len(row):
        return np.zeros(mask.shape, int)
    span = w + 2
    first = np.searchsorted(row * span + end, (row + 1) * span + start)  # runs below that end at or after this one's start
    past = np.searchsorted(row * span + start, (row + 1) * span + end, side="right")
    n = np.maximum(past - first, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    root = np.arange(len(row))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    ids = np.zeros(mask.shape, int)
    length = end - start
    at = np.repeat(row * w + start - np.cumsum(length) + length, length) + np.arange(length.sum())
    ids.ravel()[at] = np.repeat((row * w + start + 1)[root], length)
    return ids


def background_of(v: np.ndarray, tile: int = 64) -> np.ndarray:
    """The background under a plane: medians of tiles, bilinear between their centres and straight on beyond the outer ones."""
    h, w = v.shape
    down, across = -(-h // tile), -(-w // tile)
    level = np.array([[np.nanmedian(v[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile]) for c in range(across)] for r in range(down)])

    def ends(n: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n) + 0.5) / tile - 0.5
        low = np.clip(np.floor(at).astype(int), 0, max(count - 2, 0))
        return low, np.minimum(low + 1, count - 1), at - low if count > 1 else np.zeros(n)

    (y0, y1, fy), (x0, x1, fx) = ends(h, down), ends(w, across)
    top = level[y0][:, x0] + (level[y0][:, x1] - level[y0][:, x0]) * fx
    low = level[y1][:, x0] + (level[y1][:, x1] - level[y1][:, x0]) * fx
    return top + (low - top) * fy[:, None]


def star_moments(v: np.ndarray, background: np.ndarray | float, threshold: np.ndarray | float) -> pd.DataFrame:
    """flux, x, y, hfr, eccentricity of each component above the threshold, brightest first."""
    ys, xs = np.nonzero(v > threshold)
    if not len(ys):
        return pd.DataFrame(columns=["flux", "x", "y", "hfr", "eccentricity"], dtype=float)
    _, k = np.unique(label(v > threshold)[ys, xs], return_inverse=True)
    n = np.bincount(k)
    w = v[ys, xs] - np.broadcast_to(background, v.shape)[ys, xs]
    total = lambda values: np.bincount(k, values, minlength=len(n))
    flux = total(w)
    safe = np.where(flux > 0, flux, 1.0)
    x, y = total(xs * w) / safe, total(ys * w) / safe
    dx, dy = xs - x[k], ys - y[k]
    a, b, c = np.maximum(0.0, total(w * dx**2) / safe), total(w * dx * dy) / safe, np.maximum(0.0, total(w * dy**2) / safe)
    root = np.sqrt(((a - c) / 2) ** 2 + b * b)
    major, minor = (a + c) / 2 + root, np.maximum(0.0, (a + c) / 2 - root)
    ecc = np.sqrt(1 - np.divide(minor, major, out=np.ones_like(major), where=major > 0))
    stars = pd.DataFrame({"flux": flux, "x": x, "y": y, "hfr": total(w * np.hypot(dx, dy)) / safe, "eccentricity": ecc})
    good = (n >= LEAST_PIXELS) & (n <= MOST_PIXELS) & (flux > 0)
    return stars[good].sort_values(list(stars.columns), ascending=False, ignore_index=True)


STARS_SCHEMA = "frame long, star long, flux double, x double, y double, hfr double, eccentricity double"


def detect_stars(planes: DataFrame, sigma: float = 5.0) -> DataFrame:
    """Stars of each frame of planes (frame, x, y, v): the background follows the tiles' medians, the noise is the upper median
    deviation from it over every seventh pixel."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = grid_of(rows)
        level = background_of(np.where(np.isnan(v), np.nanmedian(v), v))
        off = np.sort(np.abs(v - level).ravel()[::NOISE_STRIDE])
        off = off[~np.isnan(off)]
        noise = max(LEAST_SIGMA, MAD_TO_SIGMA * float(off[len(off) // 2])) if len(off) else LEAST_SIGMA
        stars = star_moments(np.where(np.isnan(v), level, v), level, level + sigma * noise)
        stars.insert(0, "frame", key[0])
        stars.insert(1, "star", np.arange(len(stars)))
        return stars

    return planes.groupBy("frame").applyInPandas(run, STARS_SCHEMA)


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """dx, dy by which b is a moved, and how far the correlation's peak stands out."""
    def window(n: int) -> np.ndarray:
        return 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(n) + 0.5) / n)

    h, w = a.shape
    hann = np.outer(window(h), window(w))
    fa, fb = (np.fft.fft2((p - p.mean()) * hann) for p in (a, b))
    cross = fb * np.conj(fa)
    r = np.real(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)))
    py, px = np.unravel_index(np.argmax(r), r.shape)
    near = np.zeros_like(r, bool)
    span = np.arange(-EXCLUSION, EXCLUSION + 1)
    near[np.ix_((py + span) % h, (px + span) % w)] = True
    rest = np.sqrt((r[~near] ** 2).mean()) if (~near).any() else 0.0
    ratio = min(MOST_RATIO, float((r[py, px] / rest) ** 2)) if rest > 0 else MOST_RATIO

    def fine(before: float, at: float, after: float) -> float:
        den = before - 2 * at + after
        return 0.5 * (before - after) / den if abs(den) > 1e-12 else 0.0

    dx = px + fine(r[py, (px - 1) % w], r[py, px], r[py, (px + 1) % w])
    dy = py + fine(r[(py - 1) % h, px], r[py, px], r[(py + 1) % h, px])
    return float(dx - w if dx > w / 2 else dx), float(dy - h if dy > h / 2 else dy), ratio


def phase_correlation(planes: DataFrame) -> DataFrame:
    """frame, dx, dy, ratio, accepted of planes (frame, x, y, v, w): w is the reference plane's value at the same pixel."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = np.nan_to_num(grid_of(rows.assign(v=rows.w))), np.nan_to_num(grid_of(rows))
        dx, dy, ratio = phase_shift(a, b)
        return pd.DataFrame([(key[0], dx, dy, ratio, ratio >= LEAST_PEAK_RATIO)], columns=["frame", "dx", "dy", "ratio", "accepted"])

    return planes.groupBy("frame").applyInPandas(run, "frame long, dx double, dy double, ratio double, accepted boolean")


def least_squares_rigid(p: np.ndarray, q: np.ndarray) -> tuple[float, float, float]:
    """Rotation (radians), dx, dy of the best rigid motion from p to q (n by 2)."""
    a, b = p - p.mean(axis=0), q - q.mean(axis=0)
    t = np.arctan2((a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum(), (a * b).sum())
    rot = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    d = q.mean(axis=0) - rot @ p.mean(axis=0)
    return float(t), float(d[0]), float(d[1])


def consensus_rigid(p: np.ndarray, q: np.ndarray, tolerance: float = TOLERANCE_PX) -> tuple[float, float, float, np.ndarray] | None:
    """The motion with most inliers among those of all pairs of correspondences (deterministic), refined on its inliers."""
    def inliers(t: float, dx: float, dy: float) -> np.ndarray:
        x = p[:, 0] * np.cos(t) - p[:, 1] * np.sin(t) + dx
        y = p[:, 0] * np.sin(t) + p[:, 1] * np.cos(t) + dy
        return np.hypot(x - q[:, 0], y - q[:, 1]) <= tolerance

    best = None
    for i, j in combinations(range(len(p)), 2):
        if np.hypot(*(p[i] - p[j])) < LEAST_BASELINE:
            continue
        good = inliers(*least_squares_rigid(p[[i, j]], q[[i, j]]))
        if best is None or good.sum() > best.sum():
            best = good
    if best is None or best.sum() < LEAST_PAIRS:
        return None
    for _ in range(3):
        motion = least_squares_rigid(p[best], q[best])
        new = inliers(*motion)
        if new.sum() < LEAST_PAIRS or (new == best).all():
            break
        best = new
    return (*motion, best)


RIGID_SCHEMA = "frame long, rotation_deg double, dx double, dy double, inliers long, pairs long"


def rigid_fit(pairs: DataFrame, tolerance: float = TOLERANCE_PX) -> DataFrame:
    """The rigid motion of each frame's correspondences (frame, x, y, u, v), at most a few tens a frame; none without consensus."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x", "y", "u", "v"])
        got = consensus_rigid(rows[["x", "y"]].to_numpy(), rows[["u", "v"]].to_numpy(), tolerance)
        out = [] if got is None else [(key[0], np.degrees(got[0]), got[1], got[2], int(got[3].sum()), len(rows))]
        return pd.DataFrame(out, columns=["frame", "rotation_deg", "dx", "dy", "inliers", "pairs"])

    return pairs.groupBy("frame").applyInPandas(run, RIGID_SCHEMA)


def largest_rectangle(mask: np.ndarray) -> tuple[int, int, int, int]:
    """left, top, width, height of the largest all-true rectangle; the first best in row order."""
    best, heights = (0, 0, 0, 0), np.zeros(mask.shape[1], int)
    for y, row in enumerate(mask):
        heights = np.where(row, heights + 1, 0)
        stack: list[tuple[int, int]] = []
        for x, h in enumerate([*heights.tolist(), 0]):
            start = x
            while stack and stack[-1][1] >= h:
                start, tall = stack.pop()
                if tall * (x - start) > best[2] * best[3]:
                    best = (start, y - tall + 1, x - start, tall)
            stack.append((start, h))
    return best


def largest_covered(coverage: DataFrame, by: str) -> DataFrame:
    """by, left, top, width, height of the largest rectangle of fully covered pixels (by, x, y, v: 1 covered, 0 not); no row if none is."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, top, width, height = largest_rectangle(grid_of(rows, 0.0) > 0)
        return pd.DataFrame([(key[0], left, top, width, height)] if width else [], columns=["k", "left", "top", "width", "height"])

    return coverage.groupBy(by).applyInPandas(run, "k long, left long, top long, width long, height long").withColumnRenamed("k", by)


def clip_convex(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """The part of a polygon inside a convex polygon (both counter-clockwise, n by 2)."""
    out, corners = subject.tolist(), clip.tolist()  # a few corners: plain numbers are quicker than arrays
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        sides = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in out]
        kept = []
        for (px, py), dp, (qx, qy), dq in zip(out, sides, out[1:] + out[:1], sides[1:] + sides[:1], strict=True):
            if dp >= 0:
                kept.append((px, py))
            if (dp >= 0) != (dq >= 0):
                kept.append((px + (qx - px) * dp / (dp - dq), py + (qy - py) * dp / (dp - dq)))
        out = kept
        if not out:
            break
    return np.array(out, float).reshape(-1, 2)


def area(polygon: np.ndarray) -> float:
    if len(polygon) < 3:
        return 0.0
    x, y = polygon.T
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


AREA_STATE = "xs array<double>, ys array<double>, frames long"


class CommonArea:
    """What some turned frames have in common, as a convex polygon in the reference's coordinates: an associative, commutative
    fold, so that parts of a session may be folded anywhere and merged in any order. A frame without a motion counts, but
    narrows nothing."""

    def __init__(self, width: float, height: float, polygon: np.ndarray | None = None, frames: int = 0) -> None:
        self.corners = np.array([[0, 0], [width, 0], [width, height], [0, height]], float)
        self.polygon = self.corners if polygon is None else polygon
        self.frames = frames

    def include(self, rotation_deg: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> None:
        """Frames' motions, as arrays."""
        self.frames += len(dx)
        known = ~(np.isnan(rotation_deg) | np.isnan(dx) | np.isnan(dy))
        t = -np.radians(rotation_deg[known])
        x, y = self.corners[:, 0] - dx[known, None], self.corners[:, 1] - dy[known, None]
        footprints = np.stack([x * np.cos(t)[:, None] - y * np.sin(t)[:, None], x * np.sin(t)[:, None] + y * np.cos(t)[:, None]], axis=2)
        while len(footprints) and len(self.polygon):
            # Only footprints that a corner of the polygon lies outside of narrow it.
            a, b = footprints[:, :, None], np.roll(footprints, -1, axis=1)[:, :, None]
            p = self.polygon[None, None]
            side = (b[..., 0] - a[..., 0]) * (p[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (p[..., 0] - a[..., 0])
            cuts = np.flatnonzero((side < 0).any(axis=(1, 2)))
            if not len(cuts):
                break
            deepest = cuts[np.argmin(side[cuts].min(axis=(1, 2)))]
            self.polygon = clip_convex(self.polygon, footprints[deepest])
            footprints = np.delete(footprints[cuts], np.flatnonzero(cuts == deepest), axis=0)

    def merge(self, other: CommonArea) -> CommonArea:
        self.frames += other.frames
        self.polygon = clip_convex(self.polygon, other.polygon) if len(other.polygon) >= 3 and len(self.polygon) else np.zeros((0, 2))
        return self

    @property
    def fraction(self) -> float:
        return min(1.0, area(self.polygon) / area(self.corners))

    def state(self) -> tuple[list[float], list[float], int]:
        return *(v.tolist() for v in self.polygon.T), int(self.frames)

    @staticmethod
    def of(width: float, height: float, xs, ys, frames: int) -> CommonArea:
        return CommonArea(width, height, np.column_stack([np.asarray(xs, float), np.asarray(ys, float)]).reshape(-1, 2), int(frames))


#: Frames that a task folds at a time, of many sessions at once.
FOLD_ROWS = 65_536


def _sides(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What is not negative where a point lies inside an edge from a to b (last axis: x, y)."""
    return (b[..., 0] - a[..., 0]) * (p[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (p[..., 0] - a[..., 0])


def _clip_many(polygons: np.ndarray, corners: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polygons (n, most corners + 1, 2; what lies beyond a polygon's corners is its first one) clipped by an edge each."""
    d = _sides(a[:, None], b[:, None], polygons)
    p, q, dp, dq = polygons[:, :-1], polygons[:, 1:], d[:, :-1], d[:, 1:]
    own = np.arange(p.shape[1]) < corners[:, None]
    kept, cross = own & (dp >= 0), own & ((dp >= 0) != (dq >= 0))
    met = p + (q - p) * (dp / np.where(cross, dp - dq, 1.0))[..., None]
    points = np.stack([p, met], axis=2).reshape(len(p), -1, 2)
    there = np.stack([kept, cross], axis=2).reshape(len(p), -1)
    corners = there.sum(axis=1)
    order = np.argsort(~there, axis=1, kind="stable")[:, : int(corners.max(initial=0)) + 1]
    points = np.take_along_axis(points, order[..., None], axis=1)
    points = np.where((np.arange(points.shape[1]) < corners[:, None])[..., None], points, points[:, :1])
    return np.concatenate([points, points[:, :1]], axis=1), corners


def narrow_many(number: np.ndarray, motions: np.ndarray, n: int, width: float, height: float) -> tuple[np.ndarray, np.ndarray]:
    """The frames (places of rows) whose footprints narrow the common areas of n sessions, and what share of a frame each area
    is. number: session of a row, 0 to n - 1; motions: rotation_deg, dx, dy. The frames that narrow give the area of all, so
    a fold of them with others is a fold of all. In each step every session is clipped by its frame that cuts deepest."""
    frame = np.array([[0, 0], [width, 0], [width, height], [0, height]], float)
    polygons, corners = np.tile(np.vstack([frame, frame[:1]]), (n, 1, 1)), np.full(n, 4)
    left = np.flatnonzero(~np.isnan(motions).any(axis=1))
    t = -np.radians(motions[left, 0])
    x, y = frame[:, 0] - motions[left, 1, None], frame[:, 1] - motions[left, 2, None]
    a = np.stack([x * np.cos(t)[:, None] - y * np.sin(t)[:, None], x * np.sin(t)[:, None] + y * np.cos(t)[:, None]], axis=2)
    least = -1e-10 * max(width, height)  # less is the error of the numbers
    chosen = []
    while len(left):
        few = max(1, 2**21 // polygons.shape[1])  # frames at a time, so that areas of many corners take no more memory
        parts = [slice(k, k + few) for k in range(0, len(left), few)]
        depth = np.concatenate([_sides(a[k, :, None], np.roll(a[k], -1, axis=1)[:, :, None], polygons[number[left[k]], None]).min(axis=(1, 2)) for k in parts])
        cuts = np.flatnonzero((depth < least) & (corners[number[left]] > 0))
        cuts = cuts[np.lexsort((depth[cuts], number[left[cuts]]))]
        sessions, first = np.unique(number[left[cuts]], return_index=True)
        deepest = cuts[first]
        if not len(deepest):
            break
        chosen.append(left[deepest])
        some, count = polygons[sessions], corners[sessions]
        for k in range(4):
            some, count = _clip_many(some, count, a[deepest, k], a[deepest, (k + 1) % 4])
        grown = max(polygons.shape[1], some.shape[1])
        polygons, some = (np.concatenate([p, np.repeat(p[:, :1], grown - p.shape[1], axis=1)], axis=1) for p in (polygons, some))
        polygons[sessions], corners[sessions] = some, count
        rest = np.sort(np.delete(cuts, first))
        left, a = left[rest], a[rest]
    polygons[corners < 3] = 0
    x, y = polygons[..., 0], polygons[..., 1]
    areas = np.abs((x[:, :-1] * y[:, 1:] - x[:, 1:] * y[:, :-1]).sum(axis=1)) / 2
    return np.concatenate(chosen) if chosen else np.zeros(0, int), np.minimum(1.0, areas / (width * height))


def common_area(motions: DataFrame, width: float, height: float) -> DataFrame:
    """session, frames, fraction: what all turned frames of a session (session, idx, rotation_deg, dx, dy) have in common. Frames
    without a session belong to none.

    Every task keeps of its sessions the frames that narrow the area, mostly some tens, with the number of all; those meet by
    session, sorted, and are folded in the same way. A fold takes FOLD_ROWS rows of many sessions at once. No task holds a
    session's frames."""
    names = ["session", "rotation_deg", "dx", "dy", "frames"]

    def fold(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The frames that narrow, with all frames' number in a session's first row, and the areas."""
        number, sessions = pd.factorize(rows.session)
        chosen, fractions = narrow_many(number, rows[["rotation_deg", "dx", "dy"]].to_numpy(float), len(sessions), width, height)
        counts = np.bincount(number, rows.frames, len(sessions)).astype(np.int64)
        # A row without a motion bears the number.
        kept = pd.DataFrame({"session": sessions, "rotation_deg": np.nan, "dx": np.nan, "dy": np.nan, "frames": counts})
        return pd.concat([kept, rows.iloc[chosen].assign(frames=0)[names]]), pd.DataFrame({"session": sessions, "frames": counts, "fraction": fractions})

    def filled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for part in parts:
            held.append(part)
            if sum(map(len, held)) >= FOLD_ROWS:
                yield pd.concat(held)
                held = []
        if held:
            yield pd.concat(held)

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = None
        for rows in filled(parts):
            known = fold(rows if known is None else pd.concat([known, rows]))[0]
            if len(known) >= FOLD_ROWS:
                yield known
                known = None
        if known is not None:
            yield known

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = None  # of the last session, which may go on
        for rows in filled(parts):
            rows = rows if known is None else pd.concat([known, rows])
            known, areas = fold(rows)
            last = rows.session.iloc[-1]
            yield areas[areas.session != last]
            known = known[known.session == last]
        if known is not None and len(known):
            yield fold(known)[1]

    m = motions.where("session IS NOT NULL").select(F.col("session").cast("long").alias("session"), *[F.col(c).cast("double").alias(c) for c in names[1:4]], F.lit(1).cast("long").alias("frames"))
    meet = m.mapInPandas(partial, "session long, rotation_deg double, dx double, dy double, frames long").repartition("session").sortWithinPartitions("session")
    return meet.mapInPandas(whole, "session long, frames long, fraction double")


def common_area_stream(motions: DataFrame, width: float, height: float) -> DataFrame:
    """session, frames, fraction after every micro-batch: the polygon and the count of a session are its state."""
    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = CommonArea.of(width, height, *state.get) if state.exists else CommonArea(width, height)
        for part in parts:
            known.include(*part[["rotation_deg", "dx", "dy"]].to_numpy(float).T)
        state.update(known.state())
        yield pd.DataFrame([(key[0], known.frames, known.fraction)], columns=["session", "frames", "fraction"])

    return motions.groupBy("session").applyInPandasWithState(step, "session long, frames long, fraction double", AREA_STATE, "update", "NoTimeout")
