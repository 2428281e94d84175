"""The deferred stack: calibrate, demosaic, warp each frame, cut it into tiles, and combine every tile over all frames.

Frames come whole (`stack`: a frame is one row until it is warped) or in bands of rows (`stack_bands`: bands are sent to the
output bands they are part of, with a halo). Either way they become rows of tiles, so the shuffle that brings a tile's frames
together carries tile-sized arrays, and the tasks that combine hold one tile of all frames. Users may give their own resampler
(`Resampler`) and their own combiner (`combine_with`).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightloom.operators import robust as K

#: The kernel constant of the bicubic resampler.
BICUBIC = -0.75


#: Colour codes of a 2x2 cell, by pattern name; and what a calibrated sample is raised by before it becomes a whole number.
PATTERNS = {"RGGB": (0, 1, 1, 2), "GRBG": (1, 0, 2, 1), "GBRG": (1, 2, 0, 1), "BGGR": (2, 1, 1, 0)}
PEDESTAL = 4096


def demosaic(mosaic: np.ndarray, cfa: tuple[int, int, int, int] = PATTERNS["GRBG"], first_row: int = 0) -> np.ndarray:
    """Bilinear colour planes (rows, columns, 3) of a mosaic with a 2x2 cell of colour codes; first_row: where its first row stands
    in the frame."""
    h, w = mosaic.shape
    site = np.array(cfa).reshape(2, 2)[(first_row + np.arange(h)[:, None]) % 2, np.arange(w)[None, :] % 2]
    kernel = np.array([[1, 2, 1], [2, 4, 2], [1, 2, 1]], float)
    out = np.empty((h, w, 3))
    for c in range(3):
        mask = (site == c).astype(float)
        v, m = np.pad(np.nan_to_num(mosaic) * mask, 1), np.pad(mask * np.isfinite(mosaic), 1)
        num = sum(kernel[j, i] * v[j : j + h, i : i + w] for j in range(3) for i in range(3))
        den = sum(kernel[j, i] * m[j : j + h, i : i + w] for j in range(3) for i in range(3))
        own = (site == c) & np.isfinite(mosaic)
        out[..., c] = np.where(own, mosaic, np.where(den > 0, num / np.maximum(den, 1e-12), np.nan))
    return out


def demosaic_whole_numbers(mosaic: np.ndarray, cfa: tuple[int, int, int, int] = PATTERNS["GRBG"], first_row: int = 0) -> np.ndarray:
    """As demosaic, of samples raised by the pedestal and cut to unsigned 16-bit whole numbers, which is then taken off again."""
    return demosaic(np.where(np.isfinite(mosaic), np.floor(np.clip(mosaic + PEDESTAL, 0, 65535)), np.nan), cfa, first_row) - PEDESTAL


def _weights(t: np.ndarray) -> list[np.ndarray]:
    a = BICUBIC
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return [far(t + 1), near(t), near(1 - t), far(2 - t)]


def source_place(x: np.ndarray, y: np.ndarray, rotation_deg: float, dx: float, dy: float) -> tuple[np.ndarray, np.ndarray]:
    """Where a reference pixel lies in a frame with this motion."""
    t = np.radians(rotation_deg)
    return x * np.cos(t) - y * np.sin(t) + dx, x * np.sin(t) + y * np.cos(t) + dy


def warp(plane: np.ndarray, rotation_deg: float, dx: float, dy: float, rows: tuple[int, int] | None = None, first_row: int = 0, height: int | None = None) -> np.ndarray:
    """Rows [rows) of a frame moved so that its motion (reference to frame) is undone; what falls outside is missing. plane
    holds the frame's rows from first_row on (all, if not given), `height` is the frame's."""
    w, height = plane.shape[1], height or plane.shape[0]
    y, x = np.mgrid[(rows or (0, height))[0] : (rows or (0, height))[1], 0:w].astype(float)
    sx, sy = source_place(x, y, rotation_deg, dx, dy)
    ix, iy = np.floor(sx).astype(int), np.floor(sy).astype(int)
    wx, wy = _weights(sx - ix), _weights(sy - iy)
    inside = (sx >= 0) & (sy >= 0) & (sx <= w - 1) & (sy <= height - 1)
    total = np.zeros((*x.shape, *plane.shape[2:]))
    for j in range(4):
        at = np.where(inside, np.clip(iy + j - 1, 0, height - 1) - first_row, 0)
        for i in range(4):
            v = plane[at, np.clip(ix + i - 1, 0, w - 1)]
            k = wx[i] * wy[j]
            total += v * (k[..., None] if plane.ndim == 3 else k)
    total[~inside] = np.nan
    return total


def clip_stack(samples: np.ndarray, weights: np.ndarray, kappa: float = K.KAPPA) -> np.ndarray:
    """The clipped weighted mean over the first axis (frames), for all pixels at once; the rules of robust.combine."""
    alive = np.isfinite(samples)
    n = alive.sum(axis=0)
    with np.errstate(all="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # pixels without samples stay missing
        x = np.where(alive, samples, np.nan)
        median = np.nanmedian(x, axis=0)
        centre, dev = median, np.abs(x - median)
        sigma = 1.4826 * np.nanmedian(dev, axis=0)
        sigma = np.where(sigma > 0, sigma, 1.2533 * np.nanmean(dev, axis=0))
        done = n < K.LEAST_SAMPLES
        for _ in range(K.PASSES):
            keep = alive & (x >= centre - kappa * sigma) & (x <= centre + kappa * sigma)
            left = keep.sum(axis=0)
            done |= ~(sigma > 0) | (left == alive.sum(axis=0)) | (left < K.LEAST_SURVIVORS)
            alive = np.where(done, alive, keep)
            y = np.where(alive, samples, np.nan)
            mean = np.nanmean(y, axis=0)
            centre, sigma = np.where(done, centre, mean), np.where(done, sigma, np.nanstd(y, axis=0, ddof=1))
        w = np.where(alive, weights.reshape(-1, *[1] * (samples.ndim - 1)), 0.0)
        value = np.nansum(w * np.where(alive, samples, 0.0), axis=0) / w.sum(axis=0)
    return np.where(n == 0, np.nan, np.where(n < K.LEAST_SAMPLES, median, value))


TILES = "session long, top int, left int, frame long, weight double, height int, width int, values array<float>"
MASTER = "session long, top int, left int, height int, width int, frames int, values array<float>"


def warped_tiles(frames: DataFrame, tile: int = 256, cfa: tuple[int, int, int, int] = (1, 0, 2, 1)) -> DataFrame:
    """Tiles of every frame, demosaicked and moved back. frames: session, frame, width, samples (calibrated, row by row; null where
    missing), weight, rotation_deg, dx, dy."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                v = np.array(r.samples, float).reshape(-1, r.width)
                moved = warp(demosaic(v, cfa), r.rotation_deg, r.dx, r.dy).astype(np.float32)
                rows = []
                for top in range(0, moved.shape[0], tile):
                    for left in range(0, moved.shape[1], tile):
                        t = moved[top : top + tile, left : left + tile]
                        rows.append((r.session, top, left, r.frame, r.weight, t.shape[0], t.shape[1], t.ravel()))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in TILES.split(", ")])

    return frames.mapInPandas(run, TILES)


def combine_tiles(tiles: DataFrame, kappa: float = K.KAPPA) -> DataFrame:
    """Each tile's clipped weighted mean over its frames; frames are taken in order, so the sum does not depend on their arrival."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        h, w = int(rows.height.iloc[0]), int(rows.width.iloc[0])
        cube = np.stack([np.asarray(v, np.float64) for v in rows["values"]])
        out = clip_stack(cube, rows.weight.to_numpy(float), kappa).astype(np.float32)
        return pd.DataFrame([(*key, h, w, len(rows), out)], columns=[c.split()[0] for c in MASTER.split(", ")])

    return tiles.groupBy("session", "top", "left").applyInPandas(run, MASTER)


def stack(frames: DataFrame, tile: int = 256, kappa: float = K.KAPPA) -> DataFrame:
    return combine_tiles(warped_tiles(frames, tile), kappa)


@dataclass(frozen=True)
class Resampler:
    """How a frame becomes colour planes in the reference's place: user code may give its own.

    demosaic(mosaic, cfa, first_row) -> (rows, columns, channels), each row from `halo` rows on either side;
    warp(planes, rotation_deg, dx, dy, rows, first_row, height) -> the reference's rows [rows), each pixel from rows at most
    `reach` above and below its place in the frame."""

    demosaic: Callable = demosaic
    warp: Callable = warp
    halo: int = 1
    reach: int = 3


BILINEAR_BICUBIC = Resampler()


def _rows_needed(motion: dict[str, Column], top: Column, rows: int, width: Column, height: Column, margin: int) -> tuple[Column, Column]:
    """First and last source row (exclusive) of the reference's rows from top on: a motion is linear, so corners bound them."""
    t = F.radians(motion["rotation_deg"])
    ends = [x * F.sin(t) + y * F.cos(t) + motion["dy"] for x in (F.lit(0.0), width - 1.0) for y in (top, F.least(top + rows, height) - 1)]
    low, high = F.floor(F.least(*ends)) - margin, F.floor(F.greatest(*ends)) + margin + 1
    return F.greatest(low, F.lit(0)), F.least(high, height)


def band_tiles(
    bands: DataFrame, motions: DataFrame, tile: int = 256, cfa: tuple[int, int, int, int] = PATTERNS["GRBG"], resampler: Resampler = BILINEAR_BICUBIC
) -> DataFrame:
    """Tiles of every frame, from bands of its rows: no row of the result or of a shuffle holds a whole frame.

    bands: session, frame, width, height, top, rows, samples (calibrated; null where missing); motions: session, frame, weight,
    rotation_deg, dx, dy, one row a frame. The reference is cut into bands of `tile` rows; each source band goes to those that
    its motion, the resampler's reach and the demosaicker's halo make it part of; a task then has one output band of one frame.
    Every band's tiles are made, missing where the frame does not reach; equal to warped_tiles bit by bit for any size of bands."""
    margin = resampler.halo + resampler.reach
    b = bands.join(motions.select("session", "frame", "weight", "rotation_deg", "dx", "dy"), ["session", "frame"])
    outs = F.sequence(F.lit(0), F.ceil(F.col("height") / tile).cast("int") - 1)

    def needs(o: Column) -> Column:
        low, high = _rows_needed({c: F.col(c) for c in ("rotation_deg", "dy")}, (o * tile).cast("double"), tile, F.col("width"), F.col("height"), margin)
        return (F.col("top") < high) & (F.col("top") + F.col("rows") > low)

    sent = b.withColumn("out", F.explode(F.filter(outs, lambda o: needs(o) | (F.col("top") == 0))))  # the first band also says that there is a frame
    sent = sent.withColumn("samples", F.when(needs(F.col("out")), F.col("samples")))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        session, frame, out = key
        r = rows.iloc[0]
        top, height, width = int(out) * tile, int(r.height), int(r.width)
        span = (top, min(top + tile, height))
        held = rows[rows.samples.notna()].sort_values("top")
        if len(held):
            x, y = (np.array(v, float).ravel() for v in np.meshgrid([0, width - 1], [span[0], span[1] - 1]))
            need = source_place(x, y, float(r.rotation_deg), float(r.dx), float(r.dy))[1]
            first = min(int(held.top.iloc[0]), max(0, int(np.floor(need.min())) - margin))
            parts = {int(t): np.asarray(v, float).reshape(-1, width) for t, v in zip(held.top, held.samples, strict=True)}
            last = max(min(height, int(np.floor(need.max())) + margin + 1), *(t + len(v) for t, v in parts.items()))
            mosaic = np.full((last - first, width), np.nan)  # a band that could not be read is missing
            for t, v in parts.items():
                mosaic[t - first : t - first + len(v)] = v
            moved = resampler.warp(resampler.demosaic(mosaic, cfa, first), float(r.rotation_deg), float(r.dx), float(r.dy), span, first, height).astype(np.float32)
        else:
            moved = np.full((span[1] - span[0], width, 3), np.nan, np.float32)
        made = [(session, top, left, frame, r.weight, moved.shape[0], t.shape[1], t.ravel()) for left in range(0, width, tile) for t in [moved[:, left : left + tile]]]
        return pd.DataFrame(made, columns=[c.split()[0] for c in TILES.split(", ")])

    columns = ["session", "frame", "out", "width", "height", "top", "samples", "weight", "rotation_deg", "dx", "dy"]
    return sent.select(*columns).groupBy("session", "frame", "out").applyInPandas(run, TILES)


def stack_bands(bands: DataFrame, motions: DataFrame, tile: int = 256, kappa: float = K.KAPPA, cfa: tuple[int, int, int, int] = PATTERNS["GRBG"], resampler: Resampler = BILINEAR_BICUBIC) -> DataFrame:
    """The deferred stack of frames that come in bands."""
    return combine_tiles(band_tiles(bands, motions, tile, cfa, resampler), kappa)


def master_bands(master: DataFrame, name: Column, width: int, height: int, channels: int = 3) -> DataFrame:
    """name, width, height, channels, top, values: a master's tiles side by side, as rows that a sink writes. A row of tiles is one
    group. master: top, left, height, width, values."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("left")
        parts = [np.asarray(v, np.float32).reshape(int(h), -1, channels) for v, h in zip(rows["values"], rows.height, strict=True)]
        return pd.DataFrame([(key[0], width, height, channels, key[1], np.concatenate(parts, axis=1).ravel())], columns=["name", "width", "height", "channels", "top", "values"])

    tiles = master.select(name.alias("name"), "top", "left", "height", "values")
    return tiles.groupBy("name", "top").applyInPandas(run, "name string, width int, height int, channels int, top int, values array<float>")


class Combiner(Protocol):
    """A user's way to combine the frames of a tile. A state is a tuple of arrays, as many as `fields` names."""

    fields: tuple[str, ...]

    def init(self, shape: tuple[int, ...]) -> tuple[np.ndarray, ...]: ...
    def update(self, state: tuple, plane: np.ndarray, weight: float) -> tuple: ...
    def merge(self, a: tuple, b: tuple) -> tuple: ...
    def finish(self, state: tuple) -> np.ndarray: ...


#: Bytes of partial states that a task holds before it passes them on.
STATE_BYTES = 256 << 20


def combine_with(tiles: DataFrame, combiner: Combiner, channels: int = 3) -> DataFrame:
    """Tiles combined over frames by a user's combiner, in a partial stage before the shuffle and a final one after it: what is
    shuffled is a state a task and tile instead of a plane a frame and tile."""
    lacking = [m for m in ("init", "update", "merge", "finish") if not callable(getattr(combiner, m, None))]
    if lacking:
        raise TypeError(f"{type(combiner).__name__} lacks {', '.join(lacking)}: partial results could not be combined")
    states = "session long, top int, left int, height int, width int, frames int, " + ", ".join(f"`{f}` array<double>" for f in combiner.fields)
    head = ["session", "top", "left", "height", "width"]

    def rows_of(held: dict) -> pd.DataFrame:
        made = [(*key, n, *(np.asarray(v, float).ravel() for v in state)) for key, (n, state) in held.items()]
        return pd.DataFrame(made, columns=[*head, "frames", *combiner.fields])

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = {}, 0
        for part in parts:
            for *key, weight, values in part[[*head, "weight", "values"]].itertuples(index=False):
                key = tuple(key)
                plane = np.asarray(values, float).reshape(key[3], key[4], channels)
                if key not in held:
                    held[key] = (0, combiner.init(plane.shape))
                    size += plane.nbytes * len(combiner.fields)
                n, state = held[key]
                held[key] = n + 1, combiner.update(state, plane, weight)
            if size > STATE_BYTES:
                yield rows_of(held)
                held, size = {}, 0
        yield rows_of(held)

    def final(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shape = (int(rows.height.iloc[0]), int(rows.width.iloc[0]), channels)
        state = None
        for r in rows[list(combiner.fields)].itertuples(index=False):
            other = tuple(np.asarray(v, float).reshape(shape) for v in r)
            state = other if state is None else combiner.merge(state, other)
        out = np.asarray(combiner.finish(state), np.float32).ravel()
        return pd.DataFrame([(*key, *shape[:2], int(rows.frames.sum()), out)], columns=[c.split()[0] for c in MASTER.split(", ")])

    return tiles.select(*head, "weight", "values").mapInPandas(partial, states).groupBy("session", "top", "left").applyInPandas(final, MASTER)


class WeightedMean:
    """The mean of finite samples by weight."""

    fields = ("total", "weight")

    def init(self, shape: tuple[int, ...]) -> tuple[np.ndarray, ...]:
        return np.zeros(shape), np.zeros(shape)

    def update(self, state: tuple, plane: np.ndarray, weight: float) -> tuple:
        there = np.isfinite(plane)
        return state[0] + np.where(there, plane * weight, 0.0), state[1] + np.where(there, weight, 0.0)

    def merge(self, a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], a[1] + b[1]

    def finish(self, state: tuple) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.where(state[1] > 0, state[0] / state[1], np.nan)


class TrimmedMean:
    """The mean of finite samples without the least and the greatest; of all, where there are fewer than three."""

    fields = ("total", "n", "low", "high")

    def init(self, shape: tuple[int, ...]) -> tuple[np.ndarray, ...]:
        return np.zeros(shape), np.zeros(shape), np.full(shape, np.inf), np.full(shape, -np.inf)

    def update(self, state: tuple, plane: np.ndarray, weight: float) -> tuple:
        there = np.isfinite(plane)
        one = np.where(there, plane, 0.0), there * 1.0, np.where(there, plane, np.inf), np.where(there, plane, -np.inf)
        return self.merge(state, one)

    def merge(self, a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], a[1] + b[1], np.minimum(a[2], b[2]), np.maximum(a[3], b[3])

    def finish(self, state: tuple) -> np.ndarray:
        total, n, low, high = state
        with np.errstate(all="ignore"):
            return np.where(n >= 3, (total - low - high) / (n - 2), np.where(n > 0, total / n, np.nan))
