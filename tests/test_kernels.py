"""NumPy kernels against planted truth or brute force, and raw files by round trip."""

import numpy as np
import pandas as pd
import pytest

from nightloom.operators import planes as P
from nightloom.operators import registration as R
from nightloom.sources import tiff


def test_largest_rectangle_against_all():
    rng = np.random.default_rng(1)
    for _ in range(30):
        m = rng.random((7, 9)) < 0.75
        best = max((w * h for y in range(7) for x in range(9) for h in range(1, 8 - y) for w in range(1, 10 - x) if m[y : y + h, x : x + w].all()), default=0)
        left, top, w, h = R.largest_rectangle(m)
        assert w * h == best and m[top : top + h, left : left + w].all()


def test_a_plane_without_covered_pixels_has_no_rectangle(spark):
    rows = [(k, x, y, float(k == 2 and (x, y) == (1, 2))) for k in (1, 2) for x in range(4) for y in range(3)]
    got = R.largest_covered(spark.createDataFrame(rows, "frame long, x long, y long, v double"), "frame").collect()
    assert [tuple(r) for r in got] == [(2, 1, 2, 1, 1)]


def test_labels_join_diagonals():
    ids = R.label(np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1]], bool))
    assert len(np.unique(ids[ids > 0])) == 3 and ids[0, 0] == ids[1, 1]


def test_labels_against_flooding():
    rng = np.random.default_rng(2)
    masks = [rng.random((17, 23)) < p for p in (0.1, 0.4, 0.6, 0.9)] + [np.zeros((3, 4), bool), np.ones((5, 5), bool)]
    spiral = np.zeros((31, 31), bool)
    for k in range(0, 15, 2):
        spiral[k, k : 31 - k] = spiral[30 - k, k : 31 - k] = spiral[k : 31 - k, k] = spiral[k : 31 - k, 30 - k] = True
    for m in [*masks, spiral]:
        got, want = R.label(m), np.zeros(m.shape, int)
        for y, x in zip(*np.nonzero(m), strict=True):
            if not want[y, x]:
                stack = [(y, x)]
                while stack:
                    b, a = stack.pop()
                    if 0 <= b < m.shape[0] and 0 <= a < m.shape[1] and m[b, a] and not want[b, a]:
                        want[b, a] = y * m.shape[1] + x + 1
                        stack += [(b + i, a + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert (got == want).all()


def test_stars_over_a_sloping_sky(spark):
    y, x = np.mgrid[0:128, 0:192].astype(float)
    rng = np.random.default_rng(4)
    stars = [(30.2, 40.6), (100.5, 90.1), (170.3, 20.8), (60.0, 110.0)]
    v = 100 + x * 2 + y + rng.normal(0, 2, x.shape)
    for a, b in stars:
        v += 400 * np.exp(-((x - a) ** 2 + (y - b) ** 2) / 6)
    v[5, 7] = np.nan
    rows = pd.DataFrame({"frame": 1, "x": x.ravel().astype(int), "y": y.ravel().astype(int), "v": v.ravel()}).dropna()
    got = R.detect_stars(spark.createDataFrame(rows), 6.0).orderBy("star").collect()
    assert len(got) == 4 and all(min(np.hypot(r.x - a, r.y - b) for r in got) < 0.2 for a, b in stars)


def test_common_area_against_points(spark):
    motions = [(1, 0, 3.0, 10.0, -5.0), (1, 1, -4.0, -20.0, 12.0), (1, 2, 0.0, 0.0, 0.0), (2, 0, 0.0, 900.0, 0.0), (3, 0, 0.0, 128.0, 0.0)]
    got = {r.session: r.fraction for r in R.common_area(spark.createDataFrame(motions, "session long, idx long, rotation_deg double, dx double, dy double"), 512.0, 384.0).collect()}
    gy, gx = np.mgrid[0.5:384, 0.5:512]
    inside = np.ones(gx.shape, bool)
    for _, _, deg, dx, dy in motions[:3]:
        t = np.radians(deg)
        u, w = gx * np.cos(t) - gy * np.sin(t) + dx, gx * np.sin(t) + gy * np.cos(t) + dy
        inside &= (u >= 0) & (u <= 512) & (w >= 0) & (w <= 384)
    assert got[1] == pytest.approx(inside.mean(), abs=0.005) and got[2] == 0 and got[3] == pytest.approx(0.75)


def test_uncovered_pixels_and_floors(spark):
    from nightloom.operators import robust

    rows = [("dead", None), ("dead", float("nan")), *[("two", x) for x in (1.0, 3.0)], *[("flat", 5.0) for _ in range(6)], *[("spread", x) for x in (1.0, 2.0, 3.0, 4.0, 5.0, 60.0)], *[("floor", x) for x in (0.0, 0.0, 10.0, 10.0, 20.0, 20.0)]]
    df = spark.createDataFrame(rows, "pixel string, v double")
    got = {r.pixel: r for r in robust.combine(df, ["pixel"], df.v).collect()}
    assert (got["dead"].n, got["dead"].survivors) == (0, 0) and np.isnan(got["dead"].value) and got["two"].value == 2.0 and got["spread"].value == 3.0
    s = robust.rejection_stats(df, ["pixel"], df.v, 0.1).first()
    assert (s.pixels, s.samples, s.uncovered, s.below_floor, s.degenerate_spread) == (5, 20, 1, 1, 1) and s.floor_hit == 2


def test_star_moments():
    y, x = np.mgrid[0:40, 0:60]
    v = 10 + 100 * np.exp(-((x - 20.3) ** 2 + (y - 15.6) ** 2) / 8) + 60 * np.exp(-((x - 45) ** 2 / 20 + (y - 25) ** 2 / 4))
    s = R.star_moments(v, 10.0, 13.0)
    assert len(s) == 2
    assert abs(s.x[0] - 20.3) < 0.05 and abs(s.y[0] - 15.6) < 0.05 and s.eccentricity[0] < 0.2 < 0.7 < s.eccentricity[1]


def test_consensus_finds_planted_motion():
    rng = np.random.default_rng(3)
    p = rng.random((24, 2)) * 400
    t = np.radians(8.25)
    q = p @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) + [12, 40] + rng.normal(0, 0.1, (24, 2))
    q[::3] += 60
    got = R.consensus_rigid(p, q)
    assert abs(np.degrees(got[0]) - 8.25) < 0.15 and abs(got[1] - 12) < 0.6 and abs(got[2] - 40) < 0.6 and got[3].sum() == 16
    assert R.consensus_rigid(p[:2], q[:2]) is None


def test_phase_shift():
    rng = np.random.default_rng(5)
    a = rng.random((64, 96))
    dx, dy, ratio = R.phase_shift(a, np.roll(a, (3, -5), axis=(0, 1)))
    assert abs(dx + 5) < 0.2 and abs(dy - 3) < 0.2 and ratio > R.LEAST_PEAK_RATIO


def test_clip_and_area():
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    assert R.area(R.clip_convex(square, square + [5, 2])) == pytest.approx(40)
    assert R.area(R.clip_convex(square, square + [50, 0])) == 0


def test_gradient_is_recovered(spark):
    x, y = np.meshgrid(np.arange(24), np.arange(18))
    v = 100 + 3.0 * x / 24 + 5 * (y / 18) ** 2
    rows = [(int(a), int(b), float(c)) for a, b, c in zip(x.ravel(), y.ravel(), v.ravel(), strict=True)]
    plane = spark.createDataFrame(rows, "x int, y int, v double")
    flat = P.subtract_gradient(plane, P.fit_gradient(plane, 24.0, 18.0, 2), 24.0, 18.0, 2).collect()
    assert np.ptp([r.v for r in flat]) < 1e-4


@pytest.mark.parametrize("order", ["<", ">"])
def test_raw_round_trip(order):
    v = np.arange(24 * 10).reshape(10, 24) % 1000
    data = tiff.build_raw(v, order, rows_per_strip=4, iso=1600)
    assert (tiff.raw_samples(data) == v).all()
    m = tiff.raw_metadata(data)
    assert (m["width"], m["height"], m["iso"], m["exposure_seconds"], m["cfa"], m["black"]) == (24, 10, 1600, 8.0, [1, 0, 2, 1], [64.0] * 4)


def test_raw_errors():
    v = np.zeros((4, 4), int)
    for bad in (b"XX" + b"\0" * 20, tiff.build_raw(v, compression=7), tiff.build_raw(v, photometric=2), tiff.build_raw(v)[:-8]):
        with pytest.raises(tiff.TiffError):
            tiff.raw_samples(bad)


def test_stack_of_a_moving_sky(spark):
    from nightloom.operators import stack as S

    rng = np.random.default_rng(8)
    y, x = np.mgrid[0:48, 0:64].astype(float)
    stars = [(20.0, 15.0), (45.0, 30.0), (30.0, 35.0)]

    def sky(angle, dx, dy):
        t = np.radians(angle)
        v = np.full(x.shape, 100.0)
        for a, b in stars:
            u, w = a * np.cos(t) - b * np.sin(t) + dx, a * np.sin(t) + b * np.cos(t) + dy
            v += 500 * np.exp(-((x - u) ** 2 + (y - w) ** 2) / 5)
        return v + rng.normal(0, 3, v.shape)

    rows = []
    for k in range(8):
        v = sky(k * 0.4, k * 0.7, -k * 0.3)
        v[10, 40] += 3000 * (k == 3)  # a passing light
        rows.append((1, k, 64, v.ravel().tolist(), 1.0, k * 0.4, k * 0.7, -k * 0.3))
    df = spark.createDataFrame(rows, "session long, frame long, width int, samples array<double>, weight double, rotation_deg double, dx double, dy double")
    out = np.full((48, 64, 3), np.nan)
    for r in S.stack(df, 32).collect():
        out[r.top : r.top + r.height, r.left : r.left + r.width] = np.array(r["values"]).reshape(r.height, r.width, 3)
    plane = np.nanmean(out, axis=2)
    for a, b in stars:
        near = plane[int(b) - 3 : int(b) + 4, int(a) - 3 : int(a) + 4] - 100
        ys, xs = np.mgrid[int(b) - 3 : int(b) + 4, int(a) - 3 : int(a) + 4]
        assert abs((near * xs).sum() / near.sum() - a) < 0.3 and abs((near * ys).sum() / near.sum() - b) < 0.3
    assert np.nanmax(plane) < 700  # the light is clipped


def test_clip_stack_follows_the_column_rules(spark):
    from pyspark.sql import functions as F

    from nightloom.operators import robust
    from nightloom.operators import stack as S

    rng = np.random.default_rng(9)
    cube = rng.normal(10, 2, (12, 40))
    cube[3, ::5] += 90
    cube[rng.random(cube.shape) < 0.35] = np.nan
    cube[:, 7], cube[4:, 8], cube[:, 9] = np.nan, np.nan, 5.0
    w = rng.random(12) + 0.5
    rows = [(p, float(cube[f, p]), float(w[f])) for f in range(12) for p in range(40)]
    df = spark.createDataFrame(rows, "p long, v double, w double")
    got = {r.p: r.value for r in robust.combine(df, ["p"], F.col("v"), F.col("w")).collect()}
    want = S.clip_stack(cube, w)
    assert all((np.isnan(got[p]) and np.isnan(want[p])) or abs(got[p] - want[p]) < 1e-9 for p in range(40))


def moving(rng, h=60, w=44, n=6):
    """Mosaics with motions, some cells missing, and their motions."""
    frames, motions = [], []
    for k in range(n):
        v = rng.integers(-200, 5000, (h, w)).astype(float)
        v[rng.random((h, w)) < 0.02] = np.nan
        frames.append(v)
        motions.append((1, k, 1.0 + k / 4, [0.0, 4.0, -7.5, 91.0, 0.3, 0.0][k], [0.0, 3.25, -2.5, 40.0, 0.1, 500.0][k], [0.0, -11.5, 6.0, 2.0, -0.7, 0.0][k]))
    return frames, motions


@pytest.mark.parametrize(("band", "tile", "pattern"), [(1, 16, "GRBG"), (7, 16, "RGGB"), (60, 32, "BGGR"), (13, 64, "GBRG")])
def test_bands_stack_like_whole_frames(spark, band, tile, pattern):
    from nightloom.operators import stack as S

    frames, motions = moving(np.random.default_rng(band))
    whole = spark.createDataFrame([(s, k, v.shape[1], [None if np.isnan(x) else x for x in v.ravel().tolist()], wt, r, dx, dy) for v, (s, k, wt, r, dx, dy) in zip(frames, motions, strict=True)],
        "session long, frame long, width int, samples array<double>, weight double, rotation_deg double, dx double, dy double")
    parts = [(1, k, 44, 60, top, len(v[top : top + band]), [None if np.isnan(x) else x for x in v[top : top + band].ravel().tolist()]) for k, v in enumerate(frames) for top in range(0, 60, band)]
    bands = spark.createDataFrame(parts, "session long, frame long, width int, height int, top int, rows int, samples array<double>")
    moves = spark.createDataFrame(motions, "session long, frame long, weight double, rotation_deg double, dx double, dy double")
    cfa = S.PATTERNS[pattern]
    key = lambda r: (r.frame, r.top, r.left)
    a = sorted(S.warped_tiles(whole, tile, cfa).collect(), key=key)
    b = sorted(S.band_tiles(bands, moves, tile, cfa).collect(), key=key)
    assert [(*key(r), r.height, r.width, r.weight) for r in a] == [(*key(r), r.height, r.width, r.weight) for r in b]
    for x, y in zip(a, b, strict=True):
        np.testing.assert_array_equal(np.array(x["values"], np.float32), np.array(y["values"], np.float32))


def test_unreadable_band_is_missing(spark):
    from nightloom.operators import stack as S

    parts = [(1, 0, 8, 40, top, 10, [1.0] * 80) for top in (0, 20, 30)]
    bands = spark.createDataFrame(parts, "session long, frame long, width int, height int, top int, rows int, samples array<double>")
    moves = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0, 0.0)], "session long, frame long, weight double, rotation_deg double, dx double, dy double")
    got = {r.top: np.array(r["values"]).reshape(10, 8, 3) for r in S.band_tiles(bands, moves, 10).collect()}
    assert sorted(got) == [0, 10, 20, 30] and np.isnan(got[10][2:8]).all() and (got[0][:8] == 1).all() and (got[30] == 1).all()


def test_whole_numbers_are_truncated():
    from nightloom.operators import stack as S

    v = np.array([[10.7, -5000.0, 3.2, 70000.0], [1.0, np.nan, 2.9, 4.0]])
    got = S.demosaic_whole_numbers(v, S.PATTERNS["RGGB"])
    assert got[0, 0, 0] == 10 and got[0, 1, 1] == -S.PEDESTAL and got[0, 2, 0] == 3 and got[0, 3, 1] == 65535 - S.PEDESTAL and not np.isnan(got[1, 1]).all()


def test_patterns_put_colours_in_place():
    from nightloom.operators import stack as S

    for name, cfa in S.PATTERNS.items():
        site = np.tile(np.array(cfa).reshape(2, 2), (4, 4))
        planes = S.demosaic(np.choose(site, [10.0, 20.0, 30.0]), cfa)
        assert (planes == [10.0, 20.0, 30.0]).all(), name
        assert (S.demosaic(np.choose(site, [10.0, 20.0, 30.0])[1:], cfa, first_row=1) == [10.0, 20.0, 30.0]).all()


def test_users_resampler(spark):
    from nightloom.operators import stack as S

    def nearest(planes, rotation, dx, dy, rows, first, height):
        return planes[rows[0] - first : rows[1] - first]

    v = np.arange(40 * 8, dtype=float).reshape(40, 8)
    bands = spark.createDataFrame([(1, 0, 8, 40, t, 10, v[t : t + 10].ravel().tolist()) for t in range(0, 40, 10)], "session long, frame long, width int, height int, top int, rows int, samples array<double>")
    moves = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0, 0.0)], "session long, frame long, weight double, rotation_deg double, dx double, dy double")
    own = S.Resampler(demosaic=lambda m, cfa, first: np.repeat(m[..., None], 3, axis=2), warp=nearest, halo=0, reach=0)
    got = {r.top: np.array(r["values"]).reshape(-1, 8, 3) for r in S.band_tiles(bands, moves, 16, resampler=own).collect()}
    np.testing.assert_array_equal(np.concatenate([got[t] for t in sorted(got)])[..., 1], v)


def test_users_combiner(spark, monkeypatch):
    from nightloom.operators import stack as S

    rng = np.random.default_rng(2)
    cube = rng.normal(size=(9, 2, 4, 5, 3))
    cube[rng.random(cube.shape) < 0.4] = np.nan
    rows = [(1, 4 * t, 0, f, 1.0 + f, 4, 5, cube[f, t].ravel().tolist()) for f in range(9) for t in range(2)]
    tiles = spark.createDataFrame(rows, S.TILES).repartition(4)
    for limit in (1, 1 << 20):  # states are passed on at once, or all at the end
        monkeypatch.setattr(S, "STATE_BYTES", limit)
        got = {r.top: r for r in S.combine_with(tiles, S.WeightedMean()).collect()}
        trimmed = {r.top: r for r in S.combine_with(tiles, S.TrimmedMean()).collect()}
        for t in range(2):
            x, w = cube[:, t], np.where(np.isfinite(cube[:, t]), np.arange(1.0, 10).reshape(-1, 1, 1, 1), 0)
            with np.errstate(all="ignore"):
                mean = np.nansum(x * w, axis=0) / w.sum(axis=0)
                n = np.isfinite(x).sum(axis=0)
                cut = np.where(n >= 3, (np.nansum(x, axis=0) - np.nanmin(x, axis=0) - np.nanmax(x, axis=0)) / (n - 2), np.nansum(x, axis=0) / n)
            np.testing.assert_allclose(np.array(got[4 * t]["values"]).reshape(4, 5, 3), mean, rtol=1e-5)
            np.testing.assert_allclose(np.array(trimmed[4 * t]["values"]).reshape(4, 5, 3), cut, rtol=1e-4, atol=1e-6)
            assert got[4 * t].frames == 9

    class NoMerge:
        fields, init, update, finish = ("a",), None, None, None

    with pytest.raises(TypeError, match="merge"):
        S.combine_with(tiles, NoMerge())
