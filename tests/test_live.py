"""Live registration as a batch and as a stream, and the matching kernel against the column operators."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.operators import geometry as G
from nightloom.operators import live as L
from nightloom.streaming import frames as S

SCHEMA = "session long, ts timestamp, idx long, stars array<struct<x: double, y: double, flux: double>>, plane array<float>, plane_width int, bin double, width int, height int, seed struct<rotation_deg: double, dx: double, dy: double>"
W, H = 1000, 800


def turned(stars, angle, dx, dy):
    t, c = np.radians(angle), np.array([(W - 1) / 2, (H - 1) / 2])
    o = stars[:, :2] - c
    return np.column_stack([o[:, 0] * np.cos(t) - o[:, 1] * np.sin(t) + dx + c[0], o[:, 0] * np.sin(t) + o[:, 1] * np.cos(t) + dy + c[1], stars[:, 2]])


def session(seed, starless=False):
    """Frames with what should come of them: (stars, plane, bin, seed, outcome, motion)."""
    rng = np.random.default_rng(seed)
    base = np.column_stack([rng.uniform(0, W, 25), rng.uniform(0, H, 25), rng.uniform(1, 100, 25)])
    plane = rng.normal(size=(40, 50))
    moved = np.roll(plane, (3, -4), (0, 1))
    few = base[:2]
    out = [(base[:7], plane, 2.0, None, "STARVED", None), (None, plane, 2.0, None, "STARVED", None), (base, plane, 2.0, None, "REFERENCE", None)]
    for k in range(8):
        m = (k * 1.5 - 4, 20.0 * k, -7.0 * k)
        s = turned(base, *m)
        s[: k % 3, :2] += 80  # some are wrong
        s[:, :2] += rng.normal(0, 0.2 if k != 6 else 1.1, (25, 2))
        out.append((s, None, 2.0, None, "ASTERISM", m))
    out.append((turned(base, 1.0, 5.0, 5.0), plane, 2.0, (1.1, 5.5, 4.0), "SEEDED", (1.0, 5.0, 5.0)))
    out.append((turned(base, 1.0, 5.0, 5.0), plane, 2.0, (40.0, 300.0, 4.0), "ASTERISM", (1.0, 5.0, 5.0)))  # a seed that leads nowhere
    out.append((few, moved, 2.0, None, "CORRELATED", (0.0, -8.0, 6.0)))
    out.append((None, moved, 3.0, None, "CORRELATED", (0.0, -12.0, 9.0)))
    out.append((few, rng.normal(size=(40, 50)), 2.0, None, "FAILED", None))
    out.append((few, moved[:, :40], 2.0, None, "FAILED", None))
    out.append((few, None, 2.0, None, "FAILED", None))
    out.append((np.column_stack([rng.uniform(0, W, 25), rng.uniform(0, H, 25), rng.uniform(1, 100, 25)]), None, 2.0, None, "FAILED", None))
    return out


def rows(sessions):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    for sid, frames in sessions.items():
        for k, (stars, plane, bin_, seed, *_) in enumerate(frames):
            s = None if stars is None else [tuple(map(float, v)) for v in stars]
            yield (sid, start + dt.timedelta(seconds=k), k, s, None if plane is None else plane.ravel().tolist(), None if plane is None else plane.shape[1], bin_, W, H, seed)


SESSIONS = {1: session(1), 2: session(2), 3: [(np.ones((3, 3)), None, 1.0, None, "STARVED", None)] * 4}


def close(got, motion):
    return motion is None or (abs(got.rotation_deg - motion[0]) < 0.1 and abs(got.dx - motion[1]) < 1 and abs(got.dy - motion[2]) < 1)


def test_batch(spark):
    got = {(r.session, r.idx): r for r in L.register(spark.createDataFrame(list(rows(SESSIONS)), SCHEMA).repartition(5)).collect()}
    assert len(got) == sum(map(len, SESSIONS.values()))
    for sid, frames in SESSIONS.items():
        for k, (*_, outcome, motion) in enumerate(frames):
            r = got[sid, k]
            assert r.outcome == outcome and close(r, motion), (sid, k, r)
            assert (r.residual_px is not None) == (outcome in ("ASTERISM", "SEEDED")) and (r.confidence is not None) == (outcome == "CORRELATED")
    # The first five residuals teach; a blurred frame after that stands out.
    assert [got[1, k].verdict for k in range(3, 11)] == ["UNKNOWN"] * 5 + ["STEADY", "SPIKE", "STEADY"]


@pytest.mark.parametrize("cuts", [(1, 9), (3, 4)])
def test_stream_is_the_batch(spark, tmp_path, cuts):
    frames = spark.createDataFrame(list(rows(SESSIONS)), SCHEMA)
    for n, (a, b) in enumerate(zip((0, *cuts), (*cuts, 99), strict=True)):
        frames.where((F.col("idx") >= a) & (F.col("idx") < b)).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        for f in os.listdir(tmp_path / "in" / str(n)):
            if f.endswith(".parquet"):
                os.makedirs(tmp_path / "src", exist_ok=True)
                os.rename(tmp_path / "in" / str(n) / f, tmp_path / "src" / f"{n}.parquet")
                os.utime(tmp_path / "src" / f"{n}.parquet", (1e9 + n, 1e9 + n))
    with S.rocks(spark):
        S.drain(L.register_stream(S.file_stream(spark, f"{tmp_path}/src", SCHEMA)), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    key = lambda r: (r.session, r.idx)
    a = sorted(spark.read.schema(L.OUTCOME).parquet(f"{tmp_path}/out").collect(), key=key)
    b = sorted(L.register(frames).collect(), key=key)
    plain = lambda r: [round(v, 9) if isinstance(v, float) else v for v in r]
    assert [plain(r) for r in a] == [plain(r) for r in b]


def test_kernel_matches_like_the_columns(spark):
    rng = np.random.default_rng(7)
    ref = np.column_stack([rng.uniform(0, 900, 14), rng.uniform(0, 900, 14), rng.permutation(14) + 1.0])
    tgt = np.vstack([turned(ref, 8.25, 12, 40)[:11], np.column_stack([rng.uniform(0, 900, 4), rng.uniform(0, 900, 4), rng.uniform(1, 9, 4)])])
    table = lambda v, f: spark.createDataFrame([(f, k, *map(float, s)) for k, s in enumerate(v)], "frame long, star long, x double, y double, flux double")
    want = {(r.ref, r.tgt, r.votes) for r in G.asterism_matches(G.triangles(table(ref, 0)), G.triangles(table(tgt, 1))).collect()}
    assert {tuple(p) for p in L.asterism_pairs(ref, tgt).tolist()} == want and len(want) >= 10
    assert len(L.asterism_pairs(ref, ref[:2])) == 0


def test_no_frames(spark):
    assert L.register(spark.createDataFrame([], SCHEMA)).count() == 0
