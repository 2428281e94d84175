"""The common area as a fold of parts: any cut into blocks and any order of merges gives the one-pass result."""

import numpy as np
import pandas as pd
import pytest

from nightloom.operators import registration as R


def motions(n, seed):
    rng = np.random.default_rng(seed)
    m = np.column_stack([rng.normal(0, 3, n), rng.normal(0, 15, n), rng.normal(0, 10, n)])
    m[::7, 0] = np.nan  # frames without a motion
    return m


def one_pass(m):
    polygon = R.CommonArea(512.0, 384.0).corners
    for r, dx, dy in m:
        if np.isnan(r) or not len(polygon):
            continue
        t = -np.radians(r)
        rot = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
        polygon = R.clip_convex(polygon, (R.CommonArea(512.0, 384.0).corners - [dx, dy]) @ rot.T)
    return R.area(polygon) / (512 * 384)


@pytest.mark.parametrize("block", [1, 3, 50, 1000])
def test_any_blocks(block):
    m = motions(200, block)
    parts = []
    for a in range(0, len(m), block):
        part = R.CommonArea(512.0, 384.0)
        part.include(*m[a : a + block].T)
        parts.append(R.CommonArea.of(512.0, 384.0, *part.state()))
    np.random.default_rng(1).shuffle(parts)
    while len(parts) > 1:  # a tree of merges
        parts = [parts[i].merge(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    assert parts[0].frames == 200 and parts[0].fraction == pytest.approx(one_pass(m), abs=1e-9)


def test_nothing_in_common_stays_nothing():
    a, b = R.CommonArea(10.0, 10.0), R.CommonArea(10.0, 10.0)
    a.include(np.array([0.0]), np.array([50.0]), np.array([0.0]))
    b.include(np.array([0.0]), np.array([1.0]), np.array([0.0]))
    assert a.fraction == 0 and b.merge(a).fraction == 0 and a.merge(R.CommonArea(10.0, 10.0)).fraction == 0


def test_one_long_session_over_many_tasks(spark):
    m = motions(100_000, 9)
    m[:, 0] /= 10
    rows = pd.DataFrame({"session": 1, "idx": np.arange(len(m)), "rotation_deg": m[:, 0], "dx": m[:, 1], "dy": m[:, 2]})
    df = spark.createDataFrame(rows, "session long, idx long, rotation_deg double, dx double, dy double").repartition(40)
    (got,) = R.common_area(df, 512.0, 384.0).collect()
    assert got.frames == 100_000 and got.fraction == pytest.approx(one_pass(m), abs=1e-9)


def test_many_sessions_are_folded_at_once(spark, monkeypatch):
    """Sessions of some frames each, of one, of the same frame over and over, of none with a motion, and one with nothing in common."""
    frames = {s: motions(1 + s % 60, s) for s in range(300)}
    frames |= {900: np.tile(motions(2, 1)[1], (5000, 1)), 901: np.full((3, 3), np.nan), 902: np.array([[0.0, 500.0, 0.0], [0.0, -500.0, 0.0]]), 903: np.array([[180.0, 0.0, 0.0]])}
    rows = pd.concat([pd.DataFrame({"session": s, "idx": np.arange(len(m)), "rotation_deg": m[:, 0], "dx": m[:, 1], "dy": m[:, 2]}) for s, m in frames.items()])
    df = spark.createDataFrame(rows, "session long, idx long, rotation_deg double, dx double, dy double").repartition(7)
    for size in (64, 65_536):
        monkeypatch.setattr(R, "FOLD_ROWS", size)
        got = {r.session: (r.frames, r.fraction) for r in R.common_area(df, 512.0, 384.0).collect()}
        assert {s: n for s, (n, _) in got.items()} == {s: len(m) for s, m in frames.items()}
        for s, m in frames.items():
            assert got[s][1] == pytest.approx(one_pass(m), abs=1e-9), s


def test_a_step_is_one_for_all_sessions(monkeypatch):
    """The steps are those of the session that takes most, not their sum."""
    m, calls, clip = motions(20_000, 4), [], R._clip_many
    monkeypatch.setattr(R, "_clip_many", lambda *v: calls.append(1) or clip(*v))
    R.narrow_many(np.arange(len(m)) % 1000, m, 1000, 512.0, 384.0)
    assert 0 < len(calls) < 200
