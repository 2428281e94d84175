"""The average of directions by blocks against a plain loop, and the join of two streams against the batch one."""

import datetime as dt
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nightloom import catalog
from nightloom.operators import monitors as M
from nightloom.operators import pointing as P
from nightloom.streaming import frames as S

SCHEMA = "session long, ts long, idx long, x double, y double, z double"


def plain(rows, alpha, interval):
    out, state = [], {}
    for session, ts, idx, *v in sorted((r for r in rows if None not in r and any(r[3:])), key=lambda r: r[:3]):
        v = np.array(v) / np.linalg.norm(v)
        last, d = state.get(session, (None, None))
        if last is None or ts >= last + interval:
            d = v if d is None else d + alpha * (v - d)
            state[session] = (ts, d)
            out.append((session, idx, *(d / np.linalg.norm(d))))
    return sorted(out)


@pytest.mark.parametrize("block", [50, 101, 1000, 10**9])
def test_blocks_average_like_one_pass(spark, block):
    rng = random.Random(block)
    rows = [(s, rng.randint(-4000, 6000), k, *(rng.uniform(-1, 1) for _ in range(3))) for k in range(400) for s in (1, 2, 3) if s < 3 or k < 2]
    rows += [(1, 10, 900, 0.0, 0.0, 0.0), (1, 20, 901, None, 1.0, 0.0), (2, 30, 902, 1.0, 0.0, 0.0), (2, 30, 903, 0.0, 1.0, 0.0)]
    got = sorted(tuple(r) for r in P.average(spark.createDataFrame(rows, SCHEMA), interval_ms=100, block_ms=block).collect())
    want = plain(rows, P.ALPHA, 100)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    np.testing.assert_allclose([r[2:] for r in got], [r[2:] for r in want], atol=1e-9)


def test_north_does_not_wrap(spark):
    rows = [(1, 1000 * k, k, np.sin(np.radians(a)), np.cos(np.radians(a)), 0.0) for k, a in enumerate([359.0, 1.0] * 10)]
    last = P.average(spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in rows], SCHEMA)).orderBy(F.desc("idx")).first()
    assert abs(np.degrees(np.arctan2(last.x, last.y))) < 1


def test_no_samples(spark):
    assert P.average(spark.createDataFrame([], SCHEMA)).count() == 0


T0 = dt.datetime(2024, 1, 1)


def test_streams_join_like_the_batch(spark, tmp_path):
    rng = random.Random(3)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    points = sorted((at(rng.randint(0, 5000)), rng.randint(0, 3), float(k)) for k in range(300))
    spans = sorted((at(a), rng.randint(0, 3), k, at(a + rng.randint(0, 120))) for k in range(80) for a in [rng.randint(0, 5000)])
    late = (at(10), 1, -1.0)  # comes when the watermark is far beyond
    kinds = {"p": ["t", "k", "v"], "s": ["a", "k", "n", "b"]}
    for name, rows in (("p", points), ("s", spans)):
        os.makedirs(tmp_path / name)
        for i in range(5):
            part = [r for r in rows if at(1000 * i) <= r[0] < at(1000 * (i + 1)) or (i == 4 and r[0] >= at(5000))] + ([late] if (name, i) == ("p", 4) else [])
            frame = pd.DataFrame(part, columns=kinds[name])
            for c in ("t", "a", "b"):
                if c in frame:
                    frame[c] = frame[c].astype("datetime64[us]").dt.tz_localize("UTC")
            frame.to_parquet(tmp_path / name / f"{i}.parquet")
            os.utime(tmp_path / name / f"{i}.parquet", (1e9 + i, 1e9 + i))
    schema = {"p": "t timestamp, k long, v double", "s": "a timestamp, k long, n long, b timestamp"}
    stream = {n: S.file_stream(spark, f"{tmp_path}/{n}", schema[n]) for n in "ps"}
    joined = M.interval_join_stream(stream["p"], stream["s"], ["k"], "t", "a", "b", "120 SECONDS", "60 seconds")
    query = joined.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = {n: spark.read.schema(schema[n]).parquet(f"{tmp_path}/{n}") for n in "ps"}
    want = M.interval_join(batch["p"].where("v >= 0"), batch["s"], ["k"], "t", "a", "b", 60).select("n", "v").collect()
    got = spark.read.parquet(f"{tmp_path}/out").select("n", "v").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 50
    progress = [p for p in query.recentProgress if p.stateOperators]
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in progress) >= 1
    assert progress[-1].stateOperators[0].numRowsTotal < 100  # of 380 rows that came


def test_spans_beyond_the_bound_are_refused(spark, tmp_path):
    os.makedirs(tmp_path / "s")
    pd.DataFrame({"a": [pd.Timestamp(T0, tz="UTC")], "k": [1], "n": [1], "b": [pd.Timestamp(T0 + dt.timedelta(hours=1), tz="UTC")]}).astype({"a": "datetime64[us, UTC]", "b": "datetime64[us, UTC]"}).to_parquet(tmp_path / "s" / "0.parquet")
    s = S.file_stream(spark, f"{tmp_path}/s", "a timestamp, k long, n long, b timestamp")
    p = s.select(F.col("a").alias("t"), "k", F.lit(1.0).alias("v"))
    with pytest.raises(PySparkException, match="longer than"):
        S.drain(M.interval_join_stream(p, s, ["k"], "t", "a", "b", "120 SECONDS", "60 seconds"), f"{tmp_path}/out", f"{tmp_path}/check")


@pytest.mark.parametrize("chunk", [16, 65_536])
def test_many_sessions_in_chunks(spark, monkeypatch, chunk):
    """Groups that go over chunks, equal times, gaps of many blocks, a session without a number."""
    monkeypatch.setattr(P, "CHUNK_ROWS", chunk)
    rng = random.Random(chunk)
    rows = [(s, rng.choice([rng.randint(0, 3000), rng.randint(0, 30), rng.randint(10**6, 10**6 + 500)]), k, *(rng.uniform(-1, 1) for _ in range(3))) for s in range(200) for k in range(s % 40)]
    rows += [(None, 40 * k, k, 1.0, float(k), 0.0) for k in range(20)]
    got = [tuple(r) for r in P.average(spark.createDataFrame(rows, SCHEMA).repartition(5), interval_ms=100, block_ms=250).collect()]
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got)
    want = plain([(-1 if r[0] is None else r[0], *r[1:]) for r in rows], P.ALPHA, 100)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    np.testing.assert_allclose([r[2:] for r in got], [r[2:] for r in want], atol=1e-9)


def test_a_step_is_one_for_all_blocks():
    """20,000 samples of 1,000 sessions, all of which count, take 20 steps."""
    group = np.repeat(np.arange(1000), 20)
    ts, first = np.tile(np.arange(20) * 100, 1000), np.arange(0, 20_000, 20)
    following = P._Times(ts, group, first).at_least(group, ts + 100)
    steps = list(P._chains(following, group, first))
    assert len(steps) == 20 and sorted(np.concatenate([at for _, at in steps])) == list(range(20_000))


def test_a_block_is_averaged_in_one_task(spark, tmp_path):
    """Samples of two sessions in eight files, whatever join or read adaptive execution takes once it knows that the blocks are few."""
    rng = random.Random(8)
    rows = [(k % 2, 10 * k, k, *(rng.uniform(-1, 1) for _ in range(3))) for k in range(20_000)]
    spark.createDataFrame(rows, SCHEMA).repartition(8).write.parquet(f"{tmp_path}/samples")
    # A partition a file; tables too large for a broadcast as far as the planner knows, small ones once they are there.
    chosen = {"spark.sql.files.openCostInBytes": "128m", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "256k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for key, value in chosen.items():
            spark.conf.set(key, value)
        got = sorted(tuple(r) for r in P.average(spark.read.parquet(f"{tmp_path}/samples"), interval_ms=100, block_ms=10**9).collect())
    finally:
        for key in chosen:
            spark.conf.unset(key)
    want = plain(rows, P.ALPHA, 100)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    np.testing.assert_allclose([r[2:] for r in got], [r[2:] for r in want], atol=1e-9)


def test_times_are_as_fine_as_the_tables(spark, tmp_path):
    """A sample some microseconds short of six hours does not count, and those of one millisecond go by time, as in the SQL."""
    at = lambda us: T0 + dt.timedelta(microseconds=us)
    six = 6 * 3_600_000_000
    rows = [(1, at(900), 1, 10.0), (2, at(six + 100), 1, 50.0), (3, at(six + 900), 1, 70.0), (9, at(100), 2, 10.0), (4, at(200), 2, 20.0), (5, at(six + 150), 2, 30.0)]
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(catalog.ORACLES["pointing_average"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["pointing_average"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and sorted(r[1] for r in want) == [1, 3, 5, 9]


def test_spans_of_many_groups_do_not_overflow():
    group, first = np.repeat(np.arange(4000), 2), np.arange(0, 8000, 2)
    ts = np.tile([0, 10**16], 4000)
    times = P._Times(ts, group, first)
    assert (times.at_least(np.arange(4000), np.full(4000, 10**16)) == first + 1).all() and (times.at_least(np.arange(4000), np.full(4000, 10**16 + 1)) == first + 2).all()
