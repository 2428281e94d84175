"""State machines against plain restatements, and the streaming twin against the batch one."""

import random

import pandas as pd
from pyspark.sql import functions as F

from nightloom.operators import monitors as M
from nightloom.streaming import frames as S


def plain_gate(rows):
    seen, out = [], []
    for r in rows:
        base = sorted(seen)[len(seen) // 2] if len(seen) >= 3 else None
        if r["saturated"]:
            out.append("SATURATED")
        elif r["tilt_deg"] is not None and r["tilt_deg"] > 0.5:
            out.append("BUMPED")
        elif (r["hfr"] is None or r["hfr"] >= 1.5) and r["eccentricity"] is not None and r["star_count"] > 0 and r["eccentricity"] > 0.6:
            out.append("TRAILED")
        elif r["bumped"]:
            out.append("BUMPED")
        elif r["star_count"] < 8 or (base is not None and r["star_count"] < base * 0.5):
            out.append("CLOUD")
        else:
            seen = [*seen, r["star_count"]][-15:]
            out.append("REGISTRATION" if r["failed"] else None)
    return out


def made(n=300):
    rng = random.Random(4)
    return [
        {
            "session": i % 3, "ts": i // 5, "idx": i, "star_count": rng.choice([0, 5, 9, 20, 40, 45]), "hfr": rng.choice([None, 1.0, 2.5]), "eccentricity": rng.choice([None, 0.3, 0.7]),
            "tilt_deg": rng.choice([None, 0.1, 0.1, 0.9]), "saturated": rng.random() < 0.05, "bumped": rng.random() < 0.05, "failed": rng.random() < 0.1,
        }
        for i in range(n)
    ]


SCHEMA = "session long, ts long, idx long, star_count int, hfr double, eccentricity double, tilt_deg double, saturated boolean, bumped boolean, failed boolean"


def test_gate(spark):
    rows = made()
    got = {r.idx: r.reason for r in M.gate_frames(spark.createDataFrame(rows, SCHEMA)).collect()}
    for s in range(3):
        own = sorted((r for r in rows if r["session"] == s), key=lambda r: (r["ts"], r["idx"]))
        assert [got[r["idx"]] for r in own] == plain_gate(own)


def test_gate_stream_keeps_state_between_batches(spark, tmp_path):
    rows = made()
    for k, part in enumerate((rows[:90], rows[90:200], rows[200:])):
        pd.DataFrame(part).astype({"hfr": float, "eccentricity": float, "tilt_deg": float, "star_count": "int32"}).to_parquet(tmp_path / f"in-{k}.parquet")
        if k == 0:
            (tmp_path / "src").mkdir()
        (tmp_path / f"in-{k}.parquet").rename(tmp_path / "src" / f"in-{k}.parquet")
        stream = S.file_stream(spark, str(tmp_path / "src"), SCHEMA)
        S.gate(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {r.idx: r.reason for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r.idx: r.reason for r in M.gate_frames(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == batch


def test_residuals(spark):
    values = [1.0, 1.1, 0.9, 1.0, 1.2, 1.0, 9.0, 1.1, -1.0, 3.7, 1.0]
    df = spark.createDataFrame([(0, i, i, v) for i, v in enumerate(values)], "session long, ts long, idx long, r double")
    got = [r.verdict for r in M.residual_verdicts(df, "r").orderBy("idx").collect()]
    assert got == ["UNKNOWN"] * 5 + ["STEADY", "SPIKE", "STEADY", "UNKNOWN", "SPIKE", "STEADY"]


def test_interval_and_as_of(spark):
    points = spark.createDataFrame([("a", 10, 1.0), ("a", 70, 2.0), ("a", 130, 5.0), ("b", 20, 9.0)], "k string, s long, v double").withColumn("t", F.timestamp_seconds("s")).drop("s")
    spans = spark.createDataFrame([("a", 1, 60, 140), ("a", 2, 0, 5), ("b", 3, 20, 30)], "k string, id long, f long, g long")
    spans = spans.select("k", "id", F.timestamp_seconds("f").alias("t0"), F.timestamp_seconds("g").alias("t1"))
    got = {(r.id, r.v) for r in M.interval_join(points, spans, ["k"], "t", "t0", "t1", 50).collect()}
    assert got == {(1, 2.0), (1, 5.0)}
    base = {r.id: r.base for r in M.as_of(spans.withColumnRenamed("t0", "t"), points, ["k"], "t", "v", "base").collect()}
    assert base == {1: 1.0, 2: None, 3: 9.0}
