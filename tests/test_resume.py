"""A stream that dies after its sink has written a batch and before the batch is committed goes on without losing or doubling rows."""

import glob
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from nightloom.operators import live as L
from nightloom.operators import monitors as M
from nightloom.streaming import frames as S
from tests import test_live
from tests.test_monitors import SCHEMA, made


def files(folder, parts):
    os.makedirs(folder)
    for k, part in enumerate(parts):
        frame = pd.DataFrame(part).astype({"hfr": float, "eccentricity": float, "tilt_deg": float, "star_count": "int32"})
        frame.to_parquet(f"{folder}/{k}.parquet")
        os.utime(f"{folder}/{k}.parquet", (1e9 + k, 1e9 + k))


def die_before_commit(checkpoint):
    """What a crash between the sink and the commit leaves: the last batch is planned and written, not committed."""
    last = max(glob.glob(f"{checkpoint}/commits/[0-9]*"), key=lambda p: int(p.rsplit("/", 1)[1]))
    os.remove(last)
    crc = f"{checkpoint}/commits/.{last.rsplit('/', 1)[1]}.crc"
    if os.path.exists(crc):
        os.remove(crc)


@pytest.mark.parametrize("kind", ["gate", "mean"])
def test_half_written_batch(spark, tmp_path, kind):
    rows = made()
    files(f"{tmp_path}/src", (rows[:90], rows[90:200]))

    def go(out, checkpoint):
        source = S.file_stream(spark, f"{tmp_path}/src", SCHEMA)
        if kind == "gate":
            S.gate(source, out, checkpoint)
        else:
            S.running_mean(source.select("session", "ts", "idx", F.col("hfr").alias("value")), out, checkpoint)

    def read(out):
        return sorted(map(tuple, spark.read.parquet(out if kind == "gate" else f"{out}/*").collect()), key=str)

    go(f"{tmp_path}/out", f"{tmp_path}/check")
    die_before_commit(f"{tmp_path}/check")
    go(f"{tmp_path}/out", f"{tmp_path}/check")  # runs the batch again
    half = read(f"{tmp_path}/out")
    go(f"{tmp_path}/plain", f"{tmp_path}/plain-check")
    assert half == read(f"{tmp_path}/plain")
    files(f"{tmp_path}/more", (rows[200:],))
    os.rename(f"{tmp_path}/more/0.parquet", f"{tmp_path}/src/2.parquet")
    for run in ("out", "plain"):
        go(f"{tmp_path}/{run}", f"{tmp_path}/check" if run == "out" else f"{tmp_path}/plain-check")
    assert read(f"{tmp_path}/out") == read(f"{tmp_path}/plain")
    if kind == "gate":
        want = {(r.idx, r.reason) for r in M.gate_frames(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert {(r.idx, r.reason) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want and len(read(f"{tmp_path}/out")) == len(rows)


def test_half_written_batch_of_typed_states(spark, tmp_path):
    frames = spark.createDataFrame(list(test_live.rows(test_live.SESSIONS)), test_live.SCHEMA)
    for n, (a, b) in enumerate(((0, 5), (5, 99))):
        frames.where((F.col("idx") >= a) & (F.col("idx") < b)).coalesce(1).write.parquet(f"{tmp_path}/src/{n}")

    def go(n):
        source = spark.readStream.schema(test_live.SCHEMA).parquet(f"{tmp_path}/src/{{{','.join(map(str, range(n + 1)))}}}")
        with S.rocks(spark):
            S.drain(L.register_stream(source), f"{tmp_path}/out", f"{tmp_path}/check")

    go(0)
    die_before_commit(f"{tmp_path}/check")
    go(0)
    go(1)
    plain = lambda rows: sorted([[round(v, 9) if isinstance(v, float) else v for v in r] for r in rows], key=str)
    assert plain(spark.read.schema(L.OUTCOME).parquet(f"{tmp_path}/out").collect()) == plain(L.register(frames).collect())
