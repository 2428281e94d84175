"""Data sources and sinks of frames by round trip, by bytes read, and with tasks that fail."""

import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nightloom.sources import frames, store, tiff

H, W = 300, 64


@pytest.fixture(scope="module")
def raws(tmp_path_factory):
    """Three readable files (a strip a row, strips of 16, big endian in one strip) and three that are not."""
    root = tmp_path_factory.mktemp("raws")
    rng = np.random.default_rng(3)
    v = {n: rng.integers(0, 1 << 16, (H, W)) for n in "abc"}
    (root / "a.dng").write_bytes(tiff.build_raw(v["a"], rows_per_strip=1, iso=100))
    (root / "deep").mkdir()
    (root / "deep" / "b.dng").write_bytes(tiff.build_raw(v["b"], rows_per_strip=16))
    (root / "c.dng").write_bytes(tiff.build_raw(v["c"], ">"))
    (root / "cut.dng").write_bytes(tiff.build_raw(v["a"])[: H * W])
    (root / "text.dng").write_bytes(b"no frame at all")
    (root / "packed.dng").write_bytes(tiff.build_raw(v["a"], compression=7))
    (root / "_hidden.dng").write_bytes(b"")
    return f"file://{root}", v


def bands(spark, path, **options):
    return frames.register(spark).read.format("raw_bands").options(**options).load(path)


@pytest.mark.parametrize(("band", "part"), [(7, 1 << 12), (64, 1 << 30), (1000, 1 << 14), (1, 1 << 13)])
def test_bands_of_any_size(spark, raws, band, part):
    path, v = raws
    got = bands(spark, path, band_rows=band, partition_bytes=part).where("error IS NULL").orderBy("path", "top").collect()
    for name, want in v.items():
        mine = [r for r in got if r.path.endswith(f"/{name}.dng")]
        assert [r.top for r in mine] == list(range(0, H, band))
        assert (np.concatenate([np.array(r.samples).reshape(r.rows, W) for r in mine]) == want).all()
    wrong = {r.path.rsplit("/", 1)[1] for r in bands(spark, path, partition_bytes=part).where("error IS NOT NULL").collect()}
    assert wrong == {"cut.dng", "text.dng", "packed.dng"}


def test_a_band_reads_its_strips_only(spark, raws):
    path, v = raws
    size = os.path.getsize(f"{path[7:]}/a.dng")
    r = bands(spark, f"{path}/a.dng", rows="100:108", band_rows=8).collect()
    assert len(r) == 1 and (np.array(r[0].samples).reshape(8, W) == v["a"][100:108]).all()
    assert r[0].bytes_read <= 8 * W * 2 + 3 * store.PAGE < size / 2
    # Strips of 16 rows: rows 100 to 107 lie in one.
    r = bands(spark, f"{path}/deep/b.dng", rows="100:108", band_rows=8).first()
    assert (np.array(r.samples).reshape(8, W) == v["b"][100:108]).all() and r.bytes_read <= 16 * W * 2 + 2 * store.PAGE


def test_a_scan_reads_the_directory_only(spark, raws):
    path, _ = raws
    scan = frames.register(spark).read.format("raw_metadata").load(path)
    got = {r.path.rsplit("/", 1)[1]: r for r in scan.collect()}
    assert len(got) == 6 and got["a.dng"].iso == 100 and got["a.dng"].rows_per_strip == 1 and got["text.dng"].error and got["a.dng"].cfa == [1, 0, 2, 1]
    assert all(r.bytes_read <= 2 * store.PAGE for r in got.values())
    # Columns that are not asked for are not read: a band scan without samples.
    slim = frames.register(spark).read.format("raw_bands").schema("path string, top int, bytes_read long").option("band_rows", 100).load(f"{path}/c.dng")
    assert sorted(r.top for r in slim.collect()) == [0, 100, 200] and max(r.bytes_read for r in slim.collect()) <= 2 * store.PAGE


def master(spark, v, name="m", rows=11, shuffle=True):
    h, w, c = v.shape
    made = [(name, w, h, c, top, v[top : top + rows].ravel().tolist()) for top in range(0, h, rows)]
    return spark.createDataFrame(made[::-1] if shuffle else made, "name string, width int, height int, channels int, top int, values array<float>")


def whole(spark, path, **options):
    rows = frames.read_masters(spark, path, **options).orderBy("path", "top").collect()
    return np.concatenate([np.array(r["values"], np.float32).reshape(r.rows, r.width, r.channels) for r in rows])


def test_masters_round_trip(spark, tmp_path):
    rng = np.random.default_rng(5)
    colour, grey = rng.normal(size=(50, 40, 3)).astype("f4"), rng.normal(size=(33, 20, 1)).astype("f4")
    colour[3, 4, 1] = np.nan
    root = f"file://{tmp_path}/masters"
    frames.write_masters(master(spark, colour, "colour").unionByName(master(spark, grey, "grey", 5)), root, description="a stack")
    assert sorted(os.listdir(tmp_path / "masters")) == ["colour.tif", "grey.tif"]
    np.testing.assert_array_equal(whole(spark, f"{root}/colour.tif", band_rows=7), colour)
    np.testing.assert_array_equal(whole(spark, f"{root}/grey.tif", partition_bytes=300, band_rows=3), grey)
    np.testing.assert_array_equal(whole(spark, f"{root}/colour.tif", max_width=15, band_rows=4), colour[::3, ::3])
    t = tiff.Tiff.open((tmp_path / "masters" / "colour.tif").read_bytes())
    assert t.one(tiff.DESCRIPTION) == "a stack" and t.many(tiff.SAMPLE_FORMAT) == [3, 3, 3] and len(t.tags) == 13
    got = {(r.x, r.y, r.channel): r.v for r in frames.master_pixels(frames.read_masters(spark, f"{root}/grey.tif")).collect()}
    assert len(got) == 33 * 20 and got[19, 32, 0] == grey[32, 19, 0]


def test_decimation_reads_the_rows_that_stay(spark, tmp_path):
    v = np.zeros((400, 300, 3), "f4")
    frames.write_masters(master(spark, v, rows=100), f"file://{tmp_path}/m")
    r = frames.read_masters(spark, f"file://{tmp_path}/m", max_width=30, band_rows=40).collect()
    assert len(r) == 1 and (r[0].width, r[0].height, r[0].step) == (30, 40, 10) and r[0].bytes_read < v.nbytes / 4


def test_region_crop(spark, tmp_path):
    v = np.random.default_rng(6).normal(size=(50, 40, 3)).astype("f4")
    root = f"file://{tmp_path}/m"
    frames.write_masters(master(spark, v), root, region="5,10,20,31")
    np.testing.assert_array_equal(whole(spark, root), v[10:41, 5:25])
    with pytest.raises(PySparkException, match="region"):
        frames.write_masters(master(spark, v, "n"), root, region="30,0,20,10")
    assert os.listdir(tmp_path / "m") == ["m.tif"]


def left(root):
    return sorted(p.name for p in root.rglob("*"))


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    root = tmp_path / "m"
    v = np.ones((20, 10, 1), "f4")
    good, gap = master(spark, v, "good"), master(spark, v, "gap", 5).where("top <> 10")
    with pytest.raises(PySparkException, match="expected row 10"):
        frames.write_masters(good.unionByName(gap), f"file://{root}")
    assert left(root) == []
    frames.write_masters(good, f"file://{root}")
    with pytest.raises(PySparkException, match="good.tif"):  # append refuses what exists, and the new file of the job goes too
        frames.write_masters(good.unionByName(master(spark, v, "new")), f"file://{root}")
    assert left(root) == ["good.tif"]
    frames.write_masters(master(spark, 2 * v, "new"), f"file://{root}", mode="overwrite")
    assert left(root) == ["new.tif"] and (whole(spark, f"file://{root}") == 2).all()
    with pytest.raises(PySparkException, match="several tasks"):
        apart = master(spark, v, "twice", 20).withColumn("k", F.explode(F.array(F.lit(0), F.lit(9)))).repartitionByRange(2, "k").drop("k")
        apart.write.format("linear_master").mode("append").save(f"file://{root}")
    with pytest.raises(PySparkException, match="not a file name"):
        frames.write_masters(master(spark, v, "../out"), f"file://{root}")
    assert left(root) == ["new.tif"]


def test_named_files(spark, tmp_path):
    rows = spark.range(20).select(F.format_string("f%02d", "id").alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    frames.write_files(rows.repartition(5), f"file://{tmp_path}/x", ".bin")
    assert left(tmp_path / "x") == [f"f{k:02d}.bin" for k in range(20)]
    with pytest.raises(PySparkException, match="bytes-like|must be|content|NoneType|null"):
        frames.write_files(rows.withColumn("content", F.when(F.col("name") != "f07", F.col("content"))).withColumn("name", F.concat(F.lit("z"), "name")), f"file://{tmp_path}/x", ".bin")
    assert len(left(tmp_path / "x")) == 20
    assert frames.register(spark).read.format("linear_bands").load(f"file://{tmp_path}/x").count() == 0


def test_flat_library(spark, tmp_path):
    from nightloom.sources.library import FlatLibrary

    flats = FlatLibrary(spark, f"file://{tmp_path}/store")
    assert flats.cameras().count() == 0 and flats.info("0") is None and flats.flat("0", 40, 30) is None
    v = np.random.default_rng(1).random((30, 40, 1)).astype("f4")
    bands = lambda x: master(spark, x, rows=7).select("top", "values")
    flats.save("0", bands(v), 40, 30, frames=16, iso=800)
    flats.save("back/wide", bands(v + 1), 40, 30, frames=9)
    got = np.concatenate([np.array(r["values"], np.float32) for r in flats.flat("0", 40, 30, band_rows="8").orderBy("top").collect()]).reshape(30, 40, 1)
    np.testing.assert_array_equal(got, v)
    assert flats.flat("0", 30, 40) is None and flats.flat("0", 80, 60) is None
    assert sorted((r.camera, r.frames, r.iso) for r in flats.cameras().collect()) == [("0", 16, 800), ("back/wide", 9, None)]
    flats.save("0", bands(v[:20]), 40, 20, frames=5)  # takes the old one's place
    assert flats.flat("0", 40, 30) is None and flats.flat("0", 40, 20).count() == 1 and flats.info("0")["frames"] == 5
    assert flats.delete("0") and not flats.delete("0") and [r.camera for r in flats.cameras().collect()] == ["back/wide"]


def test_session_store(spark, tmp_path):
    from nightloom.sources.library import SessionStore

    sessions = SessionStore(spark, f"file://{tmp_path}/sessions")
    assert sessions.folders().count() == 0
    assert [sessions.create("2024-05-01"), sessions.create("2024-05-01"), sessions.create("2024-05-03")] == ["2024-05-01", "2024-05-01-2", "2024-05-03"]
    sessions.write_log("2024-05-03", {"lights": 3})
    frames.write_files(spark.createDataFrame([("f1", b"x" * 100), ("f2", b"y" * 50)], "name string, content binary"), f"file://{tmp_path}/sessions/2024-05-03", ".dng")
    assert sessions.read_log("2024-05-03") == {"lights": 3} and sessions.read_log("none") is None
    assert [(r.folder, r.files, r.size_bytes) for r in sessions.folders().collect()] == [("2024-05-03", 3, 163), ("2024-05-01-2", 1, 2), ("2024-05-01", 1, 2)]
    for bad in ("", "..", "a/b", "/etc"):
        with pytest.raises(ValueError, match="not a folder"):
            sessions.delete(bad)
    assert sessions.delete("2024-05-01") and not sessions.delete("2024-05-01") and sessions.folders().count() == 2
    assert not [p for p in left(tmp_path) if p.startswith("_")]
