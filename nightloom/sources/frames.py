"""Spark data sources of frames: raw sensor files by bands of rows, linear masters by bands, and sinks that commit whole jobs.

| format | direction | a row is |
|-|-|-|
| `raw_metadata` | read | a *.dng file's directory; no sample is read |
| `raw_bands` | read | `band_rows` image rows of a *.dng file, from the strips that overlap them |
| `linear_bands` | read | `band_rows` rows of a *.tif master, decimated to `max_width` columns |
| `linear_master` | write | rows (name, width, height, channels, top, values): bands of masters in order; one file a name |
| `named_files` | write | rows (name, content): one file each |

A scan is cut by file and, for large files, by range of bands, from the sizes that a listing gives; headers are read in the
tasks. Only the columns of the schema that is asked for are made: `raw_bands` without `samples` reads directories only.
`bytes_read` (optional) says what a row cost. A file that cannot be read is one row with an `error`.

The sinks write in two phases. Tasks write under `_staged-<job>`, which no listing shows; the commit moves every file to its
name once all tasks have succeeded; an abort, or a task that fails, leaves nothing. `append` refuses names that exist,
`overwrite` replaces all files of the sink's kind.
"""

from __future__ import annotations

import contextlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from nightloom.sources import store, tiff

#: Bytes of a file that one partition reads, about; small files share a partition up to that and this many files.
PARTITION_BYTES, FILES_A_PARTITION = 32 << 20, 256
_RAW = "path string, width int, height int, rows_per_strip int, cfa array<int>, black array<double>, white int, iso int, exposure_seconds double, model string"


@dataclass
class FileParts(InputPartition):
    """Some files, or the k-th of n parts of one."""

    paths: list[str]
    part: int = 0
    parts: int = 1


class _Reader(DataSourceReader):
    suffix = ""

    def __init__(self, schema: StructType, options: dict, whole: bool) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        self.names, self.arrow = schema.names, to_arrow_schema(schema)
        self.root, self.whole = options["path"], whole
        self.band_rows = int(options.get("band_rows", 256))
        self.max_width = int(options.get("max_width", 0))
        self.part_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        first, _, last = options.get("rows", ":").partition(":")
        self.first, self.last = int(first or 0), int(last) if last else None

    def partitions(self) -> list[FileParts]:
        out, held, size = [], [], 0
        for path, n in store.listing(self.root, self.suffix):
            if not self.whole and n > self.part_bytes:
                parts = -(-n // self.part_bytes)
                out += [FileParts([path], k, parts) for k in range(parts)]
                continue
            if held and (len(held) == FILES_A_PARTITION or (not self.whole and size + n > self.part_bytes)):
                out.append(FileParts(held))
                held, size = [], 0
            held.append(path)
            size += n
        return out + ([FileParts(held)] if held else [])

    def read(self, partition: FileParts | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no file
            return
        files, _ = store.open_store(self.root)
        for path in partition.paths:
            with files.open_input_file(path) as f:
                data = store.Ranges(f)
                try:
                    for row in self.rows(data, partition):
                        yield self._batch({"path": path, **row, "bytes_read": data.bytes_read})
                except (tiff.TiffError, struct.error, OverflowError) as e:
                    if partition.part == 0 or data.known:  # all parts of a file meet a bad header, one reports it
                        yield self._batch({"path": path, "error": str(e), "bytes_read": data.bytes_read})

    def _batch(self, row: dict) -> pa.RecordBatch:
        columns = []
        for kind in self.arrow:
            v = row.get(kind.name)
            if isinstance(v, np.ndarray):
                flat = pa.array(v.ravel()).cast(kind.type.value_type)
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
            else:
                columns.append(pa.array([v], kind.type))
        return pa.RecordBatch.from_arrays(columns, self.names)

    def span(self, height: int, partition: FileParts) -> tuple[int, int]:
        """The rows of this partition: whole bands, so that parts neither meet nor leave gaps."""
        last = height if self.last is None else min(self.last, height)
        bands = max(0, -(-(last - self.first) // self.band_rows))
        k, n = partition.part, partition.parts
        return self.first + bands * k // n * self.band_rows, min(last, self.first + bands * (k + 1) // n * self.band_rows)

    def rows(self, data: store.Ranges, partition: FileParts) -> Iterator[dict]:
        raise NotImplementedError


class _RawReader(_Reader):
    suffix = ".dng"

    def rows(self, data: store.Ranges, partition: FileParts) -> Iterator[dict]:
        m = tiff.raw_metadata(data)
        data.known = True
        if self.whole:
            yield m
            return
        image = tiff.Tiff.open(data, tiff.CFA_PHOTOMETRIC)
        first, last = self.span(m["height"], partition)
        for top in range(first, last, self.band_rows):
            n = min(self.band_rows, last - top)
            yield {**m, "top": top, "rows": n, **({"samples": image.rows(top, n, "u2").astype(np.int32)} if "samples" in self.names else {})}


class _LinearReader(_Reader):
    suffix = ".tif"

    def rows(self, data: store.Ranges, partition: FileParts) -> Iterator[dict]:
        h, w, c, start = tiff.linear_shape(tiff.Tiff.open(data))
        data.known = True
        step = -(-w // self.max_width) if self.max_width and w > self.max_width else 1
        out_h, out_w = -(-h // step), -(-w // step)
        first, last = self.span(out_h, partition)
        for top in range(first, last, self.band_rows):
            n = min(self.band_rows, last - top)
            at = lambda y: start + 4 * w * c * y
            if "values" not in self.names:
                v = None
            elif step == 1:
                v = np.frombuffer(data[at(top) : at(top + n)], "<f4")
            else:  # only the rows that stay
                v = np.concatenate([np.frombuffer(data[at(y * step) : at(y * step + 1)], "<f4").reshape(w, c)[::step].ravel() for y in range(top, top + n)])
            if v is not None and len(v) != n * out_w * c:
                raise tiff.TiffError("values lie outside the file")
            yield {"width": out_w, "height": out_h, "channels": c, "step": step, "top": top, "rows": n, "values": v}


class RawMetadata(DataSource):
    """Options: path."""

    @classmethod
    def name(cls) -> str:
        return "raw_metadata"

    def schema(self) -> str:
        return f"{_RAW}, bytes_read long, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RawReader(schema, self.options, True)


class RawBands(DataSource):
    """Options: path; band_rows (256); rows, as first:last, to read a range of image rows; partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "raw_bands"

    def schema(self) -> str:
        return f"{_RAW}, top int, rows int, samples array<int>, bytes_read long, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RawReader(schema, self.options, False)


class LinearBands(DataSource):
    """Options: path; band_rows (256); max_width (decimates by every n-th row and column); rows; partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "linear_bands"

    def schema(self) -> str:
        return "path string, width int, height int, channels int, step int, top int, rows int, values array<float>, bytes_read long, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LinearReader(schema, self.options, False)


@dataclass
class Staged(WriterCommitMessage):
    """The files that a task wrote: where they lie and what they will be called."""

    files: list[tuple[str, str]]


class _TwoPhase(DataSourceArrowWriter):
    suffix = ""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.root, self.overwrite, self.options = options["path"], overwrite, dict(options)
        self.job = f"_staged-{uuid.uuid4().hex}"

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return store.open_store(self.root)

    def stage(self, batches: Iterator[pa.RecordBatch], folder: str, files: pafs.FileSystem) -> Iterator[tuple[str, str]]:
        """Writes files into a folder; gives each one's place and final name when it is whole."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, root = self._open()
        folder = f"{root}/{self.job}/{uuid.uuid4().hex}"  # of this attempt alone
        files.create_dir(folder, recursive=True)
        try:
            return Staged(list(self.stage(iterator, folder, files)))
        except BaseException:
            with contextlib.suppress(OSError):
                files.delete_dir(folder)
            raise

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = self._open()
        made = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in made]
        if len(set(names)) < len(names):
            raise ValueError("several tasks wrote one file; deal rows by name first")
        if self.overwrite:
            for path, _ in store.listing(self.root, self.suffix) if files.get_file_info(root).type == pafs.FileType.Directory else []:
                files.delete_file(path)
        else:
            there = [n for n in names if files.get_file_info(f"{root}/{n}").type != pafs.FileType.NotFound]
            if there:
                raise FileExistsError(f"{root}: {', '.join(sorted(there)[:5])}")
        for path, name in made:
            files.move(path, f"{root}/{name}")
        self.abort([])

    def abort(self, messages: list[Staged | None]) -> None:
        files, root = self._open()
        if files.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            files.delete_dir(f"{root}/{self.job}")


def _plain_name(name: str) -> str:
    if not name or "/" in name or name[0] in "._":
        raise ValueError(f"not a file name: {name!r}")
    return name


class _FilesWriter(_TwoPhase):
    def __init__(self, options: dict, overwrite: bool) -> None:
        super().__init__(options, overwrite)
        self.suffix = options.get("suffix", "")
        if overwrite and not self.suffix:
            raise ValueError("overwrite replaces files by suffix: set one")

    def stage(self, batches: Iterator[pa.RecordBatch], folder: str, files: pafs.FileSystem) -> Iterator[tuple[str, str]]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                path = f"{folder}/{_plain_name(name)}{self.suffix}"
                with files.open_output_stream(path) as out:
                    out.write(content)
                yield path, f"{name}{self.suffix}"


class _MasterWriter(_TwoPhase):
    """One master at a time: its header, then its bands as they come."""

    suffix = ".tif"

    def region(self, w: int, h: int) -> tuple[int, int, int, int]:
        if "region" not in self.options:
            return 0, 0, w, h
        left, top, rw, rh = (int(v) for v in self.options["region"].split(","))
        if left < 0 or top < 0 or rw <= 0 or rh <= 0 or left + rw > w or top + rh > h:
            raise ValueError(f"region {left},{top},{rw},{rh} does not lie inside {w} x {h}")
        return left, top, rw, rh

    def stage(self, batches: Iterator[pa.RecordBatch], folder: str, files: pafs.FileSystem) -> Iterator[tuple[str, str]]:
        name, shape, at, out, done = None, (0, 0, 0), 0, None, set()

        def finish() -> tuple[str, str]:
            out.close()
            if at != shape[1]:
                raise ValueError(f"{name}: rows end at {at} of {shape[1]}")
            return f"{folder}/{name}.tif", f"{name}.tif"

        try:
            for batch in batches:
                for k in range(batch.num_rows):
                    r = {c: batch.column(c)[k] for c in ("name", "width", "height", "channels", "top", "values")}
                    now = tuple(r[c].as_py() for c in ("width", "height", "channels"))
                    if r["name"].as_py() != name:
                        if name is not None:
                            yield finish()
                        name, shape, at = _plain_name(r["name"].as_py()), now, 0
                        if name in done:
                            raise ValueError(f"{name}: bands of another master stand between its own")
                        done.add(name)
                        left, first, rw, rh = self.region(shape[0], shape[1])
                        out = files.open_output_stream(f"{folder}/{name}.tif")
                        out.write(tiff.linear_header(rw, rh, shape[2], self.options.get("description", "")))
                    v = np.asarray(r["values"].values, np.float32).reshape(-1, shape[0], shape[2])
                    if now != shape or r["top"].as_py() != at:
                        raise ValueError(f"{name}: expected row {at} of {shape}, got {r['top'].as_py()} of {now}")
                    a, b = max(at, first), min(at + len(v), first + rh)
                    if a < b:
                        out.write(v[a - at : b - at, left : left + rw].astype("<f4").tobytes())
                    at += len(v)
            if name is not None:
                yield finish()
        finally:
            if out is not None and not out.closed:
                out.close()


class NamedFiles(DataSource):
    """Options: path, suffix (added to every name)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _FilesWriter(self.options, overwrite)


class LinearMaster(DataSource):
    """Options: path, region (left,top,width,height: writes that part of the master), description."""

    @classmethod
    def name(cls) -> str:
        return "linear_master"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _MasterWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes the formats known to a session."""
    for source in (RawMetadata, RawBands, LinearBands, NamedFiles, LinearMaster):
        spark.dataSource.register(source)
    return spark


def write_files(files: DataFrame, path: str, suffix: str = "", mode: str = "append") -> None:
    """files: name, content."""
    register(files.sparkSession)
    files.select("name", "content").write.format("named_files").option("suffix", suffix).mode(mode).save(path)


def write_masters(bands: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """bands: name, width, height, channels, top, values. A file is one stream, so a master's bands go to one task, in order; it
    holds a band at a time."""
    register(bands.sparkSession)
    dealt = bands.select("name", "width", "height", "channels", "top", "values").repartition("name").sortWithinPartitions("name", "top")
    dealt.write.format("linear_master").options(**options).mode(mode).save(path)


def read_masters(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return register(spark).read.format("linear_bands").options(**options).load(path)


def master_pixels(bands: DataFrame) -> DataFrame:
    """path, x, y, channel, v of masters' bands."""
    from pyspark.sql import functions as F

    b = bands.where("error IS NULL").select("path", "top", "width", "channels", F.posexplode("values").alias("i", "v"))
    across = F.floor(F.col("i") / F.col("channels"))
    return b.select(
        "path", (across % F.col("width")).alias("x"), (F.col("top") + F.floor(across / F.col("width"))).alias("y"), (F.col("i") % F.col("channels")).alias("channel"), F.col("v").cast("double").alias("v")
    )
