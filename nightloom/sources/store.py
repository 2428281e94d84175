"""Files of any store that Arrow opens by URI (local, HDFS, S3, GCS): listing, ranged reads, staged writes."""

from __future__ import annotations

import functools
import os
import uuid

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

PAGE = 4096


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a folder of its own is taken on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/nightloom-checkpoints"
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def checkpoints(spark: SparkSession) -> None:
    """Makes DataFrame.checkpoint() write to the shared folder where the session names no other."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))


@functools.lru_cache(64)
def _store(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if "://" in root else "file://" + os.path.abspath(root))


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI (a plain path is local) and the path in it."""
    return _store(uri.rstrip("/"))


def listing(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files under a folder, by path; a file stands for itself. Names that begin with _ or . are not data."""
    store, path = open_store(uri)
    info = store.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = store.get_file_info(pafs.FileSelector(path, recursive=True))
    hidden = lambda p: any(part[:1] in ("_", ".") for part in p[len(path) :].split("/"))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(suffix) and not hidden(f.path))


def put(uri: str, content: bytes) -> None:
    """A file written under a name of its own, then moved in place: a reader sees the old one or the new one, whole."""
    store, path = open_store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{os.path.dirname(path)}/_{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(content)
    store.move(draft, path)


def get(uri: str) -> bytes | None:
    store, path = open_store(uri)
    if store.get_file_info(path).type != pafs.FileType.File:
        return None
    with store.open_input_stream(path) as f:
        return f.read()


def exists(uri: str) -> bool:
    store, path = open_store(uri)
    return store.get_file_info(path).type != pafs.FileType.NotFound


def inside(root: str, name: str) -> str:
    """The URI of a folder of root; a name that leads elsewhere is refused."""
    if not name or name in (".", "..") or "/" in name or "\\" in name or name[0] == "_":
        raise ValueError(f"not a folder of {root}: {name!r}")
    return f"{root.rstrip('/')}/{name}"


def delete(uri: str) -> bool:
    """Whether there was a folder, which is gone now."""
    store, path = open_store(uri)
    there = store.get_file_info(path).type == pafs.FileType.Directory
    if there:
        store.delete_dir(path)
    return there


class Ranges:
    """An open file that is sliced like bytes. Small reads come from pages that are kept, large ones go straight to the file;
    bytes_read says what was asked of the store, known whether the file's header could be read."""

    def __init__(self, file) -> None:
        self.file, self.size, self.bytes_read = file, file.size(), 0
        self.pages: dict[int, bytes] = {}
        self.known = False

    def __len__(self) -> int:
        return self.size

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        raw = self.file.read(n)
        self.bytes_read += len(raw)
        return raw

    def __getitem__(self, span: slice) -> bytes:
        a, b, _ = span.indices(self.size)
        if b - a > PAGE:
            return self._read(a, b - a)
        out = b""
        for k in range(a // PAGE, -(-b // PAGE)):
            if k not in self.pages:
                self.pages[k] = self._read(k * PAGE, min(PAGE, self.size - k * PAGE))
            out += self.pages[k]
        return out[a % PAGE : a % PAGE + b - a]
