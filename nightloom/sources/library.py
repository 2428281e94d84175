"""Stores on any file system that driver and executors share: flats by camera, and folders of sessions.

A flat is a linear master of one channel in a folder of its camera, with its facts beside it as JSON, which are written last: a flat
without facts is none. A session is a folder with a log, which is replaced whole. Lists are Spark tables.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.sources import frames, store

INFO = "camera string, width int, height int, frames int, iso int, created long"


class FlatLibrary:
    """One flat a camera; a newer one takes the place of an older."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, f"{root.rstrip('/')}/flats"

    def _folder(self, camera: str) -> str:
        return store.inside(self.root, "camera-" + (re.sub(r"[^A-Za-z0-9_-]+", "-", camera).strip("-") or "unknown"))

    def save(self, camera: str, bands: DataFrame, width: int, height: int, **facts: int) -> None:
        """bands: top, values (rows of the flat, in bands). facts: frames, iso, created."""
        folder = self._folder(camera)
        rows = bands.select(F.lit("flat").alias("name"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(1).alias("channels"), "top", "values")
        frames.write_masters(rows, folder, mode="overwrite", description=f"flat field of {camera}")
        store.put(f"{folder}/info.json", json.dumps({"camera": camera, "width": width, "height": height, **facts}).encode())

    def info(self, camera: str) -> dict | None:
        raw = store.get(f"{self._folder(camera)}/info.json")
        return json.loads(raw) if raw else None

    def cameras(self) -> DataFrame:
        """The facts of every flat (columns of INFO)."""
        if not store.exists(self.root):
            return self.spark.createDataFrame([], INFO)
        return self.spark.read.schema(INFO).option("pathGlobFilter", "info.json").option("recursiveFileLookup", "true").json(self.root)

    def flat(self, camera: str, width: int, height: int, **options: str) -> DataFrame | None:
        """The bands of a camera's flat for frames of this size. A flat of another size is refused, never scaled: it would mix sites of
        different colours."""
        known = self.info(camera)
        if known is None or (known["width"], known["height"]) != (width, height):
            return None
        return frames.read_masters(self.spark, self._folder(camera), **options)

    def delete(self, camera: str) -> bool:
        return store.delete(self._folder(camera))


class SessionStore:
    """Folders of sessions under a root, by name."""

    LOG = "session.json"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def create(self, name: str) -> str:
        """A new folder of this name, or of the name with the first number from 2 on that is free."""
        n, folder = 1, name
        while store.exists(store.inside(self.root, folder)):
            n += 1
            folder = f"{name}-{n}"
        self.write_log(folder, {})
        return folder

    def write_log(self, folder: str, log: dict) -> None:
        store.put(f"{store.inside(self.root, folder)}/{self.LOG}", json.dumps(log).encode())

    def read_log(self, folder: str) -> dict | None:
        raw = store.get(f"{store.inside(self.root, folder)}/{self.LOG}")
        return json.loads(raw) if raw else None

    def folders(self) -> DataFrame:
        """folder, files, size_bytes of every session, the last name first. Files are listed, not read."""
        if not store.exists(self.root):
            return self.spark.createDataFrame([], "folder string, files long, size_bytes long")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root).select("path", "length")
        return sizes(files, F.element_at(F.split(F.substring_index("path", "/" + self.root.rsplit("/", 1)[1] + "/", -1), "/"), 1))

    def delete(self, folder: str) -> bool:
        return store.delete(store.inside(self.root, folder))


def sizes(files: DataFrame, folder: Column) -> DataFrame:
    """folder, files, size_bytes; files: path, length."""
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("size_bytes")).orderBy(F.desc("folder"))
