"""The format of TIFF-shaped files: raw sensor frames (DNG) and linear float masters.

A directory is read from bytes or from an open file by ranges (`store.Ranges`); rows of an image come from the strips that
hold them and no others. Only uncompressed data is handled. `frames.py` makes data sources of this.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the formats: TIFF tags, sizes and codes of value types, the photometric code of sensor mosaics.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
DESCRIPTION, PLANAR, FLOATS = 270, 284, 3
SUBFILE, SUB_IFDS, SAMPLE_FORMAT, CFA_DIM, CFA_PATTERN, EXPOSURE, ISO, MODEL, BLACK, WHITE = 254, 330, 339, 33421, 33422, 33434, 34855, 50708, 50714, 50717
KINDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 7: "B", 9: "i", 10: "ii"}
CFA_PHOTOMETRIC, PLAIN = 32803, 1


class TiffError(ValueError):
    pass


@dataclass
class Tiff:
    """The directory of a file that holds its image; data is sliced, so it may be bytes or ranges of an open file."""

    data: Sequence
    order: str = "<"
    tags: dict[int, tuple[int, int, int]] = field(default_factory=dict)

    def _unpack(self, kinds: str, at: int) -> tuple:
        return struct.unpack(self.order + kinds, self.data[at : at + struct.calcsize("<" + kinds)])

    @staticmethod
    def open(data: Sequence, photometric: int | None = None) -> Tiff:
        order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
        if order is None or len(data) < 8:
            raise TiffError("not a TIFF: bad byte order")
        magic, first = struct.unpack(order + "HI", data[2:8])
        if magic != 42:
            raise TiffError(f"not a TIFF: magic {magic}")
        t = Tiff(data, order)
        t.tags = t._directory(first)
        if photometric is None or t.one(PHOTOMETRIC) == photometric:
            return t
        for at in t.many(SUB_IFDS) or []:
            sub = Tiff(data, order, t._directory(int(at)))
            if sub.one(PHOTOMETRIC) == photometric and (sub.one(SUBFILE) or 0) == 0:
                return sub
        raise TiffError("no mosaic image in any directory")

    def _directory(self, at: int) -> dict[int, tuple[int, int, int]]:
        if at + 2 > len(self.data):
            raise TiffError("directory lies outside the file")
        (n,) = self._unpack("H", at)
        out = {}
        for i in range(n):
            tag, kind, count = self._unpack("HHI", at + 2 + 12 * i)
            if kind in KINDS:
                size = struct.calcsize("<" + KINDS[kind]) * count
                place = at + 2 + 12 * i + 8
                out[tag] = (kind, count, place if size <= 4 else self._unpack("I", place)[0])
        return out

    def count(self, tag: int) -> int:
        return self.tags[tag][1] if tag in self.tags else 0

    def many(self, tag: int, first: int = 0, last: int | None = None) -> list | None:
        """A tag's values, or those from `first` to before `last`, without reading the others."""
        if tag not in self.tags:
            return None
        kind, count, at = self.tags[tag]
        if kind == 2:
            return [bytes(self.data[at : at + count]).split(b"\0")[0].decode("ascii", "replace")]
        last = count if last is None else min(last, count)
        v = self._unpack(KINDS[kind] * (last - first), at + first * struct.calcsize("<" + KINDS[kind]))
        return [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2], strict=True)] if kind in (5, 10) else list(v)

    def one(self, tag: int):
        v = self.many(tag, 0, 1)
        return v[0] if v else None

    def rows(self, top: int, count: int, dtype: str) -> np.ndarray:
        """Samples of image rows [top, top + count) from the strips that overlap them. Strips that lie side by side are read at once."""
        width, height = int(self.one(WIDTH)), int(self.one(HEIGHT))
        count = max(0, min(count, height - top))
        each = int(self.one(ROWS_PER_STRIP) or height)
        first, last = top // each, -(-(top + count) // each)
        if self.count(STRIP_OFFSETS) != self.count(STRIP_BYTES) or self.count(STRIP_OFFSETS) != -(-height // each):
            raise TiffError("strip offsets and sizes disagree")
        if not count:
            return np.zeros((0, width), self.order + dtype)
        offsets, sizes = self.many(STRIP_OFFSETS, first, last), self.many(STRIP_BYTES, first, last)
        size = np.dtype(dtype).itemsize
        parts, a = [], 0
        for b in range(1, len(offsets) + 1):
            if b == len(offsets) or offsets[b] != offsets[b - 1] + sizes[b - 1]:
                parts.append(bytes(self.data[offsets[a] : offsets[b - 1] + sizes[b - 1]]))
                if len(parts[-1]) != sum(sizes[a:b]):
                    raise TiffError("strip lies outside the file")
                a = b
        v = np.frombuffer(b"".join(parts), self.order + dtype)
        want = width * (min(last * each, height) - first * each)
        if sum(sizes) != want * size:
            raise TiffError(f"{len(v)} samples in strips that hold {want}")
        return v.reshape(-1, width)[top - first * each : top - first * each + count]


def raw_metadata(data: Sequence) -> dict:
    t = Tiff.open(data, CFA_PHOTOMETRIC)
    width, height = t.one(WIDTH), t.one(HEIGHT)
    if width is None or height is None:
        raise TiffError("no image size")
    if (t.one(COMPRESSION) or PLAIN) != PLAIN:
        raise TiffError(f"compression {t.one(COMPRESSION)} is not handled")
    if (t.one(BITS) or 16) != 16:
        raise TiffError(f"{t.one(BITS)} bits a sample are not handled")
    return {
        "width": int(width), "height": int(height), "rows_per_strip": int(t.one(ROWS_PER_STRIP) or height), "cfa": [int(c) for c in t.many(CFA_PATTERN) or []],
        "black": [float(b) for b in t.many(BLACK) or []], "white": t.one(WHITE), "iso": t.one(ISO), "exposure_seconds": t.one(EXPOSURE), "model": t.one(MODEL),
    }


def raw_samples(data: Sequence) -> np.ndarray:
    """The samples of a whole frame."""
    m = raw_metadata(data)
    return Tiff.open(data, CFA_PHOTOMETRIC).rows(0, m["height"], "u2").astype(np.int32)


def pixels(bands: DataFrame) -> DataFrame:
    """path, x, y, v: one row a sample, for the column operators."""
    b = bands.where("error IS NULL").select("path", "top", "width", F.posexplode("samples").alias("i", "v"))
    return b.select("path", (F.col("i") % F.col("width")).alias("x"), (F.col("top") + F.floor(F.col("i") / F.col("width"))).cast("int").alias("y"), F.col("v").cast("double").alias("v"))


def _entries(tags: list[tuple[int, int, list]], order: str = "<", base: int = 8) -> bytes:
    """A directory at `base` and the values that do not fit into it."""
    extra, at, out = b"", base + 2 + 12 * len(tags) + 4, struct.pack(order + "H", len(tags))
    for tag, kind, values in sorted(tags):
        flat = [x for v in values for x in (v if isinstance(v, tuple) else (v,))]
        raw = struct.pack(order + KINDS[kind] * len(values), *flat)
        if len(raw) > 4:
            raw, extra = struct.pack(order + "I", at + len(extra)), extra + raw + b"\0" * (len(raw) % 2)
        out += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return out + struct.pack(order + "I", 0) + extra


def build_raw(samples: np.ndarray, order: str = "<", rows_per_strip: int | None = None, **more) -> bytes:
    """The bytes of a raw frame: for round trips and fixtures. more: iso, exposure (a pair), black, white, compression, photometric."""
    h, w = samples.shape
    step = rows_per_strip or h
    strips = [samples[i : i + step].astype(order + "u2").tobytes() for i in range(0, h, step)]

    def tags(offsets: list[int]) -> list[tuple[int, int, list]]:
        return [
            (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [16]), (COMPRESSION, 3, [more.get("compression", PLAIN)]), (PHOTOMETRIC, 3, [more.get("photometric", CFA_PHOTOMETRIC)]),
            (STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [step]), (STRIP_BYTES, 4, [len(s) for s in strips]), (CFA_DIM, 3, [2, 2]), (CFA_PATTERN, 1, more.get("cfa", [1, 0, 2, 1])),
            (BLACK, 5, [(b, 1) for b in more.get("black", [64] * 4)]), (WHITE, 4, [more.get("white", 1023)]), (ISO, 3, [more.get("iso", 800)]), (EXPOSURE, 5, [more.get("exposure", (8, 1))]),
        ]

    start = 8 + len(_entries(tags([0] * len(strips)), order))
    offsets = [start + sum(len(s) for s in strips[:i]) for i in range(len(strips))]
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + _entries(tags(offsets), order) + b"".join(strips)


def linear_header(width: int, height: int, channels: int, description: str = "") -> bytes:
    """What stands before the values of a float32 master, which follow as one uncompressed strip, row by row."""
    size = 4 * width * height * channels
    text = description.encode("ascii", "replace")[:1023] + b"\0"
    if size + 4096 > 1 << 32:
        raise TiffError(f"{width} x {height} x {channels} does not fit the offsets of a TIFF")

    def tags(at: int) -> list[tuple[int, int, list]]:
        return [
            (SUBFILE, 4, [0]), (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [32] * channels), (COMPRESSION, 3, [PLAIN]), (PHOTOMETRIC, 3, [2 if channels == 3 else 1]), (DESCRIPTION, 2, [bytes([b]) for b in text]),
            (STRIP_OFFSETS, 4, [at]), (SAMPLES, 3, [channels]), (ROWS_PER_STRIP, 4, [height]), (STRIP_BYTES, 4, [size]), (PLANAR, 3, [1]), (SAMPLE_FORMAT, 3, [FLOATS] * channels),
        ]

    return b"II" + struct.pack("<HI", 42, 8) + _entries(tags(8 + len(_entries(tags(0)))))


def linear_shape(t: Tiff) -> tuple[int, int, int, int]:
    """Height, width, channels and where the values begin; anything but a master in one strip is an error."""
    w, h, c = (int(t.one(tag) or 0) for tag in (WIDTH, HEIGHT, SAMPLES))
    if w <= 0 or h <= 0 or c not in (1, 3) or (t.one(COMPRESSION) or PLAIN) != PLAIN or t.many(SAMPLE_FORMAT) != [FLOATS] * c or len(t.many(STRIP_OFFSETS) or []) != 1:
        raise TiffError("not a linear master")
    return h, w, c, int(t.one(STRIP_OFFSETS))


def encode_raw(planes: DataFrame, by: str, black: int = 64, white: int = 1023) -> DataFrame:
    """path, content: the raw file of each frame. planes: by, x, y, v (whole numbers); a frame is one group, as it is one file, and
    missing samples are black."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = np.full((int(rows.y.max()) + 1, int(rows.x.max()) + 1), black, np.int32)
        v[rows.y.to_numpy(int), rows.x.to_numpy(int)] = rows.v
        return pd.DataFrame({"path": [str(key[0])], "content": [build_raw(v, rows_per_strip=16, black=[black] * 4, white=white)]})

    return planes.groupBy(by).applyInPandas(run, "path string, content binary")
