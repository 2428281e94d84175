"""Lists of arrays written as one file to a shared folder, and read back memory-mapped."""

from __future__ import annotations

import functools
import json
import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs as pafs


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write(uri: str, arrays: list[np.ndarray]) -> None:
    """Written under a name of its own, then moved: a task that runs twice leaves one whole file."""
    store, path = _open(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    head, at = [], 0
    for a in arrays:
        head.append([a.dtype.str, len(a), at])
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    start = -(-(len(text) + 16) // 64) * 64
    draft = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(f"{len(text):15d}\n".encode() + text.ljust(start - 16))
        for a in arrays:
            out.write(a.tobytes())
            out.write(b"\0" * (-a.nbytes % 64))
    store.move(draft, path)


@functools.lru_cache(4096)
def read(uri: str) -> list[np.ndarray]:
    """A file that this machine can't open itself is fetched into an unnamed local file, once a worker process. Files are
    never changed once they are written, so a name stands for its contents."""
    store, path = _open(uri)
    if isinstance(store, pafs.LocalFileSystem):
        file = open(path, "rb")  # noqa: SIM115  the mapping outlives it
    else:
        file = tempfile.TemporaryFile()  # noqa: SIM115
        with store.open_input_stream(path) as source:
            while part := source.read(1 << 22):
                file.write(part)
        file.flush()
    with file:
        whole = np.asarray(np.memmap(file, np.uint8, mode="r"))  # plain arrays over the mapping
    n = int(whole[:15].tobytes())
    start = -(-(n + 16) // 64) * 64
    out = []
    for dtype, length, at in json.loads(whole[16 : 16 + n].tobytes()):
        size = np.dtype(dtype).itemsize * length
        out.append(whole[start + at : start + at + size].view(dtype))
    return out
