"""Token ids in files: one Zstandard frame a document under a dictionary that all files share, and an index of frames.

A written folder holds
- `dictionary-<sha256>`: a dictionary trained on serialized id arrays of a bounded sample of documents;
- `part-NNNNN.ids`: the documents' frames, one after another; a frame's content is the ids as little-endian unsigned
  integers of `width` bytes, whole documents, in ascending doc_id order within a file and from file to file;
- `part-NNNNN.idx`: a line of JSON (version, width, the dictionary's hash), then arrays by document: doc_id, whether it is
  null, how many ids it has, and where its frame starts (one more than documents);
- `manifest`: a table of the files with their documents, ids and the ids of all files before, written last.
A reader takes what the manifest lists and refuses another dictionary than the one an index names. One short document is
read by its index entry and one ranged read (`TokenFile`).

Documents are encoded once into a table of frames in the shared folder, then dealt by ranges of (doc_id, ids, hash, row), so
rows that share a doc_id spread over files too. A task writes its file as a stream under a name of its own and moves it in
place, so a task that runs twice leaves one whole file.

The tokenizers library encodes each distinct stretch between blanks once: the vocabulary drops white space and never joins
across it, so joined stretches have the ids of the whole text. That holds for vocabularies that split at white space first,
such as the one the query uses.

Defined results: a null or empty text has the end id only; a null doc_id comes first; rows that share a doc_id stand by
number of ids, then crc32; an empty table makes a manifest without files; very long texts are whole; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.llm import common as C
from nightloom.llm import wordhash as H

VERSION, END = 1, 2
#: Bounds of the sample that the dictionary is trained on: documents, pieces of each (spread over the whole document), ids of a piece.
SAMPLE_DOCS, SAMPLE_PIECES, PIECE_IDS = 1000, 4, 1024
DICTIONARY_BYTES, LEVEL = 1 << 16, 3
#: Bytes of frames in a file, about; bytes of texts and stretches that are encoded at a time; stretches that a worker remembers
#: beside those of a block, and the characters beyond which it does not.
FILE_BYTES, BLOCK_BYTES, AT_ONCE, REMEMBERED, LONG = 64 << 20, 8 << 20, 4096, 800_000, 64
#: How the vocabulary names ids that end a word, and marks that are words of their own after an ASCII letter or digit.
WORD_END, MARKS = "</w>", ".,;:!?"
MANIFEST = "file string, documents long, ids long, start long"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel work
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Encodes texts by their stretches between ASCII blanks, each distinct one once: the vocabulary drops white space and joins
    nothing across it. A block's stretches are numbered by Arrow; the ids of a stretch are kept serialized, so that the ids of
    a block are gathered by number, and a text's are a slice of them."""

    def __init__(self, path: str, end: int = END) -> None:
        self.tokenizer, self.width, self.kept = _tokenizer(path), id_width(path, end), {}
        self.kind = f"<u{self.width}"
        names = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(names.values()) + 1, bool)  # ids that end a word
        self.closes[[i for name, i in names.items() if name.endswith(WORD_END)]] = True
        self.end = np.array([end], self.kind)

    def _apart(self, stretches: list[str]) -> None:
        for w, e in zip(stretches, self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False), strict=True):
            self.kept[w] = np.array(e.ids, self.kind).tobytes()

    def _words(self, words: list[str]) -> None:
        """Stretches of letters, as one text; each gives one word, which ends where an id ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        at = np.flatnonzero(self.closes[ids]) + 1
        if len(at) != len(words) or at[-1] != len(ids):  # a letter that the vocabulary's rules take apart
            self._apart(words)
            return
        raw, at = ids.astype(self.kind).tobytes(), (at * self.width).tolist()
        self.kept.update(zip(words, map(raw.__getitem__, map(slice, [0, *at[:-1]], at)), strict=True))

    def _learn(self, stretches: list[str]) -> None:
        # Marks after an ASCII letter or digit are words of their own, so what stands before them is shared.
        marked = {}
        for w in stretches:
            if w[-1] in MARKS:
                base = w.rstrip(MARKS)
                if base and base[-1].isascii() and base[-1].isalnum():
                    marked[w] = base
        new = {w for w in stretches if w not in marked}.union(marked.values(), (w[len(base) :] for w, base in marked.items())).difference(self.kept)
        letters = [w for w in new if w.isalpha()]
        others = list(new.difference(letters))
        for some, learn in ((letters, self._words), (others, self._apart)):
            for a in range(0, len(some), AT_ONCE):
                learn(some[a : a + AT_ONCE])
        for w, base in marked.items():
            self.kept[w] = self.kept[base] + self.kept[w[len(base) :]]

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, with the end id."""
        texts = texts.fill_null("")
        # A-Z go to lower case anyway, but for what could be one of the vocabulary's special words.
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.kept.setdefault("", b"")
        got = list(map(self.kept.get, distinct))
        new = [w for w, g in zip(distinct, got, strict=True) if g is None]
        if new:
            self._learn(new)
            got = list(map(self.kept.__getitem__, distinct))
        if len(self.kept) > REMEMBERED:  # what this block holds is what the next will ask for
            self.kept = dict(zip(distinct, got, strict=True))
        for w in new:
            if len(w) > LONG:
                self.kept.pop(w, None)
        size = np.array([len(g) for g in got], np.int32) // self.width
        flat, start = np.frombuffer(b"".join(got), self.kind), np.cumsum(size, dtype=np.int32) - size
        index = coded.indices.to_numpy(zero_copy_only=False)
        length = size[index]
        before = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        place = np.repeat((start[index] - before[:-1]).astype(np.int32), length)  # a block's ids fit 32 bits
        place += np.arange(before[-1], dtype=np.int32)
        ids = flat[place]
        at = before[split.offsets.to_numpy() - split.offsets[0].as_py()]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield np.append(ids[a:b], self.end)


@functools.lru_cache(2)
def _encoder(path: str, end: int) -> Encoder:
    """One encoder a worker process, which keeps what it has learned from task to task."""
    return Encoder(path, end)


def id_width(path: str, end: int = END) -> int:
    """Bytes of an id in the files."""
    return 2 if max(_tokenizer(path).get_vocab_size(), end + 1) <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, path: str, end: int = END) -> bytes:
    """A dictionary for serialized ids, from pieces of about SAMPLE_DOCS documents chosen by hash (all, where there are fewer)."""
    total = docs.count()
    share = 1.0 if total <= SAMPLE_DOCS else SAMPLE_DOCS / total
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, end)
        size = PIECE_IDS * encoder.width
        for batch in batches:
            for ids in encoder(batch.column(1)):
                raw = ids.tobytes()
                places = range(0, len(raw), size)
                places = places[:: max(1, -(-len(places) // SAMPLE_PIECES))]
                yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(raw)]), pa.array([[raw[p : p + size] for p in places]], pa.list_(pa.binary()))], ["crc", "pieces"])

    got = chosen.mapInArrow(cut, "crc long, pieces array<binary>").limit(2 * SAMPLE_DOCS).collect()  # 16 MB at most
    some = [bytes(p) for r in sorted(got, key=lambda r: (r.crc, len(r.pieces))) for p in r.pieces]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, some, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the ids themselves are the dictionary
        return b"".join(some)[-DICTIONARY_BYTES:]


def encoded(docs: DataFrame, path: str, folder: str, digest: str, end: int = END) -> DataFrame:
    """doc_id, n_tokens, crc (of the ids as 32-bit integers), frame of every row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, end)
        packer = _codec(zstandard.ZstdCompressor, folder, digest, level=LEVEL, write_dict_id=False, write_checksum=False)
        for batch in batches:
            for i, j, _, _ in H.slices(batch.column(1), BLOCK_BYTES):
                part = batch.slice(i, j - i)
                n, crc, frame = [], [], []
                for ids in encoder(part.column(1)):
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4")))
                    frame.append(packer.compress(ids.tobytes()))
                columns = [pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(frame, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_tokens", "crc", "frame"])

    return docs.mapInArrow(encode, "doc_id long, n_tokens long, crc long, frame binary")


def _put(uri: str, write) -> None:
    """A file written under a name of its own, then moved."""
    store, path = pafs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        write(out)
    store.move(draft, path)


def _get(uri: str) -> pa.NativeFile:
    store, path = pafs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _whole(uri: str) -> bytes:
    with _get(uri) as f:
        return f.read()


@functools.lru_cache(8)
def _dictionary(folder: str, digest: str) -> zstandard.ZstdCompressionDict | None:
    raw = _whole(f"{folder}/dictionary-{digest}")
    if hashlib.sha256(raw).hexdigest() != digest:
        raise ValueError(f"{folder}: the dictionary is not the one that files were written with")
    return _precomputed(raw) if raw else None


def _codec(kind, folder: str, digest: str, **settings):
    held = _dictionary(folder, digest)
    return kind(**settings, **({"dict_data": held} if held else {}))


def _precomputed(raw: bytes) -> zstandard.ZstdCompressionDict:
    held = zstandard.ZstdCompressionDict(raw)
    held.precompute_compress(level=LEVEL)
    return held


def write_documents(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> DataFrame:
    """Writes the files of a table (doc_id, text) to a new folder that driver and executors share. Gives the manifest."""
    spark, path = docs.sparkSession, path or vocabulary()
    docs, width = C.documents_only(docs), id_width(path, end)
    dictionary = train_dictionary(docs, path, end)
    digest = hashlib.sha256(dictionary).hexdigest()
    _put(f"{folder}/dictionary-{digest}", lambda out: out.write(dictionary))
    rows = C.stored(encoded(docs, path, folder, digest, end).withColumn("row", F.monotonically_increasing_id()), f"{folder}/encoded")
    size = rows.agg(F.sum(F.octet_length("frame"))).first()[0] or 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name = f"part-{TaskContext.get().partitionId():05d}"
        ids, empty, lengths, at = [], [], [], [0]

        def frames(out) -> None:
            for batch in itertools.chain([first], batches):
                for doc_id, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out.write(frame)
                    ids.append(doc_id or 0)
                    empty.append(doc_id is None)
                    lengths.append(n)
                    at.append(at[-1] + len(frame))

        def index(out) -> None:
            head = json.dumps({"version": VERSION, "width": width, "dictionary": digest, "documents": len(ids)})
            out.write(head.encode() + b"\n")
            for values, kind in ((ids, "<i8"), (empty, "u1"), (lengths, "<i8"), (at, "<i8")):
                out.write(np.array(values, kind).tobytes())

        _put(f"{folder}/{name}.ids", frames)
        _put(f"{folder}/{name}.idx", index)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)]), pa.array([sum(lengths)])], ["file", "documents", "ids"])

    by = ["doc_id", "n_tokens", "crc", "row"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    dealt = rows.select(*by, "frame").repartitionByRange(parts, *by).sortWithinPartitions(*by).select("doc_id", "n_tokens", "frame")
    start, listed = 0, []
    for r in sorted(dealt.mapInArrow(write, "file string, documents long, ids long").collect()):  # one row a file
        listed.append((r.file, r.documents, r.ids, start))
        start += r.ids
    C.delete_dir(spark, f"{folder}/encoded")
    return C.stored(spark.createDataFrame(listed, MANIFEST).coalesce(1), f"{folder}/manifest")


class TokenFile:
    """One file of a folder, by its index. Opening reads the index; a document costs one ranged read."""

    def __init__(self, folder: str, name: str):
        raw = _whole(f"{folder}/{name}.idx")
        cut = raw.index(b"\n") + 1
        self.head = json.loads(raw[:cut])
        if self.head["version"] != VERSION:
            raise ValueError(f"{name}: version {self.head['version']} is not known")
        n = self.head["documents"]
        self.doc_ids = np.frombuffer(raw, "<i8", n, cut)
        self.nulls = np.frombuffer(raw, "u1", n, cut + 8 * n)
        self.lengths = np.frombuffer(raw, "<i8", n, cut + 9 * n)
        self.at = np.frombuffer(raw, "<i8", n + 1, cut + 17 * n)
        self.unpacker = _codec(zstandard.ZstdDecompressor, folder, self.head["dictionary"])
        self.uri = f"{folder}/{name}.ids"

    def _ids(self, frame: bytes, k: int) -> np.ndarray:
        ids = np.frombuffer(self.unpacker.decompress(frame), f"<u{self.head['width']}")
        if len(ids) != self.lengths[k]:
            raise ValueError(f"{self.uri}: document {k} does not hold what its index says")
        return ids

    def find(self, doc_id: int | None) -> range:
        """The places of a doc_id's documents."""
        first = int(self.nulls.sum())
        if doc_id is None:
            return range(first)
        return range(*(first + int(np.searchsorted(self.doc_ids[first:], doc_id, side)) for side in ("left", "right")))

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        with _get(self.uri) as f:
            f.seek(int(self.at[k]))
            return self._ids(f.read(int(self.at[k + 1] - self.at[k])), k)

    def all(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of all documents, in order."""
        with _get(self.uri) as f:
            for k, doc_id in enumerate(self.doc_ids):
                yield None if self.nulls[k] else int(doc_id), self._ids(f.read(int(self.at[k + 1] - self.at[k])), k)


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")


def _read(spark: SparkSession, folder: str, table: Callable[[list[tuple]], pa.RecordBatch], schema: str) -> DataFrame:
    """A table of (doc_id, start, ids) of the documents of a written folder, about a million ids at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[tuple] = []
                size = 0
                for doc_id, ids in TokenFile(folder, name).all():
                    held.append((doc_id, start, ids))
                    start += len(ids)
                    size += len(ids)
                    if size >= 1 << 20:
                        yield table(held)
                        held, size = [], 0
                if held:
                    yield table(held)

    return _manifest(spark, folder).select("file", "start").mapInArrow(read, schema)


def _with_ids(held: list[tuple]) -> pa.RecordBatch:
    doc_id, start, ids = zip(*held, strict=True)
    n = [len(x) for x in ids]
    flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), flat], ["doc_id", "start", "n_tokens", "ids"])


def _with_crc(held: list[tuple]) -> pa.RecordBatch:
    doc_id, start, ids = zip(*held, strict=True)
    columns = [doc_id, start, [len(x) for x in ids], [zlib.crc32(x.astype("<u4")) for x in ids]]
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids of every document of a written folder."""
    return _read(spark, folder, _with_ids, "doc_id long, start long, n_tokens long, ids array<int>")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), read back from the files."""
    return _read(spark, folder, _with_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.shared_dir(spark)
    write_documents(C.table(spark, sf_dir, "documents"), folder)
    return digests(spark, folder)
