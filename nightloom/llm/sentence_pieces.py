"""SentencePiece encoding and decoding by a streaming Viterbi search.

The trellis has a node for each character boundary; an edge is a piece that ends there. Only the nodes within the
longest piece of the current one can still begin an edge, so only they survive; whenever all their back pointers
lead through one earlier boundary, the ids up to it are committed and forgotten. A text of any length needs a
window bounded by the longest piece and by how far back the survivors' paths part.

Unigram models: the best path has the largest sum of scores. BPE models: a path is admissible if each pair of
neighbours is what merging their joint characters by score gives back; exactly one admissible edge ends at each
boundary, and the path is what the merges of the whole text give. Characters without a piece become byte pieces.

No piece holds a blank mark after another character, and no character without a piece can join a piece: no edge spans
such a place, so one node survives there, all paths meet in it, and the ids up to it are committed. A batch is cut at
these places, each distinct stretch of it is searched once, and many stretches are searched side by side, column
by column of the trellis (`Block`). `Codec.stream` is the same search over one stretch of any length, with its commits.

Defined results: a null text is empty and has no ids; decoding gives the text back, but for U+2581, the blank mark,
which comes back as a space; repeated rows are encoded alike; extra columns are ignored. A very long stretch in which
paths do not converge is kept until they do; its time and memory stay in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.llm import common as C
from nightloom.llm import wordhash as H
from nightloom.llm.lookup import Lookup

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Bytes of text that are cut into stretches together; stretches that a worker remembers from one such part to the next.
PART_BYTES, REMEMBERED = 1 << 22, 500_000
#: Pairs of pieces whose fit is remembered, as a power of two.
PAIR_BITS = 20
#: Characters of a stretch that is searched beside others, and cells of the trellis they may fill.
BLOCK_CHARS, BLOCK_CELLS = 256, 1 << 18
_kept: dict = {}


def load(path: str = MODEL) -> dict:
    """The pieces of a model file, read on the driver: a table of fixed size that goes to the tasks."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    norm = m.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("models that rewrite characters or drop blanks are not handled")
    kind = {1: "normal", 2: "unknown", 3: "control", 4: "user", 5: "unused", 6: "byte"}
    pieces = [(p.piece, float(p.score), kind[p.type]) for p in m.pieces]
    name = path, hash(tuple(pieces))  # a changed file under the same path is another model
    return {"name": name, "bpe": m.trainer_spec.model_type == 2, "dummy": norm.add_dummy_prefix, "pieces": pieces}


class Codec:
    def __init__(self, model: dict):
        pieces = model["pieces"]
        self.bpe, self.dummy = model["bpe"], model["dummy"]
        self.names = [p for p, _, _ in pieces]
        self.score = {p: s for p, s, kind in pieces if kind in ("normal", "user")}
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in ("normal", "user")}
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == "unknown"), 0)
        self.longest = max(map(len, self.id))
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == "byte" else b"" if kind == "control" else p.encode() for p, _, kind in pieces]
        self.worst = min(self.score.values()) - 10
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.edges: dict[str, tuple[list[str], list[str]]] = {}
        self.loose = [c for c in "\n\t\r" if c not in self.id]
        self.apart = np.isin(np.arange(256), [ord(c) for c in self.loose])
        apart = "".join(map(re.escape, self.loose))
        # A piece with a blank mark inside would rule out cutting there.
        self.cut = not any(BLANK in p.lstrip(BLANK) for p in self.id)
        blank = f"[ {BLANK}]"
        self.stretches = re.compile(f"{blank}*[^ {BLANK}{apart}]+|{blank}+" + (f"|[{apart}]" if apart else "")).findall if self.cut else lambda s: [s]
        plain = [b.replace(BLANK.encode(), b" ") for b in self.bytes]
        # The second half has the pieces as they stand at the beginning of a text.
        self.plain = pa.array(plain + [b[1:] if b[:1] == b" " and self.dummy else b for b in plain], pa.large_binary())
        self.block = Block(self) if self.bpe and self.cut else None
        self.memo = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def merged(self, s: str, until: int = 1) -> list[str]:
        """Merges by score, ties from the left, down to `until` parts; only ever called on the few characters of a piece or two."""
        parts = list(s)
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _whole(self, p: str) -> bool:
        """Whether merging a piece's own characters gives the piece."""
        got = self.whole.get(p)
        if got is None:
            got = self.whole[p] = len(p) == 1 or len(self._edges(p)[0]) > 1
        return got

    def _edges(self, p: str) -> tuple[list[str], list[str]]:
        """What stands at the left and at the right edge of a piece while its characters are merged."""
        got = self.edges.get(p)
        if got is None:
            if len(p) == 1:
                got = [p], [p]
            else:
                parts = self.merged(p, 2)  # more than two of a piece that its own merges do not reach
                got = ([*self._edges(parts[0])[0], p], [*self._edges(parts[1])[1], p]) if len(parts) == 2 else ([p], [p])
            self.edges[p] = got
        return got

    def _fits(self, a: str, b: str) -> bool:
        """Whether a before b stay apart when their characters are merged together."""
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > 1 << PAIR_BITS:
                self.fits.clear()
            # Blank marks have pieces of equal score, of which the last does not come from the best two: merge those in full.
            got = self.merged(a + b) == [a, b] if BLANK * 2 in a + b else self._apart(self._edges(a)[1], self._edges(b)[0])
            self.fits[a, b] = got
        return got

    def _apart(self, left: list[str], right: list[str]) -> bool:
        """Whether no merge across the boundary comes before those that grow its two sides."""
        score, x, y = self.score, 0, 0
        while True:
            across = score.get(left[x] + right[y])
            grow_left = score[left[x + 1]] if x + 1 < len(left) else None
            grow_right = score[right[y + 1]] if y + 1 < len(right) else None
            if across is not None and (grow_left is None or across > grow_left) and (grow_right is None or across >= grow_right):
                return False
            if grow_left is None and grow_right is None:
                return True
            if grow_right is None or (grow_left is not None and grow_left >= grow_right):
                x += 1
            else:
                y += 1

    def _step(self, tail: str, i: int, nodes: dict) -> tuple[int, float]:
        """The surviving edge that ends at i: where it begins, and its path's score. tail: the characters before i."""
        best, end = None, len(tail)
        for n in range(min(self.longest, end), 0, -1):
            before = nodes.get(i - n)
            if before is None:
                continue
            p = tail[end - n :]
            score = self.score.get(p)
            if score is None:
                if n > 1:
                    continue
                score = self.worst  # a character without a piece
            if not self.bpe:
                if best is None or before[1] + score > best[1]:
                    best = i - n, before[1] + score
            elif self._whole(p) and (before[0] is None or self._fits(tail[end - n - (i - n - before[0]) : end - n], p)):
                return i - n, 0.0
        if best is None:
            raise ValueError(f"no path reaches {tail!r}")
        return best

    def _ids(self, piece: str) -> list[int]:
        got = self.id.get(piece)
        return [got] if got is not None else [self.byte.get(b, self.unknown) for b in piece.encode()]

    def stream(self, chars: Iterator[str]) -> Iterator[int]:
        """Ids of a stream of strings, committed as soon as all surviving paths agree."""
        kept: list[str] = []  # characters that are not committed, and those of the piece before them
        nodes: dict = {0: (None, 0.0)}
        at = done = i = 0
        look = 4 * self.longest
        for more in chars:
            for c in more:
                kept.append(c)
                i += 1
                nodes[i] = self._step("".join(kept[-2 * self.longest :]), i, nodes)
                if i - done >= look:
                    paths = {k for k in range(max(done, i - self.longest + 1), i + 1)}
                    while len(paths) > 1:  # the latest boundary that all paths of survivors pass
                        k = max(paths)
                        paths.discard(k)
                        paths.add(nodes[k][0] if k > done else done)
                    meet = paths.pop()
                    if meet > done:
                        yield from self._between(kept, at, nodes, done, meet)
                        keep = nodes[meet][0]  # the piece before the boundary decides what may follow
                        kept, at, done = kept[keep - at :], keep, meet
                        nodes = {k: v for k, v in nodes.items() if k >= meet}
                    # Where paths do not meet, the next look comes when twice as much is kept: looks stay cheap.
                    look = max(4 * self.longest, 2 * (i - done))
        yield from self._between(kept, at, nodes, done, i)

    def _between(self, kept: list[str], at: int, nodes: dict, begin: int, end: int) -> list[int]:
        out = []
        while end > begin:
            start = nodes[end][0]
            out.append(self._ids("".join(kept[start - at : end - at])))
            end = start
        return [x for part in reversed(out) for x in part]

    def encode(self, text: str | None) -> np.ndarray:
        ids = self.encode_column(pa.array([text], pa.string()))
        return ids.values.to_numpy(zero_copy_only=False)

    def encode_column(self, column: pa.Array) -> pa.ListArray:
        """The ids of every text of a column of strings."""
        parts = []
        for i, j, data, off in H.slices(column, PART_BYTES):
            raw = data.tobytes()
            if self.block is None or BLANK.encode() in raw:
                texts = [raw[a:b].decode() for a, b in zip(off[:-1], off[1:], strict=True)]
                ids = [self._one(" " + t if self.dummy else t) if t else [] for t in texts]
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                parts.append((off, np.array([x for one in ids for x in one], np.int32)))
            else:
                parts.append(self._part(data, off))
        ends = np.cumsum([0, *[len(p[1]) for p in parts]])
        offsets = np.concatenate([[0], *[p[0][1:] + e for p, e in zip(parts, ends, strict=False)]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *[p[1] for p in parts]])))

    def _one(self, text: str) -> list[int]:
        return [x for s in self.stretches(text) for x in self.stream([s.replace(" ", BLANK)])]

    def _part(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin, and all ids, of plain texts (bytes and offsets)."""
        full = off[:-1] < off[1:]
        if self.dummy:
            data = np.insert(data, off[:-1][full], 32)
            off = off + np.concatenate([[0], np.cumsum(full)])
        blank, apart = data == 32, self.apart[data]
        first = apart.copy()
        first[1:] |= blank[1:] & ~blank[:-1] | apart[:-1] & ~blank[1:]
        first[off[:-1][full]] = True
        start = np.flatnonzero(first)
        edges = pa.py_buffer(np.append(start, len(data)).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_string(), len(start), [None, edges, pa.py_buffer(data)]).dictionary_encode()
        ids = self._distinct(coded.dictionary).take(coded.indices)  # the ids of all stretches, one after the other
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(start) + 1] // 4
        return ends[np.searchsorted(start, off)], np.frombuffer(ids.buffers()[2] or b"", np.int32)[: ends[-1]]

    def _distinct(self, stretches: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of each of some distinct stretches, as bytes; those of the parts before are remembered."""
        known, known_ids = self.memo
        at = pc.index_in(stretches, value_set=known) if len(known) else pa.nulls(len(stretches), pa.int32())
        fresh = stretches.filter(at.is_null())
        found = self.block.search(fresh)
        place = at.to_numpy(zero_copy_only=False).copy() if at.null_count < len(at) else np.full(len(at), np.nan)
        new = np.isnan(place)
        place[new] = len(known) + np.arange(len(fresh))
        self.memo = (fresh, found) if len(known) + len(fresh) > REMEMBERED else (pa.concat_arrays([known, fresh]), pa.concat_arrays([known_ids, found]))
        return pa.concat_arrays([known_ids, found]).take(pa.array(place.astype(np.int64)))

    def decode_column(self, ids: pa.ListArray) -> pa.Array:
        """The text of every list of ids; a null list is an empty text."""
        off = ids.offsets.to_numpy()
        values = ids.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype(np.int64)
        off = (off - off[0]).astype(np.int64)
        if ids.null_count:
            return pa.array([self.decode(x.values.to_pylist()) if x.is_valid else "" for x in ids], pa.string())
        values[off[:-1][off[:-1] < off[1:]]] += len(self.bytes)
        texts = self.plain.take(pa.array(values))
        ends = np.frombuffer(texts.buffers()[1], np.int64)[: len(values) + 1]
        whole = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends[off]), texts.buffers()[2]])
        try:
            return whole.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # byte pieces that are no UTF-8
            return pa.array([b.as_py().decode("utf-8", "replace") for b in whole], pa.string())

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.dummy and text.startswith(" ") else text


class Block:
    """The search of a BPE model over many stretches at once: node i of all of them, then node i + 1.

    Everything is looked up by exact keys: trie steps by (state, character), merges by (left piece, right piece)."""

    def __init__(self, codec: Codec):
        self.codec = codec
        steps, accept = {}, [-1]
        for p, i in codec.id.items():
            state = 0
            for c in p:
                key = state << 21 | ord(c)
                state = steps.setdefault(key, len(accept))
                if state == len(accept):
                    accept.append(-1)
            if codec._whole(p):
                accept[state] = i
        self.steps = Lookup(steps)
        self.accept = np.array(accept)
        names, ids = codec.names, codec.id
        depth = 1 + max(max(map(len, codec._edges(p))) for p in ids)
        self.score = np.full(len(names) + 1, -np.inf)
        self.left, self.right = (np.full((len(names), depth), len(names)) for _ in range(2))  # the last place stands for none
        merges = {}
        for p, i in ids.items():
            self.score[i] = codec.score[p]
            for table, edge in zip((self.left, self.right), codec._edges(p), strict=True):
                table[i, : len(edge)] = [ids[x] for x in edge]
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    merges[ids[p[:k]] << 32 | ids[p[k:]]] = i
        self.merges = Lookup(merges)
        self.names = names
        self.double = np.array([BLANK * 2 in p for p in names])
        self.begins, self.ends = (np.array([f(p, BLANK) for p in names]) for f in (str.startswith, str.endswith))
        self.seen, self.fit = np.full(1 << PAIR_BITS, -1), np.zeros(1 << PAIR_BITS, bool)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a before b stay apart when their characters are merged together."""
        key = a << 32 | b
        spot = (H.mix(key.view(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.fit[spot]
        new = np.flatnonzero(self.seen[spot] != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            got = self._apart(keys >> 32, keys & (2**32 - 1))
            out[new] = got[back]
            self.seen[spot[new]], self.fit[spot[new]] = key[new], out[new]
            self.fit[spot[new]] = got[np.searchsorted(keys, self.seen[spot[new]])]  # of two keys at one spot the last is there
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        blanks = self.double[a] | self.double[b] | (self.ends[a] & self.begins[b])
        for k in np.flatnonzero(blanks):
            out[k] = self.codec._fits(self.names[a[k]], self.names[b[k]])
        on = np.flatnonzero(~blanks)
        x, y = np.zeros(len(on), np.int64), np.zeros(len(on), np.int64)
        while len(on):
            l, r = a[on], b[on]
            across = self.score[self.merges.get(self.right[l, x] << 32 | self.left[r, y], len(self.names))]
            grow_l, grow_r = self.score[self.right[l, x + 1]], self.score[self.left[r, y + 1]]
            joined = (across > grow_l) & (across >= grow_r) & (across > -np.inf)
            out[on[joined]] = False
            more = ~joined & (np.maximum(grow_l, grow_r) > -np.inf)
            go = grow_l[more] >= grow_r[more]
            on, x, y = on[more], x[more] + go, y[more] + ~go
        return out

    def search(self, stretches: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of each stretch as bytes."""
        n_chars = pc.utf8_length(stretches).to_numpy(zero_copy_only=False)
        order = np.argsort(-n_chars, kind="stable")
        out: list = [b""] * len(order)
        i = int(np.searchsorted(-n_chars[order], -BLOCK_CHARS))
        alone = order[:i].tolist()
        sizes, flats, rows = [], [], []
        while i < len(order):
            j = min(len(order), i + max(1, BLOCK_CELLS // (int(n_chars[order[i]]) + 1)))
            size, flat, odd = self._columns(stretches.take(pa.array(order[i:j])), n_chars[order[i:j]])
            alone += order[i:j][odd].tolist()
            sizes.append(size)
            flats.append(flat)
            rows.append(order[i:j])
            i = j
        size = np.concatenate([np.zeros(0, np.int64), *sizes])
        edges = np.concatenate([[0], np.cumsum(size)]) * 4
        flat = np.concatenate([np.zeros(0, np.int32), *flats])
        many = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(flat)])
        few = [np.array(list(self.codec.stream([stretches[k].as_py().replace(" ", BLANK)])), np.int32).tobytes() for k in alone]
        place = np.zeros(len(order), np.int64)
        if rows:
            place[np.concatenate(rows)] = np.arange(len(size))
        place[alone] = len(size) + np.arange(len(alone))
        return pa.concat_arrays([many, pa.array(few, pa.large_binary())]).take(pa.array(place))

    def _columns(self, stretches: pa.LargeStringArray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many ids each stretch has, all ids, and which stretches hold characters without a piece (their ids do not count).
        Longest stretches first."""
        rows, width, most = len(length), int(length[0]), self.codec.longest
        edges = np.frombuffer(stretches.buffers()[1], np.int64)[stretches.offset : stretches.offset + rows + 1]
        text = stretches.buffers()[2].to_pybytes()[edges[0] : edges[-1]].decode().replace(" ", BLANK)
        row = np.repeat(np.arange(rows), length)
        begin = np.cumsum(length) - length
        chars = np.zeros((rows, width + most), np.int64)
        chars[row, np.arange(len(row)) - begin[row]] = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        edge = np.full((width + 1, most, rows), -1, np.int32)  # the piece that ends at a boundary, by its length
        at = np.arange(len(row)) - begin[row]
        state, left = np.zeros(len(row), np.int64), length[row] - at
        for n in range(most):
            state = self.steps.get(state << 21 | chars[row, at + n], -1)
            on = np.flatnonzero(state >= 0)
            row, at, state, left = row[on], at[on], state[on], left[on]
            edge[at + n + 1, n, row] = self.accept[state]
            on = np.flatnonzero(left > n + 1)
            row, at, state, left = row[on], at[on], state[on], left[on]
            if not len(row):
                break
        last, size = np.full((width + 1, rows), -1), np.zeros((width + 1, rows), np.int64)
        odd = np.zeros(rows, bool)
        for i in range(1, width + 1):
            open_ = np.flatnonzero(~odd[: int(np.searchsorted(-length, -i, side="right"))])
            for n in range(min(most, i), 0, -1):
                p = edge[i, n - 1, open_].astype(np.int64)
                there = np.flatnonzero(p >= 0)
                if not len(there):
                    continue
                if n < i:
                    there = there[self.fits(last[i - n, open_[there]], p[there])]
                r = open_[there]
                last[i, r], size[i, r] = p[there], n
                open_ = np.delete(open_, there)
                if not len(open_):
                    break
            odd[open_] = True
        keep, count = np.flatnonzero(~odd), np.zeros(rows, np.int64)
        end, found = length[keep].copy(), []
        while len(keep):  # back along the paths, a piece of every stretch at a time
            found.append((keep, last[end, keep]))
            count[keep] += 1
            end = end - size[end, keep]
            keep, end = keep[end > 0], end[end > 0]
        first = np.cumsum(count)
        flat = np.zeros(int(count.sum()), np.int32)
        for k, (r, p) in enumerate(found):
            flat[first[r] - 1 - k] = p
        return count, flat, odd


def codec(model: dict) -> Codec:
    """One for each worker process, with what it remembers."""
    if _kept.get("name") != model["name"]:
        _kept.update(name=model["name"], codec=Codec(model))
    return _kept["codec"]


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about PART_BYTES of text (the last column), or of one longer text."""
    for batch in batches:
        for i, j, _, _ in H.slices(batch.column(batch.num_columns - 1), PART_BYTES):
            yield batch.slice(i, j - i)


def _encode(model: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = codec(model)
    for part in _parts(batches):
        yield _with(part, "ids", c.encode_column(part.column(part.num_columns - 1)))


def _decode(model: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = codec(model)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], c.decode_column(batch.column(batch.num_columns - 1))], [*batch.schema.names[:-1], "decoded"])


def encode(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, text, ids of every row of docs (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(partial(_encode, model), "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, model: dict) -> DataFrame:
    """doc_id, decoded of every row of encoded (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, model), "doc_id long, decoded string")


def round_trip(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_ids, ids, decoded_sha256, exact: encoded and decoded again in the same task."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for part in _encode(model, batches):
            yield _with(part, "decoded", c.decode_column(part.column(2)))

    made = docs.select("doc_id", "text").mapInArrow(both, "doc_id long, text string, ids array<int>, decoded string")
    plain = F.translate(F.coalesce("text", F.lit("")), BLANK, " ")
    same = F.when(F.contains("text", F.lit(BLANK)), F.col("decoded") == plain).otherwise(F.col("decoded") == F.coalesce("text", F.lit("")))
    return made.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), F.coalesce(same, F.col("decoded") == "").alias("exact")
    )


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(C.documents_only(C.table(spark, sf_dir, "documents")), load())
