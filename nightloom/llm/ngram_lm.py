"""N-gram language model in an Elias-Fano trie, over words and an end token.

Level 1 holds the words' 64-bit hashes, ascending, so that a word's rank is its id, and their counts. A level above
holds the n-grams seen at least `prune` times (1 keeps all), by context: the entries of the level below are its contexts,
in the order of their ranks. Its pointers and its values are monotone sequences, in which each context's followers stand
above the last value of the context before; both are Elias-Fano coded, and a follower is found by a successor search
from its context's base. Level 2 names a follower by its word id; level 3 and those above name it by the rank of the
n-gram without its first word among the followers of that one's context, which is a small number. Each entry has its
smoothed probability in 8 bits, each context its back-off weight. The levels are cut into shards by ranges of
contexts, written by the tasks that make them, and memory-mapped where texts are scored; only their names and sizes
reach the driver. Keys of counts are pairs of 64-bit numbers at any size.

The model: P(w | c) = (n(c, w) - d) / n(c) + b(c) P(w | c') for kept n-grams and b(c) P(w | c') for others, c' being c
without its first word and b(c) what the kept ones leave over, so that the probabilities of all words after c sum to 1
(but for the 8 bits). P(w) = (n(w) + 0.1) / (N + 0.1 (V + 1)), the 1 standing for any unknown word.

Defined results: a null text is empty and has one token, the end; without training texts N and V are 0 and all
tokens are unknown; rows that share a doc_id are scored each by its own text; a null doc_id counts as an empty id in
the fold; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.llm import common as C
from nightloom.llm import mapped
from nightloom.llm import wordhash as H
from nightloom.llm.elias_fano import EliasFano

#: The hash of a text's end, which no word has but by chance.
END = np.uint64(0x0123456789ABCDEF)
ADD, DISCOUNT, PRUNE, ORDER = 0.1, 0.75, 2, 3
#: Words a shard of level 1 and entries a shard of a level above, about, and shards of such a level at least.
SHARD_WORDS, SHARD_ENTRIES, LEAST_SHARDS = 500_000, 500_000, 16
#: Bytes of text whose n-grams are looked up together.
PART_BYTES = 1 << 22
#: Distinct keys that a task holds before it sends them on.
HELD_KEYS = 3_000_000


def _tokens(words: H.Words) -> tuple[np.ndarray, np.ndarray]:
    """Every text's word hashes and its end, in order, and where each text begins."""
    at = words.text_at[1:]
    return np.insert(words.hash, at, END), words.text_at + np.arange(len(words.text_at))


def _counted(c: np.ndarray, w: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (c, w) in order, and their counts. Small numbers are sorted as one key."""
    packed = not len(c) or (int(c.max()) < 2**31 and int(w.max()) < 2**32 and int(w.min()) >= 0)
    if packed and n is None:
        key, n = np.unique(c << 32 | w, return_counts=True)
        return key >> 32, key & (2**32 - 1), n
    order = np.argsort(c << 32 | w, kind="stable") if packed else np.lexsort((w, c))
    c, w, n = c[order], w[order], n[order] if n is not None else np.ones(len(c), np.int64)
    new = np.flatnonzero(np.concatenate([np.ones(min(len(c), 1), bool), (c[1:] != c[:-1]) | (w[1:] != w[:-1])]))
    return c[new], w[new], np.add.reduceat(n, new) if len(new) else n


class _Tally:
    """Counts of pairs (c, w), merged as they come and sent on when there are many."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.sorted = 0

    def add(self, c: np.ndarray, w: np.ndarray) -> None:
        self.parts.append(_counted(c, w))
        self.size += len(self.parts[-1][0])

    def full(self) -> bool:
        if self.size > max(HELD_KEYS, 2 * self.sorted):
            self.merge()
        return self.size > HELD_KEYS

    def merge(self) -> None:
        if len(self.parts) > 1:
            self.parts = [_counted(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        self.size = self.sorted = sum(len(p[0]) for p in self.parts)

    def send(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for part in self.parts:
            for i in range(0, len(part[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in part], ["c", "w", "n"])
        self.__init__()


COUNTS = "c long, w long, n long"


def _tally(keys_of):
    """A task that counts keys_of(tokens, at) over the texts in its first column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, keys = _Tally(), keys_of()
        for batch in batches:
            for _, _, data, off in H.slices(batch.column(0), PART_BYTES):
                tally.add(*keys(*_tokens(H.Words(data, off))))
                if tally.full():
                    yield from tally.send()
        yield from tally.send()

    return count


class Vocabulary:
    """Level 1: shards by the first `bits` bits of the hash."""

    def __init__(self, uris: list[str], first: list[int], bits: int):
        self.first, self.bits = np.array(first, np.int64), bits
        self.shards = []
        for uri in uris:
            arrays = mapped.read(uri) if uri else None
            self.shards.append((EliasFano.decode(arrays[:4]), arrays[4]) if arrays else None)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1 where unknown) and counts of hashes in ascending order."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cut = np.searchsorted(hashes, np.arange(1, len(self.shards), dtype=np.uint64) << np.uint64(64 - self.bits)) if self.bits else np.zeros(0, int)
        edges = [0, *cut.tolist(), len(hashes)]
        for s, shard in enumerate(self.shards):
            if shard and edges[s] < edges[s + 1]:
                part = slice(edges[s], edges[s + 1])
                x = hashes[part]
                rank, found = shard[0].successor(x - (np.uint64(s) << np.uint64(64 - self.bits)) if self.bits else x)
                ids[part] = np.where(found, rank + self.first[s], -1)
                counts[part] = np.where(found, shard[1][np.minimum(rank, len(shard[1]) - 1)], 0)
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """The counts of known ids; only the shards that hold them are touched."""
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.first, ids, side="right") - 1  # of shards that begin alike the last is not empty
        for s in np.unique(shard):
            here = shard == s
            out[here] = self.shards[s][1][ids[here] - self.first[s]]
        return out


def _quantise(values: np.ndarray, levels: int = 255) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and their codebook (means of bins of equal size); code 255 is 0."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(256)
    edges = np.unique(np.quantile(values, np.linspace(0, 1, levels + 1)[1:-1]))
    code = np.searchsorted(edges, values, side="left")
    n = np.bincount(code, minlength=256)
    book = np.bincount(code, values, minlength=256) / np.maximum(n, 1)
    book[255] = 0.0
    return code.astype(np.uint8), book


def _log_p1(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    return np.log10((counts + ADD) / (n + ADD * (v + 1)))


class Followers:
    """Level 2 or above: shards by ranges of context ids."""

    def __init__(self, level: dict):
        self.step, self.shards, self.first = level["step"], [], np.array(level["first"], np.int64)
        for uri in level["uris"]:
            a = mapped.read(uri) if uri else None
            self.shards.append((EliasFano.decode(a[:4]), EliasFano.decode(a[4:8]), *a[8:]) if a else None)

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For pairs ordered by context id: the entry (-1 where none is kept), its log10 probability, log10 of the
        context's back-off, and the context's first entry. A word of -1 is in no entry."""
        n = len(word)
        entry, p, back, origin = np.full(n, -1, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        edges = np.searchsorted(context, np.arange(len(self.shards) + 1) * self.step)
        edges[-1] = n
        for s, shard in enumerate(self.shards):
            a, b = edges[s], edges[s + 1]
            if not shard or a == b:
                continue
            pointers, values, codes, book, back_codes, back_book, _ = shard
            c, inv = np.unique(context[a:b] - s * self.step, return_inverse=True)
            begin, end = pointers.access(c).astype(np.int64), pointers.access(c + 1).astype(np.int64)
            base = np.zeros(len(c), np.int64)
            later = begin > 0
            base[later] = values.access(begin[later] - 1).astype(np.int64) + 1
            back[a:b] = back_book[back_codes[c]][inv]
            origin[a:b] = (self.first[s] + begin)[inv]
            ask = np.flatnonzero((end > begin)[inv] & (word[a:b] >= 0))
            rank, found = values.successor((base[inv[ask]] + word[a:b][ask]).astype(np.uint64))
            found &= rank < end[inv[ask]]
            hit = a + ask[found]
            entry[hit] = self.first[s] + rank[found]
            p[hit] = book[codes[rank[found]]]
        return entry, p, back, origin

    def _at(self, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
        shard = np.searchsorted(self.first, entries, side="right") - 1
        for s in np.unique(shard):
            here = np.flatnonzero(shard == s)
            yield here, entries[here] - self.first[s], self.shards[s]

    def counts(self, entries: np.ndarray) -> np.ndarray:
        out = np.zeros(len(entries), np.int64)
        for here, rank, shard in self._at(entries):
            out[here] = shard[6][rank]
        return out

    def place_and_p(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each entry's rank among the followers of its context, and its log10 probability."""
        place, p = np.zeros(len(entries), np.int64), np.zeros(len(entries))
        for here, rank, shard in self._at(entries):
            context = shard[0].successor((rank + 1).astype(np.uint64))[0] - 1
            place[here] = rank - shard[0].access(context).astype(np.int64)
            p[here] = shard[3][shard[2][rank]]
        return place, p


class Trie:
    """All levels of a model, as far as it is built."""

    def __init__(self, model: dict):
        self.n, self.v = model["n"], model["v"]
        self.vocabulary = Vocabulary(model["level1"], model["first"], model["bits"]) if self.v else None
        self.above = [Followers(level) for level in model.get("above", [])]

    def walk(self, tokens: np.ndarray, at: np.ndarray) -> dict:
        """For each token: its word id (-1 where unknown), count, log10 P of the longest kept context (`p`) and of the word
        alone (`p1`); at the highest level the context's entry and the entry of the n-gram without its first word."""
        u, inv = np.unique(tokens, return_inverse=True)
        ids, counts = self.vocabulary.find(u) if self.v else (np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64))
        p1 = _log_p1(counts, self.n, self.v)[inv] if self.v else np.zeros(len(tokens))
        entry, p = ids[inv], p1.copy()
        out = {"count": counts[inv], "p1": p1}
        origin = np.zeros(len(tokens), np.int64)
        starts = at[:-1]
        context = _before(entry, starts, self.v)
        for level in self.above:
            # An n-gram is kept only where the one without its first word is, so the place among that one's followers names it.
            word = np.where(entry >= 0, entry - origin, -1)
            ask = np.flatnonzero(context >= 0)
            c, w = context[ask], word[ask]
            small = not len(c) or max(int(c.max()), int(w.max())) < 2**31 - 1
            order = np.argsort(c << 32 | (w + 1)) if small else np.lexsort((w, c))
            c, w = c[order], w[order]
            new = np.flatnonzero(np.concatenate([np.ones(min(len(c), 1), bool), (c[1:] != c[:-1]) | (w[1:] != w[:-1])]))
            found = level.find(c[new], w[new])
            back_at = np.empty(len(ask), np.int64)
            back_at[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(c))))
            e, lp, back, first = (x[back_at] for x in found)
            p[ask] = np.where(e >= 0, lp, back + p[ask])
            entry, origin = np.full(len(tokens), -1, np.int64), np.zeros(len(tokens), np.int64)
            entry[ask], origin[ask] = e, first
            context = _before(entry, starts, -1)
        return out | {"p": p, "entry": entry, "context": context}


def _before(x: np.ndarray, starts: np.ndarray, first: int) -> np.ndarray:
    """The value of the token before; `first` for the first of a text."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = first
    return out


def train(docs: DataFrame, prune: int = PRUNE, order: int = ORDER) -> dict:
    """Builds the trie from the texts of docs and returns the names of its files. docs: doc_id, text."""
    spark = docs.sparkSession
    path = C.shared_dir(spark)
    texts = docs.select("text")
    words = texts.mapInArrow(_tally(lambda: lambda tokens, at: (np.zeros(len(tokens), np.int64), tokens.view(np.int64))), COUNTS)
    words = C.stored(words.groupBy(F.col("w").alias("key")).agg(F.sum("n").alias("n")), f"{path}/words")
    v, n = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not v:
        return {"n": 0, "v": 0}
    n_texts = words.where(F.col("key") == int(END.view(np.int64))).first()["n"]
    bits = max(3, int(np.ceil(np.log2(max(1, v / SHARD_WORDS)))))

    def level1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        shard, key, count = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in parts]) for k in range(3))
        key = key.view(np.uint64)
        for s in np.unique(shard):
            h, c = key[shard == s], count[shard == s]
            order = np.argsort(h)
            uri = f"{path}/level-1/shard-{s:05d}"
            mapped.write(uri, [*EliasFano.encode(h[order] - (np.uint64(s) << np.uint64(64 - bits)), 1 << (64 - bits)).arrays(), c[order].astype(np.uint32 if c.max() < 2**32 else np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([len(h)], pa.int64()), pa.array([uri])], ["shard", "n", "uri"])

    cut = words.select(F.shiftrightunsigned("key", 64 - bits).cast("int").alias("shard"), "key", "n").repartition(2**bits, "shard")
    made = {r.shard: r for r in cut.mapInArrow(level1, "shard int, n long, uri string").collect()}  # a row a shard
    sizes = [made[s].n if s in made else 0 for s in range(2**bits)]
    model = {"n": int(n), "v": int(v), "bits": bits, "first": [0, *np.cumsum(sizes).tolist()][:-1], "level1": [made[s].uri if s in made else "" for s in range(2**bits)], "above": []}

    contexts = v + 1  # the id v stands for the beginning of a text
    for k in range(2, order + 1):
        level = _level(k, model, texts, contexts, prune, n_texts, path)
        if not level["entries"]:
            break
        model["above"].append(level)
        contexts = level["entries"]
    C.keep_only(spark, path, *(f"level-{k}" for k in range(1, order + 1)))
    return model


def _level(k: int, model: dict, texts: DataFrame, contexts: int, prune: int, n_texts: int, path: str) -> dict:
    """Counts and writes the k-th level over the levels below it."""

    def keys_of():
        trie = Trie(model)

        def keys(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found = trie.walk(tokens, at)
            if k == 2:
                word = np.where(found["count"] >= prune, found["entry"], -1)
                context = _before(word, at[:-1], trie.v)
            else:
                word, context = found["entry"], found["context"]
            good = np.flatnonzero((word >= 0) & (context >= 0))
            return context[good], word[good]

        return keys

    counts = texts.mapInArrow(_tally(keys_of), COUNTS).groupBy("c", "w").agg(F.sum("n").alias("n")).where(F.col("n") >= prune)
    counts = C.stored(counts, f"{path}/counts-{k}")
    entries = counts.count()
    if not entries:
        return {"entries": 0}
    shards = max(LEAST_SHARDS, -(-entries // SHARD_ENTRIES))
    step = -(-contexts // shards)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        trie = Trie(model)
        shard, cs, ws, ns = (np.concatenate([b.column(j).to_numpy(zero_copy_only=False) for b in parts]) for j in range(4))
        for s in np.unique(shard):
            here = np.flatnonzero(shard == s)
            here = here[np.lexsort((ws[here], cs[here]))]
            context, word, m = cs[here] - s * step, ws[here], ns[here]
            width = min(step, contexts - s * step)
            used, inv = np.unique(context, return_inverse=True)
            if k == 2:
                of_used = np.full(len(used), n_texts)
                inner = used + s * step < trie.v
                of_used[inner] = trie.vocabulary.counts(used[inner] + s * step)
                lower = _log_p1(trie.vocabulary.counts(word), trie.n, trie.v)
            else:
                of_used = trie.above[-1].counts(used + s * step)
                word, lower = trie.above[-1].place_and_p(word)
            took = np.bincount(inv, m - DISCOUNT)
            back = np.maximum(1 - took / of_used, 1e-9)
            p = (m - DISCOUNT) / of_used[inv] + back[inv] * 10**lower
            pointers = np.concatenate([[0], np.cumsum(np.bincount(context, minlength=width))])
            base = np.zeros(len(used), np.int64)
            base[1:] = np.cumsum(word[pointers[used[1:]] - 1] + 1)
            values = word + base[inv]
            codes, book = _quantise(np.log10(p))
            back_codes = np.full(width, 255, np.uint8)
            back_codes[used], back_book = _quantise(np.log10(back))
            uri = f"{path}/level-{k}/shard-{s:05d}"
            small = np.uint32 if m.max() < 2**32 else np.uint64
            mapped.write(uri, [*EliasFano.encode(pointers, int(pointers[-1]) + 1).arrays(), *EliasFano.encode(values, int(values[-1]) + 1).arrays(), codes, book, back_codes, back_book, m.astype(small)])
            yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([len(m)], pa.int64()), pa.array([uri])], ["shard", "n", "uri"])

    cut = counts.select((F.col("c") / step).cast("int").alias("shard"), "c", "w", "n").repartition(shards, "shard")
    made = {r.shard: r for r in cut.mapInArrow(write, "shard int, n long, uri string").collect()}  # a row a shard
    sizes = [made[s].n if s in made else 0 for s in range(shards)]
    return {"entries": entries, "step": step, "first": [0, *np.cumsum(sizes).tolist()][:-1], "uris": [made[s].uri if s in made else "" for s in range(shards)]}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of docs (doc_id, text)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model)
        for batch in batches:
            for i, j, data, off in H.slices(batch.column(1), PART_BYTES):
                tokens, at = _tokens(H.Words(data, off))
                got = trie.walk(tokens, at)
                total = lambda x, at=at: np.add.reduceat(x, at[:-1])  # noqa: E731  every text has its end, so none is empty
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(total((got["count"] > 0).astype(np.int64))), pa.array(total(got["p1"])), pa.array(total(got["p"]))],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op10_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents_only(C.table(spark, sf_dir, "documents"))
    model = train(docs.where(C.fold(F.col("doc_id"), 10) != 0))
    return score(docs, model).select(
        "doc_id", (C.fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"), "base_score", "score"
    )
