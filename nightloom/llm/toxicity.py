"""Toxicity by nearest labelled examples under exact TF-IDF cosine, through a block-max inverted index.

Terms are words and their beginnings (4, 5, 6 and 8 bytes), hashed: all that at least two documents of a bounded
sample of labelled documents hold. A term's weight in a text is (1 + log count) x idf x lean. Its idf comes from its
document frequency over all documents; its lean is how far its share among toxic examples stands from that among others,
in standard deviations, so that two texts are near each other for what bears on the label and not for their topic.
Texts and examples are unit vectors of these weights. The index has, for each term, postings by example, and its largest
weight in each block of examples. A text's dearest terms (long lists, little weight) are left out at first; an example
whose sum and its block's bound for what was left out cannot reach the k-th best sum is out, and the others' cosines are
computed in full: the neighbours are exact. Votes weighted by cosine, and the nearest toxic example's cosine, become a
score through a logistic regression on labelled documents outside the index.

Defined results: a text without any such term (null and empty ones too) has no neighbours and gets the score that
the calibration gives to none; without labels of both classes every score is the share of label 1 (0 without any);
ties of cosine go to the smaller doc_id; rows that share a doc_id are scored each by its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.llm import common as C
from nightloom.llm import samples as S
from nightloom.llm import wordhash as H

#: The bound of the labelled sample, documents a class.
DOCS_A_CLASS = 1000
BEGINNINGS = (4, 5, 6, 8)
BLOCK, NEAREST = 128, 8
#: The share of a text's whole bound that its dearest terms, left out at first, may hold.
LEFT_OUT = 0.02


def _terms(words: H.Words) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of a slice and the text of each: every word once, and each beginning that is shorter than it."""
    of, length = words.text_of(), words.end - words.start
    h, t = [words.hash], [of]
    for n in BEGINNINGS:
        longer = length > n
        h.append(words.prefix_hash(n)[longer])
        t.append(of[longer])
    return np.concatenate(h), np.concatenate(t)


def _known_terms(vocabulary: np.ndarray, words: H.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term (index into the sorted vocabulary), text and count of each distinct pair of a slice, ordered by text.
    A word's terms are looked up once for all its places."""
    u, first, inv = np.unique(words.hash, return_index=True, return_inverse=True)
    one = object.__new__(H.Words)
    one.start, one.end, one.low, one.lanes = words.start[first], words.end[first], words.low, words.lanes
    length = one.end - one.start
    at, word = _chosen(vocabulary, np.concatenate([u, *[one.prefix_hash(n)[length > n] for n in BEGINNINGS]]), np.concatenate([np.arange(len(u)), *[np.flatnonzero(length > n) for n in BEGINNINGS]]))
    order = np.argsort(word, kind="stable")
    at, edges = at[order], np.searchsorted(word[order], np.arange(len(u) + 1))
    n = np.diff(edges)[inv]
    place = np.repeat(edges[inv] - np.cumsum(n) + n, n) + np.arange(n.sum())
    key = np.repeat(words.text_of(), n) * len(vocabulary) + at[place]
    key.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
    return key[first] % len(vocabulary), key[first] // len(vocabulary), np.diff(np.append(first, len(key)))


def _counts(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """term, text, count of each distinct pair, ordered by text."""
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return h[at], of[at], np.diff(np.append(at, len(h)))


def _chosen(vocabulary: np.ndarray, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into the sorted vocabulary of the terms that are in it, and the text of each."""
    at = np.searchsorted(vocabulary, h)
    at[at == len(vocabulary)] = 0
    good = vocabulary[at] == h
    return at[good], of[good]


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, label, text -> term, label, n: in how many documents of a slice each term stands."""
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for i, j, data, off in H.slices(batch.column(2)):
            h, of, _ = _counts(*_terms(H.Words(data, off)))
            for y in (0, 1):
                u, n = np.unique(h[label[i:j][of] == y], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.full(len(u), y, np.int32)), pa.array(n)], ["term", "label", "n"])


def _frequencies(vocabulary: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for i, j, data, off in H.slices(batch.column(0)):
                at, _, _ = _known_terms(vocabulary, H.Words(data, off))
                df += np.bincount(at, minlength=len(df))
                n += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(df)), -1)), pa.array(np.append(df, n))], ["term", "n"])

    return count


class BlockMax:
    """Examples' unit vectors as postings by term, with each term's largest weight in each block of examples."""

    def __init__(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]], n_terms: int):
        # Alike vectors share blocks, so bounds are sharp: by the term of the largest weight.
        examples = sorted(examples, key=lambda e: (e[1], int(e[2][np.argmax(e[3])]), e[0]))
        self.ids = np.array([e[0] for e in examples], np.int64)
        self.label = np.array([e[1] for e in examples], np.int64)
        n = len(examples)
        size = [len(e[2]) for e in examples]
        self.terms = np.concatenate([e[2] for e in examples] or [np.zeros(0, int)])
        self.weights = np.concatenate([e[3] for e in examples] or [np.zeros(0)])
        self.edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)  # example by example
        example = np.repeat(np.arange(n), size)
        order = np.lexsort((example, self.terms))
        self.example, self.weight = example[order], self.weights[order]
        self.start = np.searchsorted(self.terms[order], np.arange(n_terms + 1))  # term by term
        self.block = np.arange(n) // BLOCK
        self.most = np.zeros((n_terms, -(-n // BLOCK)))
        np.maximum.at(self.most, (self.terms, self.block[example]), self.weights)
        self.full = np.zeros(n_terms)

    def nearest(self, terms: np.ndarray, weight: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """Ordinals and cosines of the k best examples with a cosine above 0."""
        none = np.zeros(0, int), np.zeros(0)
        length = self.start[terms + 1] - self.start[terms]
        used = np.flatnonzero(length)
        if not len(used):
            return none
        terms, weight, length = terms[used], weight[used], length[used]
        bound = weight[:, None] * self.most[terms]
        high = bound.max(axis=1)
        order = np.argsort(high / length, kind="stable")
        out = order[np.cumsum(high[order]) <= LEFT_OUT * high.sum()]
        kept = np.delete(np.arange(len(terms)), out)
        n = length[kept]
        at = np.repeat(self.start[terms[kept]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        sums = np.bincount(self.example[at], np.repeat(weight[kept], n) * self.weight[at], minlength=len(self.ids))
        least = np.partition(sums, -k)[-k] if len(sums) > k else 0.0
        reach = sums + bound[out].sum(axis=0)[self.block]
        some = np.flatnonzero((reach >= least - 1e-9) & (reach > 0))
        if not len(some):
            return none
        self.full[terms] = weight
        n = self.edge[some + 1] - self.edge[some]
        ends = np.cumsum(n)
        at = np.repeat(self.edge[some] - ends + n, n) + np.arange(ends[-1])
        score = np.add.reduceat(self.full[self.terms[at]] * self.weights[at], ends - n)
        self.full[terms] = 0
        some, score = some[score > 0], score[score > 0]
        order = np.lexsort((self.ids[some], -np.round(score, 9)))[:k]
        return some[order], score[order]


def _vectors(vocabulary: np.ndarray, weight: np.ndarray, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, terms and unit weights of every text that has terms of any weight."""
    for i, j, data, off in H.slices(column):
        at, of, n = _known_terms(vocabulary, H.Words(data, off))
        w = (1 + np.log(n)) * weight[at]
        norm = np.sqrt(np.bincount(of, w * w, minlength=j - i))
        w = w / np.maximum(norm, 1e-300)[of]
        edges = np.searchsorted(of, np.arange(j - i + 1))
        for r in np.flatnonzero(norm > 0):
            s = slice(edges[r], edges[r + 1])
            yield i + int(r), at[s], w[s]


def _voter(model: dict, n_kept: int):
    """Adds votes to the first n_kept columns; the text is the last column."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model["index"]
        seen: dict[bytes, tuple] = {}  # copies are looked up once
        for batch in batches:
            got = np.zeros((3, batch.num_rows))
            evidence: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for r, terms, weight in _vectors(model["terms"], model["weight"], batch.column(batch.num_columns - 1)):
                key = hashlib.blake2b(terms.tobytes() + weight.tobytes(), digest_size=16).digest()
                if key not in seen:
                    if len(seen) > 50_000:
                        seen.clear()
                    near, cosine = index.nearest(terms, weight)
                    y = index.label[near]
                    seen[key] = (float((cosine * y).sum() / cosine.sum()) if len(near) else 0.0, float(max(cosine[y == 1], default=0.0)), 1.0 if len(near) else 0.0, index.ids[near].tolist())
                got[:, r], evidence[r] = seen[key][:3], seen[key][3]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_kept], *(pa.array(x) for x in got), pa.array(evidence, pa.list_(pa.int64()))],
                [*batch.schema.names[:n_kept], "vote", "nearest", "any", "evidence"],
            )

    return vote


VOTES = "vote double, nearest double, any double, evidence array<long>"


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Terms, index and calibration; docs: doc_id, text (all documents: frequencies are counted over them)."""
    chosen, counts = S.sample_by_class(S.labelled(labels, "toxic"), DOCS_A_CLASS)
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    none = {"share": share}
    if len(counts) < 2:
        return none
    # At most a few thousand ids and their texts, see sample_by_class.
    rows = C.stored(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text"), f"{C.shared_dir(docs.sparkSession)}/sample")
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return none
    by_term = rows.mapInArrow(_presence, "term long, label int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).cast("double").alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).cast("double").alias("b")
    )
    # The sample is bounded, so its distinct terms are.
    top = by_term.where("a + b > 1").toPandas().sort_values("term", key=lambda t: t.to_numpy().view(np.uint64))
    vocabulary, a, b = top["term"].to_numpy(np.int64).view(np.uint64), top["a"].to_numpy(), top["b"].to_numpy()
    if not len(vocabulary):
        return none
    share_of = (a + b) / (n[0] + n[1])
    lean = np.abs(a / n[1] - b / n[0]) / np.sqrt(share_of * (1 - share_of) * (1 / n[1] + 1 / n[0]) + 1e-12)
    df = np.zeros(len(vocabulary) + 1)
    for r in docs.select("text").mapInArrow(_frequencies(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():  # a row a term
        df[r.term] = r.n  # the number of documents comes last, as term -1
    weight = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * lean

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, terms, w in _vectors(vocabulary, weight, batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), batch.column(1).slice(r, 1), pa.array([terms.tobytes()]), pa.array([w.tobytes()])], ["doc_id", "label", "terms", "weights"])

    indexed = rows.where(F.pmod("doc_id", F.lit(3)) != 0).mapInArrow(vector, "doc_id long, label int, terms binary, weights binary").collect()  # the bounded sample
    examples = [(r.doc_id, r.label, np.frombuffer(r.terms, np.int64), np.frombuffer(r.weights)) for r in indexed]
    model = {"share": share, "terms": vocabulary, "weight": weight, "index": BlockMax(examples, len(vocabulary))}
    got = rows.where(F.pmod("doc_id", F.lit(3)) == 0).mapInArrow(_voter(model, 2), f"doc_id long, label int, {VOTES}").collect()
    got.sort(key=lambda r: (r.doc_id, r.vote))
    y = np.array([r.label for r in got])
    if len(set(y.tolist())) < 2:
        return none
    w = np.where(y == 1, share / max((y == 1).mean(), 1e-9), (1 - share) / max((y == 0).mean(), 1e-9))
    return model | {"logit": S.logistic(np.array([[r.vote, r.nearest, r.any] for r in got]), y, w, ridge=1e-2)}


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, evidence (doc_ids of the nearest examples) of every row of docs (doc_id, text)."""
    if "logit" not in model:
        return docs.select("doc_id", F.lit(float(model["share"])).alias("score"), F.array().cast("array<long>").alias("evidence"))
    a, b, c, d = model["logit"]
    voted = docs.select("doc_id", "text").mapInArrow(_voter(model, 1), f"doc_id long, {VOTES}")
    logit = float(a) * F.col("vote") + float(b) * F.col("nearest") + float(c) * F.col("any") + float(d)
    return voted.select("doc_id", (1 / (1 + F.exp(-logit))).alias("score"), "evidence")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents_only(C.table(spark, sf_dir, "documents"))
    labels = C.table(spark, sf_dir, "labels").where(C.fold(F.col("doc_id"), 4) != 2)
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", (C.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")
