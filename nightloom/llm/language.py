"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased letters; whatever is no letter counts as a word boundary. N-grams of 1 to 3 characters
are hashed into a fixed number of features. Document frequencies are counted over all rows to learn from, and no
others. The model is trained with FTRL-proximal under an elastic net (L1 and L2) on the whole texts of a bounded sample
of these rows. A third of the sample is held back to fit the temperature of the softmax, on whole texts and on short
runs of them; targets are smoothed by their number, (n + 1) / (n + classes), so that rows that are all told apart do
not make every score 1.

Defined results: a null text or one without a letter is `und` with score 0; with a single learned language every
other text gets it with score 1, with none every text is `und`; ties go to the first language in order; rows
that share a doc_id are predicted each from its own text; null languages are never learned.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.llm import common as C
from nightloom.llm import samples as S
from nightloom.llm import wordhash as H

FEATURES = 1 << 15
ORDERS = (1, 2, 3)
#: The bound of the sample, documents a language; characters of the short runs that the temperature is fitted on.
DOCS_A_LANGUAGE, RUN_CHARS = 800, 24
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.001
ROWS, BYTES = 256, 1 << 19
UNDETERMINED = "und"

_tables: dict = {}


def _letters() -> np.ndarray:
    """By code point: its lower-case letter, or 0 for what is no letter. Made once a process."""
    if "letters" not in _tables:
        t = np.zeros(sys.maxunicode + 1, np.uint32)
        for c in range(0x323B0):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _tables["letters"] = t
    return _tables["letters"]


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and text of every n-gram of a slice of texts, and whether each text has a letter."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
    c = _letters()[points]
    of = np.repeat(np.arange(len(off) - 1), np.diff(begins))
    has = np.bincount(of[c > 0], minlength=len(off) - 1) > 0
    f, t = [], []
    x = c.astype(np.uint64)
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            break
        h = np.full(m, n, np.uint64)
        any_letter = np.zeros(m, bool)
        for k in range(n):
            h = h * H.U64(H.P) + x[k : m + k]
            any_letter |= c[k : m + k] > 0
        good = (of[:m] == of[n - 1 :]) & any_letter
        f.append((H.mix(h[good]) >> H.U64(40)).astype(np.int64) % FEATURES)
        t.append(of[:m][good])
    if not f:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    return np.concatenate(f), np.concatenate(t), has


def _small(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of at most ROWS texts and about BYTES bytes, so that a count for each text and feature fits in memory."""
    for i, j, data, off in H.slices(column):
        a = 0
        while a < j - i:
            b = max(a + 1, min(a + ROWS, int(np.searchsorted(off, off[a] + BYTES, side="right")) - 1))
            b = min(b, j - i)
            yield i + a, i + b, data[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for i, j, data, off in _small(batch.column(0)):
            f, t, _ = features(data, off)
            seen = np.zeros((j - i, FEATURES), bool)
            seen[t, f] = True
            df += seen.sum(axis=0)
            n += j - i
    yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(FEATURES), -1)), pa.array(np.append(df, n))], ["feature", "n"])


def _rows(data: np.ndarray, off: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, feature, weight (unit TF-IDF) of the non-zero entries, ordered by text; whether each text has a letter."""
    f, t, has = features(data, off)
    n = np.bincount(t * FEATURES + f, minlength=1)
    at = np.flatnonzero(n)
    of, f = at // FEATURES, at % FEATURES
    w = (1 + np.log(n[at])) * idf[f]
    norm = np.sqrt(np.bincount(of, w * w, minlength=len(off) - 1))
    return of, f, w / norm[of], has


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = 5) -> np.ndarray:
    """Weights (features + bias, classes) by FTRL-proximal with L1 and L2."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))
    rng = np.random.Generator(np.random.PCG64(seed))

    def weights(f):
        w = -(z[f] - np.sign(z[f]) * L1) / ((BETA + np.sqrt(n[f])) / ALPHA + L2)
        return np.where(np.abs(z[f]) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for e in rng.permutation(len(examples)):
            f, x, y = examples[e]
            w = weights(f)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            more = np.sqrt(n[f] + g * g) - np.sqrt(n[f])
            z[f] += g - more / ALPHA * w
            n[f] += g * g
    return weights(np.arange(FEATURES + 1))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The softmax temperature with the least loss against smoothed targets, by golden section over its logarithm."""
    n, k = logits.shape
    right = (n + 1) / (n + k)
    target = np.full((n, k), (1 - right) / max(k - 1, 1))
    target[np.arange(n), y] = right

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - (target * s).sum(axis=1)).mean())

    a, b, r = -8.0, 8.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


VECTOR = "doc_id long, label string, short boolean, features binary, weights binary"


def _vectors(idf: np.ndarray):
    """doc_id, label, text, short -> the sparse vector of each text that has a letter."""

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in _small(batch.column(2)):
                of, f, w, has = _rows(data, off, idf)
                at = np.searchsorted(of, np.arange(j - i + 1))
                cut = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())  # noqa: B023, E731
                rows = batch.slice(i, j - i)
                out = [rows.column(0), rows.column(1), rows.column(3), cut(f, np.int32), cut(w, np.float32)]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "label", "short", "features", "weights"]).filter(pa.array(has))

    return vector


def train(rows: DataFrame) -> dict:
    """rows: doc_id, text, lang to learn from."""
    known = rows.where("lang IS NOT NULL")
    chosen, counts = S.sample_by_class(known.select("doc_id", "text", F.col("lang").alias("label")), DOCS_A_LANGUAGE)
    languages = sorted(counts)
    if len(languages) < 2:
        return {"languages": languages}
    df = {r.feature: r.n for r in known.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}  # a row a feature
    idf = np.array([np.log((1 + df[-1]) / (1 + df.get(f, 0))) + 1 for f in range(FEATURES)])
    run = F.expr(f"substring(text, 1 + cast(pmod(xxhash64(text), greatest(length(text) - {RUN_CHARS}, 1)) as int), {RUN_CHARS})")
    both = F.explode(F.array(F.struct(F.col("text"), F.lit(False).alias("short")), F.struct(run.alias("text"), F.lit(True).alias("short"))))
    sample = chosen.where("text IS NOT NULL").select("doc_id", "label", both.alias("t")).select("doc_id", "label", "t.text", "t.short")
    got = sample.mapInArrow(_vectors(idf), VECTOR).collect()  # two vectors of at most FEATURES entries for each row of the bounded sample
    got.sort(key=lambda r: (r.doc_id or 0, r.short, r.features, r.weights))
    examples = {True: [], False: []}
    for r in got:
        f, w = np.frombuffer(r.features, np.int32), np.frombuffer(r.weights, np.float32)
        examples[r.short].append((np.append(f, FEATURES), np.append(w, 1.0), languages.index(r.label), r.doc_id or 0))
    # Held back by document, so that no short run comes from a text that the weights are fitted on.
    fit, held = [e[:3] for e in examples[False] if e[3] % 3], [e for kind in examples.values() for e in kind if e[3] % 3 == 0]
    if not fit or not held:
        fit = held = [e[:3] for e in examples[False]]
    if not fit:
        return {"languages": []}
    weights = ftrl(fit, len(languages))
    logits = np.array([e[1] @ weights[e[0]] for e in held]).reshape(-1, len(languages))
    return {"languages": languages, "weights": weights, "idf": idf, "temperature": temperature(logits, np.array([e[2] for e in held]))}


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text)."""
    languages = model["languages"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*languages, UNDETERMINED], object)
        for batch in batches:
            best, score = np.full(batch.num_rows, len(languages)), np.zeros(batch.num_rows)
            for i, j, data, off in _small(batch.column(1)):
                if len(languages) > 1:
                    of, f, w, has = _rows(data, off, model["idf"])
                    s = np.tile(model["weights"][FEATURES], (j - i, 1))
                    for k in range(len(languages)):
                        s[:, k] += np.bincount(of, w * model["weights"][f, k], minlength=j - i)
                    s = np.exp((s - s.max(axis=1, keepdims=True)) / model["temperature"])
                    s /= s.sum(axis=1, keepdims=True)
                    best[i:j], score[i:j] = np.where(has, s.argmax(axis=1), len(languages)), np.where(has, s.max(axis=1), 0.0)
                elif languages:
                    has = features(data, off)[2]
                    best[i:j], score[i:j] = np.where(has, 0, 1), has.astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = C.table(spark, sf_dir, "documents")
    docs = C.documents_only(table)
    rows = table.where(C.fold(F.col("doc_id"), 4) != 2).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = identify(docs, train(rows))
    return found.select("doc_id", (C.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
