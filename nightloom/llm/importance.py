"""Importance resampling towards a target: documents are drawn by hashed n-gram features that a target corpus is rich in.

A vectorised automaton runs over the bytes of an Arrow string column. One lookup table folds A-Z and marks the bytes that
belong to words (digits, letters, all bytes from 0x80 up); differences between neighbours give where words start and end;
and the crc32 of all features advances by table through their bytes at the same time, one byte of every feature a step.
What is left of features longer than LONG bytes is finished one by one. A feature is a run of 1 to `most` consecutive
words, joined by one space; its bucket is its crc32 modulo `buckets`.

The counts of both sides and the gain of a bucket are tables of at most `buckets` rows. Documents are read twice: once
for the counts, once for their weights. Gumbel noise by a hash of the doc_id makes the largest scores a draw without
replacement. The draw is ranked without one task for all: the cut comes from counts of whole-number scores (some 100,000
values at most, as both parts of a score are logarithms), the rows above it are sorted by ranges.

Defined results: a null or empty text has no features and the weight 0; a null doc_id is hashed as an empty text and ranks
before others of its score; rows that agree in all of doc_id, score and features are ranked next to each other; an empty
table has no rows, an empty target a count of 0 everywhere; very long texts are read in windows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nightloom.llm import common as C

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Bytes that one step of the automaton reads, features hashed side by side, and the bytes after which a feature is finished alone.
WINDOW, SIDE_BY_SIDE, LONG = 1 << 22, 1 << 19, 48


def _fold_table() -> np.ndarray:
    """Byte -> the byte folded to lower case where it belongs to words, else 0."""
    out = np.zeros(256, np.uint8)
    for first, last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        out[first : last + 1] = np.arange(first, last + 1)
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


FOLD, CRC = _fold_table(), _crc_table()


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row's begin (one more than rows), without copying a text."""
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    _, places, data = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(places, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def find_words(folded: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; rows' borders (`at`) end words."""
    starts, ends = [], []
    for a in range(0, len(folded), WINDOW):
        b = min(a + WINDOW, len(folded))
        inside = np.zeros(b - a + 2, np.int8)
        lo, hi = max(a - 1, 0), min(b + 1, len(folded))
        inside[lo - a + 1 : hi - a + 1] = folded[lo:hi] != 0
        step = np.diff(inside)  # step[i] compares byte a + i with the one before it
        begins, stops = step[:-1] == 1, step[1:] == -1
        border = at[np.searchsorted(at, a) : np.searchsorted(at, b)] - a  # rows that begin in this window
        begins[border] = inside[1:-1][border] == 1
        last = at[np.searchsorted(at, a, "right") : np.searchsorted(at, b, "right")] - a - 1  # their last bytes
        last = last[last >= 0]
        stops[last] = inside[1:-1][last] == 1
        starts.append(np.flatnonzero(begins) + a)
        ends.append(np.flatnonzero(stops) + a + 1)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *starts]), np.concatenate([empty, *ends])


def crc_of_spans(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of raw[start : start + size] of every span; all spans advance together."""
    order = np.argsort(-sizes, kind="stable")
    s, size = starts[order], sizes[order]
    crc = np.full(len(s), 0xFFFFFFFF, np.uint32)
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(min(longest, LONG)), "left")  # spans with more than j bytes
    for j, n in enumerate(live):
        c = crc[:n]
        crc[:n] = CRC[(c ^ raw[s[:n] + j]) & np.uint32(255)] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(int(np.searchsorted(-size, -LONG, "left"))):
        crc[k] = zlib.crc32(raw[s[k] + LONG : s[k] + size[k]].tobytes(), int(crc[k]))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def feature_crcs(column: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, crc, words in a run) of the features of a string column, some at a time."""
    raw, at = string_bytes(column)
    folded = FOLD[raw]
    starts, ends = find_words(folded, at)
    row, sizes = np.searchsorted(at, starts, "right") - 1, ends - starts
    if most > 1:  # words side by side, one space after each
        spaced = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
        spaced[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = folded[folded != 0]
        folded = spaced
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
    for run in range(1, most + 1):
        first = np.arange(len(starts) - run + 1) if run <= len(starts) else np.zeros(0, np.int64)
        first = first[row[first] == row[first + run - 1]]
        for a in range(0, len(first), SIDE_BY_SIDE):
            some = first[a : a + SIDE_BY_SIDE]
            yield row[some], crc_of_spans(folded, starts[some], ends[some + run - 1] - starts[some]), run


def bucket_counts(texts: DataFrame, most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (a column `text`) fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, crc, _ in feature_crcs(batch.column(0), most):
                held += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["bucket", "n"])

    counts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of how much likelier a bucket is in the target), counts raised by one."""
    n = len(corpus)
    all_corpus, all_target = int(corpus.sum()), int(target.sum())
    ratio = ((target + 1) * float(all_corpus + n)) / ((corpus + 1) * float(all_target + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, most: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean of gains; 0 without features) of every row."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, features, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for row, crc, run in feature_crcs(batch.column(1), most):
                some = np.bincount(row, minlength=n)
                features += some
                words += some if run == 1 else 0
                total += np.bincount(row, gains[crc % np.uint32(len(gains))].astype(float), minlength=n).astype(np.int64)
            weight = np.floor_divide(total, np.maximum(features, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return C.documents_only(docs).mapInArrow(mean, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int):
    """Gumbel noise in thousandths, from a hash of seed and doc_id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, wanted: int, path: str) -> DataFrame:
    """row, rank of the `wanted` rows with the highest scores. scored: row (unique), doc_id, n_features, score; stored rows."""
    spark = scored.sparkSession
    cut, above = None, 0
    for r in sorted(scored.groupBy("score").count().collect(), reverse=True) if wanted else []:  # whole numbers in a fixed range
        cut, above = r[0], above + r[1]
        if above >= wanted:
            break
    if cut is None:
        return spark.createDataFrame([], "row long, rank long")
    by = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("row")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), above // 1_000_000)
    top = scored.where(F.col("score") >= cut).select("row", "doc_id", "n_features", "score").repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id())
    top = C.stored(top, f"{path}/top")
    before, starts = 0, []
    for part, n in sorted(tuple(r) for r in top.groupBy("part").count().collect()):  # one row a partition
        starts.append((part, before))
        before += n
    starts = spark.createDataFrame(starts, "part int, before long")
    place = F.row_number().over(W.partitionBy("part").orderBy(*by))
    return top.withColumn("place", place).join(F.broadcast(starts), "part").select("row", (F.col("before") + F.col("place")).alias("rank")).where(F.col("rank") <= wanted)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, most: int = 1, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of docs, and rank (1, 2, ...) of those that are drawn:
    floor(percent / 100) of the rows with at least least_words words, by score."""
    spark = docs.sparkSession
    path = C.shared_dir(spark)
    gains = bucket_gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))
    scored = weigh(docs, gains, most).withColumn("score", F.col("weight") + noise(seed)).withColumn("row", F.monotonically_increasing_id())
    scored = C.stored(scored, f"{path}/scored")
    able = scored.where(F.col("n_words") >= least_words)
    ranks = draw(able, percent * able.count() // 100, path)
    return scored.join(ranks, "row", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 by table in SQL: crc_row(bytes) over a list of byte values.
CRC_SQL = """
crc_table AS (SELECT list(t ORDER BY i) AS crc FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS t FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    """SQL for the crc32 of a string's UTF-8 bytes; the query joins crc_table."""
    codes = f"list_transform(range(octet_length(encode({text}))), lambda j: ('0x' || substr(hex(encode({text})), 2 * j + 1, 2))::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)))"


ORACLE = rf"""
WITH {CRC_SQL},
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
dw AS (SELECT row, unnest(words) AS word FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
w AS (SELECT word, {crc_sql('word')} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc_table),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN w USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN w USING (word) GROUP BY bucket),
g AS (SELECT b AS bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
m AS (SELECT row, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN w USING (word) JOIN g USING (bucket) GROUP BY row),
h AS (SELECT row, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (row)),
x AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS rank FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * 10 // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (row)
"""
