"""Line dedup: levelled sorted runs of line hashes, merged and compacted like a log-structured store.

A run holds one row per line key: its hash (two 64-bit words), how many documents of the batch hold it, and
the document that keeps it. Batches are taken from the largest doc_ids downwards. Each new batch is
anti-joined with the runs: a key that no run holds is new, and the batch's largest doc_id keeps it for good; a
key that a run holds only adds to the count. The batch is then added as a run of its own on level 0; `fanout`
runs of one level are merged into one run of the next. The rows of a batch are written apart when lines are
hashed, so each batch reads its own rows only. A batch takes BATCH_BYTES of texts, or a share of the table where that would
make more than MOST_BATCHES.

Defined results: a null or empty text is one empty line; a null doc_id ranks below every other id, and rows
with the same doc_id count as one document; short keys are never dropped; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.llm import common as C

RUN_SCHEMA = "k1 long, k2 long, n_docs long, keeper long"


def line_key(line: Column) -> Column:
    return C.ascii_lower(C.strip_blanks(line))


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2"))


class LineRuns:
    """Sorted runs in a shared folder. Only run names are kept on the driver."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4):
        self.spark, self.path, self.fanout = spark, path, fanout
        self.levels: list[list[str]] = []
        self.made = 0

    def read(self) -> DataFrame:
        """All runs' rows; a key may stand in several runs."""
        names = [run for level in self.levels for run in level]
        if not names:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        return self.spark.read.schema(RUN_SCHEMA).parquet(*names)

    def merged(self, rows: DataFrame | None = None) -> DataFrame:
        return (self.read() if rows is None else rows).groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def add(self, batch: DataFrame) -> None:
        """batch: k1, k2, n_docs, keeper, one row a key, of smaller doc_ids than all batches before."""
        if self.levels:
            seen = self.read().select("k1", "k2").distinct()
            new = batch.join(seen, ["k1", "k2"], "left_anti")
            known = batch.join(seen, ["k1", "k2"], "left_semi").withColumn("keeper", F.lit(None).cast("long"))
            batch = new.unionByName(known)
        self._write(0, batch)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _write(self, level: int, rows: DataFrame) -> None:
        name = f"{self.path}/level-{level}/run-{self.made}"
        self.made += 1
        rows.select("k1", "k2", "n_docs", "keeper").sortWithinPartitions("k1", "k2").write.parquet(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _compact(self, level: int) -> None:
        names, self.levels[level] = self.levels[level], []
        self._write(level + 1, self.merged(self.spark.read.schema(RUN_SCHEMA).parquet(*names)))
        for name in names:
            C.delete_dir(self.spark, name)


#: Bytes of texts in a batch, about, and the most batches: then batches grow with the table. A batch meets all runs before it, so
#: reading grows with batches; five are the fewest of which four are compacted and one meets the level above.
BATCH_BYTES, MOST_BATCHES = 50 << 20, 5


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int | None = None, fanout: int = 4, carry: bool = False) -> DataFrame:
    """doc_id, text, lines (before), dropped_lines, kept_text: lines whose key of at least min_chars code points
    stands in at least min_docs documents go, except in the largest doc_id that holds the key. With carry,
    the columns of docs, with the kept text for the text (the others in a struct meanwhile, so that no name can clash).

    What goes is joined by the places of lines: a row learns which of its lines go, by place, and takes the others by place, so
    its work grows with its lines. Rows are named by doc_id and text, so rows that share a doc_id spread."""
    spark = docs.sparkSession
    columns = docs.columns
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(F.col("doc_id"), *[F.col(f"`{c}`") for c in columns if c not in ("doc_id", "text")]).alias("row")] if carry else []))
    beside = ["row"] if carry else []
    path = C.shared_dir(spark)
    low = F.lit(-(2**63)).cast("long")
    rank = F.coalesce(F.col("doc_id"), low)
    key = F.xxhash64("doc_id", "text")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    named = lambda x, i, row: C.once(line_key(x), lambda k: F.when(F.length(k) >= min_chars, F.struct(row.alias("key"), i.alias("at"), key_hash(k).alias("h"))))
    # The row's key is made before its lines are told apart, so that no line carries the text.
    hashes = C.once(key, lambda row: F.filter(F.transform(lines, lambda x, i: named(x, i, row)), lambda h: h.isNotNull()))
    if batches is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        batches = min(MOST_BATCHES, -(-size // BATCH_BYTES) or 1)
    ranks = docs.select(rank.alias("rank"))
    cuts = ranks.agg(F.percentile_approx("rank", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or ()))
    batch = len(cuts) - sum(((F.col("rank") > c).cast("int") for c in cuts), F.lit(0))  # the largest ids are batch 0
    keyed = docs.select(rank.alias("rank"), F.explode(hashes).alias("h")).select("rank", "h.key", "h.at", "h.h.k1", "h.h.k2").withColumn("batch", batch.cast("int"))
    keyed.write.partitionBy("batch").parquet(f"{path}/lines")
    keyed = spark.read.schema("rank long, key long, at int, k1 long, k2 long, batch int").parquet(f"{path}/lines")
    runs = LineRuns(spark, f"{path}/runs", fanout)
    for k in range(len(cuts) + 1):
        runs.add(keyed.where(F.col("batch") == k).select("rank", "k1", "k2").distinct().groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("rank").alias("keeper")))
    # Written first, so that the join below has plain shuffles on both sides and a very common key can be split.
    common = C.stored(runs.merged().where(F.col("n_docs") >= min_docs).select("k1", "k2", "keeper"), f"{path}/common")
    drops = keyed.drop("batch").join(common, ["k1", "k2"]).where(F.col("rank") != F.col("keeper")).groupBy("key").agg(F.collect_set("at").alias("drop"))
    joined = docs.withColumn("key", key).join(drops.hint("shuffle_hash"), "key", "left")
    # What stays comes in an array of one, so that it is made once for the columns that use it.
    places = lambda all_: F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("drop"))
    stay = lambda all_: F.when(F.col("drop").isNull(), all_).otherwise(F.transform(places(all_), lambda i: all_[i]))
    split = C.once(lines, lambda all_: F.struct(F.size(all_).alias("n"), stay(all_).alias("kept")))
    out = (
        joined.select("doc_id", "text", *beside, F.explode(F.array(split)).alias("split"))
        .select("doc_id", "text", *beside, F.col("split.n").cast("long").alias("lines"), (F.col("split.n") - F.size("split.kept")).cast("long").alias("dropped_lines"), F.array_join("split.kept", "\n").alias("kept_text"))
    )
    return out.select(*[F.col("kept_text" if c == "text" else f"row.`{c}`").alias(c) for c in columns]) if carry else out


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("lines").alias("n_lines"), F.col("dropped_lines").alias("n_dropped"), F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.pos, c.key IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
