"""Benchmark decontamination: size-partitioned MinHash containment search.

Items and documents are sets of hashed five-word shingles (A-Z lower-cased). Items are partitioned by their
number of shingles, in powers of two. The sketch of an item holds its least-hashed shingles, floor((1 - t) n) + 1
of its n: a document that holds a share t of the item misses at most floor((1 - t) n), so it must hold one of
the sketch, and the search loses nothing. A partition's sketches only count in documents with enough shingles for its
smallest item. What hits are pairs of a document and an item; each pair is then checked exactly, on all shingles of
the two. Whether sketches are sent to all tasks or dealt out with the documents' shingles is left to Spark, which
knows the size of the stored sketches.

Defined results: a text with fewer than five words has one shingle, the whole sequence; null and empty texts and
items have none and match nothing; repeated items (same id) join their shingles; rows that share a doc_id are
searched each by its own text, and the largest overlap with an item is reported; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.llm import common as C

WIDTH = 5


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Hashes of a text's runs of `width` words, in order."""
    def runs(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - width)
        return F.transform(at, lambda i: F.xxhash64(*[h[i + j] for j in range(width)]))

    return C.once(
        F.transform(C.words(text), lambda w: F.xxhash64(w)),
        lambda h: F.when(F.size(h) >= width, C.once(h, runs)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>")),
    )


def item_sets(items: DataFrame) -> DataFrame:
    """item_id, shingle: distinct."""
    flat = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(shingles(F.col("text").cast("string"))).alias("shingle"))
    return flat.where("item_id IS NOT NULL").distinct()


def sketches(sets: DataFrame, threshold: float) -> DataFrame:
    """item_id, n_item, class (size partition), sketch (array of the least shingles)."""
    miss = F.floor((F.lit(1.0) - F.lit(threshold)) * F.col("n_item") + 1e-9)
    grouped = sets.groupBy("item_id").agg(F.sort_array(F.collect_set("shingle")).alias("all")).withColumn("n_item", F.size("all"))
    return grouped.select("item_id", "n_item", F.floor(F.log2(F.col("n_item"))).cast("int").alias("class"), F.slice("all", F.lit(1), (miss + 1).cast("int")).alias("sketch"))


def row_key(docs: DataFrame) -> Column:
    """Names a row by its doc_id and its text: rows that share both share their verdict."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _matches(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """row, doc_id, item_id, n_item, n_shared of every row and item with containment >= threshold."""
    spark = docs.sparkSession
    docs = C.documents_only(docs)
    docs = docs.withColumn("row", row_key(docs))
    path = C.shared_dir(spark)
    sets = C.stored(item_sets(items), f"{path}/items")
    found = sketches(sets, threshold)
    found = C.stored(found.join(found.groupBy("class").agg(F.min("n_item").alias("class_least")), "class"), f"{path}/sketches")
    entries = C.stored(found.select(F.explode("sketch").alias("shingle"), "item_id", "class_least"), f"{path}/entries")
    each = lambda some: some.select("row", "doc_id", F.explode(F.array(F.array_distinct(shingles(F.col("text"))))).alias("set"))  # noqa: E731  made once a row
    looked = each(docs).select("row", F.size("set").alias("n_set"), F.explode("set").alias("shingle"))
    pairs = looked.join(entries, "shingle").where(F.col("n_set") >= F.lit(threshold) * F.col("class_least") - 1e-9).select("row", "item_id").distinct()
    pairs = C.stored(pairs, f"{path}/pairs")
    hit = each(docs.join(pairs.select("row").distinct(), "row", "left_semi")).select("row", "doc_id", F.explode("set").alias("shingle")).distinct()
    met = hit.join(pairs, "row").join(sets, ["item_id", "shingle"])
    shared = met.groupBy("row", "doc_id", "item_id").agg(F.count("*").alias("n_shared")).join(found.select("item_id", F.col("n_item").cast("long").alias("n_item")), "item_id")
    return shared.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - 1e-9)


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of every pair with containment >= threshold."""
    shared = _matches(docs, items, threshold).groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    return shared.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, whose own text holds no item."""
    leaks = _matches(docs, items, threshold).select(F.col("row").alias(_ROW)).distinct()
    return docs.withColumn(_ROW, row_key(docs)).join(leaks.hint("shuffle_hash"), _ROW, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


#: The name of a row's key beside a table's own columns.
_ROW = "nightloom row"


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH norm AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') FROM benchmark),
s AS (SELECT DISTINCT side, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM norm),
b AS (SELECT id AS item_id, g, count(*) OVER (PARTITION BY id) AS n_item FROM s WHERE side = 'b')
SELECT s.id AS doc_id, b.item_id, max(n_item)::BIGINT AS n_item, count(*)::BIGINT AS n_shared, count(*)::DOUBLE / max(n_item) AS containment
FROM s JOIN b USING (g) WHERE s.side = 'd' GROUP BY 1, 2 HAVING count(*) >= 0.8 * max(n_item)
"""
