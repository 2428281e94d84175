"""Document fingerprints from closed syncmers.

Tokens are the words of a text, cut into pieces of at most 16 characters. Of each run of four tokens (the k-mer)
the three inner pairs (the s-mers) are hashed; the run is an anchor if the least pair stands at an edge. That
depends on the run alone, not on what surrounds it, so equal passages have equal anchors wherever they stand.
anchors() gives them with their places, for positional matching; fingerprint() keeps the `size` least anchor
hashes, a sample by which the likeness of two whole texts (Jaccard of their anchors) is estimated.

Defined results: a null text is an empty text; a text without tokens has the empty fingerprint; one with fewer
than four tokens has a single anchor of all of them; two empty fingerprints have likeness 1, an empty and any
other 0. Rows that share a doc_id follow each other by their text's hash; a null doc_id comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nightloom.llm import common as C

TOKEN = r"[^\x20\x09-\x0D]{1,16}"
SIZE = 128


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _anchors(text: Column, result) -> Column:
    """result(place, hash) of each anchor of the text, in order."""
    def pairs(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.xxhash64(t[i], t[i + 1]))

    def edges(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - 3)
        return F.transform(F.filter(at, lambda i: (h[i] <= h[i + 1]) | (h[i + 2] <= h[i + 1])), lambda i: result(i, F.xxhash64(h[i], h[i + 2])))

    none = F.slice(F.array(result(F.lit(0), F.lit(0).cast("long"))), 1, 0)
    return C.once(
        tokens(text),
        lambda t: F.when(F.size(t) >= 4, C.once(pairs(t), edges))
        .when(F.size(t) > 0, F.array(result(F.lit(0), F.xxhash64(t))))
        .otherwise(none),
    )


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, place (token index), anchor: the closed syncmers of every document."""
    pair = lambda i, h: F.struct(i.alias("place"), h.alias("anchor"))
    return C.documents_only(docs).select("doc_id", F.explode(_anchors(F.col("text"), pair)).alias("a")).select("doc_id", "a.place", "a.anchor")


def sketch(text: Column, size: int = SIZE) -> Column:
    """The least `size` anchor hashes (32 bits each), ascending."""
    return F.slice(F.array_sort(F.array_distinct(_anchors(text, lambda _, h: h.bitwiseAND(F.lit(0xFFFFFFFF))))), 1, size)


def fingerprint(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """The share of the union's least hashes that both sketches hold."""
    share = C.once(
        F.slice(F.array_sort(F.array_union(a, b)), 1, size),
        lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))).cast("double") / F.greatest(F.size(u), F.lit(1)),
    )
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(share)


#: Ranges of ids at each of two levels, at most; and rows of a range, about, as long as there are ranges.
RANGES, RANGE_ROWS = 1000, 32


def with_next(docs: DataFrame, value: Column, range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs with `next`: value of the row that follows by doc_id; the first row's for the last.

    The ids are cut at percentiles into ranges, and these again, so there are up to RANGES^2 of them; a window orders each
    range by itself, and the first row of each range also stands, marked, at the end of the one before. Rows that share
    a doc_id are spread by their text's hash. The driver gets the cuts of the upper level; the others are sent to all tasks,
    RANGES arrays of RANGES numbers at most."""
    low = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long"))
    rows = docs.withColumns({"at": low, "tie": F.xxhash64("text")})
    ids = rows.select("at", "tie")
    n = ids.count()
    if not n:
        return docs.withColumn("next", F.lit(None).cast(docs.select(value.alias("v")).schema["v"].dataType))
    each = max(1, min(RANGES, int((n / range_rows) ** 0.5)))
    points = [i / each for i in range(1, each)]
    cuts = sorted(set(ids.agg(F.percentile_approx("at", points, 100_000)).first()[0])) if points else []
    upper = lambda x: F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda b: b <= x)) if cuts else F.lit(0)
    # A range whose ids are all the same one (repeated rows) is cut by the rows' hashes instead.
    span = ids.withColumn("upper", upper(F.col("at"))).groupBy("upper")
    lower = span.agg(*[F.percentile_approx(c, points or [0.5], 10_000).alias(c) for c in ("at", "tie")], (F.min("at") == F.max("at")).alias("one"))
    lower = lower.select("upper", "one", F.array_distinct(F.when(F.col("one"), F.col("tie")).otherwise(F.col("at"))).alias("cuts"))
    key = F.when(F.col("one"), F.col("tie")).otherwise(F.col("at"))
    dealt = lambda some: some.withColumn("upper", upper(F.col("at"))).join(F.broadcast(lower), "upper").withColumn(
        "range", F.col("upper").cast("long") * (RANGES + 1) + F.size(F.filter("cuts", lambda b: b <= key))
    ).drop("cuts", "one")
    # A row a range, at most RANGES^2; the driver gets a row for each of the upper level.
    firsts = C.stored(dealt(ids).groupBy("upper", "range").agg(F.min(F.struct("at", "tie")).alias("first")), f"{C.shared_dir(docs.sparkSession)}/ranges")
    tops = [r.last for r in firsts.groupBy("upper").agg(F.max("range").alias("last")).orderBy("upper").collect()]
    ends = docs.sparkSession.createDataFrame([(top // (RANGES + 1), tops[i - 1]) for i, top in enumerate(tops)], "upper long, last long")
    prior = F.coalesce(F.lag("range").over(W.partitionBy("upper").orderBy("range")), F.col("last"))
    before = firsts.join(F.broadcast(ends), "upper").select("range", "first", prior.alias("prior"))
    doubled = dealt(rows).drop("upper").join(F.broadcast(before), "range")
    places = F.array(F.struct(F.col("range"), F.lit(0).alias("late")), F.struct(F.col("prior").alias("range"), F.lit(1).alias("late")))
    is_first = F.struct("at", "tie") == F.col("first")
    placed = doubled.withColumn("place", F.explode(F.when(is_first, places).otherwise(F.slice(places, 1, 1)))).drop("range").withColumns({"range": F.col("place.range"), "late": F.col("place.late")})
    window = W.partitionBy("range").orderBy("late", "at", "tie")
    return placed.withColumn("next", F.lead(value).over(window)).where("late = 0").select(*docs.columns, "next")


def fingerprint_pairs(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Each document with its edited text (the last half gives way to the start of the next document) and both fingerprints."""
    base = C.documents_only(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("sketch", sketch(F.col("text"), size))
    base = with_next(base, F.struct("text", "sketch"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.when(half > 0, F.expr("left(next.text, cast(floor(length(text) / 2) as int))")).otherwise(F.lit("")))
    made = base.select("doc_id", n.cast("long").alias("n_chars"), "sketch", F.col("next.sketch").alias("next_sketch"), F.explode(F.array(edited)).alias("edited"))
    return made.select("doc_id", "n_chars", "edited", "sketch", "next_sketch", F.explode(F.array(sketch(F.col("edited"), size))).alias("edited_sketch"))


def op7_fingerprint_of(docs: DataFrame) -> DataFrame:
    made = fingerprint_pairs(docs)
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return made.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(a).alias("fingerprint"), fingerprint(b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"),
    )


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_fingerprint_of(C.table(spark, sf_dir, "documents"))
