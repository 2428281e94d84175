"""The sessions' library: scanning logs, selections, states, settings of a stack as text, and what a result records about itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that settings may hold, the first being the default.
METHODS = ["SIGMA_CLIP", "KAPPA_SIGMA", "MEDIAN", "MEAN"]
CROPS = ["COMMON_AREA", "FULL_FRAME"]
KEEP_OF_OLD = 100


def scan(logs: DataFrame, document: str, schema: str) -> DataFrame:
    """logs with `log` (null where the document does not parse) and `unreadable`; every row is kept under its name."""
    got = logs.withColumn("log", F.from_json(document, f"{schema}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}))
    bad = F.col(document).isNull() | F.col("log.corrupt").isNotNull()
    return got.withColumn("unreadable", bad).withColumn("log", F.when(~bad, F.col("log"))).drop(document)


def newest(scanned: DataFrame, at: Column, by: str, k: int = 5) -> DataFrame:
    """The k newest readable sessions, and beside them how many there are and how many cannot be read (one row)."""
    counts = scanned.agg(F.count("*").alias("sessions"), F.coalesce(F.sum(F.col("unreadable").cast("long")), F.lit(0)).alias("n_unreadable"))
    return scanned.where("NOT unreadable").orderBy(at.desc(), by).limit(k).crossJoin(F.broadcast(counts))


def lookup(scanned: DataFrame, by: str, names: DataFrame) -> DataFrame:
    """names with the log of each; null where there is none or it cannot be read."""
    return names.join(scanned.select(by, "log"), by, "left")


def toggled(selection: Column, name: Column) -> Column:
    """A selection (array of names) with a name put in, or taken out if it is there."""
    return F.when(F.array_contains(selection, name), F.array_remove(selection, name)).otherwise(F.array_append(selection, name))


def retaining(selection: Column, existing: Column) -> Column:
    """What of a selection still exists, in the selection's order."""
    return F.array_intersect(selection, existing)


def exposure_set(frames: DataFrame, name: str | None) -> DataFrame:
    """Frames of one set of exposures, or all where no set is named."""
    return frames if name is None else frames.where(F.col("exposure_set") == name)


def with_state(state: str, finished: str, new_state: Column, at: Column) -> list[Column]:
    """State and finishing time after a transition: a time once set stays unless a new one is given."""
    return [new_state.alias(state), F.coalesce(at, F.col(finished)).alias(finished)]


def settings_map(method: Column, crop: Column, keep: Column, weighted: Column) -> Column:
    return F.create_map(F.lit("method"), method, F.lit("crop"), crop, F.lit("keepBestPercent"), keep.cast("string"), F.lit("weighted"), weighted.cast("string"))


def settings_of(recorded: Column) -> Column:
    """method, crop, keep, weighted of recorded settings. What is unknown reads as the default; what is absent, as a stack from
    before the setting: everything kept, nothing weighted."""
    one_of = lambda key, names: F.when(recorded[key].isin(names), recorded[key]).otherwise(F.lit(names[0]))
    keep = F.when(recorded["keepBestPercent"].rlike(r"^[+-]?\d{1,9}$"), recorded["keepBestPercent"].cast("int"))
    keep = F.when(keep.isNull(), F.lit(KEEP_OF_OLD)).otherwise(F.greatest(F.lit(1), F.least(F.lit(100), keep)))
    weighted = F.coalesce(recorded["weighted"] == "true", F.lit(False))
    return F.struct(one_of("method", METHODS).alias("method"), one_of("crop", CROPS).alias("crop"), keep.alias("keep"), weighted.alias("weighted"))


def provenance(nights: DataFrame, by: str) -> DataFrame:
    """by, record: what a stack of several nights says of itself (nights: by, folder, camera, frames, seconds, reason; reason
    is null for nights that are in it). Folders come in order, and keys without anything to say are left out."""
    into = F.col("reason").isNull()
    listed = lambda c, when: F.array_sort(F.collect_list(F.when(when, c)))
    g = nights.groupBy(by).agg(
        F.array_join(listed(F.col("folder"), into), ",").alias("nights"), F.min_by("camera", F.when(into, F.col("folder"))).alias("camera"),
        F.coalesce(F.sum(F.when(into, F.col("frames"))), F.lit(0)).alias("frames"), F.coalesce(F.sum(F.when(into, F.col("seconds"))), F.lit(0.0)).alias("seconds"),
        F.array_join(listed(F.concat("folder", F.lit(": "), "reason"), ~into), "; ").alias("rejected"),
    )
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (("nights", F.col("nights")), ("camera", F.col("camera")), ("frames", F.col("frames").cast("string")), ("integrationSeconds", F.format_string("%.1f", F.col("seconds"))), ("rejected", F.nullif("rejected", F.lit(""))))])
    return g.select(by, F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull())).alias("record"))
