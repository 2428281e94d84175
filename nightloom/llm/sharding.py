"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Every row hashes into one of a fixed number of slots; rows' bytes are summed per slot, and a map from slot to
shard, held in a table with a version on each state, deals the slots out. Rebalancing edits the map: slots move
until the shards' bytes are near equal again, and all others stay where they are. A new table's map deals the slots out
in turn (version 1); once the slots' bytes are known it is edited by them (version 2), and that version places the rows.
The law that op6 keeps is `bytes`. Only the map (a fixed number of slots) reaches the driver. A row's slot comes from
its doc_id and its text, so copies of one text spread over all slots: a hot group cannot fill a shard.

Defined results: a null text has 0 bytes, so size 1, and the crc32 of an empty text; a null doc_id hashes like
any value; rows that agree in all of doc_id and text land in one slot; extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nightloom.llm import common as C

SLOTS = 4096
MAP_SCHEMA = "version int, slot int, shard int, bytes long"


def slot_of(slots: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def deal(weights: dict[int, int], shards: int, slots: int) -> dict[int, int]:
    """A first map: the heaviest slot that is left goes to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-weights.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), shard))
    return out


def rebalance(held: dict[int, int], weights: dict[int, int], shards: int) -> dict[int, int]:
    """An edited map for `shards` shards: slots leave shards that are above the mean (or gone) for the lightest one."""
    out = dict(held)
    loads = dict.fromkeys(range(shards), 0)
    loose = []
    for slot, shard in held.items():
        if shard in loads:
            loads[shard] += weights.get(slot, 0)
        else:
            loose.append(slot)
    mean = sum(weights.get(s, 0) for s in held) / shards
    by_shard: dict[int, list[int]] = {}
    for slot, shard in held.items():
        by_shard.setdefault(shard, []).append(slot)
    for shard in list(loads):
        for slot in sorted(by_shard.get(shard, []), key=lambda s: (-weights.get(s, 0), s)):
            w = weights.get(slot, 0)
            if w and loads[shard] - w >= mean:
                loads[shard] -= w
                loose.append(slot)
    heap = [(load, shard) for shard, load in loads.items()]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-weights.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), shard))
    return out


class SlotMap:
    """The versioned map in a shared folder: each state is appended under the next version."""

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS):
        self.spark, self.path, self.slots, self.version = spark, path, slots, 0

    def _append(self, held: dict[int, int], weights: dict[int, int]) -> DataFrame:
        self.version += 1
        rows = [(self.version, s, held[s], weights.get(s, 0)) for s in sorted(held)]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{self.path}/version={self.version}")
        return self.read()

    def read(self, version: int | None = None) -> DataFrame:
        at = version or self.version
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/version={at}")

    def create(self, weights: dict[int, int], shards: int) -> DataFrame:
        return self._append(deal(weights, shards, self.slots), weights)

    def edit(self, weights: dict[int, int], shards: int) -> DataFrame:
        held = {r.slot: r.shard for r in self.read().collect()}
        return self._append(rebalance(held, weights, shards), weights)


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard and slot (the row's place in its shard, from 0 and without gaps)."""
    spark = docs.sparkSession
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    sized = C.documents_only(docs).select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    path = C.shared_dir(spark)
    sized = C.stored(sized.withColumn("vslot", slot_of(slots, F.col("doc_id"), F.col("text_crc32"))), f"{path}/sized")
    totals = {r.vslot: (r.bytes, r.n) for r in sized.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    held = SlotMap(spark, f"{path}/map", slots)
    held.create({}, shards)
    held = held.edit({s: b for s, (b, _) in totals.items()}, shards)
    first: dict[int, int] = {}
    rows = []
    for r in held.orderBy("slot").collect():
        n = totals.get(r.slot, (0, 0))[1]
        rows.append((r.slot, r.shard, first.get(r.shard, 0)))
        first[r.shard] = first.get(r.shard, 0) + n
    places = spark.createDataFrame(rows, "vslot int, shard int, first long")
    within = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return (
        sized.withColumn("within", within)
        .join(F.broadcast(places), "vslot")  # as many rows as there are slots
        .select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first") + F.col("within") - 1).alias("slot"))
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(C.table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
