"""Fixed virtual slots: record hash -> slot -> shard through a versioned map.

Records are hashed into a fixed number of slots.  Bytes are summed per slot, and
a small map deals slots to shards so that the shards' bytes are nearly equal.
Rebalancing edits the map (version + 1) and moves whole slots; records are never
hashed anew.

Version 1 deals the slots out evenly, whatever they hold; the bytes of the slots
then make version 2.  Versions are rows of a table, from which the latest is read.

A record's hash is that of its text, so equal texts share a slot and a shard.  Only
a group of equal texts that no shard can hold, of more than ``1 / shards`` of all
bytes (there are fewer than ``shards`` such groups, which bounds the broadcast),
is hashed by doc_id instead, so that its rows spread over all slots.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir

SLOTS = 4096
#: Parts of a slot that are numbered independently.
PARTS = 16


@dataclass(frozen=True)
class SlotMap:
    """A version of the slot-to-shard map."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def column(self, slot: str) -> Column:
        return F.element_at(F.array(*map(F.lit, self.shard_of)), F.col(slot).cast("int") + 1)

    def frame(self, spark) -> DataFrame:
        rows = [(self.version, self.shards, k, s) for k, s in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, shards int, vslot int, shard int")

    def save(self, spark, path: str) -> None:
        """Append this version to the table of versions at ``path``."""
        self.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def load(spark, path: str, version: int | None = None) -> SlotMap:
        t = spark.read.parquet(path)
        version = t.agg(F.max("version")).first()[0] if version is None else version
        rows = t.where(F.col("version") == version).orderBy("vslot").collect()
        return SlotMap(version, rows[0].shards, tuple(r.shard for r in rows))


def even_map(slots: int, shards: int) -> SlotMap:
    """Version 1: the same number of slots for each shard, before any record is seen."""
    return SlotMap(1, shards, tuple(k % shards for k in range(slots)))


def initial_map(slot_bytes: list[int], shards: int) -> SlotMap:
    """Slots in descending size, each to the least filled shard (ties: lowest number)."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(slot_bytes)
    for k in sorted(range(len(slot_bytes)), key=lambda k: (-slot_bytes[k], k)):
        size, s = heapq.heappop(heap)
        out[k] = s
        heapq.heappush(heap, (size + slot_bytes[k], s))
    return SlotMap(1, shards, tuple(out))


def rebalance(old: SlotMap, slot_bytes: list[int], shards: int) -> SlotMap:
    """The next version for a new shard count or new sizes, moving few slots.

    Slots of shards that are no more, and slots that a shard holds beyond its
    fair share (smallest first), go to the least filled shards.
    """
    fair = sum(slot_bytes) / shards
    load = [0] * shards
    out = list(old.shard_of)
    loose = [k for k, s in enumerate(out) if s >= shards]
    for k, s in enumerate(out):
        if s < shards:
            load[s] += slot_bytes[k]
    for k in sorted(range(len(out)), key=lambda k: (slot_bytes[k], k)):
        s = out[k]
        if s < shards and slot_bytes[k] and load[s] - slot_bytes[k] >= fair:
            load[s] -= slot_bytes[k]
            loose.append(k)
    heap = [(x, s) for s, x in enumerate(load)]
    heapq.heapify(heap)
    for k in sorted(loose, key=lambda k: (-slot_bytes[k], k)):
        size, s = heapq.heappop(heap)
        out[k] = s
        heapq.heappush(heap, (size + slot_bytes[k], s))
    return SlotMap(old.version + 1, shards, tuple(out))


def slotted(docs: DataFrame, shards: int, slots: int = SLOTS, into: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, vslot per row: texts are read once, and only their hashes carried on."""
    text = F.coalesce(docs["text"], F.lit(""))
    base = cut(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("th"),
    ), into)
    groups = base.groupBy("th", "text_crc32").agg(F.sum("size").alias("bytes"))
    total = base.agg(F.sum("size")).first()[0] or 0
    large = groups.where(F.col("bytes") * shards > total).select("th", "text_crc32", F.lit(True).alias("large"))
    base = base.join(F.broadcast(large), ["th", "text_crc32"], "left")  # fewer than shards rows
    h = F.when(F.col("large"), F.xxhash64("th", "doc_id")).otherwise(F.col("th"))
    return base.select("doc_id", "size", "text_crc32", F.pmod(h, F.lit(slots)).cast("int").alias("vslot"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of each slot (a fixed number of slots comes to the driver)."""
    out = [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b")).collect():
        out[r.vslot] = r.b
    return out


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, slot_map: SlotMap | None = None, store: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version.

    Without a ``slot_map``, the even one is edited for the bytes of the slots, both
    versions are added to the table ``store`` (default: a new one in the shared
    folder), and the latest version there is used.

    ``slot`` numbers the rows of a shard from 0 without gaps, by virtual slot and
    doc_id.  Null text has size 1; null doc_ids come first in their slot;
    repeated rows get numbers of their own.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = slotted(docs, shards, slots)
    if slot_map is None:
        store = store or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
        first_map = even_map(slots, shards)
        first_map.save(spark, store)
        rebalance(first_map, slot_sizes(rows, slots), shards).save(spark, store)
        slot_map = SlotMap.load(spark, store)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    # a fixed number of parts: slots * PARTS counts give each part's first number
    counts = {(r.vslot, r.part): r.n for r in rows.groupBy("vslot", "part").agg(F.count("*").alias("n")).collect()}
    at, first = [0] * slot_map.shards, []
    for k, s in enumerate(slot_map.shard_of):
        for p in range(PARTS):
            if (k, p) in counts:
                first.append((k, p, s, at[s]))
                at[s] += counts[k, p]
    first = spark.createDataFrame(first, "vslot int, part int, shard int, base long")
    w = Window.partitionBy("vslot", "part").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (
        rows.join(F.broadcast(first), ["vslot", "part"])  # at most slots * PARTS rows
        .withColumn("slot", F.col("base") + F.row_number().over(w) - 1)
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
            "vslot", F.lit(slot_map.version).alias("map_version"),
        )
    )
