"""Sharding by fixed virtual slots (native: DataFrame functions only).

Every record hashes by its key into one of `SLOTS` virtual slots, for ever. A small versioned map says
which shard owns each slot; rebalancing edits the map and never the hash. Rows and bytes are aggregated
per slot, which is all that planning a move needs.

Defined results: null text has no bytes (size 1, crc32 of the empty text); null keys hash as the empty
text; rows of equal key, size and crc32 tie and lie side by side, repeated rows among them; a very long text is read
once, in the JVM, and goes no further; an empty table gives an empty result; extra columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import durable, md5_int

SLOTS = 4096
#: Parts of a slot, by the text's crc32: what one task sorts.
PARTS = 16
#: Equal rows spelled out from one array.
STEP = 1 << 16


@dataclass(frozen=True)
class SlotMap:
    """Version `version` of the map: `owners[slot]` is the shard of that slot."""

    version: int
    n_shards: int
    owners: tuple[int, ...]

    @staticmethod
    def build(n_shards: int, slots: int = SLOTS) -> SlotMap:
        """The map for `n_shards` shards: one shard, grown one by one. It depends on nothing but the two counts."""
        if not 1 <= n_shards <= slots:
            raise ValueError(f"{n_shards} shards can't share {slots} slots")
        grown = SlotMap(1, 1, (0,) * slots)
        while grown.n_shards < n_shards:
            grown = grown.grown()
        return grown

    def grown(self) -> SlotMap:
        """One shard more: the new one takes its part of the slots, always from whichever shard owns most."""
        held: dict[int, list[int]] = {s: [] for s in range(self.n_shards)}
        for slot, owner in enumerate(self.owners):
            held[owner].append(slot)
        heap = [(-len(slots), shard) for shard, slots in held.items()]
        heapq.heapify(heap)
        owners = list(self.owners)
        for _ in range(len(owners) // (self.n_shards + 1)):
            _, shard = heapq.heappop(heap)
            owners[held[shard].pop()] = self.n_shards
            heapq.heappush(heap, (-len(held[shard]), shard))
        return SlotMap(self.version + 1, self.n_shards + 1, tuple(owners))

    def rebalanced(self, slot_bytes: dict[int, int], tolerance: float = 0.02) -> SlotMap:
        """The next version, with slots moved from the heaviest to the lightest shard while that evens the bytes out."""
        owners, load = list(self.owners), [0] * self.n_shards
        for slot, owner in enumerate(owners):
            load[owner] += slot_bytes.get(slot, 0)
        mean = sum(load) / self.n_shards
        for _ in range(len(owners)):
            high, low = max(range(self.n_shards), key=load.__getitem__), min(range(self.n_shards), key=load.__getitem__)
            gap = load[high] - load[low]
            movable = [s for s, o in enumerate(owners) if o == high and 0 < slot_bytes.get(s, 0) < gap]
            if gap <= tolerance * mean or not movable:
                break
            slot = min(movable, key=lambda s: (abs(2 * slot_bytes[s] - gap), s))
            owners[slot] = low
            load[high] -= slot_bytes[slot]
            load[low] += slot_bytes[slot]
        return SlotMap(self.version + 1, self.n_shards, tuple(owners))

    def frame(self, spark: SparkSession) -> DataFrame:
        """map_version, n_shards, vslot, shard: one row per slot, so its size is fixed."""
        return spark.range(1).select(
            F.lit(self.version).alias("map_version"),
            F.lit(self.n_shards).alias("n_shards"),
            F.posexplode(F.from_json(F.lit(json.dumps(self.owners)), "array<int>")).alias("vslot", "shard"),
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the stored maps; older versions stay readable."""
        self.frame(spark).write.mode("append").partitionBy("map_version").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        stored = spark.read.parquet(path)
        if version is None:
            version = stored.agg(F.max("map_version")).first()[0]
        rows = sorted((r.vslot, r.shard, r.n_shards) for r in stored.where(F.col("map_version") == version).collect())
        return SlotMap(version, rows[0][2], tuple(r[1] for r in rows))


def virtual_slot(key: str, slots: int = SLOTS):
    return (md5_int(F.col(key)) % slots).cast("int")


def records(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """key, size, text_crc32, vslot; the texts themselves go no further."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        virtual_slot(key, slots).alias("vslot"),
    )


def slot_totals(grouped: DataFrame) -> DataFrame:
    """vslot, part, n_rows, n_bytes of rows of `size` that stand for `n` equal ones; at most one row per part of a slot."""
    return grouped.groupBy("vslot", "part").agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") * F.col("size")).alias("n_bytes"))


def assign(df: DataFrame, slot_map: SlotMap, grown: SlotMap | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard, its gapless place in the shard, and its shard under the map with one shard more.

    Equal rows (key, size, crc32) are counted map-side and travel as one, so a key or text that holds much of the table
    is no hot spot; they are spelled out at the end, in neighbouring places. A place is the number of rows in the
    shard's earlier slots and parts of slots, plus the place within the part, so no task sorts more than the different
    rows of one part of one virtual slot. The tables joined by broadcast have one row per slot or part of a slot.
    """
    spark, slots = df.sparkSession, len(slot_map.owners)
    rows = records(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", slots)
    grouped = durable(rows.groupBy("key", "size", "text_crc32", "vslot").agg(F.count("*").alias("n")).withColumn("part", (F.col("text_crc32") % PARTS).cast("int")))
    owners = slot_map.frame(spark).join(F.broadcast((grown or slot_map.grown()).frame(spark).select("vslot", F.col("shard").alias("grown_shard"))), "vslot")
    in_shard = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        slot_totals(grouped)
        .join(F.broadcast(owners), "vslot")
        .withColumn("before", F.coalesce(F.sum("n_rows").over(in_shard), F.lit(0)))
        .withColumn("slot_bytes", F.sum("n_bytes").over(Window.partitionBy("vslot")))
        .drop("n_rows", "n_bytes")
    )
    in_part = Window.partitionBy("vslot", "part").orderBy(F.col("key").asc_nulls_first(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("n").over(in_part), F.lit(0))
    # In two steps, so that no array grows with the table.
    steps = grouped.withColumn("within", within).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STEP))))
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n") - F.col("step") * STEP, F.lit(STEP)) - 1))
    return (
        steps.withColumn("nth", nth)
        .join(F.broadcast(placed), ["vslot", "part"])
        .select(
            F.col("key").alias(key),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("before") + F.col("within") + F.col("step") * STEP + F.col("nth")).cast("long").alias("slot"),
            "grown_shard",
            "vslot",
            "slot_bytes",
            "map_version",
        )
    )
