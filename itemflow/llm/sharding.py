"""Sharding by fixed virtual slots, with DataFrame functions only.

A record hashes into one of ``SLOTS`` virtual slots, for good.  Bytes and rows are summed for each slot, and a
map of slots to shards, a table with a version, decides where a slot lives.  Rebalancing edits the map: it
moves slots, never single records; each version is written next to the others, with what it moved, and records are
placed by the table as it is read back.  What reaches the driver is a row for each slot, a fixed number.

Null text: no bytes.  Records that share a doc_id hash apart by their text.  Rows alike in all of that are counted
first and dealt in chunks of ``CHUNK``, each with a slot of its own, so no repeated row fills a slot or a task; rows
without a doc_id are records like others.  Other columns are ignored; texts of any length count whole.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, written

SLOTS = 16_384
#: Rows alike that go to one slot at most.
CHUNK = 256
#: Bytes that a record takes besides its text.
OVERHEAD = 16


@dataclass
class SlotMap:
    """Versioned slot-to-shard map; ``edits`` has what each version changed."""

    shards: int
    home: dict[int, int]
    version: int = 1
    edits: list[dict[int, int]] = field(default_factory=list)

    @classmethod
    def even(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 1: slots in turn."""
        return cls(shards, {s: s % shards for s in range(slots)})

    def rebalanced(self, weight: dict[int, int], shards: int | None = None) -> SlotMap:
        """The next version: slots move from shards above the mean to those below, largest first, until equal.

        weight: bytes of each slot.  Shards may be added.  Slots of a shard within the mean stay where they are.
        """
        n = shards or self.shards
        load = [0] * n
        held: list[list[int]] = [[] for _ in range(n)]
        spare: list[int] = []
        mean = sum(weight.values()) / n
        for s in sorted(self.home, key=lambda s: (-weight.get(s, 0), s)):
            w, k = weight.get(s, 0), self.home[s]
            if k < n and load[k] + w <= mean:
                load[k] += w
                held[k].append(s)
            else:
                spare.append(s)
        home = {s: k for k, slots in enumerate(held) for s in slots}
        heap = [(x, k) for k, x in enumerate(load)]
        heapq.heapify(heap)
        for s in spare:  # descending: the lightest shard takes the largest slot left
            x, k = heapq.heappop(heap)
            home[s] = k
            heapq.heappush(heap, (x + weight.get(s, 0), k))
        return SlotMap(n, home, self.version + 1, [*self.edits, {s: k for s, k in home.items() if self.home[s] != k}])

    def frame(self, spark: SparkSession) -> DataFrame:
        """(virtual_slot, shard, moved): moved says whether this version put the slot there."""
        moved = self.edits[-1] if self.edits else {}
        rows = ",".join(f"({s},{k},{str(s in moved).lower()})" for s, k in sorted(self.home.items()))
        return spark.sql(f"SELECT * FROM VALUES {rows} AS t(virtual_slot, shard, moved)")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write this version next to the others of the table at ``path``; an error where it exists already."""
        self.frame(spark).withColumn("shards", F.lit(self.shards)).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> DataFrame:
        """(version, virtual_slot, shard, moved, shards) of all versions."""
        return spark.read.schema("virtual_slot int, shard int, moved boolean, shards int, version int").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version, the newest by default, with the edits that led to it."""
        saved = cls.read(spark, path)
        version = version or saved.agg(F.max("version")).first()[0]
        rows = saved.where((F.col("version") == version) | F.col("moved") & (F.col("version") < version)).collect()
        mine = [r for r in rows if r.version == version]
        edits = [{r.virtual_slot: r.shard for r in rows if r.moved and r.version == v} for v in sorted({r.version for r in rows}) if v > 1]
        return cls(mine[0].shards, {r.virtual_slot: r.shard for r in mine}, version, edits)


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 of each record."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def placed(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, chunk, n, virtual_slot: n records alike in each row."""
    alike = records(docs).groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("rows"))
    last = F.floor((F.col("rows") - 1) / CHUNK)
    chunks = alike.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    n = F.least(F.lit(CHUNK).cast("long"), F.col("rows") - F.col("chunk") * CHUNK)
    return chunks.select("doc_id", "size", "text_crc32", "chunk", n.alias("n"), F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "chunk"), F.lit(slots)).cast("int").alias("virtual_slot"))


def running(count: Column | str, partition: str, *order: str) -> Column:
    """Sum of the counts before this row."""
    return F.sum(count).over(Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, current: SlotMap | None = None, save_to: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of each record.

    Shards get near-equal bytes.  ``slot`` numbers the records of a shard from 0, without gaps: slots of a shard
    stand one after the other, records of a slot by doc_id.  current: the map to rebalance.  save_to: table of
    map versions that gets the new one (and the first, if there is none); a scratch table by default.
    """
    spark = docs.sparkSession
    dealt = materialize(placed(docs, slots), "records")
    held = materialize(dealt.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows")), "slots")
    weight = {r.virtual_slot: r.bytes for r in held.select("virtual_slot", "bytes").collect()}  # a row for each slot at most
    if save_to is None:
        save_to = written(spark, f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}")
    if current is None:
        current = SlotMap.even(shards, slots)
        current.save(spark, save_to)
    made = current.rebalanced(weight, shards)
    made.save(spark, save_to)
    home = SlotMap.read(spark, save_to).where(F.col("version") == made.version)
    before = F.coalesce(running("rows", "shard", "virtual_slot"), F.lit(0)).alias("base")
    home = home.join(held, "virtual_slot").select("virtual_slot", "shard", "version", before)
    at = F.col("base") + F.coalesce(running("n", "virtual_slot", "doc_id", "size", "text_crc32", "chunk"), F.lit(0))
    return (
        dealt.join(F.broadcast(home), "virtual_slot")
        .withColumn("at", at)
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("at") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))
    )
