"""Sharding by fixed virtual slots.

Every record hashes into one of `n_slots` virtual slots, for good. The bytes of the slots are summed in
Spark; the sums (at most n_slots rows, whatever the input) decide a map from slots to shards. The map is a
small versioned table in a store: the first run makes version 0, later runs on the same store load the last version and
edit it, which moves whole slots; records never hash anew.

Defined cases: a null text has 0 bytes (size 1, CRC 0); rows with a null doc_id hash by their text instead, so that they
do not share a slot; repeated rows are rows of their own; an empty table gives an empty result; other columns
pass through untouched unless they have the name of a result column, which then wins.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

N_SLOTS = 8192


def byte_size(text: str = "text") -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def virtual_slot(key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> Column:
    """The fixed slot of a record: by its key, or by its text if that is null."""
    return F.pmod(F.when(F.col(key).isNull(), F.xxhash64(F.lit("no key"), F.col(text))).otherwise(F.xxhash64(F.col(key))), F.lit(n_slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """Version `version` of the map: shards[slot] is the shard of the slot."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    @staticmethod
    def balanced(slot_bytes: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
        """Version 0: the largest slot first, each to the shard with the fewest bytes."""
        loads, shards = [0] * n_shards, [0] * n_slots
        for slot in sorted(range(n_slots), key=lambda s: (-slot_bytes.get(s, 0), s)):
            to = min(range(n_shards), key=lambda k: (loads[k], k))
            shards[slot], loads[to] = to, loads[to] + slot_bytes.get(slot, 0)
        return SlotMap(0, n_shards, tuple(shards))

    def loads(self, slot_bytes: dict[int, int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shards):
            out[shard] += slot_bytes.get(slot, 0)
        return out

    def rebalanced(self, slot_bytes: dict[int, int], n_shards: int | None = None) -> SlotMap:
        """The next version: slots leave the fullest shard for the emptiest while that narrows their gap; the others stay."""
        k = n_shards or self.n_shards
        if k < self.n_shards:
            raise ValueError("the number of shards can only grow")
        shards, loads = list(self.shards), self.loads(slot_bytes) + [0] * (k - self.n_shards)
        held = [sorted((slot_bytes.get(s, 0), s) for s, x in enumerate(shards) if x == i) for i in range(k)]
        while True:
            full, empty = max(range(k), key=lambda i: (loads[i], -i)), min(range(k), key=lambda i: (loads[i], i))
            gap = loads[full] - loads[empty]
            fits = [x for x in held[full] if 0 < x[0] < gap]
            if not fits:
                return replace(self, version=self.version + 1, n_shards=k, shards=tuple(shards))
            best = min(fits, key=lambda x: (abs(gap - 2 * x[0]), x[1]))
            held[full].remove(best)
            held[empty].append(best)
            shards[best[1]], loads[full], loads[empty] = empty, loads[full] - best[0], loads[empty] + best[0]

    def lookup(self, slot: Column) -> Column:
        """The shard of a slot, as one literal array of n_slots numbers: bounded by the number of slots, no join."""
        return F.get(F.split(F.lit(",".join(map(str, self.shards))), ",").cast("array<int>"), slot)


class SlotMapStore:
    """The versions of a slot map, as Parquet tables (slot, shard) in folders version=0, 1, ... below `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def save(self, slot_map: SlotMap) -> None:
        """Add a version; one that exists is never written over."""
        rows = self.spark.range(len(slot_map.shards)).select(F.col("id").cast("int").alias("slot"), slot_map.lookup(F.col("id").cast("int")).alias("shard"), F.lit(slot_map.n_shards).alias("n_shards"))
        rows.coalesce(1).write.parquet(f"{self.path}/version={slot_map.version}")

    def load(self, version: int) -> SlotMap:
        """A version, n_slots rows."""
        rows = sorted((r.slot, r.shard, r.n_shards) for r in self.spark.read.parquet(f"{self.path}/version={version}").collect())
        return SlotMap(version, rows[0][2], tuple(r[1] for r in rows))

    def current(self, slot_bytes: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
        """The map for these bytes: the last version as it is if nothing has to move, else edited and stored as the next one; version 0 on an empty store."""
        known = self.versions()
        if not known:
            self.save(SlotMap.balanced(slot_bytes, n_shards, n_slots))
            return self.load(0)
        last = self.load(known[-1])
        edited = last.rebalanced(slot_bytes, n_shards)
        if edited.shards == last.shards and edited.n_shards == last.n_shards:
            return last
        self.save(edited)
        return self.load(edited.version)


def slot_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> dict[int, int]:
    """Bytes of each slot: partial sums in every task, then at most n_slots rows to the driver."""
    return _sums(df.select(virtual_slot(key, text, n_slots).alias("virtual_slot"), byte_size(text).alias("size")))


def _sums(sized: DataFrame) -> dict[int, int]:
    return {r.virtual_slot: r.bytes for r in sized.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()}


def shard_documents(df: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS, store: SlotMapStore | None = None) -> DataFrame:
    """df with the columns virtual_slot, shard and map_version, by the current map of `store` for df's bytes (a new store without one)."""
    store = store or SlotMapStore(df.sparkSession, f"{Scratch(df.sparkSession, 'slot-map').path}")
    slot_map = store.current(slot_bytes(df, key, text, n_slots), n_shards, n_slots)
    return df.withColumn("virtual_slot", virtual_slot(key, text, n_slots)).withColumn("shard", slot_map.lookup(F.col("virtual_slot"))).withColumn("map_version", F.lit(slot_map.version))


def number_rows(sharded: DataFrame, order: tuple[str, ...] = ("doc_id",), into: str = "slot") -> DataFrame:
    """Number the rows of every shard from 0 without gaps.

    A shard is never sorted as a whole: the rows of each virtual slot are counted (n_slots sums), a running sum over the
    slots of a shard gives the offset of each slot, and rows are numbered inside their slot, thousands of them in parallel.
    """
    counts = sharded.groupBy("shard", "virtual_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("virtual_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("virtual_slot").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return sharded.withColumn("_rank", F.row_number().over(inside)).join(offsets, "virtual_slot").withColumn(into, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_before", "_rank")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 of all documents under the law `bytes`. Texts are read once."""
    run = Scratch(spark, "op2")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32")
    sized = run.write(docs.select("doc_id", byte_size().alias("size"), crc, virtual_slot().alias("virtual_slot"), F.xxhash64("text").alias("hash")), "sized")
    slot_map = SlotMapStore(spark, f"{run.path}/map").current(_sums(sized), 16)
    sharded = sized.withColumns({"shard": slot_map.lookup(F.col("virtual_slot")), "map_version": F.lit(slot_map.version)})
    return number_rows(sharded, ("doc_id", "hash")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
