"""Sharding by fixed virtual slots.

A hash of a record's text alone decides its slot, one of thousands, for good; so equal texts
are together, and stay together when slots move. Only the map from slots to shards is
decided by the data: bytes are summed per slot and slots dealt to shards so that shards get
nearly equal bytes (but for a slot that is larger than a shard should be, as one is that
holds a large group of equal texts: it is a shard's only one then). The map is a small
versioned table (one row per slot); rebalancing edits it and moves slots, never single
records. Versions are written to a folder; a run given that folder follows the newest, or
writes the first. For another number of shards it writes the next version. A version that
wasn't written whole is an error.

The map has as many rows as there are slots, whatever the input, so it is handled on the
driver and broadcast. A shard's rows are numbered slot by slot, and a slot with many rows
part by part: no task numbers more than about a PARTS-th of all rows.

Null texts are empty: they have no bytes and one slot. A null id is a record like any other.
Ties: rows of equal text, repeated rows and rows that share an id included, share a slot and
are numbered each, in no set order. Very long texts are hashed whole where they lie; they are
not shuffled. An empty table gives an empty result and a map that deals slots in turn. Other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.llm._spark import saved

SLOTS = 8192
#: Into how many parts all rows are split at least for numbering.
PARTS = 1024
#: Bytes a record has besides its text.
OVERHEAD = 16


def virtual_slot(text: Column, slots: int = SLOTS) -> Column:
    """The slot of a text; null counts as empty."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """Which shard has each slot, and how many times that was edited."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def balanced(cls, size: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
        """Largest slot first, each to the shard with the fewest bytes so far (then fewest slots)."""
        heap = [(0, 0, s) for s in range(shards)]
        shard_of = [0] * slots
        for slot in sorted(range(slots), key=lambda x: (-size.get(x, 0), x)):
            total, n, s = heap[0]
            shard_of[slot] = s
            heapq.heapreplace(heap, (total + size.get(slot, 0), n + 1, s))
        return cls(1, shards, tuple(shard_of))

    def rebalanced(self, size: dict[int, int], shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
        """The next version: slots move from the fullest shard to the emptiest until they differ by at most `tolerance` of the mean, or no move helps. Shards may be added; of removed ones all slots move."""
        shards = shards or self.shards
        total = [0] * shards
        of = list(self.shard_of)
        homeless = [x for x, s in enumerate(of) if s >= shards]
        held: list[list[int]] = [[] for _ in range(shards)]
        for slot, s in enumerate(of):
            if s < shards:
                total[s] += size.get(slot, 0)
                held[s].append(slot)
        for slot in sorted(homeless, key=lambda x: (-size.get(x, 0), x)):
            s = min(range(shards), key=lambda i: (total[i], i))
            of[slot] = s
            total[s] += size.get(slot, 0)
            held[s].append(slot)
        limit = tolerance * sum(total) / shards
        while True:
            hi, lo = max(range(shards), key=lambda i: (total[i], -i)), min(range(shards), key=lambda i: (total[i], i))
            gap = total[hi] - total[lo]
            fits = [x for x in held[hi] if 0 < size.get(x, 0) < gap]
            if gap <= limit or not fits:
                return replace(self, version=self.version + 1, shards=shards, shard_of=tuple(of))
            slot = min(fits, key=lambda x: (abs(gap - 2 * size[x]), x))
            held[hi].remove(slot)
            held[lo].append(slot)
            of[slot] = lo
            total[hi] -= size[slot]
            total[lo] += size[slot]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, slot, s, self.shards, len(self.shard_of)) for slot, s in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "map_version int, virtual_slot int, shard int, shards int, slots int")

    def write(self, spark: SparkSession, folder: str) -> SlotMap:
        """Written under a passing name and renamed when whole, so no run finds half a version. A version is never written over: a number that is taken leads to the next one. Returns the map with the number it got."""
        self.table(spark).coalesce(1).write.parquet(draft := f"{folder}/_draft-{uuid.uuid4().hex}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        number = self.version
        while files.exists(path(f"{folder}/version={number}")) or not files.rename(path(draft), path(f"{folder}/version={number}")):
            number += 1
        return replace(self, version=number)

    @classmethod
    def read(cls, spark: SparkSession, folder: str, version: int | None = None) -> SlotMap | None:
        """The newest whole version in the folder, or the one asked for; None if there is none. What a broken run has left is passed over. A version's number is its folder's."""
        try:
            kept = spark.read.schema("virtual_slot int, shard int, shards int, slots int, version int").parquet(folder)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        each = kept.groupBy("version").agg(F.count_distinct("virtual_slot").alias("n"), F.max("slots").alias("slots")).where("n = slots")
        newest = each.agg(F.max("version")).first()[0]
        if version is not None and not each.where(F.col("version") == version).count():
            raise ValueError(f"version {version} of the map in {folder} is missing or not whole")
        version = newest if version is None else version
        if version is None:
            return None
        rows = sorted(kept.where(F.col("version") == version).select("virtual_slot", "shard", "shards").collect())
        return cls(version, rows[0][2], tuple(r[1] for r in rows))


def slot_sizes(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot; at most one entry for each slot of the map."""
    rows = records.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    return {r["virtual_slot"]: (r["size"], r["n"]) for r in rows}


def shard(documents: DataFrame, shards: int = 40, slots: int = SLOTS, slot_map: SlotMap | None = None, id_column: str = "doc_id", text_column: str = "text", maps: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot (its place in the shard), virtual_slot, map_version. With slot_map, a map kept from before is followed; with maps, the newest of that folder."""
    return placed(documents, shards, slots, slot_map, id_column, text_column, maps)[0]


def placed(documents: DataFrame, shards: int = 40, slots: int = SLOTS, slot_map: SlotMap | None = None, id_column: str = "doc_id", text_column: str = "text", maps: str | None = None) -> tuple[DataFrame, SlotMap]:
    """The rows of shard(), and the map that placed them."""
    spark = documents.sparkSession
    slot_map = known = slot_map or (SlotMap.read(spark, maps) if maps else None)
    slots = len(slot_map.shard_of) if slot_map else slots
    text = F.encode(F.coalesce(F.col(text_column), F.lit("")), "utf-8")
    records = saved(
        documents.select(
            F.col(id_column).alias("doc_id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            virtual_slot(F.col(text_column), slots).alias("virtual_slot"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "records",
    )
    sizes = slot_sizes(records)
    by_bytes = {k: v[0] for k, v in sizes.items()}
    slot_map = slot_map or SlotMap.balanced(by_bytes, shards, slots)
    if maps:
        # A kept map is edited when its shards no longer have nearly equal bytes.
        edited = slot_map.rebalanced(by_bytes, shards)
        if (edited.shards, edited.shard_of) != (slot_map.shards, slot_map.shard_of):
            slot_map = edited if known else replace(edited, version=slot_map.version)
        if slot_map is not known:
            slot_map = slot_map.write(spark, maps)
    each = max(1, -(-sum(n for _, n in sizes.values()) // PARTS))
    parts = [-(-sizes[x][1] // each) if x in sizes else 1 for x in range(slots)]
    shard_of = spark.createDataFrame([(x, s, parts[x]) for x, s in enumerate(slot_map.shard_of)], "virtual_slot int, shard int, parts int")
    dealt = records.join(F.broadcast(shard_of), "virtual_slot").withColumn("part", F.pmod("number", "parts").cast("int"))
    counts = {(r["virtual_slot"], r["part"]): r["n"] for r in dealt.groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, begins = [0] * slot_map.shards, []
    for slot, s in enumerate(slot_map.shard_of):
        for part in range(parts[slot]):
            begins.append((slot, part, before[s]))
            before[s] += counts.get((slot, part), 0)
    places = spark.createDataFrame(begins, "virtual_slot int, part int, begin long")
    order = Window.partitionBy("virtual_slot", "part").orderBy("number")
    numbered = dealt.withColumn("n", F.row_number().over(order))
    rows = numbered.join(F.broadcast(places), ["virtual_slot", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("n") - 1).alias("slot"), "virtual_slot", F.lit(slot_map.version).alias("map_version")
    )
    return rows, slot_map
