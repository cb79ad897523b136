"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots. A versioned map sends slots to shards:
version 0 deals them out in turn, each later version is an edit of the one before that
moves or swaps whole slots until the shards hold nearly the same bytes. Only the map, which
has one row per slot whatever the input, is edited on the driver.

Defined results: a NULL text has no bytes and the checksum 0; a NULL key is a value like
another; rows that agree in key and text share a slot; an empty table gives no rows and an
unedited map. Columns of the input other than key and text are not looked at, so their names
cannot clash.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendlens.llm.scratch import written

SLOTS = 8192
SHARDS = 40
ROW_BYTES = 16
#: Largest difference between two shards, as a share of the mean, that ends the edits.
TOLERANCE = 0.001
#: Rows of a shard that are put in order by one task, about.
ORDERED_ROWS = 25_000


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: the shard of each slot."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def initial(cls, slots: int = SLOTS, shards: int = SHARDS) -> SlotMap:
        return cls(0, shards, tuple(slot % shards for slot in range(slots)))

    def table(self, spark: SparkSession) -> DataFrame:
        """(version, virtual_slot, shard), one row per slot."""
        listed = F.from_json(F.lit(json.dumps(self.shard_of)), "array<int>")
        return spark.range(len(self.shard_of), numPartitions=1).select(
            F.lit(self.version).alias("version"),
            F.col("id").cast("int").alias("virtual_slot"),
            F.get(listed, F.col("id").cast("int")).alias("shard"),
        )


def rebalanced(
    made: SlotMap, bytes_of: dict[int, int], shards: int | None = None, tolerance: float = TOLERANCE
) -> SlotMap:
    """The next version: slots moved from the fullest to the emptiest shard, or swapped.

    With a larger number of shards the new ones start empty and are filled by the same edits.
    """
    count = shards or made.shards
    shard_of = [shard if shard < count else slot % count for slot, shard in enumerate(made.shard_of)]
    held: list[list[tuple[int, int]]] = [[] for _ in range(count)]
    for slot, shard in enumerate(shard_of):
        if bytes_of.get(slot):
            insort(held[shard], (bytes_of[slot], slot))
    total = [sum(size for size, _ in slots) for slots in held]
    allowed = tolerance * sum(total) / count

    def move(edge: tuple[int, int], source: int, target: int) -> None:
        held[source].remove(edge)
        insort(held[target], edge)
        total[source] -= edge[0]
        total[target] += edge[0]
        shard_of[edge[1]] = target

    for _ in range(4 * len(shard_of)):
        full = max(range(count), key=total.__getitem__)
        empty = min(range(count), key=total.__getitem__)
        gap = total[full] - total[empty]
        if gap <= allowed:
            break
        best = _best_edit(held[full], held[empty], gap)
        if best is None:
            break
        given, taken = best
        move(given, full, empty)
        if taken is not None:
            move(taken, empty, full)
    return SlotMap(made.version + 1, count, tuple(shard_of))


def _best_edit(full: list, empty: list, gap: int):
    """The move or swap that comes nearest to half the gap; none if no edit narrows it."""
    best, miss = None, gap / 2
    for taken in [None, *empty]:
        back = 0 if taken is None else taken[0]
        at = bisect_left(full, (back + gap / 2, -1))
        for given in full[max(0, at - 1) : at + 1]:
            shift = given[0] - back
            if 0 < shift < gap and abs(shift - gap / 2) < miss:
                best, miss = (given, taken), abs(shift - gap / 2)
    return best


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def sharded(
    docs: DataFrame,
    shards: int = SHARDS,
    slots: int = SLOTS,
    key: str = "doc_id",
    text: str = "text",
    current: SlotMap | None = None,
) -> tuple[DataFrame, SlotMap]:
    """Each record's size, checksum, virtual slot, shard and place in the shard; the map used.

    `current` is the map in force; its next version is fitted to the bytes found.
    """
    placed = written(
        docs.select(
            F.col(key).alias("doc_id"),
            record_size(F.col(text)).alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
            F.pmod(F.xxhash64(key, text), F.lit(slots)).cast("int").alias("virtual_slot"),
            F.spark_partition_id().alias("part"),
        ),
        "placed",
    )
    # At most one row per slot, so the driver's share does not grow with the input.
    filled = (
        placed.groupBy("virtual_slot")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .collect()
    )
    rows = sum(row["rows"] for row in filled)
    made = rebalanced(
        current or SlotMap.initial(slots, shards),
        {row["virtual_slot"]: row["bytes"] for row in filled},
        shards,
    )
    stored = written(made.table(docs.sparkSession), "slot_map")

    # Places are counted in buckets of write tasks, so that no task orders a whole shard.
    buckets = max(64, rows // (shards * ORDERED_ROWS))
    mapped = placed.join(stored, "virtual_slot").withColumn(
        "bucket", F.pmod(F.col("part"), F.lit(buckets))
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        mapped.groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            F.col("shard").alias("of_shard"),
            F.col("bucket").alias("of_bucket"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
        )
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    out = (
        mapped.withColumn("place", F.row_number().over(inside))
        .join(
            offsets, (F.col("shard") == F.col("of_shard")) & (F.col("bucket") == F.col("of_bucket"))
        )
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            F.col("version").alias("map_version"),
        )
    )
    return out, made
