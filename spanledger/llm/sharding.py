"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots, whose number never changes. Bytes are summed per slot, and a small map says which shard has which slot.
The map is a table with versions: growing or rebalancing writes a new version in which as few slots as possible have moved.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanledger.llm.common import cut_lineage, fresh_names

#: Slots for ever; also the bound of everything that reaches the driver or is broadcast.
SLOTS = 16_384
MAP = "version int, virtual_slot int, shard int, bytes long, rows long"


def record_size(text: str = "text"):
    """UTF-8 bytes of the text (null: none) and eight more."""
    return F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long") + 8


def virtual_slot(key: str = "doc_id", text: str = "text", slots: int = SLOTS):
    """Slot of a record. The text is hashed as well, so a key that repeats a lot does not fill one slot; null key or text is hashed as null."""
    return F.pmod(F.xxhash64(key, text), F.lit(slots)).cast("int")


def numbered_copies(records: DataFrame, same: list[str], out: str = "copy") -> DataFrame:
    """Adds the number of each row among rows with equal ``same``, from 0: all of 0 where a row has no copy.

    Copies are counted task by task, so a group of any size is numbered by the tasks that hold its rows, and only one count per
    group and task is ordered. Which copy has which number is no matter, as they are equal."""
    part, ahead, n = fresh_names(records, "part", "ahead", "n")
    rows = cut_lineage(records.withColumn(part, F.spark_partition_id()))
    counts = rows.groupBy(*same, part).agg(F.count("*").alias(n))
    earlier = Window.partitionBy(*same).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*same, part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(ahead), F.sum(n).over(Window.partitionBy(*same)).alias(n))
    again = cut_lineage(before.where(F.col(n) > 1).drop(n))
    found = rows.join(again, [*same, part], "left")
    own = F.row_number().over(Window.partitionBy(*same, part).orderBy(F.lit(0))) - 1
    several = found.where(F.col(ahead).isNotNull()).withColumn(out, F.col(ahead) + own)
    return found.where(F.col(ahead).isNull()).withColumn(out, F.lit(0).cast("long")).unionByName(several).drop(part, ahead)


def slot_loads(records: DataFrame, size: str = "size", slot: str = "virtual_slot") -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of all slots in use: at most SLOTS rows, summed on the executors."""
    return sorted(tuple(r) for r in records.groupBy(slot).agg(F.sum(size).alias("b"), F.count("*").alias("n")).collect())


def first_map(loads: list[tuple[int, int, int]], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Shard of every slot: heaviest slot first, always to the lightest shard. Unused slots are dealt in turn."""
    free = [(0, s) for s in range(shards)]
    out = {}
    for slot, size, _ in sorted(loads, key=lambda x: (-x[1], x[0])):
        have, shard = heapq.heappop(free)
        out[slot] = shard
        heapq.heappush(free, (have + size, shard))
    for slot in range(slots):
        out.setdefault(slot, slot % shards)
    return out


def rebalanced(old: dict[int, int], loads: list[tuple[int, int, int]], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """The old map with few edits: slots of shards that no longer exist move; then, while a shard is over the mean by more than
    ``tolerance``, its best fitting slot moves to the lightest shard. With one more shard, slots move only into that one."""
    size = {s: b for s, b, _ in loads}
    out = dict(old)
    load, own = [0] * shards, [[] for _ in range(shards)]
    homeless = []
    for slot, shard in out.items():
        if shard < shards:
            load[shard] += size.get(slot, 0)
            own[shard].append(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-size.get(s, 0), s)):
        shard = min(range(shards), key=lambda s: (load[s], s))
        out[slot] = shard
        load[shard] += size.get(slot, 0)
        own[shard].append(slot)
    mean = sum(load) / shards
    for _ in range(len(out)):
        full, light = max(range(shards), key=lambda s: load[s]), min(range(shards), key=lambda s: load[s])
        room = min(load[full] - mean, mean - load[light])
        fits = [s for s in own[full] if 0 < size.get(s, 0) <= max(room, (load[full] - load[light]) / 2)]
        if load[full] <= mean * (1 + tolerance) or not fits:
            break
        slot = max(fits, key=lambda s: (size[s], -s))
        own[full].remove(slot)
        own[light].append(slot)
        out[slot] = light
        load[full] -= size[slot]
        load[light] += size[slot]
    return out


def store_map(spark: SparkSession, folder: str, version: int, owner: dict[int, int], loads: list[tuple[int, int, int]]) -> None:
    """Writes one version of the map below ``folder``; a version that exists is an error."""
    by = {s: (b, n) for s, b, n in loads}
    rows = [(version, slot, shard, *by.get(slot, (0, 0))) for slot, shard in sorted(owner.items())]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{folder}/version={version}")


def shard_places(records: DataFrame, owner: DataFrame, order: list[str], slot: str = "virtual_slot") -> DataFrame:
    """Adds ``shard`` and ``slot``, the gapless place in the shard from 0: the rows of earlier virtual slots and the rank in the own one.

    A window sees one virtual slot at a time; what stands before it comes from the map. Columns called shard or slot are replaced."""
    # At most SLOTS rows.
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside, ahead = fresh_names(records, "inside", "ahead")
    small = F.broadcast(owner.select(F.col("virtual_slot").alias(slot), "shard", before.cast("long").alias(ahead)))
    rank = F.row_number().over(Window.partitionBy(slot).orderBy(*order)) - 1
    out = records.drop("shard", "slot").withColumn(inside, rank).join(small, slot)
    return out.withColumn("slot", F.col(ahead) + F.col(inside)).drop(inside, ahead)


def shard_records(spark: SparkSession, docs: DataFrame, folder: str, shards: int, key: str = "doc_id", version: int = 1, slots: int = SLOTS) -> DataFrame:
    """Deals all records into shards of near equal bytes and stores the map: key, size, text_crc32, virtual_slot, shard, slot, map_version.

    Null text has no bytes; null keys, equal keys and repeated rows are records like others (identical rows go to slots by their number among
    them, so that no slot has them all). Texts of any length count with all their bytes. An empty table stores a map and gives no rows. Only the key and
    figures of the text are shuffled."""
    records = docs.select(key, record_size().alias("size"), F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
                          virtual_slot(key, "text", slots).alias("virtual_slot"), F.xxhash64(key, "text").alias("record"))
    records = numbered_copies(records, ["record"])
    spread = F.when(F.col("copy") == 0, F.col("virtual_slot")).otherwise(F.pmod(F.xxhash64("record", "copy"), F.lit(slots)).cast("int"))
    records = cut_lineage(records.select(key, "size", "text_crc32", spread.alias("virtual_slot")))
    loads = slot_loads(records)
    store_map(spark, folder, version, first_map(loads, shards, slots), loads)
    return shard_places(records, load_map(spark, folder, version), [key, "text_crc32"]).withColumn("map_version", F.lit(version))
