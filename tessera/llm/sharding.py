"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots, the bytes of each slot are summed, and a table
(version, vslot, shard) assigns slots to shards so that the shards' bytes are nearly equal (law ``bytes``).
Rebalancing edits that table: a new version moves some slots and leaves the others where they are; rows
follow their slot. The table is kept in the shared folder, a version beside the other.

A record's slot is the hash of its text, so that equal texts share a slot and a shard; a group of copies
with more than 1 / ``GROUP_SHARE`` of a shard's bytes is spread by doc_id and row number instead. Within a shard,
rows are numbered without gaps: slots give the offsets, and the numbering inside a slot is over slices of it by
the same two, so no task sees a whole shard, whatever the doc_ids.

Defined results: null text has no bytes and size 1; rows with null or repeated doc_id are rows like any
other; an empty table gives no rows; other columns are ignored. All of it is DataFrame functions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, cut, shared_dir
from .common import numbered as with_key

SHARDS, SLOTS, GROUP_SHARE, SLICES = 16, 4096, 2, 64


def sized(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, row, size, text_crc32, text_hash) of every document; the text goes no further."""
    text = F.coalesce("text", F.lit(""))
    return with_key(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"{KEY}.row").alias("row"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(slots)).cast("int")


def place(rows: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Adds vslot. Copies share one, but for groups too large for that."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    large = rows.groupBy("text_hash").agg(F.sum("size").alias("bytes")).join(F.broadcast(total)).where(F.col("bytes") * (shards * GROUP_SHARE) > F.col("total")).select("text_hash", F.lit(True).alias("spread"))
    # fewer than shards * GROUP_SHARE rows, as the sums cannot exceed the total
    marked = rows.join(F.broadcast(large), "text_hash", "left")
    own = F.xxhash64("text_hash", F.when(F.col("spread"), F.xxhash64("doc_id", "row")).otherwise(F.lit(0)))
    return marked.withColumn("vslot", virtual_slot(own, slots)).drop("spread")


def slot_bytes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def assign(sums: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The first version of the map: slots from the largest down, each to the shard with the fewest bytes.
    ``sums`` has at most one row for each virtual slot, so one array of them is small."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("b"), "vslot")))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("to"))

    def step(acc: Column, x: Column) -> Column:
        least = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int") - 1
        load = F.transform(acc["load"], lambda v, i: F.when(i == least, v - x["b"]).otherwise(v))
        return F.struct(load.alias("load"), F.array_append(acc["to"], least).alias("to"))

    to = sums.agg(ordered.alias("slots")).select("slots", F.aggregate("slots", start, step)["to"].alias("to"))
    return to.select(F.explode(F.arrays_zip("slots", "to")).alias("x")).select(F.lit(1).alias("version"), F.col("x.slots.vslot").alias("vslot"), F.col("x.to").alias("shard"))


def rebalance(slot_map: DataFrame, sums: DataFrame, shards: int) -> DataFrame:
    """The next version for ``shards`` shards, more than before: each new shard takes slots from the others
    until it has its share; all other slots stay."""
    old = slot_map.agg(F.max("version").alias("v"), (F.max("shard") + 1).alias("n"))
    known = slot_map.join(sums, "vslot", "left").join(F.broadcast(old)).where("version = v")
    # of each old shard, the share that the new shards need, dealt to them in turn
    order = Window.partitionBy("shard").orderBy(F.xxhash64("vslot"))
    whole = Window.partitionBy("shard")
    size = F.coalesce("bytes", F.lit(0))
    ranked = known.withColumn("upto", F.sum(size).over(order)).withColumn("all", F.sum(size).over(whole)).withColumn("k", F.row_number().over(order))
    moves = (F.col("upto") <= F.col("all") * (shards - F.col("n")) / shards) & (F.col("n") < shards)
    new = F.col("n") + F.pmod(F.col("k") + F.col("shard"), F.greatest(shards - F.col("n"), F.lit(1)))
    return ranked.select((F.col("v") + 1).alias("version"), "vslot", F.when(moves, new).otherwise(F.col("shard")).cast("int").alias("shard"))


def store(slot_map: DataFrame, folder: str) -> DataFrame:
    """Append a version of the map to the table in ``folder`` and read the table back."""
    slot_map.coalesce(1).write.mode("append").parquet(folder)
    return slot_map.sparkSession.read.schema(slot_map.schema).parquet(folder)


def latest(slot_map: DataFrame) -> DataFrame:
    """The last version of a stored map."""
    return slot_map.join(F.broadcast(slot_map.agg(F.max("version").alias("version"))), "version")


def numbered(placed: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds shard and slot, the row's number in its shard: from 0, without gaps."""
    parts = placed.withColumn("slice", F.pmod(F.xxhash64("doc_id", "row", F.lit("slice")), F.lit(SLICES)).cast("int"))
    counts = parts.groupBy("vslot", "slice").count().join(F.broadcast(slot_map.select("vslot", "shard")), "vslot")
    # at most SLOTS * SLICES counts, summed up within each shard
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("vslot", "slice")) - F.col("count")
    offsets = counts.select("vslot", "slice", "shard", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("vslot", "slice").orderBy("doc_id", "text_hash", "row")) - 1
    return parts.withColumn("within", within).join(offsets, ["vslot", "slice"]).withColumn("slot", F.col("before") + F.col("within"))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot) of every document."""
    placed = cut(place(sized(docs), shards, slots), "placed")
    folder = f"{shared_dir(docs.sparkSession)}/slot-map-{uuid.uuid4().hex}"
    slot_map = store(assign(slot_bytes(placed), shards), folder)
    return numbered(placed, slot_map).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")
