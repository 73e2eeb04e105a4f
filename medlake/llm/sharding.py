"""Sharding through fixed virtual slots.

Records hash into a fixed number of virtual slots; bytes are added up per slot,
and a versioned table maps each slot to a shard. A record never changes its slot:
rebalancing edits the map only.  All of it is DataFrame and SQL functions.

Nulls: a null text counts no bytes and has the checksum of the empty text; a null
doc_id hashes like any other value.  Repeated rows share a slot and get distinct
places.  An empty table gives an empty result.  Further columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.llm.common import whole_text, written
from medlake.session import shared_dir

SLOTS = 4096
ROW_OVERHEAD = 8
MAP_SCHEMA = "version int, vslot int, shard int"


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of each record."""
    text = whole_text()
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        virtual_slot(F.col("doc_id"), slots).alias("vslot"),
    )


def slot_totals(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """bytes and n_rows of every slot, empty ones included; as many rows as slots."""
    held = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    every = records.sparkSession.range(0, slots, 1, 1).select(F.col("id").cast("int").alias("vslot"))
    return every.join(held, "vslot", "left").fillna(0, ["bytes", "n_rows"])


def first_map(totals: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: largest slot first, each to the shard that is lightest so far.

    The fold runs over one array with an entry per slot, a fixed number.
    """
    ordered = totals.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot"))).alias("s"))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("shards")
    )

    def place(acc: Column, x: Column) -> Column:
        to = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        return F.struct(
            F.transform(acc["loads"], lambda v, j: F.when(j == to, v - x["less"]).otherwise(v)).alias("loads"),
            F.concat(acc["shards"], F.array(to)).alias("shards"),
        )

    placed = ordered.select("s", F.aggregate("s", start, place, lambda a: a["shards"]).alias("to"))
    return placed.select(F.explode(F.arrays_zip(F.col("s.vslot").alias("vslot"), F.col("to").alias("shard"))).alias("m")).select(
        F.lit(1).alias("version"), "m.vslot", "m.shard"
    )


def grown_map(slot_map: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version for one more shard: each shard hands over small slots up to its excess; nothing else moves."""
    by_shard = Window.partitionBy("shard")
    upto = by_shard.orderBy("bytes", "vslot").rowsBetween(Window.unboundedPreceding, 0)
    held = slot_map.join(totals, "vslot").withColumns(
        {"load": F.sum("bytes").over(by_shard), "upto": F.sum("bytes").over(upto)}
    )
    share = totals.agg((F.sum("bytes") / F.lit(shards + 1)).alias("share"))
    return held.crossJoin(F.broadcast(share)).select(
        (F.col("version") + 1).alias("version"),
        "vslot",
        F.when(F.col("upto") <= F.col("load") - F.col("share"), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"),
    )


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored maps; earlier versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """The given version of the stored map, or the newest."""
    maps = spark.read.parquet(path).select("version", "vslot", "shard")
    if version is None:
        newest = maps.agg(F.max("version").alias("version"))
        return maps.join(F.broadcast(newest), "version").select("version", "vslot", "shard")
    return maps.where(F.col("version") == version)


def assign(records: DataFrame, slot_map: DataFrame, totals: DataFrame) -> DataFrame:
    """The shard of each record and its place in it, from 0 without gaps.

    Places are counted within each virtual slot, whose rows are few, and moved by the
    rows of the earlier slots of the shard; no task sees a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slot_map.join(totals, "vslot").select(
        "vslot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("first_place")
    )
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("nth", F.row_number().over(within) - 1)
        .join(F.broadcast(slots), "vslot")  # as many rows as slots, a parameter
        .withColumn("slot", (F.col("first_place") + F.col("nth")).cast("long"))
    )


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (place in the shard) and vslot, with byte totals near equal.

    The map is stored as version 1 under `maps`, a new folder of the shared one where none is named, and read from there;
    where `maps` holds versions already, records go by the newest of them.
    """
    spark = docs.sparkSession
    records = sized(docs, slots)
    totals = written(slot_totals(records, slots), "totals")
    if maps is None:
        maps = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
        store_map(first_map(totals, shards), maps)
    return assign(records, load_map(spark, maps), totals).select("doc_id", "size", "text_crc32", "shard", "slot", "vslot")
