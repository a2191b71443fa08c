"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots, far more than there are shards. The bytes of each slot are added up, and
a versioned table maps slots to shards; records never move one by one, the map is edited instead. All of it is DataFrame
and SQL expressions. The map has one row a slot, so its size is fixed whatever the input.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, cut, shared_path, spread, table

SLOTS = 4096


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes and 1), crc and spread (a hash) of each row. Null texts count as empty.

    The texts are read here only. Rows that repeat so often that one slot would gather over a thousandth of all get hashes
    of their own each.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    rows = cut(rows.withColumn("same", F.xxhash64("id", "crc")))
    return cut(rows.withColumn("spread", spread(F.col("same"), rows, "same")).drop("same"))


def slot_of(slots: int) -> Column:
    """The virtual slot of a row."""
    return F.pmod("spread", F.lit(slots)).cast("int")


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, bytes and n of all slots, empty ones too."""
    held = rows.groupBy(slot_of(slots).alias("virtual_slot")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(F.broadcast(held), "virtual_slot", "left").na.fill(0, ["bytes", "n"])


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of a map, made before any bytes are known: slots in equal ranges. virtual_slot, shard, version."""
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), F.floor(F.col("id") * shards / slots).cast("int").alias("shard"), F.lit(1).alias("version"))


def rebalanced(old: DataFrame, loads: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """The next version of a map, edited so that the shards hold near equal bytes.

    Slots go by falling bytes, each to the shard with the least bytes so far; of equal shards to the one that holds the
    slot now, else to the lowest. So the largest and the smallest shard differ by one slot's bytes at most as long as no
    slot alone exceeds a shard's share. ``shards`` may be more or fewer than before. The fold runs over ``slots`` rows.
    """
    rows = old.join(F.broadcast(loads.select("virtual_slot", "bytes")), "virtual_slot")
    gathered = rows.agg(F.max("version").alias("version"), F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual_slot", "shard"))).alias("all"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("to"))

    def place(state: Column, x: Column) -> Column:
        least = F.array_min(state["loads"])
        now = F.when(F.get(state["loads"], x["shard"]) == least, x["shard"]).otherwise(F.array_position(state["loads"], least).cast("int") - 1)
        loads = F.transform(state["loads"], lambda b, i: F.when(i == now, b - x["minus"]).otherwise(b))
        return F.struct(loads.alias("loads"), F.concat(state["to"], F.array(now)).alias("to"))

    placed = gathered.select("version", "all", F.aggregate("all", start, place)["to"].alias("to"))
    new = placed.select("version", F.explode(F.arrays_zip("all", "to")).alias("x"))
    return new.select("x.all.virtual_slot", F.col("x.to").alias("shard"), (F.col("version") + 1).alias("version"))


def grown(old: DataFrame, shards: int) -> DataFrame:
    """The next version of a map with one shard more: every shard gives its highest slots to the new one, no others move."""
    per = Window.partitionBy("shard").orderBy(F.col("virtual_slot").desc())
    rank, held = F.row_number().over(per), F.count("*").over(Window.partitionBy("shard"))
    moved = old.withColumns({"rank": rank, "held": held})
    to = F.when(F.col("rank") <= F.floor(F.col("held") / (shards + 1)), F.lit(shards)).otherwise(F.col("shard"))
    return moved.select("virtual_slot", to.cast("int").alias("shard"), (F.col("version") + 1).alias("version"))


def save(slot_map: DataFrame, path: str) -> None:
    """Stores a map beside the versions before it."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, by default the last."""
    found = spark.read.parquet(path)
    if version is None:
        return found.join(F.broadcast(found.agg(F.max("version").alias("version"))), "version").select("virtual_slot", "shard", "version")
    return found.where(F.col("version") == version).select("virtual_slot", "shard", "version")


def stored(rows: DataFrame, path: str, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """The current version of the map at ``path``, as it is read from there.

    A store without a map gets a first version, made before any bytes are known, and a second one, edited to the rows'
    bytes; a store that has one is used as it is.
    """
    spark = rows.sparkSession
    try:
        return load(spark, path)
    except AnalysisException:  # nothing is stored there yet
        save(first_map(spark, shards, slots), path)
        save(rebalanced(load(spark, path), slot_bytes(rows, slots), shards, slots), path)
        return load(spark, path)


def assigned(docs: DataFrame, shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", store: str | None = None) -> DataFrame:
    """Every row's shard: id_col, size, text_crc32, virtual_slot, shard, slot (the row's place in its shard, gapless from 0), version.

    The map is that of ``store``, a folder that all nodes share, or a new one in the shared folder: made, rebalanced to the
    rows' bytes, stored and read again. A row's place follows from the rows of its shard's lower slots, known from the
    slots' counts, and its place in its own slot, so that no task sorts more than one virtual slot. Rows of equal id and
    text get places in any order, and where they are many, slots of their own each; null ids are hashed like others. An
    empty table gives an empty one. One row larger than a shard's share makes its shard larger than the others.
    """
    rows = sized(docs, id_col, text_col)
    slot_map = stored(rows, store or shared_path(docs.sparkSession, "slot-map"), shards, slots)
    loads = slot_bytes(rows, slots)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = slot_map.join(loads, "virtual_slot").select("virtual_slot", "shard", "version", before.alias("before"))
    here = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("id", "crc", "size", "spread"))
    rows = rows.withColumn("virtual_slot", slot_of(slots)).withColumn("here", here).join(F.broadcast(placed), "virtual_slot")  # a row a slot
    return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "virtual_slot", "shard", (F.col("before") + F.col("here") - 1).cast("long").alias("slot"), "version")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 of near equal bytes."""
    rows = assigned(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))
