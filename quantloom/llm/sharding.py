"""Sharding by fixed virtual slots.

A record's key is hashed into one of a fixed number of slots; a small, versioned table maps slots to shards. Growing or
rebalancing edits that table: only the records of slots that it reassigns move.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.shared import new_path, repeated, small, stash

SLOTS = 4096
#: Different rows of a slot are numbered in parts of about so many, so that a slot with many rows isn't one task's work.
PART_ROWS = 100_000


def slot_of(key, slots: int = SLOTS):
    """The slot of a key (null: a key of its own): the first 32 bits of its MD5, modulo slots."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long") % slots).cast("int")


def _grown(shard_of: list[int], shards: int) -> list[int]:
    """With one more shard: each of the old ones gives up the same share of its slots, told by a hash, to the new one only."""
    held: dict[int, list[int]] = {}
    for slot in sorted(range(len(shard_of)), key=lambda slot: hashlib.md5(str(slot).encode()).hexdigest()):
        held.setdefault(shard_of[slot], []).append(slot)
    new = {slot for own in held.values() for slot in own[: len(own) // (shards + 1)]}
    return [shards if slot in new else k for slot, k in enumerate(shard_of)]


def _as_map(spark: SparkSession, shard_of: list[int], version: int) -> DataFrame:
    shards = F.split(F.lit(",".join(map(str, shard_of))), ",").cast("array<int>")
    return spark.range(len(shard_of)).select(F.col("id").cast("int").alias("vslot"), F.element_at(shards, (F.col("id") + 1).cast("int")).alias("shard"), F.lit(version).alias("version"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map: vslot, shard, version. It is grown from a single shard, so that a slot's shard depends on the
    number of shards alone, however a store came to it."""
    shard_of = [0] * slots
    for n in range(1, shards):
        shard_of = _grown(shard_of, n)
    return _as_map(spark, shard_of, 1)


def grown_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version with one more shard. The map has SLOTS rows, whatever the input's size; it is edited on the driver."""
    rows = sorted(slot_map.select("vslot", "shard", "version").collect())
    return _as_map(slot_map.sparkSession, _grown([r.shard for r in rows], shards), max((r.version for r in rows), default=0) + 1)


def slot_bytes(sized: DataFrame) -> DataFrame:
    """Rows and bytes of each slot, from columns vslot and size."""
    return sized.groupBy("vslot").agg(F.count(F.lit(1)).alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def rebalanced_map(slot_map: DataFrame, stats: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """The next version, with shards' bytes near equal: slots move from the fullest to the emptiest shard while that helps.

    The map has SLOTS rows, whatever the input's size; it is edited on the driver.
    """
    rows = slot_map.join(stats, "vslot", "left").select("vslot", "shard", "version", F.coalesce("slot_bytes", F.lit(0)).alias("b")).collect()
    held: dict[int, dict[int, int]] = {}
    for r in sorted(rows):
        held.setdefault(r.shard, {})[r.vslot] = r.b
    total = {k: sum(v.values()) for k, v in held.items()}
    mean = sum(total.values()) / max(1, len(total))
    for _ in range(len(rows)):
        full, empty = max(total, key=lambda k: (total[k], -k)), min(total, key=lambda k: (total[k], k))
        gap = total[full] - total[empty]
        if gap <= tolerance * mean:
            break
        slot, b = min(((s, b) for s, b in held[full].items() if 0 < b < gap), key=lambda x: (abs(x[1] - gap / 2), x[0]), default=(None, 0))
        if slot is None:
            break
        held[empty][slot] = held[full].pop(slot)
        total[full] -= b
        total[empty] += b
    version = max((r.version for r in rows), default=0) + 1
    shard_of = {s: k for k, v in held.items() for s in v}
    return _as_map(slot_map.sparkSession, [shard_of[s] for s in sorted(shard_of)], version)


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the store of maps; versions are folders and are never changed."""
    slot_map.write.partitionBy("version").mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int, version int").parquet(path).where(F.col("version") == version)


def shard(rows: DataFrame, key: str, size, crc, shards: int, slots: int = SLOTS, map_path: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard, vslot, slot_bytes for every row.

    size and crc are columns over rows. slot numbers the rows of a shard from 0 without a gap. Rows of equal key, crc and
    size are counted first and numbered in one run, so neither a repeated row nor a null key (all of them share one slot)
    is one task's work. Texts come in as size and crc alone, so very long ones cost nothing here. An empty table gives no
    rows; other columns are not looked at.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(key).alias("k"), size.cast("long").alias("size"), crc.cast("long").alias("crc"), slot_of(F.col(key), slots).alias("vslot"))
    base = stash(base.groupBy("vslot", "k", "crc", "size").agg(F.count(F.lit(1)).alias("n")), "sharding")
    map_path = map_path or new_path(spark, "slot_map")
    store_map(first_map(spark, shards, slots), map_path)
    store_map(grown_map(load_map(spark, map_path, 1), shards), map_path)
    maps = load_map(spark, map_path, 1).join(F.broadcast(load_map(spark, map_path, 2).select("vslot", F.col("shard").alias("grown_shard"))), "vslot").drop("version")
    # a row for each slot
    parts = base.groupBy("vslot").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"), F.sum(F.col("n") * F.col("size")).alias("slot_bytes"))
    base = base.join(small(parts, slots), "vslot").withColumn("part", F.pmod(F.xxhash64("k", "crc", "size"), F.col("parts")).cast("int"))
    counts = base.groupBy("vslot", "part").agg(F.sum("n").alias("n")).join(F.broadcast(maps), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("vslot", "part", "shard", "grown_shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    within = Window.partitionBy("vslot", "part").orderBy(F.col("k").asc_nulls_last(), "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0))).join(small(counts, slots * 8), ["vslot", "part"])
    return repeated(placed, "n", "copy").select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        (F.col("from") + F.col("at") + F.col("copy")).cast("long").alias("slot"), "grown_shard", "vslot", "slot_bytes",
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by doc_id into shards 0 to 15 under the law `key`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs, "doc_id", F.octet_length(text) + 1, F.crc32(F.encode(text, "UTF-8")), 16)
