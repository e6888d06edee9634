"""Sharding by longest-processing-time scheduling.

Groups that must stay together, largest first, go to the least-loaded shard through a heap. The heap is on the
driver, so what it schedules has a bound: every group above a HEAVY-th of a shard by itself (by counting, there
are at most shards * HEAVY of them), and the lighter groups in LIGHT parcels by a hash of the group. Everything
else is sums by group and by parcel, and two joins with those bounded tables.

Rows of a shard are numbered without gaps: a shard's rows fall into SLOT_BUCKETS by a hash, the counts give each
bucket its first number, and rows are numbered within buckets.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.llm.common import durable, text_of

SHARDS, HEAVY, LIGHT, SLOT_BUCKETS = 24, 64, 1 << 14, 512
#: Bytes that a row takes besides its text.
ROW_BYTES = 8


def longest_first(sizes: Iterable[tuple[str, int]], shards: int) -> dict[str, int]:
    """The shard of each named size: largest first (ties by name), each to the least-loaded shard (ties to the smallest)."""
    loads = [(0, shard) for shard in range(shards)]
    placed = {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = loads[0]
        placed[name] = shard
        heapq.heapreplace(loads, (load + size, shard))
    return placed


def place(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows (with group, a string, and size) with shard; rows of one group share a shard."""
    spark = rows.sparkSession
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = durable(rows.groupBy("group").agg(F.sum("size").alias("size")))
    is_heavy = F.col("size") * (shards * HEAVY) > total
    heavy = [(row["group"], row["size"]) for row in groups.where(is_heavy).collect()]  # shards * HEAVY rows at most
    parcel = F.concat(F.lit("parcel "), F.pmod(F.xxhash64("group"), F.lit(LIGHT)).cast("string"))
    light = groups.where(~is_heavy).groupBy(parcel.alias("name")).agg(F.sum("size").alias("size")).collect()  # LIGHT rows at most
    placed = longest_first([("group " + name, size) for name, size in heavy] + [(row["name"], row["size"]) for row in light], shards)
    own = [(name.removeprefix("group "), shard) for name, shard in placed.items() if name.startswith("group ")]
    parcels = [(name, shard) for name, shard in placed.items() if name.startswith("parcel ")]
    own = spark.createDataFrame(own, "group string, own_shard int")
    parcels = spark.createDataFrame(parcels, "parcel string, parcel_shard int")
    joined = rows.withColumn("parcel", parcel).join(F.broadcast(own), "group", "left").join(F.broadcast(parcels), "parcel", "left")
    return joined.withColumn("shard", F.coalesce("own_shard", "parcel_shard")).drop("parcel", "own_shard", "parcel_shard")


def number(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with shard) with slot: 0, 1, 2 ... without gaps within each shard. Rows equal in order are numbered as they come."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(SLOT_BUCKETS)))
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "bucket", first.alias("first"))  # shards * SLOT_BUCKETS rows at most
    within = F.row_number().over(W.partitionBy("shard", "bucket").orderBy(*order))
    numbered = dealt.withColumn("within", within).join(F.broadcast(starts), ["shard", "bucket"])
    return numbered.withColumn("slot", F.col("first") + F.col("within") - 1).drop("bucket", "within", "first")


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    The law is bytes: sizes of shards are near equal, as far as groups of equal texts, which stay together,
    let them. Null and empty texts have no bytes and form one group. Repeated rows get a slot each; a null
    doc_id is no exception. An empty table gives no rows.
    """
    body = text_of()
    rows = durable(
        docs.select(
            "doc_id",
            (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.sha2(body.cast("binary"), 256).alias("group"),
        )
    )
    numbered = number(durable(place(rows, shards).drop("group")), ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
