"""Sharding by jump consistent hashing, with DataFrame functions only.

The shard of a key is the end of a walk: from bucket b the walk jumps to
floor((b + 1) / u), where u is the key's next uniform draw, and stops before
the number of shards. The draws depend on the key and the step alone, so with
one more shard a key either stays or moves into the new shard.

The draws come from Spark's 64-bit hash of (key, step), not from a linear
congruential generator: under ANSI mode a wrapping 64-bit product is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.session import materialize

SLOT_ROWS = 1_000_000


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. shards-1 of ``key``. Null is a key like any other."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(at: Column, i: Column) -> Column:
        draw = (F.shiftrightunsigned(F.xxhash64(key, i), 33) + 1) / F.lit(float(1 << 31))
        # at.next is the bucket that the last jump reached; past the end the walk rests
        inside = at["next"] < shards
        return F.struct(
            F.when(inside, at["next"]).otherwise(at["bucket"]).alias("bucket"),
            F.when(inside, F.least(F.floor((at["next"] + 1) / draw), F.lit(shards)))
             .otherwise(at["next"]).cast("long").alias("next"))

    start = F.struct(F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("next"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)
    return walk["bucket"].cast("int")


def with_slots(rows: DataFrame, shard: str, order: list[str], slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2, ... within each shard.

    A shard is not numbered in one task: rows are dealt into ranges by a hash
    of ``order``, numbered there, and moved up by the rows of the ranges
    before. The table of those offsets has a row per shard and range. ``rows``
    is read three times, so it should be a stored table.
    """
    ranges = max(1, -(-rows.count() // slot_rows))
    dealt = rows.withColumn("__range", F.pmod(F.xxhash64(*order), F.lit(ranges)).cast("int"))
    before = Window.partitionBy(shard).orderBy("__range").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy(shard, "__range").agg(F.count(F.lit(1)).alias("__n"))
               .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
               .drop("__n"))
    inside = Window.partitionBy(shard, "__range").orderBy(*order)
    return (dealt.withColumn("__at", F.row_number().over(inside))
            .join(offsets, [shard, "__range"])
            .withColumn("slot", F.col("__at") - 1 + F.col("__before"))
            .drop("__range", "__at", "__before"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Place every row of ``docs`` by its doc_id.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per
    row: size is the text's UTF-8 bytes plus 1 (null text: 1), text_crc32 that
    of the bytes (null: of none), grown_shard the shard if there were one
    more. Rows that repeat a doc_id share its shard and get slots of their
    own; null doc_id is a key too. An empty table gives no rows.
    """
    key, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    placed = materialize(docs.select(
        key.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        jump_shard(key, shards).alias("shard"), jump_shard(key, shards + 1).alias("grown_shard")), "shards")
    return with_slots(placed, "shard", ["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write ``docs`` (all columns) as Parquet, one folder per shard, named
    ``shard=N``; with as many underscores before it as it takes where ``docs``
    has a column of that name. Null ids share a shard, repeated rows are all
    written, an empty table writes no folder."""
    name = "shard"
    while name in docs.columns:
        name = "_" + name
    (docs.withColumn(name, jump_shard(F.col("doc_id").cast("long"), shards))
     .write.partitionBy(name).parquet(path))
