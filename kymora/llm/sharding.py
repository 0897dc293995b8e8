"""Jump consistent hashing in SQL functions: a key's shard follows from the key and the shard count alone.

The published algorithm draws 64-bit numbers from a multiplicative generator seeded by the key and jumps from shard
to shard until it would leave the range; with one more shard a row stays or goes to the new one. Multiplication modulo
2**64 is written in 32-bit halves, so it neither overflows nor depends on a session's ANSI setting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymora.llm.common import offsets, own, range_bounds, range_bucket, save

#: Fixed value of the generator.
MULTIPLIER = 2862933555777941757
#: Rows of a range bucket, about.
BUCKET_ROWS = 65_536
LOW = (1 << 32) - 1


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) of ``key * MULTIPLIER + 1`` modulo 2**64; every product and sum stays below 2**53."""
    m = [(MULTIPLIER >> (16 * i)) & 0xFFFF for i in range(4)]
    low16 = lambda x: F.shiftleft(x.bitwiseAND(0xFFFF), 16)
    bottom = lo * m[0] + low16(lo * m[1]) + 1
    top = F.shiftright(bottom, 32) + F.shiftright(lo * m[1], 16) + lo * m[2] + low16(lo * m[3]) + hi * m[0] + low16(hi * m[1])
    return top.bitwiseAND(LOW), bottom.bitwiseAND(LOW)


def jump(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards - 1``, of a bigint key; a null key counts as 0. At most ``shards`` jumps can happen."""
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(LOW)).alias("lo"),
        F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("to"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        to = F.floor((s["to"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(hi, 1) + 1).cast("double"))).cast("bigint")
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), s["to"].alias("at"), to.alias("to"))
        return F.when(s["to"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)["at"].cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Shards of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus one (null text: one, and the checksum of no bytes); the law is ``key``, so
    equal ids share a shard, whatever their texts, and a null id counts as 0. Slots are gapless from 0 within a shard, in
    ascending order of doc_id (nulls first), checksum and size; of rows alike in all three the order is any. Rows are
    numbered within range buckets of the ids, and one row per bucket and shard gives the rows before, so no task holds a
    shard; an id of very many rows is several buckets, by checksum. Long texts count whole. An empty table gives no rows;
    further columns are ignored, whatever their names.
    """
    docs = own(docs, "doc_id", "text")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(data) + 1).cast("bigint").alias("size"),
        F.crc32(data).cast("bigint").alias("text_crc32"),
        jump(F.col("doc_id"), shards).alias("shard"),
        jump(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    # The texts are read once; what follows works on a few numbers per row.
    keyed, _ = save(keyed, "keyed")
    bounds = range_bounds(keyed, "doc_id", max(1, -(-keyed.count() // bucket_rows)))
    keyed = keyed.withColumn("bucket", range_bucket("doc_id", bounds, F.col("text_crc32") / float(1 << 32)))
    counts = keyed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = offsets(counts, ["shard"], "bucket", "n", "before").select("shard", "bucket", "before")
    order = Window.partitionBy("bucket", "shard").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    numbered = keyed.repartitionById(len(bounds) + 1, "bucket").withColumn("nth", F.row_number().over(order))
    return numbered.join(before, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("before") + F.col("nth") - 1).cast("bigint").alias("slot"), "grown_shard",
    )
