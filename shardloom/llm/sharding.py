"""Contiguous shards of nearly equal bytes from a global prefix sum.

Documents are ordered by id in range partitions. Only the partitions' byte and row totals meet in
one place (one row per partition); each partition then continues the sum from what lies before it.
The texts themselves are never moved, only (id, size, checksum).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.common import text_or_empty
from shardloom.session import materialize

ORDER = ("doc_id", "size", "text_crc32")


def byte_shards(docs: DataFrame, n_shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document.

    A document's size is its text's UTF-8 bytes (none if null) plus ``overhead``, which keeps every
    size above zero. It goes to the shard that holds its middle byte, so a border is off its equal
    target by half a document at most. Null ids come first. Equal ids are ordered by size, then
    checksum; rows equal in all three are interchangeable. No rows give no shards.
    """
    text = text_or_empty(F.col("text"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # Written, because range borders are sampled anew whenever the plan is run again.
    rows = materialize(
        rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("_part", F.spark_partition_id()),
        "shard-rows",
    )
    totals = rows.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(whole).alias("_total"),
    )
    within = Window.partitionBy("_part").orderBy(*ORDER)
    start = F.col("_bytes_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = (
        rows.join(F.broadcast(starts), "_part")  # one row per shuffle partition
        .withColumn("_start", start)
        .withColumn("_rank", F.col("_rows_before") + F.row_number().over(within) - 1)
        .withColumn("shard", F.expr(f"int((2 * _start + size) * {n_shards} div (2 * _total))"))
    )
    firsts = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot")
    )
