"""Tokenising and packing an unbounded corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from shardloom.constants import SHARD_SIZE
from shardloom.functions.vocab import DEFAULT_VOCAB
from shardloom.operators.packing import pack_shards, token_offsets, tokenize_corpus

TOTALS = "source string, n_tok bigint"
SEGMENTS = (
    "seg_start bigint, ord bigint, n_tok int, tokens array<int>, batch bigint, source string, split string, shard_id bigint"
)


def tokenize_stream(
    docs: DataFrame, path: str, state: str, vocab: str = DEFAULT_VOCAB, available_now: bool = True
) -> StreamingQuery:
    """Append (source, ord, n_tok, tokens) to Parquet; resumes from ``state``."""
    writer = tokenize_corpus(docs, vocab).writeStream.format("parquet").option("checkpointLocation", state)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def pack_stream(
    docs: DataFrame,
    path: str,
    state: str,
    shard_size: int = SHARD_SIZE,
    total: int | None = None,
    val_shards: int = 1,
    vocab: str = DEFAULT_VOCAB,
    available_now: bool = True,
) -> StreamingQuery:
    """Pack arriving documents behind everything already packed.

    Each micro-batch writes its tokens, running totals and segments under its batch number, and
    starts at the totals of the number before, so a replayed batch overwrites itself with the
    same rows and no trigger reads more than one earlier total. Segments lie under their source,
    split and shard, so a reader of one split opens its folders only. A source that has reached the
    cap (whole shards) is not tokenised any more.
    """

    def before(spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], TOTALS)
        return spark.read.schema(TOTALS).parquet(f"{path}/totals/batch={batch_id - 1}")

    def pack(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base = before(spark, batch_id)
        if total is not None:
            full = base.where(F.col("n_tok") >= -(-total // shard_size) * shard_size).select("source")
            batch = batch.join(full, "source", "left_anti")
        tokens_path = f"{path}/tokens/batch={batch_id}"
        tokenize_corpus(batch, vocab).write.mode("overwrite").parquet(tokens_path)
        tokens = spark.read.parquet(tokens_path)
        counted = tokens.select("source", F.col("n_tok").cast("bigint").alias("n_tok"))
        totals = base.unionByName(counted).groupBy("source").agg(F.sum("n_tok").alias("n_tok"))
        totals.write.mode("overwrite").parquet(f"{path}/totals/batch={batch_id}")
        placed = token_offsets(tokens).join(base.withColumnRenamed("n_tok", "base"), "source", "left")
        shifted = placed.withColumn("start", F.col("start") + F.coalesce("base", F.lit(0))).drop("base")
        segments = pack_shards(shifted, shard_size, total, val_shards)
        segments.write.mode("overwrite").partitionBy("source", "split", "shard_id").parquet(
            f"{path}/segments/batch={batch_id}"
        )

    writer = docs.writeStream.foreachBatch(pack).option("checkpointLocation", state)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    segments = spark.read.schema(SEGMENTS).option("basePath", f"{path}/segments").parquet(f"{path}/segments")
    return segments.select("source", "split", "shard_id", "seg_start", "ord", "n_tok", "tokens")
