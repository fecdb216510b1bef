"""A tokenised corpus that grows: blocks of documents with their totals, and places from the totals.

A block is a range of ``2**bits`` order keys of a source. Adding, correcting or removing documents
writes new versions of the blocks they fall into and of no other; a document's place inside its
block is stored with it, and what lies before a block follows from the totals, a row per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from shardloom.constants import SHARD_SIZE
from shardloom.functions.arrays import whole_div
from shardloom.functions.text import is_filled
from shardloom.functions.vocab import DEFAULT_VOCAB
from shardloom.operators.ordering import prefix_scan
from shardloom.operators.packing import pack_shards, tokenize_corpus
from shardloom.session import folders_done

BLOCK_BITS = 16
TOKENS = "ord bigint, n_tok int, inner bigint, tokens array<int>, generation bigint, source string, block bigint"
TOTALS = "source string, block bigint, n_docs bigint, n_tok bigint, generation bigint"


def _totals(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The newest version of each block, of published generations up to ``upto``: (source, block, n_docs,
    n_tok, generation)."""
    done = [g for g in folders_done(spark, f"{path}/totals", "generation=") if upto is None or g <= upto]
    if not done:
        return spark.createDataFrame([], TOTALS)
    folders = [f"{path}/totals/generation={g}" for g in done]
    rows = spark.read.schema(TOTALS).option("basePath", f"{path}/totals").parquet(*folders)
    newest = F.max_by(F.struct("n_docs", "n_tok", "generation"), "generation").alias("newest")
    return rows.groupBy("source", "block").agg(newest).select("source", "block", "newest.*")


def _read(spark: SparkSession, path: str, blocks: DataFrame) -> DataFrame:
    """Documents of versions of blocks. The folders are the join's keys, so no other is opened."""
    keys = ["source", "block", "generation"]
    tokens = spark.read.schema(TOKENS).option("basePath", f"{path}/tokens").parquet(f"{path}/tokens")
    return tokens.join(blocks.where("n_docs > 0"), keys)


def add_documents(
    docs: DataFrame, path: str, vocab: str = DEFAULT_VOCAB, bits: int = BLOCK_BITS, generation: int | None = None
) -> int:
    """Place documents (source, ord, text) among those already there; returns the generation written.

    A document with a known (source, ord) replaces that one, a null or empty text removes it. Of
    repeated rows in one call the one with the most tokens stays, of equals the one with the greater
    ids. Source and ord must not be null, and ``bits`` stays the same for a path.

    Only the given texts are encoded, and only blocks they fall into are read. A generation counts
    once its totals are complete; one that failed is written again under its number, and so is one
    that a stream replays (the state before it is what both start from).
    """
    spark = docs.sparkSession
    if generation is None:
        generation = max(folders_done(spark, f"{path}/totals", "generation="), default=-1) + 1
    block = F.shiftright("ord", bits).alias("block")
    keys = docs.select("source", F.col("ord").cast("bigint").alias("ord"))
    touched_path = f"{path}/touched/generation={generation}"
    keys.select("source", block).distinct().write.mode("overwrite").parquet(touched_path)
    touched = spark.read.schema("source string, block bigint").parquet(touched_path)

    given = docs.select("source", F.col("ord").cast("bigint").alias("ord"), "text")
    removed = given.where(~F.coalesce(is_filled(F.col("text")), F.lit(False)))
    none = F.lit(None).cast("array<int>")
    fresh = tokenize_corpus(given, vocab).unionByName(removed.select("source", "ord", F.lit(0).alias("n_tok"), none.alias("tokens")))
    rows = fresh.select("source", block, "ord", "n_tok", "tokens", F.lit(1).alias("fresh"))
    known = _totals(spark, path, generation - 1).join(touched, ["source", "block"])
    if generation > 0:
        old = _read(spark, path, known.select("source", "block", "generation", "n_docs"))
        rows = rows.unionByName(old.select("source", "block", "ord", "n_tok", "tokens", F.lit(0).alias("fresh")))

    # One exchange brings a block together; a block is at most 2**bits documents of either kind.
    order = Window.partitionBy("source", "block").orderBy("ord", F.desc("fresh"), F.desc("n_tok"), F.desc("tokens"))
    stays = F.coalesce(F.lag("ord").over(order) != F.col("ord"), F.lit(True))
    kept = rows.withColumn("stays", stays).where("stays AND n_tok > 0")
    inner = F.sum("n_tok").over(Window.partitionBy("source", "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    placed = kept.select("source", "block", "ord", "n_tok", F.coalesce(inner, F.lit(0)).cast("bigint").alias("inner"), "tokens")
    tokens_path = f"{path}/tokens/generation={generation}"
    placed.write.mode("overwrite").partitionBy("source", "block").parquet(tokens_path)

    # A block that lost its last document has no folder, and a row that says so.
    written = spark.read.schema(TOKENS).option("basePath", f"{path}/tokens").parquet(tokens_path)
    counted = written.groupBy("source", "block").agg(F.count("*").alias("n_docs"), F.sum("n_tok").alias("n_tok"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    totals = touched.join(counted, ["source", "block"], "left").select("source", "block", zero("n_docs"), zero("n_tok"))
    totals.write.mode("overwrite").parquet(f"{path}/totals/generation={generation}")
    return generation


def block_starts(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Each block's newest version with ``base``, the tokens of its source before it. Reads totals only."""
    based = prefix_scan(_totals(spark, path, upto), ["source"], "block", {"base": ("sum", F.col("n_tok"))}, inclusive=False)
    return based.withColumn("base", F.col("base").cast("bigint"))


def first_change(spark: SparkSession, path: str, generation: int) -> DataFrame:
    """(source, changed_at): the token position from which a generation may differ from the one before.
    Everything in front of it is as it was."""
    blocks = block_starts(spark, path, generation)
    return blocks.where(F.col("generation") == generation).groupBy("source").agg(F.min("base").alias("changed_at"))


def placed_documents(spark: SparkSession, path: str, upto: int | None = None, first: DataFrame | None = None) -> DataFrame:
    """(source, ord, n_tok, tokens, start), as ``token_offsets`` would give for all documents at once.

    ``first`` (source, position) leaves out the blocks that end at or before a source's position and
    sources that it does not name.
    """
    blocks = block_starts(spark, path, upto)
    if first is not None:
        blocks = blocks.join(first, "source").where(F.col("base") + F.col("n_tok") > F.col("position")).drop("position")
    docs = _read(spark, path, blocks.select("source", "block", "generation", "n_docs", "base"))
    return docs.select("source", "ord", "n_tok", "tokens", (F.col("base") + F.col("inner")).alias("start"))


def changed_shards(
    spark: SparkSession, path: str, generation: int, shard_size: int = SHARD_SIZE, total: int | None = None, val_shards: int = 1
) -> DataFrame:
    """Segments of the shards that a generation may have changed, to replace those from the same shard
    number on; shards of a source before them stay as they are, and so do the blocks they came from."""
    size = F.lit(shard_size).cast("bigint")
    shard = whole_div(F.col("changed_at"), size)
    changed = first_change(spark, path, generation).select("source", shard.alias("shard"))
    placed = placed_documents(spark, path, generation, changed.select("source", (F.col("shard") * size).alias("position")))
    segments = pack_shards(placed, shard_size, total, val_shards)
    return segments.join(changed, "source").where("shard_id >= shard").drop("shard")


def add_stream(
    docs: DataFrame,
    path: str,
    state: str,
    vocab: str = DEFAULT_VOCAB,
    bits: int = BLOCK_BITS,
    available_now: bool = True,
) -> StreamingQuery:
    """Add arriving documents wherever their key says, late and corrected ones included; each trigger is
    a generation, and a replay writes it again."""

    def add(batch: DataFrame, batch_id: int) -> None:
        add_documents(batch, path, vocab, bits, batch_id)

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", state)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
