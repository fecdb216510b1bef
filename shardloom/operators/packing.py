"""Corpus packing: filter, tokenise, place every token, cut into shards."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.constants import EOT, MAX_ID, SHARD_SIZE
from shardloom.functions.arrays import char_ids, ids_in_range, whole_div
from shardloom.functions.text import is_filled
from shardloom.functions.vocab import DEFAULT_VOCAB, encode_column
from shardloom.operators.ordering import DENSE_LEVELS, prefix_scan
from shardloom.session import new_scratch_path


def drop_empty(docs: DataFrame, text: str = "text") -> DataFrame:
    """Null and '' yield no tokens; whitespace-only text stays."""
    return docs.where(is_filled(F.col(text)))


def tokenize_corpus(docs: DataFrame, vocab: str = DEFAULT_VOCAB, keep: Sequence[str] = ()) -> DataFrame:
    """(source, ord, text) -> (source, ord, n_tok, tokens), each document led by the separator.

    Empty texts leave before the Python stage. ``vocab="char"`` stays wholly in the JVM. The columns
    ``keep`` of the documents stay beside their tokens.
    """
    kept = drop_empty(docs).select("source", "ord", *keep, "text")
    if vocab == "char":
        ids = F.concat(F.array(F.lit(EOT)), char_ids(F.col("text")))
        tokens = kept.select("source", "ord", *keep, ids.alias("tokens"))
    else:
        tokens = encode_column(kept, vocab=vocab, prefix=[EOT], limit=MAX_ID)
    return tokens.select("source", "ord", *keep, F.size("tokens").alias("n_tok"), "tokens")


def tokenize_in_place(docs: DataFrame, together_bits: int | None = None) -> DataFrame:
    """``token_offsets`` of the documents' tokens in the vocabulary ``char``.

    An id is a character there, so offsets come from the texts' lengths: texts are moved, a quarter of
    their tokens' size, and become tokens where those are packed. No table of tokens is written before.
    """
    counted = drop_empty(docs).select("source", "ord", (F.length("text") + 1).alias("n_tok"), "text")
    tasks = None
    if together_bits is not None:
        # The work after the exchange is many times its bytes: a few tasks per core, more for many documents.
        tasks = max(4 * docs.sparkSession.sparkContext.defaultParallelism, docs.count() >> together_bits)
    return tokenize_corpus(token_offsets(counted, together_bits, tasks), "char", keep=["start"])


def check_id_range(tokens: DataFrame, ids: str = "tokens") -> DataFrame:
    """Fail the job on an id that does not fit 16 bits."""
    ok = F.assert_true(ids_in_range(F.col(ids)), F.lit(f"token id outside 0..{MAX_ID}"))
    return tokens.withColumn(ids, F.when(ok.isNull(), F.col(ids)))


def split_by_id_range(tokens: DataFrame, ids: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows): the form that does not fail the job."""
    good = ids_in_range(F.col(ids))
    return tokens.where(good), tokens.where(~good)


def token_offsets(tokens: DataFrame, together_bits: int | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``start``: tokens of the same source before this document.

    With ``together_bits`` documents of the same ``ord >> together_bits`` share a task, so packed
    segments leave in shard order and can be written without another shuffle. They are dealt to so many
    ``partitions``, or as adaptive execution decides.
    """
    scan = {"levels": DENSE_LEVELS}
    if together_bits is not None:
        scan = {"levels": (min(DENSE_LEVELS[0], together_bits - 1), together_bits, 36), "together": 1, "partitions": partitions}
    scanned = prefix_scan(tokens, ["source"], "ord", {"start": ("sum", F.col("n_tok"))}, inclusive=False, **scan)
    return scanned.withColumn("start", F.col("start").cast("bigint"))


def task_bits(n_docs: int, parallelism: int) -> int:
    """Documents per task as a power of two: a few tasks per core, at most 65,536 documents each."""
    return max(6, min(16, int(math.log2(max(n_docs / (2 * parallelism), 1)))))


def budget_limit(total: int, shard_size: int) -> int:
    """The cap counts whole shards, so it rounds up to a multiple of the shard size."""
    return -(-total // shard_size) * shard_size


def token_budget(placed: DataFrame, total: int, shard_size: int) -> DataFrame:
    """Documents that still reach into the capped output."""
    return placed.where(F.col("start") < F.lit(budget_limit(total, shard_size)).cast("bigint"))


def assign_split(shard_id: Column, val_shards: int = 1) -> Column:
    return F.when(shard_id < F.lit(val_shards), "val").otherwise("train")


def pack_shards(
    placed: DataFrame, shard_size: int = SHARD_SIZE, total: int | None = None, val_shards: int = 1
) -> DataFrame:
    """Cut documents at multiples of the shard size.

    Rows are (source, split, shard_id, seg_start, ord, n_tok, tokens); ``n_tok`` lets counting jobs
    skip the ids. A document may cover any number of shards; one row never holds a whole shard. The slices are
    built inside the row, so a long document is not copied once per shard.
    """
    size = F.lit(shard_size).cast("bigint")
    start, end = F.col("start"), F.col("start") + F.col("n_tok")
    if total is not None:
        placed = token_budget(placed, total, shard_size)
        end = F.least(end, F.lit(budget_limit(total, shard_size)).cast("bigint"))
    first, last = whole_div(start, size), whole_div(end - 1, size)

    def piece(shard: Column) -> Column:
        low = F.greatest(start, shard * size)
        high = F.least(end, (shard + 1) * size)
        part = F.slice("tokens", (low - start + 1).cast("int"), (high - low).cast("int"))
        part = F.when(high - low == F.col("n_tok"), F.col("tokens")).otherwise(part)  # a slice boxes every token
        return F.struct(shard.alias("shard_id"), (low - shard * size).alias("seg_start"), part.alias("tokens"))

    cut = placed.select("source", "ord", F.inline(F.transform(F.sequence(first, last), piece)))
    return cut.select(
        "source",
        assign_split(F.col("shard_id"), val_shards).alias("split"),
        "shard_id",
        "seg_start",
        "ord",
        F.size("tokens").alias("n_tok"),
        "tokens",
    )


def tokenize_to_budget(
    docs: DataFrame, total: int, shard_size: int, vocab: str = DEFAULT_VOCAB, tokens_per_doc: float = 500.0
) -> DataFrame:
    """Tokenise documents in order only until every source passes its budget.

    Works on ranges of the order key: a first range sized by ``tokens_per_doc``, later ones by the
    rate seen so far (at most eight times the last). Each range is a pushed-down filter, so text
    far beyond the budget is neither read nor encoded, and the rounds are few. The exact cut is
    ``token_budget`` on the result. Only a few numbers per source reach the driver.
    """
    spark = docs.sparkSession
    limit = budget_limit(total, shard_size)
    out = new_scratch_path(spark, "budget-tokens")
    schema = "source string, ord bigint, n_tok int, tokens array<int>"
    extent = docs.groupBy("source").agg(F.min("ord").alias("low"), F.max("ord").alias("high"), F.count("*").alias("n"))
    open_ranges = {}
    for r in extent.collect():
        share = min(1.0, limit / (r["n"] * tokens_per_doc))
        open_ranges[r["source"]] = (r["low"], max(1, int((r["high"] - r["low"] + 1) * share)), r["low"], r["high"])
    if not open_ranges:
        return spark.createDataFrame([], schema)
    while open_ranges:
        wanted = F.lit(False)
        for source, (at, width, _, _) in open_ranges.items():
            wanted = wanted | ((F.col("source") == source) & (F.col("ord") >= at) & (F.col("ord") < at + width))
        tokenize_corpus(docs.where(wanted), vocab).write.mode("append").parquet(out)
        sums = spark.read.schema(schema).parquet(out).groupBy("source").agg(F.sum("n_tok").alias("n"))
        found = {r["source"]: r["n"] for r in sums.collect()}
        following = {}
        for source, (at, width, first, last) in open_ranges.items():
            after, have = at + width, found.get(source, 0)
            if after > last or have >= limit:
                continue
            rate = max(have / (after - first), 1e-9)
            need = min(int((limit - have) / rate * 1.1) + 1, 8 * width)
            following[source] = (after, max(need, width), first, last)
        open_ranges = following
    return spark.read.schema(schema).parquet(out)
