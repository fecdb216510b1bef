"""How the given tables stand in for corpora, chats and run logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators.packing import pack_shards, tokenize_corpus, tokenize_in_place
from shardloom.session import new_scratch_path
from shardloom.sources.shards import scan_shards, shard_manifest, write_shards

# Sizes of the registered layout queries.
SHARD = 100_000
SEQ = 512
BATCH = 4
RANKS = 2
TASK_BITS = 12  # documents that share a task while shards are written: 4,096, some 50 MB of ids

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Path of a table a query reads more than once. Every query writes its own, so that its work is
    part of its plan and its time."""
    path = new_scratch_path(spark, name)
    write(path)
    return path


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a given table out by its key: each is one row group, which is one task, at every scale.
    How many partitions come out is left to adaptive execution."""
    return df.repartition(key)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as two sources: English is the base corpus, the rest the second one."""
    return sourced(spread(table(spark, sf_dir, "documents"), "doc_id"))


def sourced(docs: DataFrame) -> DataFrame:
    by_lang = F.when(F.col("lang") == "en", "base").otherwise("extra")
    return docs.select(by_lang.alias("source"), F.col("doc_id").alias("ord"), "text")


def char_placed(spark: SparkSession, sf_dir: str, together_bits: int | None = None) -> DataFrame:
    """Tokens of the documents and their offsets. Placing deals the texts out, so they are not spread before."""
    return tokenize_in_place(sourced(table(spark, sf_dir, "documents")), together_bits)


def char_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(path: str) -> None:
        tokenize_corpus(corpus(spark, sf_dir), "char").write.parquet(path)

    return spark.read.parquet(written(spark, sf_dir, "char-tokens", write))


def bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(path: str) -> None:
        tokenize_corpus(corpus(spark, sf_dir)).write.parquet(path)

    return spark.read.parquet(written(spark, sf_dir, "bpe-tokens", write))


def char_segments(spark: SparkSession, sf_dir: str, total: int | None = None) -> DataFrame:
    return pack_shards(char_placed(spark, sf_dir), SHARD, total)


def shard_folder(spark: SparkSession, sf_dir: str) -> str:
    def write(path: str) -> None:
        placed = char_placed(spark, sf_dir, TASK_BITS)
        write_shards(pack_shards(placed, SHARD), path, in_order=True, shard_size=SHARD)

    return written(spark, sf_dir, "char-shards", write)


def char_shards(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    return scan_shards(spark, shard_folder(spark, sf_dir), split)


def char_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per shard, from the manifest of the written shards: no token is read."""
    return shard_manifest(spark, shard_folder(spark, sf_dir))


# The same views in SQL.
DOCS_SQL = """
docs AS (SELECT CASE WHEN lang = 'en' THEN 'base' ELSE 'extra' END AS source, doc_id AS ord, text
         FROM documents)"""

TOKENS_SQL = (
    DOCS_SQL
    + """,
toks AS (SELECT source, ord,
                list_prepend(50256, list_transform(string_split(text, ''), lambda c: unicode(c))) AS tokens
         FROM docs WHERE text IS NOT NULL AND text <> ''),
placed AS (SELECT source, ord, tokens, len(tokens) AS n_tok,
                  (sum(len(tokens)) OVER (PARTITION BY source ORDER BY ord) - len(tokens))::BIGINT AS start_at
           FROM toks)"""
)

SEGMENTS_SQL = (
    TOKENS_SQL
    + f""",
spans AS (SELECT source, ord, tokens, n_tok, start_at,
                 unnest(generate_series(start_at // {SHARD}, (start_at + n_tok - 1) // {SHARD})) AS shard_id
          FROM placed),
segs AS (SELECT source, CASE WHEN shard_id < 1 THEN 'val' ELSE 'train' END AS split, shard_id,
                greatest(start_at, shard_id * {SHARD}) - shard_id * {SHARD} AS seg_start, ord,
                list_slice(tokens, greatest(start_at, shard_id * {SHARD}) - start_at + 1,
                           least(start_at + n_tok, (shard_id + 1) * {SHARD}) - start_at) AS tokens
         FROM spans)"""
)

POSITIONS_SQL = (
    SEGMENTS_SQL
    + f""",
cells AS (SELECT source, split, shard_id, seg_start + generate_subscripts(tokens, 1) - 1 AS pos,
                 unnest(tokens) AS tok
          FROM segs),
lens AS (SELECT source, split, shard_id, count(*) AS shard_len FROM cells GROUP BY ALL),
labelled AS (SELECT *, lead(tok) OVER (PARTITION BY source, split, shard_id ORDER BY pos) AS nxt FROM cells),
seqs AS (SELECT source, split, shard_id, pos // {SEQ} AS seq, list(tok ORDER BY pos) AS x,
                list(nxt ORDER BY pos) AS y, count(*) AS n, count(nxt) AS n_y
         FROM labelled GROUP BY ALL)"""
)

DEALT_SQL = (
    POSITIONS_SQL
    + f""",
slots AS (SELECT s.*, shard_len, (seq // {BATCH}) % {RANKS} AS rank, (seq // {BATCH}) // {RANKS} AS shard_k,
                 seq % {BATCH} AS b, (seq // {BATCH}) * {BATCH * SEQ} AS begin_at
          FROM seqs s JOIN lens USING (source, split, shard_id) WHERE n_y = {SEQ}),
dealt AS (SELECT * FROM slots
          WHERE begin_at + {BATCH * SEQ} + 1 <= shard_len
            AND (shard_k = 0 OR begin_at + {BATCH * SEQ * RANKS} + 1 <= shard_len))"""
)


def list_digest(name: str) -> str:
    return f"md5(array_to_string({name}, ' '))"


def int_list_total(name: str) -> str:
    return f"coalesce(list_sum({name}), 0)::BIGINT"

