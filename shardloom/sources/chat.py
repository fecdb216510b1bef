"""Chat rows: arrays of (role, content), or one row per turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.arrays import whole_div
from shardloom.operators.ordering import dense_index

MESSAGES = "array<struct<role:string,content:string>>"
CHUNK_TURNS = 10_000


def scan_chat(
    spark: SparkSession, path: str, messages_col: str = "messages", fmt: str = "json", multi_line: bool = False
) -> DataFrame:
    """(messages) from JSON or Parquet with an explicit schema; other columns are not read.

    ``multi_line`` reads a file that holds one JSON array; one object per line is splittable.
    """
    return spark.read.format(fmt).option("multiLine", multi_line).schema(f"`{messages_col}` {MESSAGES}").load(path).select(
        F.col(messages_col).alias("messages")
    )


def turns_to_chat(turns: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """(conv_id, chunk, last, messages): every turn of every conversation, in rows of bounded length.

    A row holds up to ``chunk_turns`` consecutive turns; nearly all conversations are one row. The
    texts of a conversation's chunks concatenate in chunk order; ``last`` marks the final one.
    """
    placed = dense_index(turns, ["conv_id"], "turn", "__idx")
    ends = turns.groupBy("conv_id").agg(whole_div(F.count("*") - 1, chunk_turns).alias("__last"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    messages = F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    chunks = placed.groupBy("conv_id", whole_div(F.col("__idx"), chunk_turns).alias("chunk")).agg(messages.alias("messages"))
    return chunks.join(ends, "conv_id").select("conv_id", "chunk", (F.col("chunk") == F.col("__last")).alias("last"), "messages")


def chat_json(messages: Column) -> Column:
    return F.to_json(F.struct(messages.alias("messages")), {"ignoreNullFields": "false"})


def write_chat_jsonl(chats: DataFrame, path: str) -> None:
    """One {"messages": [...]} object per line, non-ASCII kept."""
    chats.select("messages").write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
