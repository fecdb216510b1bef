"""Columns shared by the operators: texts, words, row keys and written tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# A word of the space-separated kind: anything but space, tab, line ends, vertical tab, form feed.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. ``lower`` is the fast path where no
    character lies outside ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two longs that tell rows apart without relying on unique, non-null or numeric ids: rows that
    agree in id and text agree on both, others don't, but for a collision of 64-bit hashes among rows
    of one whole-number id (of all rows, where ids are none). Both are non-null, so an ordinary
    equi-join on them loses nothing."""
    return [
        F.coalesce(doc_id.try_cast("bigint"), F.lit(0)).alias("_k1"),
        F.xxhash64(doc_id.isNull(), doc_id.cast("string"), text_or_empty(text)).alias("_k2"),
    ]


def bounded(df: DataFrame, name: str, max_bytes: int, row_bytes: int) -> DataFrame:
    """A written small side, with a broadcast hint only if its counted rows fit in ``max_bytes`` at
    ``row_bytes`` each. Beyond that the planner shuffles both sides, with adaptive skew splitting."""
    small = materialize(df, name)
    return F.broadcast(small) if small.count() * row_bytes <= max_bytes else small


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cuts a batch into (start, stop) runs of rows whose sizes add up to about ``most``, one row at
    least, so that a worker's memory follows ``most`` and the largest row, not the batch."""
    ends = np.cumsum(sizes)
    out, start = [], 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        out.append((start, stop))
        start = stop
    return out
