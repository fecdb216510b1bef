"""Reading text corpora, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {"parquet", "json", "orc", "csv", "text"}


def _shape(df: DataFrame, text_col: str, order_col: str, source: str | None) -> DataFrame:
    name = F.lit(source) if source is not None else F.col("source")
    return df.select(name.alias("source"), F.col(order_col).cast("bigint").alias("ord"), F.col(text_col).alias("text"))


def scan_corpus(
    spark: SparkSession,
    path: str,
    text_col: str = "text",
    order_col: str = "doc_id",
    source: str | None = None,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """(source, ord, text) of one corpus; only the chosen columns are read.

    ``order_col`` must be a unique bigint: it carries the order that shards depend on.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return _shape(reader.load(path), text_col, order_col, source)


def scan_corpus_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    text_col: str = "text",
    order_col: str = "doc_id",
    source: str | None = None,
    fmt: str = "parquet",
    files_per_trigger: int = 64,
    file_pattern: str = "*",
) -> DataFrame:
    """The same rows as an unbounded stream of files."""
    stream = (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", file_pattern)
        .load(path)
    )
    return _shape(stream, text_col, order_col, source)
