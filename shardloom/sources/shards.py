"""Token shards as partitioned Parquet."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.constants import EOT, SHARD_SIZE
from shardloom.functions.arrays import occurrences, whole_div

# ``shard`` is a segment's shard, ``shard_id`` its folder's first one.
SCHEMA = (
    "shard bigint, seg_start bigint, ord bigint, n_tok int, tokens array<int>, "
    "build string, source string, split string, shard_id bigint"
)
# A row per shard of a published build.
MANIFEST = (
    "source string, build string, split string, shard_id bigint, n_segments bigint, n_tokens bigint, shard_len bigint, "
    "min_id int, max_id int, n_separators bigint, first_ord bigint, last_ord bigint"
)


def folder_of(shard_id: Column, shard_size: int) -> Column:
    """The shard that names a shard's folder: one folder takes as many neighbours as make up a shard of
    the default size, so that folders and files grow with the tokens, however small the shards."""
    return shard_id - F.pmod(shard_id, F.lit(max(1, SHARD_SIZE // shard_size)))


def write_shards(
    segments: DataFrame, path: str, in_order: bool = False, spread: int = 16, shard_size: int = SHARD_SIZE
) -> str:
    """Write a build of segments under builds/source/split/shard_id, sorted by shard and position inside
    each file, and publish it with a manifest: a row of statistics per shard, counted from what was
    written in one pass. Returns the build's name. Shards that are small by ``shard_size`` share folders.

    A build has a folder of its own, so nothing of an earlier one can mix with it: readers see a
    source's newest published build only, whatever its splits, sizes or caps were before. A build
    that fails is never published, and running a stage again publishes the same shards anew.

    ``in_order`` segments (from offsets whose documents share tasks) are written where they are: a
    shard then lies in the few tasks its documents came from. Others go to ``spread`` tasks per
    folder by position, so a 100M-token shard neither sits in one task nor leaves a small file per
    input task.
    """
    build = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    segments = segments.withColumnRenamed("shard_id", "shard").withColumn("shard_id", folder_of(F.col("shard"), shard_size))
    if not in_order:
        place = F.col("shard") * F.lit(shard_size).cast("bigint") + F.col("seg_start")
        segments = segments.repartition("source", "split", "shard_id", F.pmod(whole_div(place, 1 << 20), F.lit(spread)))
    (
        segments.sortWithinPartitions("source", "split", "shard_id", "shard", "seg_start")
        .write.partitionBy("source", "split", "shard_id")
        .parquet(f"{path}/builds/build={build}")
    )
    written = segments.sparkSession.read.schema(SCHEMA).parquet(f"{path}/builds").where(F.col("build") == build)
    statistics(by_shard(written)).write.mode("append").parquet(f"{path}/manifest")
    return build


def by_shard(written: DataFrame) -> DataFrame:
    """What is in the folders, with each segment's own shard as ``shard_id``."""
    return written.drop("shard_id").withColumnRenamed("shard", "shard_id")


def statistics(shards: DataFrame) -> DataFrame:
    """The manifest's rows of written shards."""
    ids = F.col("tokens")
    found = shards.groupBy("source", "build", "split", "shard_id").agg(
        F.count("*").alias("n_segments"),
        F.sum("n_tok").alias("n_tokens"),
        F.max(F.col("seg_start") + F.col("n_tok")).alias("shard_len"),
        F.min(F.array_min(ids)).alias("min_id"),
        F.max(F.array_max(ids)).alias("max_id"),
        F.sum(occurrences(ids, EOT)).alias("n_separators"),
        F.min("ord").alias("first_ord"),
        F.max("ord").alias("last_ord"),
    )
    columns = [part.split() for part in MANIFEST.split(", ")]
    return found.select(*[F.col(name).cast(kind).alias(name) for name, kind in columns])


def newest_builds(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's rows of each source's newest published build."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as error:
        raise FileNotFoundError(f"no build was published in {path}") from error
    newest = rows.groupBy("source").agg(F.max("build").alias("build"))  # a row per source
    return rows.join(F.broadcast(newest), ["source", "build"])


def shard_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row per shard of the newest builds, from what was written when they were published: shards,
    segments, tokens, bounds of ids and documents. No file of tokens is opened."""
    return newest_builds(spark, path).drop("build")


def stale_shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards whose files don't hold what the manifest says: (source, build, split, shard_id, n_segments,
    found). Segments are counted by their shard's number alone, so no token is read."""
    found = by_shard(spark.read.schema(SCHEMA).parquet(f"{path}/builds")).groupBy("source", "build", "split", "shard_id")
    found = found.agg(F.count("*").alias("found"))
    keys = ["source", "build", "split", "shard_id"]
    named = newest_builds(spark, path).select(*keys, "n_segments")
    wanted = named.select("source", "build").distinct()
    both = named.join(found.join(wanted, ["source", "build"], "left_semi"), keys, "full")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_segments", "found")]
    return both.select(*keys, *counts).where("n_segments <> found")


def require_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``shard_manifest``, once its shards are found as it says; anything else is an error."""
    stale = stale_shards(spark, path).limit(1).collect()
    if stale:
        raise ValueError(f"the manifest of {path} is stale: {stale[0].asDict()}")
    return shard_manifest(spark, path)


def scan_shards(spark: SparkSession, path: str, split: str | None = None, source: str | None = None) -> DataFrame:
    """Segments of the newest build of each source; an empty split is an error.

    Partition pruning reads only a split's folders, and the published builds (one row per source and
    build, far below any broadcast limit) prune the rest when the job runs.
    """
    listed = newest_builds(spark, path)
    for name, wanted in (("split", split), ("source", source)):
        if wanted is not None:
            listed = listed.where(F.col(name) == wanted)
    if listed.isEmpty():  # the manifest only
        raise FileNotFoundError(f"no shards for split {split} of {source or 'any source'} in {path}")
    newest = listed.select("source", "build").distinct()
    shards = spark.read.schema(SCHEMA).parquet(f"{path}/builds")
    if split is not None:
        shards = shards.where(F.col("split") == split)
    if source is not None:
        shards = shards.where(F.col("source") == source)
    shards = by_shard(shards).join(F.broadcast(newest), ["source", "build"])  # a row per source
    return shards.select("source", "split", "shard_id", "seg_start", "ord", "n_tok", "tokens")


def list_shards(shards: DataFrame) -> DataFrame:
    """Distinct shards; a metadata-sized result ordered by name (zero-padded, so by number)."""
    return shards.select("source", "split", "shard_id").distinct()
