"""Checks on finished data: shards, completeness, weights, splits, masks, batch layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.constants import EOT, TEXT_VOCAB_SIZE
from shardloom.functions.arrays import whole_div
from shardloom.operators.ordering import prefix_scan

SHARD = ["source", "split", "shard_id"]


def shard_stats(segments: DataFrame) -> DataFrame:
    """Shards and tokens written per source and split; two-phase, distinct over shard ids only."""
    per_shard = segments.groupBy(*SHARD).agg(F.sum("n_tok").alias("n_tokens"), F.count("*").alias("n_segments"))
    return per_shard.groupBy("source", "split").agg(
        F.count("*").alias("n_shards"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_segments").alias("n_segments"),
    )


def manifest_stats(manifest: DataFrame) -> DataFrame:
    """``shard_stats`` from a manifest, a row per shard."""
    return manifest.groupBy("source", "split").agg(
        F.count("*").alias("n_shards"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_segments").alias("n_segments")
    )


def validate_shards(segments: DataFrame, shard_size: int, vocab_size: int = TEXT_VOCAB_SIZE) -> DataFrame:
    """Per shard: id bounds, separators, length, and whether its segments follow each other without
    gap or overlap; ``ok`` sums it up.

    What the segments before each one reach is a running maximum in blocks of positions, over
    narrow rows. Shard numbers of a source must run from 0 without a hole; only its last shard may
    be short.
    """
    ids = F.col("tokens")
    narrow = segments.select(*SHARD, "seg_start", (F.col("seg_start") + F.size(ids)).alias("seg_end"))
    reached = prefix_scan(narrow, SHARD, "seg_start", {"reached": ("max", F.col("seg_end"))}, tie=["seg_end"], inclusive=False)
    joined = F.col("seg_start") == F.coalesce("reached", F.lit(0).cast("bigint"))
    follows = reached.groupBy(*SHARD).agg(F.min(joined).alias("follows"))
    per_shard = segments.groupBy(*SHARD).agg(
        F.min(F.array_min(ids)).alias("min_id"),
        F.max(F.array_max(ids)).alias("max_id"),
        F.sum(F.size(F.filter(ids, lambda t: t == EOT))).alias("n_separators"),
        F.sum(F.size(ids)).alias("n_tokens"),
        F.max(F.col("seg_start") + F.size(ids)).alias("shard_len"),
    )
    tail = per_shard.groupBy("source").agg(
        F.max("shard_id").alias("tail_shard"), F.count_distinct("shard_id").alias("n_shards"), F.min("shard_id").alias("head_shard")
    )
    good = (
        (F.col("min_id") >= 0)
        & (F.col("max_id") < vocab_size)
        & (F.col("n_separators") > 0)
        & F.col("follows")
        & (F.col("head_shard") == 0)
        & (F.col("n_shards") == F.col("tail_shard") + 1)
        & ((F.col("n_tokens") == shard_size) | (F.col("shard_id") == F.col("tail_shard")))
    )
    checked = per_shard.join(follows, SHARD).join(tail, "source").withColumn("ok", good)
    return checked.drop("tail_shard", "head_shard", "n_shards", "follows")


def preflight(required: DataFrame, shards: DataFrame) -> DataFrame:
    """Required (source, split, need) against the shards found; absent counts as zero."""
    found = shards.select(*SHARD).distinct().groupBy("source", "split").agg(F.count("*").alias("found"))
    return (
        required.join(found, ["source", "split"], "left")
        .withColumn("found", F.coalesce("found", F.lit(0)))
        .withColumn("ok", F.col("found") >= F.col("need"))
    )


def require_preflight(required: DataFrame, shards: DataFrame) -> DataFrame:
    """The refusing form: the job fails on the first requirement that is not met."""
    checked = preflight(required, shards)
    message = F.format_string("%s/%s holds %d shards, %d required", "source", "split", "found", "need")
    return checked.withColumn("ok", F.assert_true(F.col("ok"), message).isNull())


def already_complete(shards: DataFrame, source: str, split: str, need: int) -> bool:
    """Whether a stage can be skipped: its shards exist. ``shards`` may be segments or a manifest."""
    found = shards.where((F.col("source") == source) & (F.col("split") == split)).select("shard_id").distinct()
    return found.count() >= need


def complete_stages(stages: DataFrame, manifest: DataFrame) -> DataFrame:
    """``skip_stage`` for many (source, split, need) rows at once, from the manifest alone."""
    checked = preflight(stages, manifest)
    return checked.select("source", "split", F.col("ok").alias("skip_stage"))


def resolve_weights(weights: DataFrame, shards: DataFrame, split: str, allow_missing: bool = False) -> DataFrame:
    """Drop sources without shards of the split and renormalise the rest to 1.

    Dropping a source changes the mixture silently, so it fails unless ``allow_missing``.
    """
    present = shards.where(F.col("split") == split).select("source").distinct().withColumn("present", F.lit(True))
    joined = weights.join(present, "source", "left")
    if not allow_missing:
        message = F.concat(F.lit(f"no {split} shards for source "), F.col("source"))
        joined = joined.withColumn(
            "present", F.when(F.assert_true(F.col("present").isNotNull(), message).isNull(), True)
        )
    kept = joined.where("present").drop("present")
    # One row per named source, so the unpartitioned window is a handful of rows.
    return kept.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0))))


def val_isolation(shards: DataFrame, val_source: str) -> tuple[DataFrame, DataFrame]:
    """(validation shards of the base source, shards that are in both splits)."""
    ids = shards.select(*SHARD).distinct()
    overlap = ids.groupBy("source", "shard_id").agg(F.count("*").alias("n_splits")).where("n_splits > 1")
    return ids.where((F.col("split") == "val") & (F.col("source") == val_source)), overlap


def mask_audit(examples: DataFrame, result_open: int, result_close: int) -> DataFrame:
    """Rows whose mask is misaligned, not 0/1, or learns an injected result."""
    pairs = F.arrays_zip(F.col("ids").alias("id"), F.col("mask").alias("m"))
    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("leak"))

    def step(state, pair):
        inside = (state["inside"] | (pair["id"] == result_open)) & (pair["id"] != result_close)
        learned = (state["inside"] | inside) & (pair["m"] == 1)
        return F.struct(inside.alias("inside"), (state["leak"] | F.coalesce(learned, F.lit(False))).alias("leak"))

    clean = ~F.aggregate(pairs, start, step)["leak"]
    aligned = F.size("ids") == F.size("mask")
    binary = F.forall("mask", lambda m: m.isin(0, 1))
    return (
        examples.withColumn("aligned", aligned)
        .withColumn("binary", binary)
        .withColumn("result_masked", clean)
        .withColumn("violation", ~(F.col("aligned") & F.col("binary") & F.col("result_masked")))
    )


def check_layout(params: DataFrame) -> DataFrame:
    """(total_batch, B, T, ranks) rows: the total must divide; adds the accumulation count."""
    per_step = F.col("B") * F.col("T") * F.col("ranks")
    return params.withColumn("divides", F.col("total_batch") % per_step == 0).withColumn(
        "accumulation", F.when(F.col("divides"), whole_div(F.col("total_batch"), per_step))
    )


def require_layout(params: DataFrame) -> DataFrame:
    checked = check_layout(params)
    ok = F.assert_true(F.col("divides"), F.lit("total batch must be a multiple of B*T*ranks"))
    return checked.withColumn("accumulation", F.when(ok.isNull(), F.col("accumulation")))
