"""Run telemetry: smoothing, ETA, retention, stalls, summaries.

Frames hold one row per (run, step) with dense 0-based steps; ``with_steps`` numbers raw rows. Any
run may hold a large part of all rows, so nothing here puts a run into one window or one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.constants import (
    DIP_UTIL,
    EMA_KEEP,
    IDLE_SAMPLES,
    MIN_UTIL,
    RECENT_SAMPLES,
    STALL_SAMPLES,
    VALIDATION_BATCHES,
)
from shardloom.functions.arrays import whole_div
from shardloom.functions.schedules import phase, validates
from shardloom.functions.text import hours_minutes
from shardloom.operators.ordering import SHARED_LEVELS, dense_index, newest, prefix_scan, with_halo

BLOCK_ROWS = 1024
ZERO_WEIGHT_STEPS = 7200  # EMA_KEEP to this power is zero as a double


def with_steps(rows: DataFrame, run: str = "run", order: str = "order") -> DataFrame:
    return dense_index(rows, [run], order, "step", levels=SHARED_LEVELS)


def run_lengths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run").agg((F.max("step") + 1).alias("n_steps"))


def with_lengths(rows: DataFrame) -> DataFrame:
    """Adds ``n_steps`` per run: a partial aggregate joined back (one row per run)."""
    return rows.join(run_lengths(rows), "run")


def moving_average(rows: DataFrame, k: int, value: str = "loss", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean of the last k values, from the k-th value on.

    Blocks of steps are evaluated side by side; the k-1 rows before a block are copied into it.
    """
    block_rows = max(block_rows, 2 * k)
    halo = with_halo(rows.select("run", "step", value), "step", k - 1, block_rows) if k > 1 else None
    if halo is None:
        return rows.select("run", "step", F.col(value).cast("double").alias("smooth"))
    frame = Window.partitionBy("run", "__window_block").orderBy("step").rowsBetween(-(k - 1), 0)
    averaged = halo.withColumn("smooth", F.avg(value).over(frame))
    return averaged.where(F.col("__home") & (F.col("step") >= k - 1)).select("run", "step", "smooth")


def ema_step_time(rows: DataFrame, value: str = "dt", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """e = 0.9 e + 0.1 dt per run, without step 0 (it carries the compile), seeded with step 1.

    Inside a block of steps the recurrence is a weighted running sum. A block starts from the ends
    of all blocks whose weight is not zero as a double yet; those ends are copied into the next
    group of blocks as a halo, so a long run is no single task. ``block_rows`` changes only how the
    work is cut. Step 0 has a null ``ema``.
    """
    block_rows = min(max(block_rows, 1), 4 * BLOCK_ROWS)  # powers within a block stay finite
    place = F.col("step") - 1
    inside = (place % block_rows).cast("double")
    weight = F.when(F.col("step") == 1, F.lit(1.0)).otherwise(F.lit(1.0 - EMA_KEEP))
    timed = rows.where("step >= 1").select(
        "run",
        "step",
        whole_div(place, block_rows).alias("__block"),
        inside.alias("__p"),
        (weight * F.col(value) * F.pow(F.lit(EMA_KEEP), -inside)).alias("__w"),
    )
    ends = timed.groupBy("run", "__block").agg((F.sum("__w") * F.pow(F.lit(EMA_KEEP), F.max("__p"))).alias("__end"))
    reach = ZERO_WEIGHT_STEPS // block_rows + 1
    halo = with_halo(ends, "__block", reach, 2 * reach + BLOCK_ROWS)
    earlier = Window.partitionBy("run", "__window_block").orderBy("__block").rowsBetween(-reach, -1)
    here = F.col("__block")
    held = halo.withColumn("__ends", F.collect_list(F.struct("__block", "__end")).over(earlier)).where("__home")
    decay = lambda end: F.pow(F.lit(EMA_KEEP), ((here - end["__block"] - 1) * block_rows).cast("double"))
    carried = held.select(
        "run", "__block", F.aggregate("__ends", F.lit(0.0), lambda acc, end: acc + end["__end"] * decay(end)).alias("__carry")
    )
    running = Window.partitionBy("run", "__block").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    scanned = timed.withColumn("__own", F.sum("__w").over(running) * F.pow(F.lit(EMA_KEEP), F.col("__p")))
    smoothed = scanned.join(carried, ["run", "__block"], "left").select(
        "run",
        "step",
        (F.col("__own") + F.coalesce("__carry", F.lit(0.0)) * F.pow(F.lit(EMA_KEEP), F.col("__p") + 1)).alias("ema"),
    )
    first = rows.where("step = 0").select("run", "step", F.lit(None).cast("double").alias("ema"))
    return smoothed.unionByName(first)


def eta(smoothed: DataFrame) -> DataFrame:
    """Adds ``seconds_left`` and its text; before the first honest rate the text says so."""
    left = (F.col("n_steps") - 1 - F.col("step")) * F.col("ema")
    return smoothed.withColumn("seconds_left", left).withColumn(
        "eta", F.coalesce(hours_minutes(left), F.lit("(compiling)"))
    )


def constant_rate_eta(step: Column, n: int, tokens_per_step: int, rate: float) -> Column:
    """Hours left at a fixed rate, for a run that has made a step."""
    return F.when(step > 0, (F.lit(n) - step) * tokens_per_step / F.lit(rate) / 3600.0)


def downsample(rows: DataFrame, n: int) -> DataFrame:
    """Rows 1, n+1, 2n+1, ... of every run."""
    return rows.where(F.col("step") % n == 0)


def tail_n(rows: DataFrame, n: int) -> DataFrame:
    return newest(rows, ["run"], "step", n)


def expired(checkpoints: DataFrame, keep: int) -> DataFrame:
    """All but the newest ``keep`` per run; keep 0 removes nothing (an empty slice).

    Only the newest rows of a run are ranked; the rest compares with the oldest kept step.
    """
    if keep == 0:
        return checkpoints.where(F.lit(False))
    kept = newest(checkpoints.select("run", "step"), ["run"], "step", keep)
    cutoff = kept.groupBy("run").agg(F.min("step").alias("__oldest"))
    return checkpoints.join(cutoff, "run").where(F.col("step") < F.col("__oldest")).drop("__oldest")


def keep_last(checkpoints: DataFrame, keep: int) -> DataFrame:
    return checkpoints if keep == 0 else newest(checkpoints, ["run"], "step", keep)


def keep_milestones(checkpoints: DataFrame, wanted: Mapping[int, str]) -> DataFrame:
    """Checkpoints of named steps with their label. The labels are a local relation of known size, so
    the planner decides how to join them."""
    labels = checkpoints.sparkSession.createDataFrame(list(wanted.items()), "step bigint, label string")
    return checkpoints.join(labels, "step")


def consecutive(rows: DataFrame, counts: Column, out: str) -> DataFrame:
    """Length of the unbroken run of ``counts`` up to each sample: distance to the last break."""
    broken = F.when(~counts, F.col("step"))
    scanned = prefix_scan(rows, ["run"], "step", {"__break": ("max", broken)})
    return scanned.withColumn(out, F.col("step") - F.coalesce("__break", F.lit(-1).cast("bigint"))).drop("__break")


def stall_runs(samples: DataFrame, min_util: float = MIN_UTIL, n: int = STALL_SAMPLES) -> DataFrame:
    """Samples at which an active device has been under the threshold n times in a row."""
    low = F.col("active") & (F.coalesce(F.col("util"), F.lit(0.0)) < min_util)
    return consecutive(samples, low, "in_row").where(F.col("in_row") == n)


def idle_runs(samples: DataFrame, n: int = IDLE_SAMPLES) -> DataFrame:
    """Samples at which nothing has been active n times in a row."""
    return consecutive(samples, ~F.col("active"), "in_row").where(F.col("in_row") == n)


def _recent(samples: DataFrame, last: int) -> DataFrame:
    """The newest samples; a missing reading counts as 0, as an idle device would."""
    recent = newest(samples, ["run"], "step", last)
    return recent.fillna(0.0, ["util", "power"])


def device_summary(samples: DataFrame, last: int = RECENT_SAMPLES, dip: float = DIP_UTIL) -> DataFrame:
    return (
        _recent(samples, last)
        .groupBy("run")
        .agg(
            F.avg("util").alias("util_avg"),
            F.min("util").alias("util_min"),
            F.max("util").alias("util_max"),
            F.avg("power").alias("power_avg"),
            F.count("*").alias("n_samples"),
            F.count_if(F.col("util") < dip).alias("n_low"),
        )
    )


def device_dips(samples: DataFrame, last: int = RECENT_SAMPLES, dip: float = DIP_UTIL, show: int = 8) -> DataFrame:
    """The last few samples under the dip threshold among the recent ones."""
    recent = _recent(samples, last)
    return newest(recent.where(F.col("util") < dip), ["run"], "step", show)


def validation_mean(losses: DataFrame, every: int, first: int = VALIDATION_BATCHES) -> DataFrame:
    """Mean over the first batches of a reset reader, at validation steps. (run, step, k, loss)"""
    at = with_lengths(losses.where(F.col("k") < first)).where(validates(F.col("step"), F.col("n_steps"), every))
    return at.groupBy("run", "step").agg(F.avg("loss").alias("val_loss"), F.count("*").alias("n_batches"))


def step_loss(micro: DataFrame) -> DataFrame:
    """Mean over a rank's micro-batches, then over ranks: a mean of means. (run, step, rank, loss)"""
    per_rank = micro.groupBy("run", "step", "rank").agg(F.avg("loss").alias("loss"))
    return per_rank.groupBy("run", "step").agg(F.avg("loss").alias("loss"), F.count("*").alias("n_ranks"))


def latest_per_run(rows: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    newest_row = F.max_by(F.struct(*columns), F.col(order)).alias("__latest")
    return rows.groupBy("run").agg(newest_row).select("run", "__latest.*")


def throughput(rows: DataFrame, tokens_per_step: int) -> DataFrame:
    """Tokens per second of each step; 0 when no time passed."""
    rate = F.when(F.col("dt") > 0, F.lit(tokens_per_step) / F.col("dt")).otherwise(0.0)
    return rows.withColumn("tok_s", rate)


def run_throughput(rows: DataFrame, tokens_per_step: int) -> DataFrame:
    totals = rows.groupBy("run").agg(F.count("*").alias("n_steps"), F.sum("dt").alias("elapsed"))
    rate = F.when(F.col("elapsed") > 0, F.col("n_steps") * tokens_per_step / F.col("elapsed")).otherwise(0.0)
    return totals.withColumn("tokens_per_sec", rate)


def phase_summary(rows: DataFrame) -> DataFrame:
    """First, last and lowest loss per schedule phase, the change within it, and the plot floor."""
    phased = with_lengths(rows).withColumn("phase", phase(F.col("step"), F.col("n_steps")))
    per_phase = phased.groupBy("run", "phase").agg(
        F.count("*").alias("n_rows"),
        F.min_by("loss", "step").alias("first_loss"),
        F.max_by("loss", "step").alias("last_loss"),
        F.min("loss").alias("min_loss"),
    )
    lowest = F.min("min_loss").over(Window.partitionBy("run"))  # at most three rows per run
    return per_phase.withColumn("delta", F.col("last_loss") - F.col("first_loss")).withColumn(
        "floor", lowest * 0.95
    )


def compare_runs(rows: DataFrame, runs: Sequence[str], value: str = "loss") -> DataFrame:
    """Named runs side by side at equal steps; the caller names the columns wanted."""
    return rows.groupBy("step").pivot("run", list(runs)).agg(F.first(value))


def stage_summary(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Steps, first and last loss per run, with the seconds of its ledger row."""
    per_run = rows.groupBy("run").agg(
        (F.max("step") + 1).alias("n_steps"),
        F.min_by("loss", "step").alias("first_loss"),
        F.max_by("loss", "step").alias("last_loss"),
    )
    return per_run.join(ledger.select("run", "seconds"), "run", "left")
