"""Watching runs while they write: bad values, progress, stalls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shardloom.constants import IDLE_SAMPLES, MIN_UTIL, STALL_SAMPLES
from shardloom.operators.ordering import dense_index, prefix_scan
from shardloom.session import folders_done
from shardloom.sources.logs import nonfinite_metrics, parse_metric_lines

ALERTS = "run bigint, step bigint, kind string, in_row bigint"
CARRY = "run bigint, last_step bigint, n_samples bigint, stall_break bigint, idle_break bigint"


def nonfinite_alerts(lines: DataFrame) -> DataFrame:
    """Stateless: lines holding nan or inf."""
    return nonfinite_metrics(lines)


def watch_stalls(
    samples: DataFrame,
    path: str,
    state: str,
    min_util: float = MIN_UTIL,
    stall_n: int = STALL_SAMPLES,
    idle_n: int = IDLE_SAMPLES,
    available_now: bool = True,
) -> StreamingQuery:
    """Alerts of (run, step, active, util) samples: n low or idle samples of a device in a row.

    Every trigger counts its samples in blocks (a device may send any share of them) and hands on one
    row per device: its last step, its number of samples and where its streaks last broke. A trigger
    writes alerts and that carry under its number, so a replay overwrites itself. Counting goes on
    after an alert. Samples at or before a device's last counted step are late: they are kept under
    ``late`` and change nothing.
    """

    def watch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = f"{path}/carry/batch={batch_id - 1}"
        carry = spark.read.schema(CARRY).parquet(earlier) if batch_id else spark.createDataFrame([], CARRY)
        seen = batch.select("run", "step", "active", "util").join(carry, "run", "left")
        late = F.coalesce(F.col("step") <= F.col("last_step"), F.lit(False))
        seen.where(late).select("run", "step", "active", "util").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        rows_path = f"{path}/rows/batch={batch_id}"
        dense_index(seen.where(~late), ["run"], "step", "place").write.mode("overwrite").parquet(rows_path)
        rows = spark.read.parquet(rows_path)
        rows = rows.withColumn("place", F.col("place") + F.coalesce("n_samples", F.lit(0)) + 1)
        low = F.col("active") & ~F.coalesce(F.col("util") >= min_util, F.lit(False))
        idle = ~F.col("active")
        scanned = prefix_scan(
            rows, ["run"], "place", {"__stall": ("max", F.when(~low, F.col("place"))), "__idle": ("max", F.when(~idle, F.col("place")))}
        )
        none = F.lit(0).cast("bigint")
        broke = lambda now, before: F.coalesce(F.col(now), F.col(before), none)
        counted = scanned.select(
            "run",
            "step",
            (F.col("place") - broke("__stall", "stall_break")).alias("stall"),
            (F.col("place") - broke("__idle", "idle_break")).alias("idle"),
        )
        alerts = [
            counted.where(F.col(kind) == n).select("run", "step", F.lit(kind).alias("kind"), F.col(kind).alias("in_row"))
            for kind, n in (("stall", stall_n), ("idle", idle_n))
        ]
        alerts[0].unionByName(alerts[1]).write.mode("overwrite").parquet(f"{path}/alerts/batch={batch_id}")
        now = rows.select(
            "run",
            F.col("step").alias("last_step"),
            F.col("place").alias("n_samples"),
            F.when(~low, F.col("place")).alias("stall_break"),
            F.when(~idle, F.col("place")).alias("idle_break"),
        )
        columns = ("last_step", "n_samples", "stall_break", "idle_break")
        merged = carry.unionByName(now).groupBy("run").agg(*[F.max(c).alias(c) for c in columns])
        merged.write.mode("overwrite").parquet(f"{path}/carry/batch={batch_id}")

    writer = samples.writeStream.foreachBatch(watch).option("checkpointLocation", state)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ALERTS}, batch bigint").option("basePath", f"{path}/alerts").parquet(f"{path}/alerts").drop("batch")


def silent_devices(spark: SparkSession, path: str, batch_id: int, last_wanted: int) -> DataFrame:
    """Devices whose last counted sample lies before a step they should have reached."""
    return spark.read.schema(CARRY).parquet(f"{path}/carry/batch={batch_id}").where(F.col("last_step") < last_wanted).select("run", "last_step")


SILENT = "run bigint, last_at timestamp"


def _bursts(times: np.ndarray, known: list[tuple[int, int]], deadline: int) -> list[tuple[int, int]]:
    """Known (first, last) stretches without a gap above ``deadline``, joined with more times."""
    times = np.sort(times)
    edge = np.flatnonzero(np.diff(times) > deadline)
    first, last = times[np.append(0, edge + 1)], times[np.append(edge, len(times) - 1)]
    out: list[tuple[int, int]] = []
    for a, b in sorted([*known, *zip(first.tolist(), last.tolist())]):
        if out and a - out[-1][1] <= deadline:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def silence_alerts(samples: DataFrame, deadline: int, delay: int, at: str = "at") -> DataFrame:
    """(run, last_at) each time a device misses its deadline: nothing for more than ``deadline`` seconds
    after ``last_at``. ``samples`` is a stream with ``run`` and the event time ``at``.

    State per device is its stretches of samples that follow each other in time. A stretch is silent
    once the watermark has passed its deadline, so an event-time timer fires for a device that sends
    nothing any more, as soon as others move the watermark. Until then a late sample still joins the
    stretches around it; samples at or behind the watermark (``delay`` seconds behind the newest,
    the year 1970 at first) are dropped. Which trigger brings any other makes no difference. Stretches above the watermark are few: each pair of them is
    more than a deadline apart.
    """
    wait = deadline * 1000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = list(zip(*state.get)) if state.exists else []
        watermark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for part in parts:
                times = part[at].astype("datetime64[ms]").astype("int64").to_numpy()
                times = times[times > watermark]
                if len(times):
                    known = _bursts(times, known, wait)
        silent = [last for _, last in known if last + wait < watermark]
        left = [burst for burst in known if burst[1] + wait >= watermark]
        if left:
            state.update(([a for a, _ in left], [b for _, b in left]))
            state.setTimeoutTimestamp(left[0][1] + wait)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"run": [key[0]] * len(silent), "last": pd.Series(silent, dtype="int64")})

    found = (
        samples.select("run", at)
        .withWatermark(at, f"{delay} seconds")
        .groupBy("run")
        .applyInPandasWithState(
            step, "run bigint, last bigint", "firsts array<bigint>, lasts array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
        )
    )
    return found.select("run", F.timestamp_millis("last").alias("last_at"))


def progress_updates(lines: DataFrame) -> DataFrame:
    """Latest step and loss per run; map-side partial, state of one row per run."""
    metrics = parse_metric_lines(lines).where("kind = 'train'")
    latest = F.max_by(F.struct("step", "loss"), F.col("step")).alias("latest")
    return metrics.groupBy("run").agg(latest).select("run", "latest.*")


def append_updates(
    updates: DataFrame, path: str, state: str, available_now: bool = True, compact_every: int = 16
) -> StreamingQuery:
    """Write changed rows of each trigger under its number; a replay overwrites itself.

    Every ``compact_every`` triggers the newest row per run of all triggers so far is written as a
    generation, from the generation before and the triggers since.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact_updates(batch.sparkSession, path, batch.schema, batch_id)

    writer = updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _update_rows(spark: SparkSession, path: str, schema: T.StructType, upto: int | None = None) -> DataFrame:
    """Rows with their trigger: of the newest complete generation below ``upto``, then of later triggers."""
    full = T.StructType([*schema, T.StructField("batch", T.LongType())])
    before = lambda n: upto is None or n < upto
    generations = [n for n in folders_done(spark, f"{path}/generations", "upto=") if before(n)]
    base = max(generations, default=-1)
    batches = [n for n in folders_done(spark, path, "batch=") if n > base and (before(n) or n == upto)]
    rows = spark.createDataFrame([], full)
    if base >= 0:
        rows = spark.read.schema(full).parquet(f"{path}/generations/upto={base}")
    if batches:
        late = spark.read.schema(full).option("basePath", path).parquet(*[f"{path}/batch={n}" for n in batches])
        rows = rows.unionByName(late) if base >= 0 else late
    return rows


def _newest_updates(rows: DataFrame) -> DataFrame:
    others = [c for c in rows.columns if c != "run"]
    newest = F.max_by(F.struct(*others), "batch").alias("u")
    return rows.groupBy("run").agg(newest).select("run", "u.*")


def compact_updates(spark: SparkSession, path: str, schema: T.StructType, upto: int) -> None:
    """Publish the generation up to a trigger. It counts once its success marker stands, and writing
    it again gives the same rows."""
    newest = _newest_updates(_update_rows(spark, path, schema, upto))
    newest.write.mode("overwrite").parquet(f"{path}/generations/upto={upto}")


def latest_updates(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest update per run, read from the newest generation and the triggers after it."""
    parsed = T.StructType.fromDDL(schema)
    return _newest_updates(_update_rows(spark, path, parsed)).select(*parsed.names)


def append_rows(rows: DataFrame, path: str, state: str, available_now: bool = True) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").option("checkpointLocation", state)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
