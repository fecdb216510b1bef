"""Streaming queries: the given tables arrive as several files, one per trigger, and the result
must equal the batch twin."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.arrays import digest, total
from shardloom.functions.text import hours_minutes
from shardloom.plans import corpus as _corpus  # noqa: F401  (registers the batch twins)
from shardloom.plans import fixtures as fx
from shardloom.plans import telemetry as tele
from shardloom.plans.registry import QUERIES, query
from shardloom.session import new_scratch_path, ship_package
from shardloom.sources import tail
from shardloom.sources.corpus import scan_corpus_stream as corpus_stream
from shardloom.sources.logs import parse_metric_lines
from shardloom.streaming import corpus as stream_corpus
from shardloom.streaming import watch

CHUNKS = 4


def arriving(
    spark: SparkSession, rows: DataFrame, order: str, name: str, fmt: str = "parquet", one_file: bool = True
) -> str:
    """Write rows as files that arrive one after the other, in key order. Without ``one_file`` a part's
    rows come in as many files as they have partitions, for readers that need no order inside a part."""
    path = new_scratch_path(spark, name)
    last = rows.agg(F.max(order)).first()[0] + 1
    for i in range(CHUNKS):
        chunk = rows.where((F.col(order) * CHUNKS >= i * last) & (F.col(order) * CHUNKS < (i + 1) * last))
        (chunk.coalesce(1) if one_file else chunk).write.mode("append").format(fmt).save(path)
    return path


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def docs_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.corpus(spark, sf_dir)
    files = arriving(spark, docs, "ord", "docs-arriving")
    return corpus_stream(spark, files, docs.schema, order_col="ord", files_per_trigger=1)


@query("J1", QUERIES["pack_shards"].sql)
def stream_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving documents end up in the shards the batch job would have written."""
    path = new_scratch_path(spark, "packed-stream")
    run = stream_corpus.pack_stream(
        docs_stream(spark, sf_dir), path, new_scratch_path(spark, "packed-stream-state"), fx.SHARD, vocab="char"
    )
    run.awaitTermination()
    return stream_corpus.read_packed(spark, path).select(
        "source",
        "split",
        "shard_id",
        "seg_start",
        "ord",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        digest(F.col("tokens")).alias("digest"),
    )


@query("J1 (byte-level BPE)")
def stream_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are encoded one by one, so each trigger takes a part's worth of files, in any order."""
    docs = fx.corpus(spark, sf_dir)
    files = arriving(spark, docs, "ord", "docs-arriving", one_file=False)
    per_trigger = -(-len(spark.read.parquet(files).inputFiles()) // CHUNKS)
    stream = corpus_stream(spark, files, docs.schema, order_col="ord", files_per_trigger=per_trigger)
    path = new_scratch_path(spark, "token-stream")
    stream_corpus.tokenize_stream(stream, path, new_scratch_path(spark, "token-stream-state")).awaitTermination()
    rows = spark.read.schema("source string, ord bigint, n_tok int, tokens array<int>").parquet(path)
    return rows.select("source", "ord", "n_tok", total(F.col("tokens")).alias("id_total"), digest(F.col("tokens")).alias("digest"))


def samples_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tele.samples(spark, sf_dir).select("run", "order", "step", "active", "util")
    return stream_of(spark, arriving(spark, rows, "order", "samples-arriving"), rows.schema)


@query(
    "J3",
    f"""WITH {tele.SAMPLES_SQL}, stalls AS (WITH {tele.islands_sql('active AND util < 40', tele.STALL)}),
        idles AS (WITH {tele.islands_sql('NOT active', tele.IDLE)})
        SELECT run, step, 'stall' AS kind, in_row FROM stalls UNION ALL SELECT run, step, 'idle', in_row FROM idles""",
)
def stream_stall_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, state = (new_scratch_path(spark, name) for name in ("stall-alerts", "stall-alerts-state"))
    run = watch.watch_stalls(samples_stream(spark, sf_dir), path, state, stall_n=tele.STALL, idle_n=tele.IDLE)
    run.awaitTermination()
    return watch.read_alerts(spark, path)


DEADLINE, DELAY = 60, 30  # minutes; a sample's order is its minute
DAY = 86_400  # the clock starts a day after 1970, where no watermark lies


@query(
    "J3 (silence, by event-time timers)",
    f"""WITH {tele.SAMPLES_SQL},
        marked AS (SELECT run, ord, coalesce(ord - lag(ord) OVER (PARTITION BY run ORDER BY ord) > {DEADLINE}, true) AS fresh FROM samples),
        bursts AS (SELECT run, ord, sum(fresh::INTEGER) OVER (PARTITION BY run ORDER BY ord) AS burst FROM marked),
        ends AS (SELECT run, max(ord) AS last_order FROM bursts GROUP BY run, burst)
        SELECT run, last_order FROM ends WHERE last_order + {DEADLINE} < (SELECT max(ord) - {DELAY} FROM samples)""",
)
def stream_silence_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices that send nothing for an hour, the ones that never come back included."""
    rows = tele.samples(spark, sf_dir).select("run", "order", F.timestamp_seconds(DAY + F.col("order") * 60).alias("at"))
    stream = stream_of(spark, arriving(spark, rows, "order", "silence-arriving"), rows.schema)
    path = new_scratch_path(spark, "silence-alerts")
    alerts = watch.silence_alerts(stream, DEADLINE * 60, DELAY * 60)
    watch.append_rows(alerts, path, new_scratch_path(spark, "silence-alerts-state")).awaitTermination()
    found = spark.read.schema(watch.SILENT).parquet(path)
    return found.select("run", ((F.unix_timestamp("last_at") - DAY) / 60).cast("bigint").alias("last_order"))


def lines_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tele.log_lines(spark, sf_dir)
    return stream_of(spark, arriving(spark, rows, "line_no", "lines-arriving"), rows.schema)


@query("J4", f"WITH {tele.LINES_SQL} SELECT run, ord AS line_no, value FROM lines WHERE regexp_matches(value, '(?i) (nan|inf)( |$)')")
def stream_nonfinite_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = watch.nonfinite_alerts(lines_stream(spark, sf_dir))
    path = new_scratch_path(spark, "nonfinite-alerts")
    watch.append_rows(alerts, path, new_scratch_path(spark, "nonfinite-alerts-state")).awaitTermination()
    return spark.read.schema(alerts.schema).parquet(path)


@query(
    "J5",
    f"""WITH {tele.METRICS_SQL}, t AS (SELECT run, step, loss FROM metrics WHERE kind = 'train'
          QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) = 1)
        SELECT run, step, CASE WHEN NOT isnan(loss) THEN loss END AS loss,
          printf('%dh%02dm', (500 - step) * 30 // 3600, ((500 - step) * 30 % 3600) // 60) AS eta FROM t""",
)
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest step and loss per run, with the time left at 30 seconds a step."""
    path = new_scratch_path(spark, "progress")
    updates = watch.progress_updates(lines_stream(spark, sf_dir))
    watch.append_updates(updates, path, new_scratch_path(spark, "progress-state")).awaitTermination()
    latest = watch.latest_updates(spark, path, "run bigint, step bigint, loss double")
    return latest.select(
        "run",
        "step",
        F.nanvl("loss", F.lit(None).cast("double")).alias("loss"),
        hours_minutes((F.lit(500) - F.col("step")) * 30).alias("eta"),
    )


def grow_files(lines: DataFrame, folder: str) -> None:
    """Write each file's lines (file, line_no, value) in order. A longer beginning of the same lines
    replaces a shorter one, which readers see as growth; a task that runs again writes the same."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = tail.open_store(folder)
        store.create_dir(root)
        out, name = None, None

        def close() -> None:
            out.close()
            store.move(f"{root}/_{name}", f"{root}/{name}")

        for part in parts:
            for file, rows in part.groupby("file", sort=False):
                if file != name:
                    if out:
                        close()
                    name, out = file, store.open_output_stream(f"{root}/_{file}")
                out.write("".join(f"{value}\n" for value in rows["value"]).encode())
            yield pd.DataFrame({"n": [len(part)]})
        if out:
            close()

    ship_package(lines.sparkSession)
    placed = lines.repartition("file").sortWithinPartitions("file", "line_no").select("file", "value")
    placed.mapInPandas(write, "n bigint").agg(F.sum("n")).collect()


@query(
    "A7, J4, J5 (files that grow)",
    f"""WITH {tele.METRICS_SQL},
        placed AS (SELECT run, ord, 'host-' || (run % 16) || '-' || (ord >> 16) || '.log' AS file FROM lines),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord) - 1 AS at_line FROM placed)
        SELECT file, at_line AS line_no, n.run, kind, step, CASE WHEN NOT isnan(loss) THEN loss END AS loss, isnan(loss) AS loss_is_nan
        FROM numbered n JOIN metrics m ON m.run = n.run AND m.line_no = n.ord""",
)
def tail_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of log files that grow between triggers, as one read of the whole files gives them.

    A file holds the lines of a host's runs, at most 65,536 of them.
    """
    path = new_scratch_path(spark, "grown-lines")
    host, stretch = (F.col("run") % 16).cast("string"), F.shiftright("line_no", 16).cast("string")
    file = F.concat(F.lit("host-"), host, F.lit("-"), stretch, F.lit(".log")).alias("file")
    value = F.concat_ws("\t", F.col("run").cast("string"), "value").alias("value")
    tele.log_lines(spark, sf_dir).select(file, "line_no", value).write.parquet(path)
    lines = spark.read.parquet(path)
    last = (lines.agg(F.max("line_no")).first()[0] or 0) + 1
    folder, out, state = (new_scratch_path(spark, f"tail-{n}") for n in ("logs", "out", "state"))
    for i in range(2):
        grow_files(lines.where(F.col("line_no") * 2 < (i + 1) * last), folder)
        tail.number_lines(tail.tail_lines(spark, folder, ".log"), out, state).awaitTermination()
    split = F.split("value", "\t", 2)
    found = tail.read_numbered(spark, out).select(
        F.element_at(F.split("path", re.escape("/")), -1).alias("file"),
        "line_no",
        split[0].cast("bigint").alias("run"),
        split[1].alias("value"),
    )
    loss_is_nan = F.isnan("loss")
    return parse_metric_lines(found).select(
        "file", "line_no", "run", "kind", "step", F.when(~loss_is_nan, F.col("loss")).alias("loss"), loss_is_nan.alias("loss_is_nan")
    )
