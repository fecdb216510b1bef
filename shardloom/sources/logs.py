"""Run logs, console captures, device samples, checkpoints and the ledger of finished runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The line formats.
TRAIN_LINE = r"^(\d+) train (\S+) norm (\S+)"
RATE_NAMES = ("lr_muon", "lr_adam", "tok_s")
VAL_LINE = r"^(\d+) val (\S+)$"
TUNING_LINE = r"^(\d+) loss (\S+) norm (\S+)$"
NONFINITE = r"(?i) (nan|inf)( |$)"
CHECKPOINT_STEP = r"(?:ckpt|sft)_(\d+)"


def parse_metric_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Typed rows of train, val and tuning lines; other lines (samples, notes) are not metrics.

    Adds step, kind, loss, norm, lr_a, lr_b, tok_s; works on batch and streaming frames alike. The
    patterns only decide what kind a line is; its fields come from one split.
    """
    text = F.col(line)
    kind = (
        F.when(text.rlike(TRAIN_LINE), "train").when(text.rlike(VAL_LINE), "val").when(text.rlike(TUNING_LINE), "sft")
    )
    others = [c for c in lines.columns if c != line]
    part = lambda i: F.get("__parts", i)
    number = lambda i: part(i).try_cast("double")
    rates = F.array_position("__parts", RATE_NAMES[0]).cast("int")  # from 1; the first value's index from 0
    named = (rates > 0) & (part(rates + 1) == RATE_NAMES[1]) & (part(rates + 3) == RATE_NAMES[2])
    rate = lambda i: F.when(named, number(rates + i))
    return (
        lines.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .withColumn("__parts", F.split(text, r"\s"))
        .select(
            *others,
            "kind",
            part(F.lit(0)).try_cast("bigint").alias("step"),
            number(F.lit(2)).alias("loss"),
            F.when(F.col("kind") != "val", number(F.lit(4))).alias("norm"),
            rate(0).alias("lr_a"),
            rate(2).alias("lr_b"),
            rate(4).alias("tok_s"),
        )
    )


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.input_file_name().alias("run"), "value")
    return parse_metric_lines(lines)


def stream_log_lines(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """(run, value): the lines of arriving log files, the file being the run."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select(F.input_file_name().alias("run"), "value")


def nonfinite_metrics(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines holding a stand-alone nan or inf."""
    return lines.where(F.col(line).rlike(NONFINITE))


def parse_console(consoles: DataFrame, metrics: DataFrame, total: int) -> DataFrame:
    """Step per run from progress-bar text (run, line_no, value), else from the metric log, else 0.

    Carriage returns separate bar updates; the last ``<n>/<total>`` wins. One aggregation over
    both inputs, no join. ``metrics`` has run, line_no, kind, step.
    """
    updates = consoles.select("run", "line_no", F.posexplode(F.split("value", "\r")).alias("update_no", "text"))
    seen = F.regexp_extract_all(F.col("text"), F.lit(rf"(\d+)/{total}(?!\d)"), F.lit(1))
    bar = updates.select(
        "run", F.struct("line_no", "update_no").alias("at"), F.try_element_at(seen, F.lit(-1)).try_cast("bigint").alias("bar")
    ).withColumn("log", F.lit(None).cast("bigint"))
    logged = metrics.select(
        "run",
        F.struct("line_no", F.lit(0).alias("update_no")).alias("at"),
        F.lit(None).cast("bigint").alias("bar"),
        F.when(F.col("kind") == "train", F.col("step")).alias("log"),
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    return (
        bar.unionByName(logged)
        .groupBy("run")
        .agg(F.coalesce(last("bar"), last("log"), F.lit(0).cast("bigint")).alias("step"))
    )


def typed_device(samples: DataFrame) -> DataFrame:
    """Strip %, MiB and W from util, mem and power and cast."""
    number = lambda c: F.regexp_replace(F.col(c), r"[^0-9.\-]", "").try_cast("double").alias(c)
    others = [c for c in samples.columns if c not in ("util", "mem", "power")]
    return samples.select(*others, number("util"), number("mem"), number("power"))


def read_device_csv(spark: SparkSession, path: str) -> DataFrame:
    return typed_device(spark.read.schema("ts string, util string, mem string, power string").csv(path))


def list_checkpoints(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified, step) of artifacts below a folder; file contents are never read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "length", "modificationTime")
    )
    step = F.regexp_extract("path", CHECKPOINT_STEP, 1).try_cast("bigint")
    return files.select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), step.alias("step")
    ).where(F.col("step").isNotNull())


LEDGER = T.StructType(
    [
        T.StructField("run_name", T.StringType()),
        T.StructField("val_loss", T.DoubleType()),
        T.StructField("tokens_per_sec", T.DoubleType()),
    ]
)


def append_ledger(finals: DataFrame, path: str) -> None:
    """Append final numbers; the schema stands for the header."""
    finals.select([F.col(f.name).cast(f.dataType) for f in LEDGER]).write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def read_csv_ledgers(spark: SparkSession, path: str) -> DataFrame:
    """Ledgers kept as CSV, with or without a header line; lines without numbers are headers."""
    names = [f.name for f in LEDGER]
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path)
    typed = raw.select([F.col(f.name).try_cast(f.dataType).alias(f.name) for f in LEDGER])
    return typed.where(F.col(names[1]).isNotNull() | F.col(names[2]).isNotNull())
