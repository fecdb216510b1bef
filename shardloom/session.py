"""Session building, the shared scratch folder and package shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()
_paths: dict[str, list[str]] = {}


def build_session(app: str = "shardloom", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the submitted session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local path
    would be lost with its executor, so an unset folder is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="shardloom-")
    return _local_scratch[app]


def new_scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Remove the intermediate tables this application has written so far; returns how many paths.

    For the end of a job, when its results are written elsewhere: frames that still read an
    intermediate table cannot be used afterwards.
    """
    paths = _paths.pop(spark.sparkContext.applicationId, [])
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = hadoop.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(paths)


def folders_done(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the folders ``prefix<number>`` below ``path`` whose write was completed, from the
    store's listing alone."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    where = hadoop.Path(path)
    found = where.getFileSystem(conf).globStatus(hadoop.Path(where, f"{prefix}*/_SUCCESS")) or []
    return [int(status.getPath().getParent().getName()[len(prefix) :]) for status in found]


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write once to the shared folder and read back.

    Used where an expensive stage has two consumers. Unlike a cached frame the result survives
    executor loss, and unlike an RDD checkpoint each consumer reads only its columns.
    """
    path = new_scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (what ``--py-files`` does on submit)."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="shardloom-pkg-"), "shardloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("shardloom", os.path.relpath(full, root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
