"""Following text files that grow: a streaming source that keeps a place in each file.

Spark's own file source reads a file once. Here an offset is the end of the last whole line of every
file, so a trigger reads the bytes added since, wherever the stream is started again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery

from shardloom.operators.ordering import SHARED_LEVELS, dense_index
from shardloom.session import ship_package

LINES = "path string, at bigint, value string"
NUMBERED = "path string, line_no bigint, at bigint, value string"
COUNTS = "path string, n_lines bigint"
SPAN = 32 << 20  # bytes one task reads
CHUNK = 1 << 20


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path all executors share, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def last_line_end(file: pa.NativeFile, size: int) -> int:
    """Where the last whole line ends; 0 if there is none. Reads backwards, mostly one chunk."""
    high = size
    while high > 0:
        low = max(0, high - (1 << 16))
        file.seek(low)
        found = file.read(high - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        high = low
    return 0


def lines_within(file: pa.NativeFile, begin: int, low: int, high: int, end: int) -> Iterator[list[tuple[int, bytes]]]:
    """Lines (place, bytes) that start in [low, high), chunk by chunk. Lines start at ``begin`` and the
    last one ends at ``end``."""
    skip = low > begin  # a line that starts before low is another task's, but one may end right there
    at = read = low - 1 if skip else low
    file.seek(read)
    parts: list[bytes] = []
    while read < end and at < high:
        chunk = file.read(min(CHUNK, end - read))
        if not chunk:
            raise EOFError(f"a file ends before {end}")
        read += len(chunk)
        parts.append(chunk)
        if b"\n" not in chunk:
            continue
        whole = b"".join(parts).split(b"\n")
        parts = [whole.pop()]
        out = []
        for line in whole:
            if at < high and not skip:
                out.append((at, line))
            skip = False
            at += len(line) + 1
        yield out


@dataclass
class Stretch(InputPartition):
    path: str
    begin: int
    low: int
    high: int
    end: int


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.suffix = options["path"], options.get("suffix", "")
        self.span = int(options.get("span", SPAN))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = open_store(self.folder)
        ends = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            hidden = any(part[:1] in "._" for part in info.path[len(root) :].split("/") if part)
            if info.type == fs.FileType.File and not hidden and info.path.endswith(self.suffix):
                with store.open_input_file(info.path) as file:
                    ends[info.path] = last_line_end(file, info.size)
        return ends

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        found = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0)
            if stop < begin:
                raise ValueError(f"{path} ends at {stop}, but was read to {begin}: a followed file must only grow")
            found += [Stretch(path, begin, low, min(low + self.span, stop), stop) for low in range(begin, stop, self.span)]
        return found

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        p = partition
        store, _ = open_store(self.folder)
        with store.open_input_file(p.path) as file:
            for lines in lines_within(file, p.begin, p.low, p.high, p.end):
                places = pa.array([at for at, _ in lines], pa.int64())
                texts = pa.array([line.decode("utf-8", "replace") for _, line in lines], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([p.path] * len(lines), pa.string()), places, texts], ["path", "at", "value"])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_text"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_lines(spark: SparkSession, path: str, suffix: str = "", span: int = SPAN) -> DataFrame:
    """(path, at, value): a stream of the lines of files below a folder, those added later included.

    ``at`` is the byte where a line starts, so it names the line for good. Lines end with a line
    feed (carriage returns stay, bytes that are not UTF-8 are replaced); the rest behind the last one
    waits for its end. Files must only grow: a shorter one is an error, a removed one is forgotten.
    Large additions are read by several tasks, ``span`` bytes each.
    """
    ship_package(spark)
    spark.dataSource.register(TailSource)
    return spark.readStream.format(TailSource.name()).option("suffix", suffix).option("span", span).load(path)


def number_lines(lines: DataFrame, path: str, state: str, available_now: bool = True) -> StreamingQuery:
    """Write a tail's lines with their number in their file, from 0.

    A trigger counts on from the number of lines per file that the one before has left; all it writes
    lies under its number, so a replay overwrites itself.
    """

    def number(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/read/batch={batch_id}")
        rows = spark.read.schema(LINES).parquet(f"{path}/read/batch={batch_id}")
        earlier = f"{path}/counts/batch={batch_id - 1}"
        known = spark.read.schema(COUNTS).parquet(earlier) if batch_id else spark.createDataFrame([], COUNTS)
        placed = dense_index(rows, ["path"], "at", "line_no", levels=SHARED_LEVELS).join(known, "path", "left")
        line_no = (F.col("line_no") + F.coalesce("n_lines", F.lit(0))).alias("line_no")
        placed.select("path", line_no, "at", "value").write.mode("overwrite").parquet(f"{path}/lines/batch={batch_id}")
        now = known.unionByName(rows.groupBy("path").agg(F.count("*").alias("n_lines")))
        now.groupBy("path").agg(F.sum("n_lines").alias("n_lines")).write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")

    writer = lines.writeStream.foreachBatch(number).option("checkpointLocation", state)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    schema = f"{NUMBERED}, batch bigint"
    return spark.read.schema(schema).option("basePath", f"{path}/lines").parquet(f"{path}/lines").drop("batch")
