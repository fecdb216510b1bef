"""Restarts, late files and equality with the batch twins."""

from pyspark.sql import functions as F

from shardloom.operators import packing as p
from shardloom.plans import streams
from shardloom.session import new_scratch_path
from shardloom.sources.corpus import scan_corpus_stream
from shardloom.sources.logs import stream_log_lines
from shardloom.streaming import corpus as sc
from shardloom.streaming import watch

DOCS = "source string, ord bigint, text string"


def add(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def packed(segments):
    return sorted((r.source, r.split, r.shard_id, r.seg_start, r.ord, tuple(r.tokens)) for r in segments.collect())


def test_packing_continues_after_a_restart(spark):
    path, out, state = (new_scratch_path(spark, f"test-{n}") for n in ("in", "packed", "state"))
    rows = [("a" if i % 4 else "b", i, None if i == 5 else f"text number {i} " * (i % 7)) for i in range(60)]
    for part in (rows[:20], rows[20:25], rows[25:]):
        add(spark, path, part, DOCS)
        stream = scan_corpus_stream(spark, path, DOCS, order_col="ord", files_per_trigger=1)
        sc.pack_stream(stream, out, state, 100, vocab="char").awaitTermination()
    batch = p.pack_shards(p.token_offsets(p.tokenize_corpus(spark.createDataFrame(rows, DOCS), "char")), 100)
    assert packed(sc.read_packed(spark, out)) == packed(batch)


def test_tokenising_resumes(spark):
    path, out, state = (new_scratch_path(spark, f"test-tok-{n}") for n in ("in", "out", "state"))
    for lo in (0, 10):
        add(spark, path, [("a", i, f"words {i}") for i in range(lo, lo + 10)], DOCS)
        stream = scan_corpus_stream(spark, path, DOCS, order_col="ord")
        sc.tokenize_stream(stream, out, state).awaitTermination()
    rows = spark.read.parquet(out)
    assert sorted(r.ord for r in rows.collect()) == list(range(20))


def test_stall_counts_survive_triggers_and_restarts(spark):
    path, out, state = (new_scratch_path(spark, f"test-stall-{n}") for n in ("in", "out", "state"))
    schema = "run bigint, step bigint, active boolean, util double"
    rows = [(1, s, True, 5.0) for s in range(4)] + [(1, 4, False, 0.0), (1, 5, False, 0.0), (1, 6, True, 90.0)]
    for part in (rows[:2], rows[2:5], rows[5:]):
        add(spark, path, part, schema)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        watch.watch_stalls(stream, out, state, 40, 3, 2).awaitTermination()
    assert sorted((r.step, r.kind) for r in watch.read_alerts(spark, out).collect()) == [(2, "stall"), (5, "idle")]
    # A late sample is kept apart and breaks no streak.
    add(spark, path, [(1, 3, False, 0.0), (1, 7, True, None), (1, 8, True, 1.0), (1, 9, True, 1.0)], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    watch.watch_stalls(stream, out, state, 40, 3, 2).awaitTermination()
    assert sorted((r.step, r.kind) for r in watch.read_alerts(spark, out).collect()) == [(2, "stall"), (5, "idle"), (9, "stall")]
    assert [r.step for r in spark.read.option("basePath", f"{out}/late").parquet(f"{out}/late").collect()] == [3]
    assert [r.run for r in watch.silent_devices(spark, out, 3, 10).collect()] == [1]


def test_log_files_arrive_as_text(spark):
    path, out = new_scratch_path(spark, "test-logs"), new_scratch_path(spark, "test-log-alerts")
    for value in ("1 train 5.0 norm 1.0", "2 train inf norm 1.0"):
        spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("append").text(path)
    lines = stream_log_lines(spark, path, files_per_trigger=1)
    watch.append_rows(watch.nonfinite_alerts(lines), out, new_scratch_path(spark, "s")).awaitTermination()
    assert [r.value[0] for r in spark.read.parquet(out).collect()] == ["2"]


def test_packing_respects_the_cap(spark):
    path, out, state = (new_scratch_path(spark, f"test-cap-{n}") for n in ("in", "out", "state"))
    rows = [("a", i, "x" * 24) for i in range(20)]
    for part in (rows[:7], rows[7:]):
        add(spark, path, part, DOCS)
    stream = scan_corpus_stream(spark, path, DOCS, order_col="ord", files_per_trigger=1)
    sc.pack_stream(stream, out, state, 100, total=150, vocab="char").awaitTermination()
    assert sc.read_packed(spark, out).agg(F.sum("n_tok")).first()[0] == 200
    # Nothing of a full source is read any more, and a split's folders are all that is opened.
    add(spark, path, [("a", 20 + i, "x" * 24) for i in range(5)] + [("b", 1, "y" * 24)], DOCS)
    stream = scan_corpus_stream(spark, path, DOCS, order_col="ord", files_per_trigger=1)
    sc.pack_stream(stream, out, state, 100, total=150, vocab="char").awaitTermination()
    assert [r.source for r in spark.read.parquet(f"{out}/tokens/batch=2").collect()] == ["b"]
    val = sc.read_packed(spark, out).where("split = 'val'")
    assert "PartitionFilters: [isnotnull(split" in val._jdf.queryExecution().toString()


def test_progress_and_bad_values(spark):
    path = new_scratch_path(spark, "test-lines")
    schema = "run bigint, value string"
    add(spark, path, [(1, "1 train 5.0 norm 1.0"), (2, "1 train nan norm 1.0")], schema)
    add(spark, path, [(1, "3 train 4.0 norm 1.0"), (1, "2 train 4.5 norm 1.0"), (1, "3 val 9.0")], schema)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = new_scratch_path(spark, "test-progress")
    watch.append_updates(watch.progress_updates(stream()), out, new_scratch_path(spark, "s")).awaitTermination()
    latest = watch.latest_updates(spark, out, "run bigint, step bigint, loss double")
    assert latest.where(F.col("run") == 1).first().step == 3
    bad = new_scratch_path(spark, "test-bad")
    watch.append_rows(watch.nonfinite_alerts(stream()), bad, new_scratch_path(spark, "s")).awaitTermination()
    assert [r.run for r in spark.read.schema(schema).parquet(bad).collect()] == [2]


def minutes(spark, rows):
    return spark.createDataFrame(rows, "run bigint, minute bigint").select("run", F.timestamp_seconds(86_400 + F.col("minute") * 60).alias("at"))


def silent_after(spark, parts, deadline=10, delay=5, restart_at=None):
    """Alerts (run, minute) when ``parts`` arrive one by one; ``restart_at`` runs the stream twice."""
    path, out, state = (new_scratch_path(spark, f"test-silence-{n}") for n in ("in", "out", "state"))
    schema = minutes(spark, [(0, 0)]).schema
    for i, part in enumerate(parts):
        minutes(spark, part).coalesce(1).write.mode("append").parquet(path)
        if i + 1 == restart_at or i + 1 == len(parts):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
            watch.append_rows(watch.silence_alerts(stream, deadline * 60, delay * 60), out, state).awaitTermination()
    found = spark.read.schema(watch.SILENT).parquet(out).select("run", ((F.unix_timestamp("last_at") - 86_400) / 60).cast("bigint").alias("m"))
    return sorted(map(tuple, found.collect()))


def test_silent_devices_alert_by_themselves(spark):
    """Device 2 stops for good, device 1 pauses and comes back, device 3 sends on."""
    three = [(3, m) for m in range(0, 60, 5)]
    rows = sorted([(1, 0), (1, 4), (1, 30), (1, 39), (2, 0), (2, 3), *three], key=lambda r: r[1])
    want = [(1, 4), (2, 3), (1, 39)]
    want = sorted(w for w in want if w[1] + 10 < 55 - 5)
    for cuts in ([], [5], [3, 8, 12]):
        edges = [0, *cuts, len(rows)]
        parts = [rows[a:b] for a, b in zip(edges, edges[1:])]
        assert silent_after(spark, parts) == want
    assert silent_after(spark, [rows[:6], rows[6:]], restart_at=1) == want


def test_late_samples_close_a_gap_until_the_watermark(spark):
    # Minute 9 arrives late but within the delay, so 0 and 18 are one stretch; it would be too late after 40.
    assert silent_after(spark, [[(1, 0), (1, 12)], [(1, 18), (1, 9)], [(2, 60)]], delay=8) == [(1, 18)]
    assert silent_after(spark, [[(1, 0), (2, 40)], [(1, 9), (1, 11)], [(2, 60)]]) == [(1, 0), (2, 40)]


def test_updates_are_compacted(spark):
    path, out, state = (new_scratch_path(spark, f"test-compact-{n}") for n in ("in", "out", "state"))
    schema = "run bigint, value string"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    want = {}
    for i in range(11):
        want[i % 3], want[7] = i, i
        add(spark, path, [(i % 3, f"{i} train {i}.5 norm 1.0"), (7, f"{i} train 1.0 norm 1.0")], schema)
    watch.append_updates(watch.progress_updates(stream()), out, state, compact_every=4).awaitTermination()
    rows = "run bigint, step bigint, loss double"
    read = lambda: {r.run: r.step for r in watch.latest_updates(spark, out, rows).collect()}
    assert read() == want
    opened = watch.latest_updates(spark, out, rows).inputFiles()
    assert {f.split("/")[-2] for f in opened} <= {"upto=7", "batch=8", "batch=9", "batch=10"}
    # A replayed trigger and a compaction done again change nothing.
    replay = spark.read.parquet(f"{out}/batch=7").collect()
    spark.createDataFrame(replay, rows).write.mode("overwrite").parquet(f"{out}/batch=7")
    watch.compact_updates(spark, out, spark.createDataFrame([], rows).schema, 7)
    assert read() == want
    assert watch.latest_updates(spark, new_scratch_path(spark, "no-updates"), rows).count() == 0


def test_a_part_may_arrive_in_many_files(spark):
    rows = spark.range(400).withColumnRenamed("id", "ord").repartition(4, "ord")
    path = streams.arriving(spark, rows, "ord", "many-files", one_file=False)
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.min("ord").alias("low"), F.max("ord").alias("high"))
    found = files.collect()
    assert len(found) > streams.CHUNKS and sum(r.n for r in found) == 400
    assert all(r.low // 100 == r.high // 100 for r in found)  # of one part each
