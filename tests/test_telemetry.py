import random

import pytest
from pyspark.sql import functions as F

from shardloom.functions import schedules as lr
from shardloom.operators import telemetry as tele
from shardloom.session import new_scratch_path
from shardloom.sources import logs

LINES = [
    "0 val 11.016083",
    "0 train 11.0 norm 18.2503",
    "10 train 9.5 norm 1.25 lr_muon 2.00e-02 lr_adam 1.20e-03 tok_s 130869 | 11/19073 (0.1%) | elapsed 0h01m | eta (compiling)",
    "3 loss 1.5 norm 0.5",
    "11 train nan norm 0.1",
    "12 train 1.0 norm INF",
    "step     0 | val loss 11.0161",
    "[sample 0] '5 train 3 norm nan '",
    "--- samples @ step 4000 ---",
    "",
]


def test_metric_lines(spark):
    path = new_scratch_path(spark, "test-log")
    spark.createDataFrame([(v,) for v in LINES], "value string").coalesce(1).write.text(path)
    rows = logs.read_metric_log(spark, path).collect()
    assert sorted((r.step, r.kind) for r in rows) == [
        (0, "train"), (0, "val"), (3, "sft"), (10, "train"), (11, "train"), (12, "train"),
    ]
    full = next(r for r in rows if r.step == 10)
    assert (full.loss, full.norm, full.lr_a, full.lr_b, full.tok_s) == (9.5, 1.25, 0.02, 0.0012, 130869.0)
    assert next(r for r in rows if r.kind == "val").loss == 11.016083
    lines = spark.read.text(path)
    assert sorted(r.value[:2] for r in logs.nonfinite_metrics(lines).collect()) == ["11", "12", "[s"]


def test_console_falls_back(spark):
    consoles = spark.createDataFrame(
        [("a", 1, "1/50\r2/50 x 3/50"), ("a", 2, "junk 9/500"), ("b", 1, "nothing"), ("c", 1, "")],
        "run string, line_no bigint, value string",
    )
    metrics = spark.createDataFrame(
        [("a", 9, "train", 7), ("b", 1, "train", 4), ("b", 2, "train", 5), ("b", 3, "val", 6)],
        "run string, line_no bigint, kind string, step bigint",
    )
    found = logs.parse_console(consoles, metrics, 50)
    assert {r.run: r.step for r in found.collect()} == {"a": 3, "b": 5, "c": 0}


def test_device_csv(spark):
    path = new_scratch_path(spark, "test-csv")
    rows = [("12:00:00,97%,62000MiB,693.12W",), ("12:01:00,,1MiB,5W",)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.text(path)
    assert [tuple(r) for r in logs.read_device_csv(spark, path).orderBy("ts").collect()] == [
        ("12:00:00", 97.0, 62000.0, 693.12), ("12:01:00", None, 1.0, 5.0),
    ]


def test_checkpoint_listing_reads_no_content(spark):
    path = new_scratch_path(spark, "test-ckpt")
    rows = [("ckpt_000100", "x"), ("sft_000020", "yy"), ("other", "z")]
    spark.createDataFrame(rows, "name string, value string").repartition("name").write.partitionBy("name").text(path)
    found = logs.list_checkpoints(spark, path, "*.txt")
    assert sorted((r.step, r["size"]) for r in found.collect()) == [(20, 3), (100, 2)]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_missing_readings_count_as_idle(spark):
    rows = [("d", 0, 90.0, 10.0), ("d", 1, None, None), ("d", 2, 70.0, 20.0)]
    df = spark.createDataFrame(rows, "run string, step bigint, util double, power double")
    r = tele.device_summary(df).first()
    assert (r.util_avg, r.util_min, r.n_low, r.power_avg, r.n_samples) == (160 / 3, 0.0, 2, 10.0, 3)
    assert sorted(r.step for r in tele.device_dips(df).collect()) == [1, 2]
    assert tele.device_summary(df, last=1).first().util_avg == 70.0


def runs(spark, lengths, seed=0, block=None):
    rng = random.Random(seed)
    rows = [(run, step, rng.uniform(0.1, 9.0)) for run, n in lengths.items() for step in range(n)]
    return rows, spark.createDataFrame(rows, "run string, step bigint, loss double").repartition(5)


def test_moving_average_crosses_blocks(spark):
    rows, df = runs(spark, {"a": 500, "b": 9, "c": 50})
    found = {(r.run, r.step): r.smooth for r in tele.moving_average(df, 10, block_rows=32).collect()}
    values = {}
    for run, _, v in rows:
        values.setdefault(run, []).append(v)
    want = {(run, i): sum(v[i - 9 : i + 1]) / 10 for run, v in values.items() for i in range(9, len(v))}
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k], rel=1e-12) for k in want)


@pytest.mark.parametrize("block_rows", [8, 1024, 1_000_000])
def test_ema_equals_the_sequential_fold(spark, block_rows):
    rows, df = runs(spark, {"a": 5000, "b": 1, "c": 2, "d": 1026})
    found = {(r.run, r.step): r.ema for r in tele.ema_step_time(df, "loss", block_rows).collect()}
    state = {}
    for run, step, v in rows:
        if step == 0:
            assert found[run, 0] is None
            continue
        state[run] = v if run not in state else 0.9 * state[run] + 0.1 * v
        assert found[run, step] == pytest.approx(state[run], rel=1e-12)
    assert len(found) == len(rows)


@pytest.mark.parametrize("keep", [0, 1, 3, 100])
def test_retention_is_a_slice(spark, keep):
    rows = [(run, s) for run, n in {"a": 7, "b": 2}.items() for s in range(0, n * 10, 10)]
    df = spark.createDataFrame(rows, "run string, step bigint")
    names = {run: sorted(s for r, s in rows if r == run) for run in ("a", "b")}
    gone = {(run, s) for run, steps in names.items() for s in steps[:-keep]} if keep else set()
    assert {tuple(r) for r in tele.expired(df, keep).collect()} == gone
    assert {tuple(r) for r in tele.keep_last(df, keep).collect()} == set(rows) - gone


def test_milestones(spark):
    df = spark.createDataFrame([("a", 15000), ("a", 16000)], "run string, step bigint")
    found = tele.keep_milestones(df, {15000: "end_of_stable", 19072: "end_of_decay"}).collect()
    assert [(r.step, r.label) for r in found] == [(15000, "end_of_stable")]


def counters(rows, min_util, n_stall, n_idle):
    out, stall, idle = [], {}, {}
    for run, step, active, util in sorted(rows):
        low = active and (util or 0.0) < min_util
        stall[run] = stall.get(run, 0) + 1 if low else 0
        idle[run] = 0 if active else idle.get(run, 0) + 1
        if stall[run] == n_stall:
            out.append((run, step, "stall"))
        if idle[run] == n_idle:
            out.append((run, step, "idle"))
    return sorted(out)


def test_stalls_and_idles(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"d{i % 5}", i, rng.random() < 0.6, rng.choice([None, 5.0, 60.0, 10.0])) for i in range(3000)]
    steps, dense = {}, []
    for run, _, active, util in rows:
        dense.append((run, steps.get(run, 0), active, util))
        steps[run] = steps.get(run, 0) + 1
    df = spark.createDataFrame(dense, "run string, step bigint, active boolean, util double").repartition(9)
    stalls = [(r.run, r.step, "stall") for r in tele.stall_runs(df, 40, 3).collect()]
    idles = [(r.run, r.step, "idle") for r in tele.idle_runs(df, 4).collect()]
    assert sorted(stalls + idles) == counters(dense, 40, 3, 4)


def test_schedules(spark):
    n = 1000
    df = spark.range(n).select(F.col("id").alias("step"), F.lit(n).cast("bigint").alias("n"))
    step, size = F.col("step"), F.col("n")
    rows = df.select(
        "step",
        lr.wsd_lr(step, size).alias("wsd"),
        lr.warmup_flat_lr(step, 1e-4).alias("flat"),
        lr.one_cycle_lr(step, size, 1.0).alias("cycle"),
    ).orderBy("step").collect()
    assert rows[0].wsd == pytest.approx(1 / 30) and rows[29].wsd == 1.0 and rows[799].wsd == 1.0
    assert rows[900].wsd == pytest.approx(0.5) and rows[999].wsd == pytest.approx(1 / 200)
    assert rows[0].flat == pytest.approx(2e-6) and rows[49].flat == pytest.approx(1e-4) == rows[999].flat
    assert rows[0].cycle == pytest.approx(0.04) and rows[49].cycle == pytest.approx(1.0)
    assert rows[999].cycle == pytest.approx(4e-6)


def test_means(spark):
    micro = spark.createDataFrame([("r", 0, 0, 1.0), ("r", 0, 0, 3.0), ("r", 0, 1, 8.0)], "run string, step bigint, rank int, loss double")
    assert tele.step_loss(micro).first().loss == 5.0
    losses = [("r", s, k, float(s + k)) for s in range(4) for k in range(25)]
    found = tele.validation_mean(spark.createDataFrame(losses, "run string, step bigint, k int, loss double"), every=2)
    assert {r.step: (r.val_loss, r.n_batches) for r in found.collect()} == {0: (9.5, 20), 2: (11.5, 20), 3: (12.5, 20)}
    rates = tele.throughput(spark.createDataFrame([("r", 0.0), ("r", 2.0)], "run string, dt double"), 10)
    assert sorted(r.tok_s for r in rates.collect()) == [0.0, 5.0]


def test_eta_text(spark):
    df = spark.createDataFrame([("r", 0, None, 10), ("r", 1, 400.0, 10)], "run string, step bigint, ema double, n_steps bigint")
    assert [r.eta for r in tele.eta(df).orderBy("step").collect()] == ["(compiling)", "0h53m"]


def test_ledger_appends(spark):
    path = new_scratch_path(spark, "test-ledger")
    for run in ("a", "b", "a"):
        logs.append_ledger(spark.createDataFrame([(run, 1.5, 2)], "run_name string, val_loss double, tokens_per_sec int"), path)
    assert sorted(r.run_name for r in logs.read_ledger(spark, path).collect()) == ["a", "a", "b"]


def test_csv_ledgers(spark):
    path = new_scratch_path(spark, "test-ledger")
    rows = [("run_name,val_loss,tokens_per_sec",), ("first,2.5,1000.5",), ("second,1.25,",)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.text(path)
    assert sorted(map(tuple, logs.read_csv_ledgers(spark, path).collect())) == [("first", 2.5, 1000.5), ("second", 1.25, None)]


def test_artifacts_of_a_run_are_written_by_many_tasks(spark, sf_dir, monkeypatch):
    import re
    from pathlib import Path

    from shardloom.plans import telemetry as plans

    kept = {}
    monkeypatch.setattr(plans, "new_scratch_path", lambda s, name: kept.setdefault(name, new_scratch_path(s, name)))
    monkeypatch.setattr(plans, "ARTIFACT_EVERY", 10)
    monkeypatch.setattr(plans, "FILES_PER_TASK", 4)
    rows = plans.list_checkpoints(spark, sf_dir).collect()
    files = list(Path(kept["checkpoints"]).glob("run=*/artifact=*/*.txt"))
    assert len(files) == len(rows) == len({(r.run, r.step) for r in rows})
    tasks = {re.match(r"part-(\d+)", f.name)[1] for f in files}
    assert len(tasks) > len({r.run for r in rows})
