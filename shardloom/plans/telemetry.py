"""Run telemetry over ``events`` (a run or device per user, or one long run per event type) and
``lineitem`` (batch losses). Step = position in event order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions import schedules as lr
from shardloom.functions.arrays import whole_div
from shardloom.functions.text import fixed1, hours_minutes
from shardloom.operators import telemetry as ops
from shardloom.plans import fixtures as fx
from shardloom.plans.registry import query
from shardloom.session import materialize, new_scratch_path
from shardloom.sources import logs

TOKENS_PER_STEP = 524_288
CKPT_EVERY = 10
ARTIFACT_EVERY = 250  # one file each
FILES_PER_TASK = 256
STALL = 4
IDLE = 3
MILESTONES = {20: "end_of_warmup", 40: "end_of_stable", 60: "end_of_decay"}


def numbered(spark: SparkSession, sf_dir: str, run: str) -> DataFrame:
    """(run, order, step, event_type, value), numbered once and shared."""

    def write(path: str) -> None:
        events = fx.table(spark, sf_dir, "events").select(
            F.col(run).alias("run"), F.col("event_id").alias("order"), "event_type", "value"
        )
        if run == "event_type":
            events = events.withColumn("event_type", F.col("run"))
        ops.with_steps(events).write.parquet(path)

    return spark.read.parquet(fx.written(spark, sf_dir, f"steps-{run}", write))


def user_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir, "user_id").withColumn("loss", F.col("value"))


def type_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir, "event_type").withColumn("loss", F.col("value"))


USERS_SQL = """
runs AS (SELECT user_id AS run, event_id AS ord, event_type, value,
                row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step,
                count(*) OVER (PARTITION BY user_id) AS n FROM events)"""

TYPES_SQL = """
runs AS (SELECT event_type AS run, event_id AS ord, value,
                row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS step,
                count(*) OVER (PARTITION BY event_type) AS n FROM events)"""

# A log line per event: which kind follows from the event type.
LINES_SQL = (
    USERS_SQL
    + """,
lines AS (SELECT run, ord, step, CASE event_type
    WHEN 'error' THEN step || ' train nan norm 0.1250'
    WHEN 'signup' THEN step || ' train ' || printf('%.6f', value) || ' norm ' || printf('%.4f', value / 4)
    WHEN 'view' THEN step || ' loss ' || printf('%.6f', value) || ' norm ' || printf('%.4f', value / 4)
    WHEN 'click' THEN step || ' train ' || printf('%.6f', value) || ' norm ' || printf('%.4f', value / 4)
         || ' lr_muon 2.00e-02 lr_adam 1.20e-03 tok_s ' || (ord * 10) || ' | ' || (step + 1) || '/500 (1.0%) | elapsed 0h00m | eta 0h01m'
    ELSE CASE WHEN step % 2 = 0 THEN step || ' val ' || printf('%.6f', value) ELSE '[sample 0] ''5 train 3''' END END AS value
  FROM runs)"""
)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, line_no, value): the same lines as text."""
    kind, step = F.col("event_type"), F.col("step").cast("string")
    loss, norm = F.format_string("%.6f", "value"), F.format_string("%.4f", F.col("value") / 4)
    train = F.concat(step, F.lit(" train "), loss, F.lit(" norm "), norm)
    rates = F.concat(
        F.lit(" lr_muon 2.00e-02 lr_adam 1.20e-03 tok_s "),
        (F.col("order") * 10).cast("string"),
        F.lit(" | "),
        (F.col("step") + 1).cast("string"),
        F.lit("/500 (1.0%) | elapsed 0h00m | eta 0h01m"),
    )
    text = (
        F.when(kind == "error", F.concat(step, F.lit(" train nan norm 0.1250")))
        .when(kind == "signup", train)
        .when(kind == "view", F.concat(step, F.lit(" loss "), loss, F.lit(" norm "), norm))
        .when(kind == "click", F.concat(train, rates))
        .when(F.col("step") % 2 == 0, F.concat(step, F.lit(" val "), loss))
        .otherwise("[sample 0] '5 train 3'")
    )
    return user_runs(spark, sf_dir).select("run", F.col("order").alias("line_no"), text.alias("value"))


METRICS_SQL = (
    LINES_SQL
    + r""",
kinds AS (SELECT *, CASE WHEN regexp_matches(value, '^\d+ train \S+ norm \S+') THEN 'train'
                         WHEN regexp_matches(value, '^\d+ val \S+$') THEN 'val'
                         WHEN regexp_matches(value, '^\d+ loss \S+ norm \S+$') THEN 'sft' END AS kind FROM lines),
metrics AS (SELECT run, ord AS line_no, kind, regexp_extract(value, '^(\d+)', 1)::BIGINT AS step,
    try_cast(regexp_extract(value, '^\d+ (?:train|val|loss) (\S+)', 1) AS DOUBLE) AS loss,
    try_cast(regexp_extract(value, ' norm (\S+)', 1) AS DOUBLE) AS norm,
    try_cast(nullif(regexp_extract(value, ' lr_muon (\S+)', 1), '') AS DOUBLE) AS lr_a,
    try_cast(nullif(regexp_extract(value, ' lr_adam (\S+)', 1), '') AS DOUBLE) AS lr_b,
    try_cast(nullif(regexp_extract(value, ' tok_s (\S+)', 1), '') AS DOUBLE) AS tok_s
  FROM kinds WHERE kind IS NOT NULL)"""
)


@query(
    "A7, M11",
    f"""WITH {METRICS_SQL} SELECT run, line_no, kind, step, isnan(loss) AS loss_is_nan,
        CASE WHEN NOT isnan(loss) THEN loss END AS loss, norm, lr_a, lr_b, tok_s FROM metrics""",
)
def parse_metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_scratch_path(spark, "metric-log")
    lines = log_lines(spark, sf_dir)
    # Through text files, as the source reads them; run and line number ride in front of the line.
    lines.select(F.concat_ws("\t", "run", "line_no", "value").alias("value")).write.text(path)
    parts = F.split("value", "\t", 3)
    back = spark.read.text(path).select(
        parts[0].cast("bigint").alias("run"), parts[1].cast("bigint").alias("line_no"), parts[2].alias("value")
    )
    rows = logs.parse_metric_lines(back)
    return rows.withColumn("loss_is_nan", F.isnan("loss")).withColumn("loss", F.nanvl("loss", F.lit(None).cast("double")))


@query(
    "B9",
    f"""WITH {LINES_SQL} SELECT run, ord AS line_no, value FROM lines
        WHERE regexp_matches(value, '(?i) (nan|inf)( |$)')""",
)
def nonfinite_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.nonfinite_metrics(log_lines(spark, sf_dir))


@query(
    "A11",
    f"""WITH {METRICS_SQL}, last AS (SELECT run, max(CASE WHEN event_type = 'click' AND run % 3 = 0 THEN step + 1 END) AS bar
          FROM runs GROUP BY run),
        logged AS (SELECT run, max(CASE WHEN kind = 'train' THEN step END) AS log FROM metrics GROUP BY run)
        SELECT run, coalesce(bar, log, 0)::BIGINT AS step FROM last LEFT JOIN logged USING (run)""",
)
def parse_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the runs have a bar, the others their metric log, if it has a training line."""
    events = user_runs(spark, sf_dir)
    n, bar = F.col("step"), F.lit("/500 [00:00]")
    click = (F.col("event_type") == "click") & (F.col("run") % 3 == 0)
    text = F.when(
        click, F.concat(F.lit("train:  0%| "), n.cast("string"), bar, F.lit("\rtrain:  1%| "), (n + 1).cast("string"), bar)
    ).otherwise("warming up 7/9999")
    consoles = events.select("run", F.col("order").alias("line_no"), text.alias("value"))
    metrics = logs.parse_metric_lines(log_lines(spark, sf_dir))
    return logs.parse_console(consoles, metrics, 500)


SAMPLES_SQL = (
    USERS_SQL
    + """,
samples AS (SELECT run, ord, step, event_type <> 'error' AS active, floor(least(value, 100))::DOUBLE AS util,
                   floor(value * 100)::DOUBLE AS mem, round(value * 7, 2) AS power FROM runs)"""
)


def device_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with units, one per minute, as the collector prints them."""
    minute = F.col("order")
    clock = F.format_string("%02d:%02d:00", whole_div(minute, 60) % 24, minute % 60)
    util = F.floor(F.least(F.col("value"), F.lit(100.0)))
    return user_runs(spark, sf_dir).select(
        "run",
        "order",
        "step",
        (F.col("event_type") != "error").alias("active"),
        clock.alias("ts"),
        F.concat(util.cast("string"), F.lit("%")).alias("util"),
        F.concat(F.floor(F.col("value") * 100).cast("string"), F.lit("MiB")).alias("mem"),
        F.concat(F.round(F.col("value") * 7, 2).cast("string"), F.lit("W")).alias("power"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.typed_device(device_lines(spark, sf_dir))


@query(
    "A8, M12",
    f"""WITH {SAMPLES_SQL} SELECT printf('%02d:%02d:00', (ord // 60) % 24, ord % 60) AS ts, util, mem, power
        FROM samples""",
)
def parse_device_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_scratch_path(spark, "device-csv")
    device_lines(spark, sf_dir).select("ts", "util", "mem", "power").write.csv(path)
    return logs.read_device_csv(spark, path)


@query(
    "B12",
    f"""WITH {SAMPLES_SQL}, recent AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rn FROM samples),
        dips AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS dn FROM recent WHERE rn <= 60 AND util < 80)
        SELECT run, step, util, mem FROM dips WHERE dn <= 8""",
)
def device_dips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.device_dips(samples(spark, sf_dir)).select("run", "step", "util", "mem")


@query(
    "E8",
    f"""WITH {SAMPLES_SQL}, recent AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rn FROM samples)
        SELECT run, round(avg(util), 6) AS util_avg, min(util) AS util_min, max(util) AS util_max,
          round(avg(power), 9) AS power_avg, count(*) AS n_samples,
          sum(CASE WHEN util < 80 THEN 1 ELSE 0 END)::BIGINT AS n_low
        FROM recent WHERE rn <= 60 GROUP BY run""",
)
def device_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = ops.device_summary(samples(spark, sf_dir))
    return summary.withColumn("util_avg", F.round("util_avg", 6)).withColumn("power_avg", F.round("power_avg", 9))


def islands_sql(flag: str, n: int) -> str:
    return f"""flagged AS (SELECT *, {flag} AS hit FROM samples),
        islands AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY step) AS island FROM flagged),
        counted AS (SELECT *, row_number() OVER (PARTITION BY run, island, hit ORDER BY step) AS in_row FROM islands WHERE hit)
        SELECT run, step, in_row FROM counted WHERE in_row = {n}"""


@query("F11", f"WITH {SAMPLES_SQL}, {islands_sql('active AND util < 40', STALL)}")
def stall_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.stall_runs(samples(spark, sf_dir), n=STALL).select("run", "step", "in_row")


@query("F12", f"WITH {SAMPLES_SQL}, {islands_sql('NOT active', IDLE)}")
def idle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.idle_runs(samples(spark, sf_dir), IDLE).select("run", "step", "in_row")


# Checkpoints, ledger.
CKPTS_SQL = (
    USERS_SQL
    + f""",
ckpts AS (SELECT run, step FROM runs WHERE step > 0 AND (step % {CKPT_EVERY} = 0 OR step = n - 1))"""
)


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_checkpoints(user_runs(spark, sf_dir), CKPT_EVERY)


def made_checkpoints(steps: DataFrame, every: int) -> DataFrame:
    rows = ops.with_lengths(steps)
    return rows.where(lr.checkpoints(F.col("step"), F.col("n_steps"), every)).select("run", "step")


@query(
    "B13",
    f"""WITH {USERS_SQL} SELECT run, step, step % 25 = 0 OR step = n - 1 AS validates,
        (step % 40 = 0 AND step > 0) OR step = n - 1 AS generates,
        step > 0 AND (step % {CKPT_EVERY} = 0 OR step = n - 1) AS checkpoints FROM runs""",
)
def cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    step, n = F.col("step"), F.col("n_steps")
    return ops.with_lengths(user_runs(spark, sf_dir)).select(
        "run",
        "step",
        lr.validates(step, n, 25).alias("validates"),
        lr.generates(step, n, 40).alias("generates"),
        lr.checkpoints(step, n, CKPT_EVERY).alias("checkpoints"),
    )


@query(
    "A10, M14",
    f"""WITH {TYPES_SQL} SELECT run, step, length(run || ':' || step) + 1 AS size FROM runs
        WHERE step > 0 AND (step % {ARTIFACT_EVERY} = 0 OR step = n - 1)""",
)
def list_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts are written as files named by step, then listed without reading them."""
    path = new_scratch_path(spark, "checkpoints")
    named = made_checkpoints(type_runs(spark, sf_dir), ARTIFACT_EVERY).select(
        "run",
        F.format_string("ckpt_%06d", "step").alias("artifact"),
        F.concat_ws(":", "run", "step").alias("value"),
    )
    # An artifact goes to one task to get one file, and tasks grow with the files: the rows are so narrow
    # that by their size one task would write all. Tasks commit their own files, or the driver would move
    # one after the other.
    named = materialize(named, "checkpoint-names")
    tasks = max(spark.sparkContext.defaultParallelism, named.count() // FILES_PER_TASK)  # from file footers
    writer = named.repartition(tasks, "run", "artifact").write.partitionBy("run", "artifact")
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    run = F.regexp_extract("path", r"run=(\w+)", 1)
    return logs.list_checkpoints(spark, path, "*.txt").select(run.alias("run"), "step", "size")


@query(
    "F10",
    f"""WITH {CKPTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rn FROM ckpts)
        SELECT 'keep' AS what, run, step FROM r WHERE rn <= 3 UNION ALL SELECT 'expire', run, step FROM r WHERE rn > 3
        UNION ALL SELECT 'keep with 0', run, step FROM r""",
)
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = checkpoints(spark, sf_dir)
    parts = [
        ("keep", ops.keep_last(made, 3)),
        ("expire", ops.expired(made, 3)),
        ("keep with 0", ops.keep_last(made, 0)),
        ("expire with 0", ops.expired(made, 0)),
    ]
    frames = [df.select(F.lit(what).alias("what"), "run", "step") for what, df in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


@query(
    "D1",
    f"""WITH {CKPTS_SQL}, w(step, label) AS (VALUES (20, 'end_of_warmup'), (40, 'end_of_stable'), (60, 'end_of_decay'))
        SELECT run, step, label FROM ckpts JOIN w USING (step)""",
)
def keep_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.keep_milestones(checkpoints(spark, sf_dir), MILESTONES).select("run", "step", "label")


def finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_runs(spark, sf_dir).withColumn("dt", F.col("value"))
    rates = ops.run_throughput(rows, TOKENS_PER_STEP)
    last = ops.latest_per_run(rows, "step", ["loss"])
    return last.join(rates, "run").select(
        "run",
        F.concat(F.lit("run"), F.col("run").cast("string")).alias("run_name"),
        F.col("loss").alias("val_loss"),
        F.round("tokens_per_sec", 2).alias("tokens_per_sec"),
    )


FINALS_SQL = (
    USERS_SQL
    + f""",
finals AS (SELECT run, 'run' || run AS run_name, arg_max(value, step) AS val_loss,
                  round(count(*) * {TOKENS_PER_STEP} / sum(value), 2) AS tokens_per_sec FROM runs GROUP BY run)"""
)


@query(
    "A9, M13",
    f"""WITH {FINALS_SQL} SELECT run_name, val_loss, tokens_per_sec FROM finals
        UNION ALL SELECT run_name, val_loss, tokens_per_sec FROM finals WHERE val_loss > 50""",
)
def append_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs are appended, then the poor ones a second time."""
    path = new_scratch_path(spark, "ledger")
    rows = finals(spark, sf_dir)
    logs.append_ledger(rows, path)
    logs.append_ledger(rows.where("val_loss > 50"), path)
    return logs.read_ledger(spark, path)


@query(
    "E9",
    f"""WITH {CKPTS_SQL}, f AS (SELECT run, max(step) AS step FROM ckpts GROUP BY run)
        SELECT run, step, printf('ckpt_%06d.pt', step) AS path FROM f""",
)
def latest_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = checkpoints(spark, sf_dir).withColumn("path", F.format_string("ckpt_%06d.pt", "step"))
    return ops.latest_per_run(named, "step", ["step", "path"])


# Schedules.
SCHEDULE_SQL = (
    USERS_SQL
    + """,
sched AS (SELECT run, step, n, greatest(1, floor(0.03::DOUBLE * n)) AS st, greatest(1, floor(0.2::DOUBLE * n)) AS de FROM runs),
sched2 AS (SELECT *, n - de AS ds FROM sched)"""
)


def scheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_lengths(user_runs(spark, sf_dir).select("run", "step"))


@query(
    "C17",
    f"""WITH {SCHEDULE_SQL} SELECT run, step, round(CASE WHEN step < st THEN (step + 1) / st
        WHEN step < ds THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - (step - ds) / de END, 6) AS factor FROM sched2""",
)
def wsd_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = lr.wsd_lr(F.col("step"), F.col("n_steps"))
    return scheduled(spark, sf_dir).select("run", "step", F.round(factor, 6).alias("factor"))


@query(
    "C18",
    f"""WITH {USERS_SQL} SELECT run, step, round(CASE WHEN step < 50 THEN 0.1::DOUBLE * (step + 1) / 50
        ELSE 0.1::DOUBLE END, 6) AS lr FROM runs""",
)
def warmup_flat_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = lr.warmup_flat_lr(F.col("step"), 0.1)
    return user_runs(spark, sf_dir).select("run", "step", F.round(rate, 6).alias("lr"))


@query(
    "C19",
    f"""WITH {USERS_SQL}, t AS (SELECT run, step, n, n * 0.05::DOUBLE - 1.0 AS top FROM runs),
        p AS (SELECT *, CASE WHEN step <= top THEN coalesce(step / nullif(top, 0), 1.0)
              ELSE coalesce((step - top) / nullif(n - 1 - top, 0), 1.0) END AS part FROM t)
        SELECT run, step, round(CASE WHEN step <= top THEN 1.0 + (0.04 - 1.0) / 2 * (cos(part * pi()) + 1)
          ELSE 0.000004 + (1.0 - 0.000004) / 2 * (cos(part * pi()) + 1) END, 6) AS lr FROM p""",
)
def one_cycle_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = lr.one_cycle_lr(F.col("step"), F.col("n_steps"), 1.0)
    return scheduled(spark, sf_dir).select("run", "step", F.round(rate, 6).alias("lr"))


@query(
    "C20",
    f"""WITH {USERS_SQL} SELECT run, step, (step + 1) || '/' || n || ' (' ||
        printf('%.1f', (step + 1)::DOUBLE / n * 100) || '%)' AS progress,
        printf('%dh%02dm', floor(step * 977.5 / 3600)::BIGINT, floor((floor(step * 977.5) % 3600) / 60)::BIGINT) AS elapsed
        FROM runs""",
)
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    step, n = F.col("step"), F.col("n_steps")
    done = F.concat(
        (step + 1).cast("string"), F.lit("/"), n.cast("string"), F.lit(" ("), fixed1((step + 1) / n * 100.0), F.lit("%)")
    )
    elapsed = hours_minutes(step * 977.5)
    return scheduled(spark, sf_dir).select("run", "step", done.alias("progress"), elapsed.alias("elapsed"))


# Losses per batch.
def batch_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, step, rank, k, loss): an order is a step, its lines are batches."""
    return fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("run"),
        F.col("l_orderkey").alias("step"),
        (F.col("l_suppkey") % 2).alias("rank"),
        (F.col("l_linenumber") - 1).alias("k"),
        (F.col("l_extendedprice") / 1000).alias("loss"),
    )


LOSSES_SQL = """
losses AS (SELECT l_linestatus AS run, l_orderkey AS step, l_suppkey % 2 AS rank, l_linenumber - 1 AS k,
                  l_extendedprice / 1000 AS loss FROM lineitem)"""


@query(
    "E5",
    f"""WITH {LOSSES_SQL}, f AS (SELECT * FROM losses WHERE k < 4), l AS (SELECT run, max(step) AS last FROM f GROUP BY run)
        SELECT run, step, round(avg(loss), 9) AS val_loss, count(*) AS n_batches
        FROM f JOIN l USING (run) WHERE step % 25 = 0 OR step = last GROUP BY ALL""",
)
def validation_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = ops.validation_mean(batch_losses(spark, sf_dir), every=25, first=4)
    return means.withColumn("val_loss", F.round("val_loss", 9))


@query(
    "E6",
    f"""WITH {LOSSES_SQL}, r AS (SELECT run, step, rank, avg(loss) AS loss FROM losses GROUP BY ALL)
        SELECT run, step, round(avg(loss), 9) AS loss, count(*) AS n_ranks FROM r GROUP BY ALL""",
)
def step_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.step_loss(batch_losses(spark, sf_dir)).withColumn("loss", F.round("loss", 9))


@query(
    "E10",
    f"""WITH {USERS_SQL}, d AS (SELECT run, step, CASE WHEN step % 10 = 3 THEN 0.0 ELSE value END AS dt FROM runs),
        t AS (SELECT run, count(*) * {TOKENS_PER_STEP} / sum(dt) AS rate FROM d GROUP BY run)
        SELECT run, step, round(CASE WHEN dt > 0 THEN {TOKENS_PER_STEP} / dt ELSE 0 END, 3) AS tok_s,
               round(rate, 3) AS run_tok_s FROM d JOIN t USING (run)""",
)
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = user_runs(spark, sf_dir).select(
        "run", "step", F.when(F.col("step") % 10 == 3, 0.0).otherwise(F.col("value")).alias("dt")
    )
    per_run = ops.run_throughput(timed, TOKENS_PER_STEP).select("run", "tokens_per_sec")
    return ops.throughput(timed, TOKENS_PER_STEP).join(per_run, "run").select(
        "run", "step", F.round("tok_s", 3).alias("tok_s"), F.round("tokens_per_sec", 3).alias("run_tok_s")
    )


@query(
    "E11",
    f"""WITH {TYPES_SQL}, p AS (SELECT *, CASE WHEN step < greatest(1, floor(0.03::DOUBLE * n)) THEN 'warmup'
          WHEN step < n - greatest(1, floor(0.2::DOUBLE * n)) THEN 'stable' ELSE 'decay' END AS phase FROM runs)
        SELECT run, phase, count(*) AS n_rows, arg_min(value, step) AS first_loss, arg_max(value, step) AS last_loss,
          min(value) AS min_loss, round(arg_max(value, step) - arg_min(value, step), 6) AS delta,
          round(min(min(value)) OVER (PARTITION BY run) * 0.95, 6) AS floor
        FROM p GROUP BY run, phase""",
)
def phase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = ops.phase_summary(type_runs(spark, sf_dir))
    return summary.withColumn("delta", F.round("delta", 6)).withColumn("floor", F.round("floor", 6))


KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    "E12",
    f"WITH {TYPES_SQL} SELECT step, "
    + ", ".join(f"max(CASE WHEN run = '{k}' THEN value END) AS {k}" for k in KINDS)
    + " FROM runs GROUP BY step",
)
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.compare_runs(type_runs(spark, sf_dir), KINDS)


@query(
    "E14",
    f"""WITH {USERS_SQL} SELECT run, max(step) + 1 AS n_steps, arg_min(value, step) AS first_loss,
        arg_max(value, step) AS last_loss, CASE WHEN run % 4 <> 0 THEN round(sum(value), 6) END AS seconds
        FROM runs GROUP BY run""",
)
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the runs has no ledger row yet."""
    rows = user_runs(spark, sf_dir)
    ledger = rows.groupBy("run").agg(F.round(F.sum("value"), 6).alias("seconds")).where(F.col("run") % 4 != 0)
    return ops.stage_summary(rows, ledger)


# Smoothing and ETA on the long runs: blocks of 1,024 steps are crossed.
@query(
    "F5",
    f"""WITH {TYPES_SQL}, a AS (SELECT run, step, avg(value) OVER (PARTITION BY run ORDER BY step
          ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS smooth FROM runs)
        SELECT run, step, round(smooth, 6) AS smooth FROM a WHERE step >= 99""",
)
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.moving_average(type_runs(spark, sf_dir), 100).withColumn("smooth", F.round("smooth", 6))


EMA_SQL = (
    TYPES_SQL
    + """,
ema(run, step, e) AS (SELECT run, step, value / 7 FROM runs WHERE step = 1
   UNION ALL SELECT r.run, r.step, 0.9::DOUBLE * e + 0.1::DOUBLE * r.value / 7 FROM ema JOIN runs r ON r.run = ema.run AND r.step = ema.step + 1),
smoothed AS (SELECT r.run, r.step, r.n, e FROM runs r LEFT JOIN ema USING (run, step))"""
)


def type_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ema_step_time(type_runs(spark, sf_dir).withColumn("dt", F.col("value") / 7))


@query("F6", f"WITH RECURSIVE {EMA_SQL} SELECT run, step, round(e, 6) AS ema FROM smoothed")
def ema_step_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_ema(spark, sf_dir).withColumn("ema", F.round("ema", 6))


@query(
    "F7",
    f"""WITH RECURSIVE {EMA_SQL}, l AS (SELECT *, (n - 1 - step) * e AS s FROM smoothed)
        SELECT run, step, round(s, 3) AS seconds_left, CASE WHEN s IS NULL THEN '(compiling)'
          ELSE printf('%dh%02dm', floor(s / 3600)::BIGINT, (floor(s)::BIGINT % 3600) // 60) END AS eta,
          round(CASE WHEN step > 0 THEN (20000 - step) * 524288 / 132000::DOUBLE / 3600 END, 6) AS hours_at_rate FROM l""",
)
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = ops.run_lengths(type_runs(spark, sf_dir))
    left = ops.eta(type_ema(spark, sf_dir).join(lengths, "run"))
    hours = ops.constant_rate_eta(F.col("step"), 20_000, TOKENS_PER_STEP, 132_000.0)
    return left.select(
        "run", "step", F.round("seconds_left", 3).alias("seconds_left"), "eta", F.round(hours, 6).alias("hours_at_rate")
    )


@query("F8", f"WITH {TYPES_SQL} SELECT run, step, value AS loss FROM runs WHERE (step + 1) % 50 = 1")
def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.downsample(type_runs(spark, sf_dir), 50).select("run", "step", "loss")


@query(
    "F9",
    f"""WITH {TYPES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rn FROM runs)
        SELECT run, step, value AS loss FROM r WHERE rn <= 8""",
)
def tail_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tail_n(type_runs(spark, sf_dir), 8).select("run", "step", "loss")
