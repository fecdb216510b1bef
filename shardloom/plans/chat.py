"""Chat queries over ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.arrays import digest, total
from shardloom.functions.pieces import learns
from shardloom.operators import chat as ops
from shardloom.plans import fixtures as fx
from shardloom.plans.registry import query
from shardloom.session import materialize, new_scratch_path
from shardloom.sources import chat as chat_source

CUT = 256  # short enough that most conversations are truncated
ROWS = 8


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_source.turns_to_chat(turns(spark, sf_dir))


def char_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.encode_turns(turns(spark, sf_dir), "char")


def char_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read twice by what batches them, so written; by every query anew."""
    return materialize(ops.min_len(ops.assemble_examples(char_turns(spark, sf_dir), CUT)), "chat-examples")


def char_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tuning_batches(char_examples(spark, sf_dir), ROWS)


def chars(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda c: unicode(c))"


def repeated(value: str, n: str) -> str:
    return f"list_transform(range({n}), lambda i: {value})"


ENCODED_SQL = f"""
enc AS (SELECT conv_id, turn, role,
               [50257] || {chars("role || chr(10)")} || {chars("text")} || [50258, 10] AS ids,
               {repeated("0", "length(role) + 2")}
                 || {repeated("CASE WHEN role = 'assistant' THEN 1 ELSE 0 END", "length(text) + 2")} AS mask
        FROM conversations)"""

EXAMPLES_SQL = (
    ENCODED_SQL
    + f""",
whole AS (SELECT conv_id, flatten(list(ids ORDER BY turn)) AS ids, flatten(list(mask ORDER BY turn)) AS mask
          FROM enc GROUP BY conv_id),
ex AS (SELECT conv_id, list_slice(ids, 1, {CUT}) AS ids, list_slice(mask, 1, {CUT}) AS mask
       FROM whole WHERE list_sum(mask) > 0 AND len(list_slice(ids, 1, {CUT})) >= 2)"""
)

BATCHES_SQL = (
    EXAMPLES_SQL
    + f""",
numbered AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS idx, count(*) OVER () AS n_all FROM ex),
bat AS (SELECT (idx // {ROWS})::BIGINT AS batch, (idx % {ROWS})::BIGINT AS row, conv_id, ids, mask,
               max(len(ids)) OVER (PARTITION BY idx // {ROWS})::BIGINT AS longest
        FROM numbered WHERE idx // {ROWS} < n_all // {ROWS}),
padded AS (SELECT batch, row, conv_id, longest, ids || {repeated("50259", "longest - len(ids)")} AS ids,
                  mask || {repeated("0", "longest - len(ids)")} AS mask FROM bat)"""
)


@query(
    "A3",
    """SELECT conv_id, count(*) AS n_turns,
       md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""",
)
def scan_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return chats(spark, sf_dir).select(
        "conv_id", F.size("messages").cast("bigint").alias("n_turns"), F.md5(text).alias("digest")
    )


@query(
    "A6",
    """SELECT count(*) AS n_turns, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest
       FROM conversations GROUP BY conv_id""",
)
def write_chat_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_scratch_path(spark, "chat-jsonl")
    chat_source.write_chat_jsonl(chats(spark, sf_dir), path)
    back = chat_source.scan_chat(spark, path)
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return back.select(F.size("messages").cast("bigint").alias("n_turns"), F.md5(text).alias("digest"))


@query(
    "B11",
    """SELECT role, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END::INTEGER AS learn, count(*) AS n_turns
       FROM conversations GROUP BY ALL""",
)
def route_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = turns(spark, sf_dir).withColumn("learn", learns(F.col("role")))
    return flagged.groupBy("role", "learn").agg(F.count("*").alias("n_turns"))


@query(
    "C4 (one row per turn, with generation prompt)",
    """SELECT conv_id, turn, md5('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)) AS digest
       FROM conversations
       UNION ALL SELECT conv_id, max(turn) + 1, md5('<|im_start|>assistant' || chr(10)) FROM conversations GROUP BY 1""",
)
def render_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = ops.render_turns(turns(spark, sf_dir), add_generation_prompt=True)
    return rendered.select("conv_id", "turn", F.md5("text").alias("digest"))


@query(
    "C4",
    """SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), ''
                                      ORDER BY turn) || '<|im_start|>assistant' || chr(10)) AS digest
       FROM conversations GROUP BY conv_id""",
)
def render_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = ops.render_chat(F.col("messages"))
    text = F.when(F.col("last"), ops.render_chat(F.col("messages"), add_generation_prompt=True)).otherwise(body)
    return chats(spark, sf_dir).select("conv_id", F.md5(text).alias("digest"))


@query(
    "C5 (char vocabulary)",
    f"""WITH {ENCODED_SQL} SELECT conv_id, turn, len(ids)::BIGINT AS n_ids, list_sum(mask)::BIGINT AS n_learn,
        {fx.list_digest("ids")} AS ids_digest, {fx.list_digest("mask")} AS mask_digest FROM enc""",
)
def loss_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return char_turns(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.size("ids").cast("bigint").alias("n_ids"),
        total(F.col("mask")).alias("n_learn"),
        digest(F.col("ids")).alias("ids_digest"),
        digest(F.col("mask")).alias("mask_digest"),
    )


@query("C2")
def tokenize_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE with special ids, piece by piece."""
    encoded = ops.encode_turns(turns(spark, sf_dir))
    return encoded.select(
        "conv_id",
        "turn",
        F.size("ids").alias("n_ids"),
        total(F.col("mask")).alias("n_learn"),
        digest(F.col("ids")).alias("digest"),
    )


@query(
    "B3",
    f"""WITH {ENCODED_SQL} SELECT conv_id, turn, len(ids)::BIGINT AS n_ids FROM enc WHERE list_sum(mask) > 0""",
)
def has_learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ops.has_learnable(char_turns(spark, sf_dir))
    return kept.select("conv_id", "turn", F.size("ids").cast("bigint").alias("n_ids"))


@query(
    "B3, B4, E13",
    f"""WITH {EXAMPLES_SQL} SELECT conv_id, len(ids)::BIGINT AS n_ids, list_sum(mask)::BIGINT AS n_learn,
        {fx.list_digest("ids")} AS ids_digest, {fx.list_digest("mask")} AS mask_digest FROM ex""",
)
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = ops.min_len(ops.assemble_examples(char_turns(spark, sf_dir), CUT))
    return cut.select(
        "conv_id",
        F.size("ids").cast("bigint").alias("n_ids"),
        total(F.col("mask")).alias("n_learn"),
        digest(F.col("ids")).alias("ids_digest"),
        digest(F.col("mask")).alias("mask_digest"),
    )


@query(
    "B5",
    """SELECT conv_id, turn, least(length(text), 64)::BIGINT AS n_ids FROM conversations
       WHERE least(length(text), 64) >= 40""",
)
def min_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut contents to 64 ids, then drop what stays shorter than 40."""
    from shardloom.functions.arrays import char_ids

    raw = turns(spark, sf_dir).select(
        "conv_id",
        "turn",
        char_ids(F.col("content")).alias("ids"),
        F.array_repeat(F.lit(1), F.length("content")).alias("mask"),
    )
    kept = ops.min_len(ops.truncate(raw, 64), 40)
    return kept.select("conv_id", "turn", F.size("ids").cast("bigint").alias("n_ids"))


@query(
    "F15",
    f"WITH {BATCHES_SQL} SELECT batch, row, conv_id, len(ids)::BIGINT AS n_ids, longest FROM bat",
)
def sft_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return char_batches(spark, sf_dir).select(
        "batch",
        F.col("row").cast("bigint").alias("row"),
        "conv_id",
        F.size("ids").cast("bigint").alias("n_ids"),
        F.col("L").cast("bigint").alias("longest"),
    )


@query(
    "C16",
    f"""WITH {BATCHES_SQL} SELECT batch, row, {fx.list_digest("ids")} AS ids_digest,
        {fx.list_digest("mask")} AS mask_digest, len(ids)::BIGINT AS n_ids FROM padded""",
)
def pad_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pad_batch(char_batches(spark, sf_dir)).select(
        "batch",
        F.col("row").cast("bigint").alias("row"),
        digest(F.col("ids")).alias("ids_digest"),
        digest(F.col("mask")).alias("mask_digest"),
        F.size("ids").cast("bigint").alias("n_ids"),
    )


@query(
    "C15",
    f"""WITH {BATCHES_SQL} SELECT batch, row, {fx.list_digest("ids[:-2]")} AS x, {fx.list_digest("ids[2:]")} AS y,
        {fx.list_digest("mask[2:]")} AS m FROM padded""",
)
def shift_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = ops.shift_masked(ops.pad_batch(char_batches(spark, sf_dir)))
    return shifted.select(
        "batch", F.col("row").cast("bigint").alias("row"), *[digest(F.col(c)).alias(c) for c in ("x", "y", "m")]
    )


@query(
    "E4",
    f"""WITH {BATCHES_SQL}, cells AS (SELECT batch, unnest(ids[2:]) AS y, unnest(mask[2:]) AS m FROM padded)
        SELECT batch, sum(m)::BIGINT AS n_learn,
               round(sum((y % 97)::DOUBLE / 97 * m) / greatest(sum(m), 1), 6) AS loss
        FROM cells GROUP BY batch""",
)
def masked_mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-token loss stands in as a function of the label id."""
    shifted = ops.shift_masked(ops.pad_batch(char_batches(spark, sf_dir)))
    with_loss = shifted.withColumn("loss", F.transform("y", lambda t: (t % 97).cast("double") / 97.0))
    means = ops.masked_mean_loss(with_loss)
    return means.select("batch", "n_learn", F.round("loss", 6).alias("loss"))


def job_steps(n_examples: int) -> int:
    """Steps of a job: an epoch and a tenth, so that every example is seen and the source starts again."""
    return -(-n_examples * 11 // (10 * ROWS))


STEPS_SQL = f"(SELECT (count(*) * 11 + {10 * ROWS - 1}) // {10 * ROWS} FROM ex)"
JOB_T = 1024  # the job's own cut


def stream_sql(cut: int) -> str:
    """The batches of ``job_steps`` steps over the endlessly repeated examples."""
    return (
        EXAMPLES_SQL.replace(f", {CUT})", f", {cut})")
        + f""",
numbered AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS idx, count(*) OVER () AS n_all FROM ex),
places AS (SELECT unnest(range({STEPS_SQL} * {ROWS})) AS pos),
bat AS (SELECT (pos // {ROWS})::BIGINT AS batch, (pos % {ROWS})::BIGINT AS row, (pos // n_all)::BIGINT AS epoch, conv_id, ids, mask,
               max(len(ids)) OVER (PARTITION BY pos // {ROWS})::BIGINT AS longest
        FROM places JOIN numbered ON idx = pos % (SELECT count(*) FROM ex)),
padded AS (SELECT batch, row, epoch, conv_id, longest, ids || {repeated("50259", "longest - len(ids)")} AS ids,
                  mask || {repeated("0", "longest - len(ids)")} AS mask FROM bat)"""
    )


@query("G5, F14, F15", f"WITH {stream_sql(CUT)} SELECT batch, row, epoch, conv_id FROM bat")
def step_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asked number of batches, over the end of an epoch."""
    from shardloom.constants import STEPS_PER_EPOCH
    from shardloom.operators.layout import step_limit

    examples = char_examples(spark, sf_dir)
    steps = step_limit(job_steps(examples.count()), 2, STEPS_PER_EPOCH)  # from file footers
    stream = ops.tuning_stream(examples, ROWS, steps)
    return stream.select("batch", F.col("row").cast("bigint").alias("row"), F.col("epoch").cast("bigint").alias("epoch"), "conv_id")


@query(
    "C4, C5, B3, B4, B5, F14, F15, C16, C15, G5",
    f"""WITH {stream_sql(JOB_T)} SELECT batch, row, conv_id, {fx.list_digest("ids[:-2]")} AS x,
        {fx.list_digest("ids[2:]")} AS y, {fx.list_digest("mask[2:]")} AS m FROM padded""",
)
def tuning_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From turns to shifted, padded batches: encode, mask, drop, cut, batch over epochs, pad, shift."""
    examples = ops.min_len(ops.assemble_examples(char_turns(spark, sf_dir), JOB_T))
    examples = materialize(examples, "tuning-examples")
    stream = ops.tuning_stream(examples, ROWS, job_steps(examples.count()))
    shifted = ops.shift_masked(ops.pad_batch(stream))
    return shifted.select(
        "batch", F.col("row").cast("bigint").alias("row"), "conv_id", *[digest(F.col(c)).alias(c) for c in ("x", "y", "m")]
    )


@query(
    "F14",
    f"""WITH {EXAMPLES_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS idx,
          count(*) OVER () AS n_all FROM ex)
        SELECT e.epoch::BIGINT AS epoch, epoch * n_all + idx AS stream_pos, conv_id
        FROM n, (SELECT unnest(range(3)) AS epoch) e""",
)
def repeat_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shardloom.operators.layout import repeat_epochs as repeat
    from shardloom.operators.ordering import dense_index

    examples = char_examples(spark, sf_dir).select("conv_id")
    indexed = dense_index(examples, [], "conv_id").withColumn("n_all", F.lit(examples.count()))
    stream = repeat(indexed, 3, "idx", "n_all")
    return stream.select(F.col("epoch").cast("bigint").alias("epoch"), "stream_pos", "conv_id")
