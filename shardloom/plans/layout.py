"""Batch layout, mixing and shard checks over the written shards of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.arrays import digest
from shardloom.operators import layout as ops
from shardloom.operators import quality
from shardloom.plans import fixtures as fx
from shardloom.plans.registry import query
from shardloom.session import materialize, new_scratch_path
from shardloom.sources.shards import scan_shards, shard_manifest

B, T, N = fx.BATCH, fx.SEQ, fx.RANKS
WEIGHTS = {"base": 0.82, "extra": 0.18}
READS = 7
PLACE = ["source", "split", "shard_id"]
SLOT = [*PLACE, "rank", "shard_k", "b"]


def shards_and_lengths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The written shards and, from their manifest, a row per shard with its length."""
    folder = fx.shard_folder(spark, sf_dir)
    lengths = shard_manifest(spark, folder).select(*PLACE, "shard_len")
    return scan_shards(spark, folder), materialize(lengths, "shard-lengths")


def positions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(segments, positions of all batches): narrow rows, no tokens read."""
    segments, lengths = shards_and_lengths(spark, sf_dir)
    return segments, ops.batch_positions(lengths, B, T, N)


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, lengths = shards_and_lengths(spark, sf_dir)
    return ops.deal_batches(segments, B, T, N, lengths)


def as_long(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


NUMBERED_SQL = (
    fx.DEALT_SQL
    + """,
per AS (SELECT source, split, rank, shard_id, max(shard_k) + 1 AS n_batches FROM dealt GROUP BY ALL),
offs AS (SELECT *, sum(n_batches) OVER (PARTITION BY source, split, rank ORDER BY shard_id) - n_batches AS k0,
                sum(n_batches) OVER (PARTITION BY source, split, rank) AS n_all FROM per),
numbered AS (SELECT d.*, (k0 + shard_k)::BIGINT AS k, n_all::BIGINT AS n_all
             FROM dealt d JOIN offs USING (source, split, rank, shard_id))"""
)

# The same additions in the same order, so ties fall the same way.
SCHEDULE_SQL = f"""
n_train AS (SELECT count(*) AS n FROM numbered WHERE split = 'train' AND rank = 0 AND b = 0),
walk(pick, a0, a1, j, c0, c1) AS (
  SELECT 0, 0.0::DOUBLE + {WEIGHTS['base']}::DOUBLE - CASE WHEN {WEIGHTS['extra']}::DOUBLE > {WEIGHTS['base']}::DOUBLE THEN 0 ELSE 1 END,
         0.0::DOUBLE + {WEIGHTS['extra']}::DOUBLE - CASE WHEN {WEIGHTS['extra']}::DOUBLE > {WEIGHTS['base']}::DOUBLE THEN 1 ELSE 0 END,
         CASE WHEN {WEIGHTS['extra']}::DOUBLE > {WEIGHTS['base']}::DOUBLE THEN 1 ELSE 0 END, 0, 0
  UNION ALL
  SELECT pick + 1,
         CASE WHEN a1 + {WEIGHTS['extra']}::DOUBLE > a0 + {WEIGHTS['base']}::DOUBLE THEN a0 + {WEIGHTS['base']}::DOUBLE ELSE a0 + {WEIGHTS['base']}::DOUBLE - 1 END,
         CASE WHEN a1 + {WEIGHTS['extra']}::DOUBLE > a0 + {WEIGHTS['base']}::DOUBLE THEN a1 + {WEIGHTS['extra']}::DOUBLE - 1 ELSE a1 + {WEIGHTS['extra']}::DOUBLE END,
         CASE WHEN a1 + {WEIGHTS['extra']}::DOUBLE > a0 + {WEIGHTS['base']}::DOUBLE THEN 1 ELSE 0 END,
         c0 + CASE WHEN j = 0 THEN 1 ELSE 0 END, c1 + CASE WHEN j = 1 THEN 1 ELSE 0 END
  FROM walk WHERE pick + 1 < (SELECT n FROM n_train)),
picks AS (SELECT pick::BIGINT AS pick, CASE WHEN j = 0 THEN 'base' ELSE 'extra' END AS source,
                 (CASE WHEN j = 0 THEN c0 ELSE c1 END)::BIGINT AS ordinal FROM walk)"""


@query(
    "E13",
    f"""WITH {fx.POSITIONS_SQL}, w AS (SELECT source, split, shard_id, seq,
          x || CASE WHEN n_y = n THEN [y[len(y)]] ELSE [] END AS tokens FROM seqs)
        SELECT source, split, shard_id, seq, len(tokens)::BIGINT AS n_tokens, {fx.list_digest("tokens")} AS digest FROM w""",
)
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = ops.assemble_sequences(fx.char_shards(spark, sf_dir), T)
    return seqs.select(
        *PLACE, "seq", F.size("tokens").cast("bigint").alias("n_tokens"), digest(F.col("tokens")).alias("digest")
    )


@query(
    "F4, M4, C15",
    f"""WITH {fx.DEALT_SQL} SELECT source, split, shard_id, rank::BIGINT AS rank, shard_k, b::BIGINT AS b,
        {fx.list_digest("x")} AS x, {fx.list_digest("y")} AS y FROM dealt""",
)
def deal_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = ops.shift_labels(dealt(spark, sf_dir))
    return shifted.select(
        *PLACE, *as_long("rank", "shard_k", "b"), digest(F.col("x")).alias("x"), digest(F.col("y")).alias("y")
    )


@query(
    "F3",
    f"""WITH {fx.DEALT_SQL}, c AS (SELECT source, shard_id, seq, unnest(x) AS tok,
          generate_subscripts(x, 1) AS p FROM dealt),
        r AS (SELECT source, shard_id, seq, p,
          sum(CASE WHEN tok = 50256 THEN 1 ELSE 0 END) OVER (PARTITION BY source, shard_id, seq ORDER BY p)::BIGINT AS d FROM c)
        SELECT source, shard_id, seq, max(d) AS n_separators, md5(string_agg(d::VARCHAR, ' ' ORDER BY p)) AS digest
        FROM r GROUP BY ALL""",
)
def doc_ids_in_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = ops.with_document_ids(sequences(spark, sf_dir))
    return marked.select(
        "source",
        "shard_id",
        "seq",
        F.array_max("doc_ids").cast("bigint").alias("n_separators"),
        digest(F.col("doc_ids")).alias("digest"),
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = (F.col("rank") + F.col("shard_k") * N) * B + F.col("b")
    return ops.shift_labels(dealt(spark, sf_dir)).select("source", "shard_id", seq.alias("seq"), "x")


@query(
    "D3",
    f"""WITH {fx.DEALT_SQL}, c AS (SELECT source, shard_id, seq, unnest(x) AS tok,
          generate_subscripts(x, 1) - 1 AS p FROM dealt),
        r AS (SELECT source, shard_id, seq, p,
          sum(CASE WHEN tok = 50256 THEN 1 ELSE 0 END) OVER (PARTITION BY source, shard_id, seq ORDER BY p)::BIGINT AS doc FROM c)
        SELECT source, shard_id, seq, doc, min(p)::BIGINT AS first, max(p)::BIGINT AS last,
               sum(p - lo + 1)::BIGINT AS n_pairs
        FROM (SELECT *, min(p) OVER (PARTITION BY source, shard_id, seq, doc) AS lo FROM r) GROUP BY ALL""",
)
def same_doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ops.attention_runs(sequences(spark, sf_dir))
    return runs.select("source", "shard_id", "seq", *as_long("doc", "first", "last", "n_pairs"))


def train_mix(train: DataFrame) -> DataFrame:
    """One schedule as long as rank 0 has training batches."""
    heads = train.where("rank = 0 AND b = 0")
    weights = F.array(*[F.lit(w) for w in WEIGHTS.values()])
    return heads.agg(F.count("*").alias("n_picks")).withColumn("mix", F.lit("train")).withColumn("weights", weights)


def with_names(picks: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(name) for name in WEIGHTS])
    return picks.select("pick", F.get(names, F.col("source_no")).alias("source"), "ordinal")


def train_positions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(segments, numbered positions of the training batches, written)."""
    segments, found = positions(spark, sf_dir)
    return segments, materialize(ops.number_batches(found.where("split = 'train'")), "train-positions")


def placed_picks(picks: DataFrame, train: DataFrame) -> DataFrame:
    """Where each rank reads for every pick; a finite source wraps."""
    # One row per source and rank.
    have = train.groupBy("source", "rank").agg((F.max("k") + 1).alias("n_all"))
    wanted = picks.join(F.broadcast(have), "source").withColumn("ordinal", F.col("ordinal") % F.col("n_all")).drop("n_all")
    return ops.scheduled_batches(wanted, train.withColumnRenamed("k", "ordinal"), ["rank"])


def read_picks(placed: DataFrame, segments: DataFrame) -> DataFrame:
    """The batches themselves: tokens move once, at the end."""
    found = ops.shift_labels(ops.with_tokens(placed, segments, T))
    return found.select("pick", "source", *as_long("rank", "b"), "shard_id", digest(F.col("x")).alias("x"))


@query("F13", f"WITH RECURSIVE {NUMBERED_SQL}, {SCHEDULE_SQL} SELECT pick, source, ordinal FROM picks")
def mix_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = positions(spark, sf_dir)
    return with_names(ops.mix_schedule(train_mix(found.where("split = 'train'"))))


@query(
    "D4",
    f"""WITH RECURSIVE {NUMBERED_SQL}, {SCHEDULE_SQL},
        have AS (SELECT DISTINCT source, rank, n_all FROM numbered WHERE split = 'train')
        SELECT p.pick, p.source, h.rank::BIGINT AS rank, t.b::BIGINT AS b, t.shard_id, {fx.list_digest("t.x")} AS x
        FROM picks p JOIN have h USING (source)
        JOIN numbered t ON t.source = p.source AND t.rank = h.rank AND t.split = 'train' AND t.k = p.ordinal % h.n_all""",
)
def scheduled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rank follows the same schedule over its own batches; a finite source wraps."""
    segments, train = train_positions(spark, sf_dir)
    picks = with_names(ops.mix_schedule(train_mix(train)))
    return read_picks(placed_picks(picks, train), segments)


@query(
    "J2 (a mixed schedule, stopped and resumed)",
    f"""WITH RECURSIVE {NUMBERED_SQL}, {SCHEDULE_SQL},
        have AS (SELECT DISTINCT source, rank, n_all FROM numbered WHERE split = 'train')
        SELECT p.pick, p.source, h.rank::BIGINT AS rank, t.b::BIGINT AS b, t.shard_id, {fx.list_digest("t.x")} AS x
        FROM picks p JOIN have h USING (source)
        JOIN numbered t ON t.source = p.source AND t.rank = h.rank AND t.split = 'train' AND t.k = p.ordinal % h.n_all
        WHERE p.pick >= (SELECT n // 3 FROM n_train)""",
)
def resume_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule stops after a third of its picks and saves its cursor; the rest comes from the saved
    table, and opens only shards that it needs."""
    segments, train = train_positions(spark, sf_dir)
    mix = train_mix(train)
    whole = mix.first()["n_picks"]  # one number
    path = new_scratch_path(spark, "mixed-cursor")
    stopped = ops.mix_cursor(mix.withColumn("n_picks", F.lit(whole // 3)))
    ops.save_cursor(ops.mixed_cursor(stopped, train, list(WEIGHTS), B, T, N), path, whole // 3)
    rest = ops.resumed_schedule(ops.load_cursor(spark, path), whole - whole // 3, list(WEIGHTS))
    placed = materialize(placed_picks(rest, train), "resumed-positions")
    return read_picks(placed, ops.pruned_segments(segments, placed))


@query(
    "J2, M15",
    f"""WITH {NUMBERED_SQL} SELECT source, split, shard_id, rank::BIGINT AS rank, shard_k, b::BIGINT AS b
        FROM numbered WHERE k >= {READS} % n_all""",
)
def resume_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, batches = positions(spark, sf_dir)
    cursor = ops.loader_cursor(batches, B, T, N, READS)
    rest = ops.resume_after(batches, cursor, B, T, N)
    return rest.select(*PLACE, *as_long("rank", "shard_k", "b"))


@query(
    "D2",
    f"""WITH {fx.SEGMENTS_SQL}, have AS (SELECT source, split, count(DISTINCT shard_id) AS n FROM segs GROUP BY ALL),
        req(source, split, need) AS (VALUES ('base', 'train', 3), ('extra', 'val', 1), ('extra', 'train', 1000), ('absent', 'train', 1))
        SELECT source, split, need::BIGINT AS need, coalesce(n, 0) AS found, coalesce(n, 0) >= need AS ok
        FROM req LEFT JOIN have USING (source, split)""",
)
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = spark.createDataFrame(
        [("base", "train", 3), ("extra", "val", 1), ("extra", "train", 1000), ("absent", "train", 1)],
        "source string, split string, need bigint",
    )
    return quality.preflight(required, fx.char_manifest(spark, sf_dir))


@query(
    "I3",
    f"""WITH {fx.SEGMENTS_SQL}, w(source, weight) AS (VALUES ('base', 0.82::DOUBLE), ('extra', 0.18::DOUBLE), ('absent', 0.5::DOUBLE))
        SELECT source, weight, round(weight / sum(weight) OVER (), 6) AS share FROM w
        WHERE source IN (SELECT source FROM segs WHERE split = 'train')""",
)
def resolve_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame([*WEIGHTS.items(), ("absent", 0.5)], "source string, weight double")
    shares = quality.resolve_weights(weights, fx.char_manifest(spark, sf_dir), "train", allow_missing=True)
    return shares.select("source", "weight", F.round("share", 6).alias("share"))


@query(
    "I4",
    f"""WITH {fx.SEGMENTS_SQL}, real AS (SELECT DISTINCT source, split, shard_id FROM segs),
        planted AS (SELECT * FROM real UNION SELECT source, 'val', shard_id FROM real WHERE split = 'train' AND shard_id % 3 = 1)
        SELECT source, split, shard_id, (SELECT count(*) FROM planted t WHERE t.source = v.source
          AND t.shard_id = v.shard_id AND t.split <> 'val') AS n_overlaps
        FROM planted v WHERE split = 'val' AND source = 'base'""",
)
def val_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third training shard is planted in validation too, and must be found there."""
    shards = fx.char_shards(spark, sf_dir).select(*PLACE)
    planted = shards.where("split = 'train' AND shard_id % 3 = 1").withColumn("split", F.lit("val"))
    val, overlap = quality.val_isolation(shards.unionByName(planted), "base")
    clashes = overlap.groupBy("source", "shard_id").agg(F.count("*").alias("n_overlaps"))
    return val.join(clashes, ["source", "shard_id"], "left").select(
        *PLACE, F.coalesce("n_overlaps", F.lit(0)).alias("n_overlaps")
    )


@query(
    "I6",
    f"""WITH {fx.DEALT_SQL}, p AS (SELECT source, split, count(DISTINCT rank) * {B * T} AS per_step,
          count(DISTINCT rank) * {B * T} * 8 AS good, count(DISTINCT rank) * {B * T} * 8 + 1 AS bad
          FROM dealt GROUP BY ALL),
        t AS (SELECT source, split, per_step, unnest([good, bad]) AS total_batch FROM p)
        SELECT source, split, total_batch::BIGINT AS total_batch, total_batch % per_step = 0 AS divides,
          (CASE WHEN total_batch % per_step = 0 THEN total_batch // per_step END)::BIGINT AS accumulation FROM t""",
)
def check_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks come from the dealt batches; one total divides, one does not."""
    ranks = positions(spark, sf_dir)[1].groupBy("source", "split").agg(F.count_distinct("rank").alias("ranks"))
    good = F.col("ranks") * (B * T * 8)
    params = ranks.select(
        "source",
        "split",
        "ranks",
        F.lit(B).alias("B"),
        F.lit(T).alias("T"),
        F.explode(F.array(good, good + 1)).alias("total_batch"),
    )
    return quality.check_layout(params).select("source", "split", "total_batch", "divides", "accumulation")
